"""Column functions and plain metrics against their definitions."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import answers as A
from corpuswright.functions import conversation as C
from corpuswright.functions import geometry as G
from corpuswright.functions import metrics as M
from corpuswright.functions.binding import runs_of
from corpuswright.operators import mixing as X
from corpuswright.operators import ordering as O
from corpuswright.operators import rows as R
from corpuswright.operators import spatial as S
from corpuswright.plans import catalogue
from corpuswright.sources import files, registry
from corpuswright.streaming import jobs


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("case", [((3000, 2000, 1000), (600, 400)), ((2000, 3000, 1000), (400, 600)), ((1000, 100, 1000), (900, 100)), ((100, 1000, 1000), (100, 900)), ((100, 500, 1000), (100, 500)), ((500, 100, 1000), (500, 100)), ((10, 10, 1000), (10, 10))])
def test_sequence_budget(spark, case):
    (source, target, cutoff), want = case
    a, b = O.sequence_budget(F.lit(source), F.lit(target), cutoff)
    assert (one(spark, a), one(spark, b)) == want


@pytest.mark.parametrize("text,want", [("The answer is B.", "B"), ("A or B", None), ("B", "B"), ("B is one of the many things that could be said", None), ("nothing", None), ("(C)", "C"), ("Cannot determine the answer", "Z"), ("Failed to obtain answer via API. A", None)])
def test_choice_letter(spark, text, want):
    assert one(spark, A.choice_letter(F.lit(text))) == want


def test_answers(spark):
    lit = F.lit
    assert one(spark, A.letter_set(lit("b, A and a"))) == "ABDN"
    assert one(spark, A.yes_no(lit("Yes, it is."))) == "Yes" and one(spark, A.yes_no(lit("yes and no"))) == "Unknown"
    assert one(spark, A.number_word(lit("there are three or 4"))) == 3 and one(spark, A.number_word(lit("none"))) is None
    assert one(spark, A.as_number(lit("12%"))) == 0.12 and one(spark, A.relaxed_match(lit("104"), lit("100"))) and not one(spark, A.relaxed_match(lit("106"), lit("100")))
    assert one(spark, A.relaxed_match(lit("Zero"), lit("zero"))) and not one(spark, A.relaxed_match(lit("0.0"), lit("0")))
    assert one(spark, A.vqa_normal(lit("The two Dogs, a cat"))) == "2 dogs cat"
    assert math.isclose(one(spark, A.vqa_score(lit("x"), F.array(*map(lit, "xxxxyyyyyy")))), (4 * 1 + 6 * 1) / 10)
    assert one(spark, A.anls(lit("hello"), lit("Hello "))) == 1.0 and one(spark, A.anls(lit("abc"), lit("xyz"))) == 0.0
    assert one(spark, A.option_exact(lit("(B)"), lit("B"))) and not one(spark, A.option_exact(lit("BC"), lit("B")))
    assert one(spark, A.reciprocal_rank(F.array(lit("x"), lit("dog")), lit("a Dog"))) == 0.5
    assert one(spark, A.after_thinking(lit("<think>a</think> b "))) == "b" and one(spark, A.thinking(lit("<think> a </think>b"))) == "a"
    assert one(spark, A.json_payload(lit('```json\n{"a": [1]}\n```'))) == '{"a": [1]}' and one(spark, A.json_payload(lit("x [1, 2] y"))) == "[1, 2]"
    assert one(spark, A.code_block(lit("x\n```python\nprint(1)\n```"))) == "print(1)" and one(spark, A.tag_body(lit("<a>\nb</a><a>c</a>"), "a")) == "\nb"
    assert one(spark, A.float_equal(lit(50.0), lit(0.5))) and not one(spark, A.float_equal(lit(40.0), lit(0.5)))
    assert one(spark, A.prefix_ratio(F.array(lit(1), lit(2), lit(9)), F.array(lit(1), lit(2), lit(3)))) == pytest.approx(2 / 3)
    assert one(spark, A.sequence_accuracy(F.array(lit(1)), F.array(lit(1), lit(2)))) == 0.0


def test_conversation(spark):
    roles = F.array(*map(F.lit, ["user", "assistant", "assistant", "user", "user"]))
    assert one(spark, C.round_numbers(roles)) == [1, 1, 2, 2, 3]
    assert one(spark, C.packed_segments(F.array(F.lit(2), F.lit(1)), 5)) == [1, 1, 2, 0, 0]
    mask = one(spark, C.block_mask(F.array(*map(F.lit, [1, 1, 2, 2, 2, 0]))))
    assert mask == [[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0]]
    calls = one(spark, C.action_calls(F.lit('Action: tool_name\nAction Input: {"foo": "bar", "size": 10}\n')))
    assert [(c["name"], c["arguments"]) for c in calls] == [("tool_name", '{"foo": "bar", "size": 10}')]
    tagged = one(spark, C.tool_calls(C.call_text(F.array(F.struct(F.lit("f").alias("name"), F.lit('{"a":1}').alias("arguments"))))))
    assert [(c["name"], c["arguments"]) for c in tagged] == [("f", '{"a":1}')]
    assert one(spark, C.expand_placeholders(F.lit("<image>a<image>"), F.array(F.lit(2)))) == "<s><p><p></s>a<image>"
    ids, mask_, labels = C.labelled(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    assert (one(spark, ids), one(spark, mask_), one(spark, labels)) == ([1, 2, 3], [1, 1, 1], [-100, -100, 3])
    history = F.array(F.array(F.lit("q"), F.lit("a")))
    turns = one(spark, C.instruction_turns(F.lit("Solve the math problem."), F.lit("3 + 4"), history))
    assert [(t["role"], t["content"]) for t in turns] == [("user", "q"), ("assistant", "a"), ("user", "Solve the math problem.\n3 + 4")]


def test_repair_alternation(spark):
    rows = [(1, k, r) for k, r in enumerate(["assistant", "user", "user", "tool", "assistant", "assistant", "user"])]
    got = C.repair_alternation(spark.createDataFrame(rows, "conv_id long, turn long, role string")).collect()
    assert sorted(r.turn for r in got) == [1, 4]


def test_geometry(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, G.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7) and one(spark, G.iou(b(0, 0, 1, 1), b(1, 1, 2, 2))) == 0.0 and one(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert one(spark, G.interval_iou(*map(F.lit, (0, 10, 5, 15)))) == pytest.approx(1 / 3) and one(spark, G.interval_hull_iou(*map(F.lit, (0, 1, 9, 10)))) == 0.0
    assert one(spark, G.point_distance_score(*map(F.lit, (0.5, 0.5, 0.5, 0.5)))) == 1.0 and one(spark, G.point_distance_score(*map(F.lit, (1.5, 0.5, 0.5, 0.5)))) == 0.0


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(0)
    rows = []
    for k in range(120):
        x, y = rng.uniform(-50, 200), rng.uniform(-50, 200)
        rows.append((1, k, x, y, x + rng.uniform(1, 90), y + rng.uniform(1, 90)))
    df = spark.createDataFrame(rows, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.l_det_id, r.r_det_id) for r in S.overlap_pairs(df, df, ["image_id"]).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    assert got == want


def test_hungarian():
    from itertools import permutations

    rng = random.Random(1)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5)):
        cost = [[rng.randint(0, 20) for _ in range(m)] for _ in range(n)]
        got = S.hungarian(cost)
        small, big = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum(cost[i][j] if n <= m else cost[j][i] for i, j in zip(small, p)) for p in permutations(big, len(small)))
        assert sum(cost[i][j] for i, j in got) == best and len(got) == min(n, m)


def test_metrics():
    assert M.lcs("ABCBDAB", "BDCABA") == 4 and M.rouge_n("a b c".split(), "a b d".split(), 2) == 0.5
    assert M.bleu(M.clipped("a b c d e".split(), "a b c d e".split()), 5, 5) == 1.0
    assert M.transposition_distance("ca", "ac") == 1 and M.transposition_distance("kitten", "sitting") == 3
    assert M.near_string("the cat", "cat") == 1.0 and M.near_string("cat", "dog") == 0.0
    assert M.tree_similarity("<a><b>x</b></a>", "<a><b>x</b></a>") == 1.0
    assert M.tree_distance(("a", (("b", ()), ("c", ()))), ("a", (("c", ()),))) == 1
    assert M.dedent("  a\r\n   b\n") == "a\n b"


def test_allocation():
    assert O.allocate({"a": 10, "b": 10}, 0.25) == {"a": 3, "b": 2} or sum(O.allocate({"a": 10, "b": 10}, 0.25).values()) == 5
    assert sum(O.allocate({"a": 3, "b": 7, "c": 1}, 0.5).values()) == 5


def test_sample_exact(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert O.sample_exact(rows, "k", 4).count() == 4 and O.sample_exact(rows, "k", 25).count() == 25 and O.sample_exact(rows.limit(0), "k", 5).count() == 0


def test_knapsack(spark):
    rows = spark.createDataFrame([(0, k, n) for k, n in enumerate([5, 3, 7, 2, 9, 20])], "g long, k long, n long")
    packs = {}
    for r in O.knapsack_pack(rows, "g", "k", "n", 10).collect():
        packs.setdefault(r.pack, []).append(r.n)
    assert sorted(map(sorted, packs.values())) == [[2, 5], [3, 7], [9]]


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.load_specs({}, ["x"])
    with pytest.raises(ValueError):
        registry.load_specs({"x": {"formatting": "alpaca"}})
    (spec,) = registry.load_specs({"x": {"file": "a.json", "table": "t", "columns": {"prompt": "q"}}})
    assert (spec.kind, spec.location) == ("table", "t") and spec.column("prompt") == "q" and spec.column("response") is None
    rows = registry.to_canonical(spark.createDataFrame([("hi",)], "q string"), spec).first()
    assert rows["prompt"] == "hi" and rows["response"] is None and rows["tools"] is None
    registry.register_converter("one", lambda d, s: d)
    with pytest.raises(ValueError):
        registry.register_converter("one", lambda d, s: d)


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, ["a.csv", "b.json"])
    with pytest.raises(ValueError):
        files.kind_of("x.pkl")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert {r.a for r in files.read(spark, str(tmp_path / "a.jsonl")).collect()} == {"1", "2"}
    (tmp_path / "b.json").write_text('[{"a": "x\\ny"}]')
    assert files.read(spark, str(tmp_path / "b.json")).first()["a"] == "x\ny"
    assert files.listing(spark, str(tmp_path), include=[".json"], exclude=["jsonl"]).count() == 1
    turns = one(spark, files.transcript_turns(F.lit("\n\nHuman: hi\n\nAssistant: hello\n\nHuman: bye")))
    assert [t["role"] for t in turns] == ["user", "assistant", "user"]
    kv = one(spark, files.key_value(F.array(F.lit(" Name "), F.lit(""), F.lit(": Bob  B"))))
    assert (kv["key"], kv["value"]) == ("Name", "Bob B")


def test_stream_arguments():
    with pytest.raises(ValueError):
        jobs.check_arguments(val_size=0.1)
    with pytest.raises(ValueError):
        jobs.check_arguments(max_samples=5)
    with pytest.raises(ValueError):
        jobs.check_arguments(mask_history=True, train_on_prompt=True)
    with pytest.raises(ValueError):
        jobs.check_arguments(probabilities=[0.5], sources=2)


LONG = 50_000


def timed(df, limit=60):
    began = time.time()
    got = df.collect()
    assert time.time() - began < limit
    return got


def test_long_texts_take_linear_time(spark):
    """One text of 50,000 words through each expression that names an array more than once."""
    words = [f"w{k % 30_000}" for k in range(LONG)]
    text, other = " ".join(words), " ".join(f"w{k}" for k in range(20_000, 20_000 + LONG))
    row = spark.createDataFrame([(1, text, other)], "id long, a string, b string")
    common = set(words) & set(other.split())
    p, r = sum(w in common for w in words) / LONG, sum(w in common for w in other.split()) / LONG
    (got,) = timed(row.select(A.bag_f1(F.col("a"), F.col("b")).alias("f")))
    assert abs(got.f - 2 * p * r / (p + r)) < 1e-12
    assert len(timed(row.select(F.explode(runs_of(A.words(F.col("a")), 5))))) == LONG - 4
    assert len(timed(M.cider_terms(row, "id", F.col("a"), 2))) == 30_000
    lines = "\n".join(words)
    (got,) = timed(spark.createDataFrame([(lines,)], "t string").select(R.split_at_middle(F.col("t")).alias("s")))
    n, places = len(lines), [k + 1 for k, c in enumerate(lines) if c == "\n"]
    at = min(places, key=lambda i: (abs(2 * i - n), i))
    assert got.s == [lines[: at - 1], lines[at:]]
    caption = " ".join(f"Name {'abcdefghij'[k % 10]}{'xyz'[k % 3]}: [{k}]" for k in range(LONG))
    (got,) = timed(spark.createDataFrame([(caption,)], "t string").select(R.caption_sections(F.col("t")).alias("m")))
    assert len(got.m) == 30 and got.m["Name ax"] == f"[{max(k for k in range(LONG) if k % 10 == 0 and k % 3 == 0)}]"


@pytest.mark.parametrize("text", ["", "a", "\n", "ab\ncd", "a\nbcdef\ng", "abcdef", "a\n\n\nb", "\nabc", "abc\n"])
def test_split_at_middle(spark, text):
    (got,) = spark.createDataFrame([(text,)], "t string").select(R.split_at_middle(F.col("t")).alias("s")).collect()
    places = [k + 1 for k, c in enumerate(text) if c == "\n"]
    if places:
        at = min(places, key=lambda i: (abs(2 * i - len(text)), i))
        assert got.s == [text[: at - 1], text[at:]]
    else:
        assert got.s == [text[: len(text) // 2], text[len(text) // 2 :]]


def test_prefix_sums_of_any_group(spark):
    """Running sums within groups that span many partitions, null groups included, and no window
    that lacks a partition."""
    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('g', id % 50) end g", "id % 11 v", "1 __at")
    got = O.prefix(rows.repartition(5), ["id"], ["g"], F.col("v"), "before", "total")
    assert got.columns == [*rows.columns, "before", "total"]
    sums = {}
    for r in sorted(got.collect(), key=lambda r: r.id):
        assert r.before == sums.get(r.g, 0)
        sums[r.g] = r.before + r.v
    assert {r.g: r.total for r in got.collect()} == sums
    ranks = O.rank_all(rows, ["v", "id"], "k")
    assert [(r.v, r.id) for r in sorted(ranks.collect(), key=lambda r: r.k)] == sorted((r.v, r.id) for r in rows.collect())
    assert sorted(r.k for r in ranks.collect()) == list(range(4000))
    assert O.rank_all(rows.limit(0), ["id"]).collect() == []
    for name in ("hash_shuffle", "shard_ntile", "mix_interleave", "fraction_split", "uid_deduplication", "block_packing", "composite_benchmark", "append_to_table"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_best_run_is_the_best(spark):
    """Against every run by the plain ratio."""
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for _ in range(60):
        hay = [rng.choice("ab cd ef gh ij klm".split()) for _ in range(12)]
        needle = " ".join(rng.choice("ab cd ef gh xy".split()) for _ in range(3))
        runs = [" ".join(hay[i : i + 3]) for i in range(10) if set(hay[i : i + 3]) & set(needle.split())]
        want = max((SequenceMatcher(None, r, needle).ratio() for r in runs), default=0.0)
        got = M.best_run(needle, " ".join(hay))
        assert got[1] == pytest.approx(want) and (not runs or got[0] in runs)
    assert M.best_run("a b", "c d e") == ("", 0.0, 0.0, 0.0, 0.0, 0.0, False)


def test_gleu_and_objects():
    assert M.gleu("a b c".split(), "a b c".split()) == 1.0 and M.gleu([], []) == 0.0
    assert M.gleu("a b".split(), "a c".split()) == pytest.approx(1 / 3)
    assert M.json_objects('x {"a": {"b": 1}} {bad} {"c": "é"}') == ['{"a": {"b": 1}}', '{"c": "é"}'] and M.json_objects("none") == []


def test_mixing_edges(spark):
    a, b = spark.range(5).selectExpr("id k", "'a' s"), spark.range(0).selectExpr("id k", "'b' s")
    assert X.interleave_by_probability([a, b], "k", [0.5, 0.5]).collect() == []
    got = X.interleave_by_probability([a, b], "k", [0.5, 0.5], stop="all").collect()
    assert sorted(r.k for r in got) == [0, 1, 2, 3, 4] and {r.source for r in got} == {0}
    with pytest.raises(ValueError):
        X.interleave_by_probability([a, b], "k", [1.0, 0.0])


def test_registry_tags_and_folders(spark, tmp_path):
    one, two = registry.load_specs({"a": {"file": "x.json", "tags": {"role_tag": "role"}}, "b": {"file": "y.json"}})
    assert (one.tag("role_tag"), one.tag("content_tag"), two.tag("content_tag")) == ("role", None, "value")
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.json").write_text("[]")
    (folder / "b.csv").write_text("x\n1\n")
    (spec,) = registry.load_specs({"m": {"file": str(folder)}})
    with pytest.raises(ValueError):
        registry.scan(spark, spec)


def test_streams_over_many_batches(spark, tmp_path):
    """Numbers, upserts and logs go on from batch to batch, and merged upserts keep the latest."""
    for k in range(7):
        rows = [(k * 10 + i, i, "a" if i % 3 else "b") for i in range(10)]
        spark.createDataFrame(rows, "id long, key long, s string").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    schema = "id long, key long, s string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    at = lambda name: str(tmp_path / name)
    got = jobs.number_batches(stream(), ["id"], ["s"], at("n"), at("cn")).collect()
    assert len(got) == 70
    for s in "ab":
        own = sorted(r.turn for r in got if r.s == s)
        assert own == list(range(len(own)))
    split = jobs.take_and_skip(stream(), "id", 15, at("t"), at("ct")).collect()
    assert sum(r.split == "validation" for r in split) == 15 and len(split) == 70
    for every in (2, 100):
        last = jobs.upsert_batches(stream(), at(f"u{every}"), "key", at(f"cu{every}"), "id", merge_every=every)
        assert sorted((r.key, r.id) for r in last.collect()) == [(i, 60 + i) for i in range(10)]
    log = jobs.batch_metrics(stream(), {"mean": F.avg("id")}, at("l"), at("cl")).collect()
    assert sorted(r.batch for r in log) == [0, 1, 2, 3] and sum(r.rows for r in log) == 70
    counts = jobs.run_to_snapshot(stream().groupBy("s").agg(F.count("*").alias("n")), at("s"), at("cs"))
    assert {r.s: r.n for r in counts.collect()} == {"a": 42, "b": 28}


def test_artifact_paths():
    assert files.artifact_path("out/m_set.xlsx", "_rating") == "out/m_set_rating.json" and files.artifact_path("out/m_set.xlsx", "_tmp") == "out/m_set_tmp.pkl"
    assert files.artifact_path("a.tsv", "_acc") == "a_acc.csv" and files.artifact_path("a.tsv", "_new") == "a_new.xlsx" and files.artifact_path("a.tsv", "_new", "json") == "a_new.json"


@pytest.mark.parametrize("payload", ["no json", "[]", '{"other": 1}', '{"items": []}', None])
def test_payloads_without_pairs(spark, payload):
    (got,) = spark.createDataFrame([(payload,)], "p string").select(A.validated_pairs(F.col("p"), {1: "q"}).alias("v")).collect()
    assert got.v is None


def test_record_accuracy():
    assert M.record_accuracy('{"a": 1, "b": ["x", "y"]}', '{"b": ["x", "y"], "a": "1"}') == 1.0
    assert M.record_accuracy("no json", '{"a": "xy"}') == 0.0 and M.record_accuracy('{"a": "xz"}', '{"a": "xy"}') == pytest.approx(1 - 1 / 3)
    menu = '{"menu": [{"name": "cake", "n": 2}, {"name": "juice", "n": 1}]}'
    assert M.record_accuracy(menu, menu) == 1.0 and 0 < M.record_accuracy('{"menu": [{"name": "cake", "n": 2}]}', menu) < 1
    assert math.isnan(M.record_accuracy("{}", "{}"))
    plain = lambda x, y: M.tree_distance(x, y)
    assert plain(("r", (("a", ()), ("b", ()))), ("r", (("a", ()),))) == 1 and plain(("r", ()), ("s", (("a", ()),))) == 2
