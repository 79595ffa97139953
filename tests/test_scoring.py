"""Scores by kind of answer against worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import scoring as S
from corpuswright.operators import judge as J
from corpuswright.operators import reports as P
from corpuswright.operators import rows as R

lit = F.lit


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[lit(x) for x in v])


def test_choices(spark):
    options = {"A": lit("red"), "B": lit("blue")}
    assert one(spark, S.single_choice(lit("I think (B) not A."), options)) == "B"
    assert one(spark, S.single_choice(lit("It is red"), options)) == "A" and one(spark, S.single_choice(lit("none"), options)) is None
    assert one(spark, S.order_answer(lit("C, A, B, D"))) == "CABD" and one(spark, S.order_answer(lit("AABD"))) is None
    assert one(spark, S.true_false(lit("It is True."))) == "T" and one(spark, S.true_false(lit("true or false"))) is None


@pytest.mark.parametrize("text,want", [("two hundred and five", 205), ("three thousand forty-two", 3042), ("seventeen", 17), ("12", 12), ("many", None), ("hundred", 100), ("", None)])
def test_words_to_number(spark, text, want):
    assert one(spark, S.words_to_number(lit(text))) == want


def test_typed(spark):
    t = lambda p, a, k: one(spark, S.typed_score(lit(p), lit(a), lit(k)))
    assert t("5", "5", "Int") == 1.0 and t("5", "6", "Int") == 0.0 and t("50%", "0.5", "Float") == 1.0 and t("Paris (France)", "paris", "Str") == 1.0
    assert t("[b, a]", "[a, b]", "List") == 1.0 and t("[a]", "[a, b]", "List") == 0.0
    assert one(spark, S.ocr_score(lit("the Total is 5"), arr("total", "x"))) == 1.0 and one(spark, S.ocr_score(lit("zzz"), arr("total"))) == 0.0
    assert one(spark, S.counting_score(lit("about 9 cats"), lit("10"))) == pytest.approx(0.9) and one(spark, S.counting_score(lit("2"), lit("10"))) == 0.0


def test_lists_and_maps(spark):
    assert one(spark, S.list_cell(lit("['a', 'b']"))) == ["a", "b"] and one(spark, S.list_cell(lit("a"))) == ["a"]
    fields = F.create_map(lit("Chief Complaint:"), lit("pain"), lit("Age"), lit("9"))
    assert one(spark, S.field_by_keyword(fields, "complaint")) == "pain" and one(spark, S.field_by_keyword(fields, "none")) is None
    assert one(spark, S.fenced_lists(lit("```json\n[1]\n``` and ```json\n[2]\n```"))) == ["[1]", "[2]"] and one(spark, S.fenced_lists(lit("```json\n[1]\n```"))) is None
    assert one(spark, S.pairs_to_json(["a", "b"], [lit("x"), lit(" ")])) == '{"a":"x"}'
    row = spark.createDataFrame([("x", None, "z")], "A string, B string, C string").select(S.options_map(["A", "B", "C"]).alias("m")).first()
    assert row["m"] == {"A": "x", "C": "z"}


def test_points_and_boxes(spark):
    pt = lambda x, y: F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y"))
    assert one(spark, S.keypoint_score(F.array(pt(0, 0)), F.array(pt(0, 0)))) == 1.0 and one(spark, S.keypoint_score(F.array(pt(0, 0)), F.array(pt(0, 0), pt(1, 1)))) == 0.0
    assert one(spark, S.keypoint_score(F.array(pt(0, 0)), F.array(pt(0.1, 0)))) == pytest.approx(math.exp(-1 / math.sqrt(2)))
    two = F.array(arr(0.0, 0.0, 2.0, 2.0), arr(5.0, 5.0, 6.0, 6.0))
    assert one(spark, S.box_list_score(two, F.array(arr(0.0, 0.0, 2.0, 2.0)))) == 0.5 and one(spark, S.box_sequence_score(two, two)) == 1.0
    assert one(spark, S.point_in_boxes(lit("<point>1, 1</point>"), two)) and not one(spark, S.point_in_boxes(lit("<point>3,3</point>"), two)) and not one(spark, S.point_in_boxes(lit("x"), two))
    assert one(spark, S.masked_rmse(arr(1.0, 2.0), arr(1.0, 2.0))) == 1.0 and one(spark, S.masked_rmse(arr(0.0), arr(20.0))) == 0.0
    assert one(spark, S.positive_int(lit(0), lit(-1))) == -1.0 and one(spark, S.positive_int(lit(3), lit(3))) == 1.0
    assert one(spark, S.token_accuracy(arr(1, 2, 3, 4), arr(-100, 1, 9, 3))) == pytest.approx(2 / 3)


def test_registries(spark):
    for name, p, a in (("exact", "x", "x"), ("exact_lower", "X", "x"), ("simple", "a-b.", "A B"), ("option", "(A)", "A"), ("code", "```py\n1\n```", "1"), ("anls", "a", "a"), ("bag_f1", "a b", "b a"), ("relaxed", "101", "100"), ("line_set", "a\nb", "B\na"), ("comma_set", "a, b", "b,a"), ("jaccard", "a b", "b a"), ("jaccard_lower", "A b", "B a")):
        assert one(spark, S.score_by(lit(name), lit(p), lit(a))) == 1.0, name
    assert one(spark, S.score_by(lit("none"), lit("x"), lit("x"))) is None
    text = lit("Now 1.25 and 2.50.\n\nDone now.")
    for name, x, want in (("begins_with", "Now", True), ("ends_with", "now.", True), ("most_words", 3, False), ("least_words", 5, True), ("paragraphs", 2, True), ("sentences", 2, True), ("contains", "DONE", True), ("decimals", 2, True)):
        assert one(spark, S.CONSTRAINTS[name](text, x)) is want, name


def test_judge_retries(spark):
    def bad(prompt, attempt):
        if attempt < 2:
            raise RuntimeError("busy")
        return "score: 0.5"

    rows = spark.createDataFrame([(1, "x")], "k long, t string")
    got = J.judged(rows, F.col("t"), bad).first()
    assert got["score"] == 0.5 and got["log"].count("busy") == 2
    assert J.judged(rows, F.col("t"), lambda p, k: "nothing", tries=2).first()["score"] == 0.0


def test_reports(spark):
    rows = spark.createDataFrame([("Caries", 1), ("Caries,Bone", 0), (None, 1)], "c string, s int")
    got = {r.category: (r.total, r.acc) for r in P.overlapping_report(rows, "c", "s", ["Caries", "Bone"]).collect()}
    assert got["Caries"] == (2, 50.0) and got["Bone"] == (1, 0.0)
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (3, 0)], "k long, hit int")
    r = P.all_right(pairs, ["k"], "hit", least=2).first()
    assert r["group_acc"] == pytest.approx(1 / 3) and r["row_acc"] == 0.8


def test_rows(spark):
    assert one(spark, R.pack_paragraphs(arr("aa", "bb", "cccccc"), 6)) == ["aa\n\nbb", "cccccc"]
    assert one(spark, R.split_at_middle(lit("ab\ncd\nef"))) == ["ab", "cd\nef"] and one(spark, R.split_at_middle(lit("abcd"))) == ["ab", "cd"]
    assert one(spark, R.rescale_boxes(lit("a<box>[1,2,3,4]</box>b"), lit(2.0), lit(0.5))) == "a<box>[2,1,6,2]</box>b"
    assert one(spark, R.segments(lit("a\n---\n\n----\nb"))) == ["a", "b"]


def test_more_rows(spark):
    got = one(spark, R.budget_turns(F.array(F.struct(lit(4).alias("source"), lit(2).alias("target")), F.struct(lit(4).alias("source"), lit(4).alias("target"))), 10))
    assert [(t["source"], t["target"]) for t in got] == [(4, 2), (2, 2)]
    assert one(spark, R.case_sections(lit("x\n# CASE 1\na\n# Reference\nz\n# CASE 2\nb"))) == ["# CASE 1\na", "# CASE 2\nb"]
    turns = F.array(*[F.struct(lit(r).alias("role"), lit(c).alias("content")) for r, c in (("user", "q"), ("assistant", "<think>x</think>a"), ("user", "q"), ("assistant", "<think>y</think>b"))])
    assert [t["content"] for t in one(spark, R.without_history_thoughts(turns))] == ["q", "a", "q", "<think>y</think>b"]
    rows = spark.createDataFrame([("Overall",), ("z",), ("b",), ("a",)], "name string")
    assert [r.name for r in R.reports_in_order(rows, "name", ["b"]).collect()] == ["b", "a", "z", "Overall"]
    lesions = F.create_map(lit("x"), F.struct(arr(1.0).alias("bbox"), lit(0.5).alias("score"), lit("m").alias("mask")), lit("y"), F.struct(lit(None).cast("array<double>").alias("bbox"), lit(0.5).alias("score"), lit("m").alias("mask")))
    assert list(one(spark, R.prune_map(lesions))) == ["x"]


def test_phrases_and_boxed(spark):
    assert one(spark, S.any_phrase(lit("a Red car"), arr("red", "x"))) and not one(spark, S.any_phrase(lit("a"), arr("red")))
    assert one(spark, S.boxed(lit(r"so \boxed{\frac{1}{2}} x"))) == r"\frac{1}{2}" and one(spark, S.general_numeric(lit(r"\boxed{3.001}"), lit("3"))) and not one(spark, S.general_numeric(lit("4"), lit("3")))
    boxes = lambda *v: F.create_map(*[x for k, b in v for x in (lit(k), arr(*b))])
    assert one(spark, S.map_box_score(boxes(("a", (0.0, 0.0, 1.0, 1.0))), boxes(("a", (0.0, 0.0, 1.0, 1.0)), ("b", (0.0, 0.0, 1.0, 1.0))))) == 0.5
    assert one(spark, F.size(S.box_guard(F.array(arr(1.0, 2.0, 3.0, 4.0), arr(1.0))))) == 1
    assert one(spark, S.letter_or_text_match(lit("It is the tooth"), lit("A.  tooth"))) and one(spark, S.letter_or_text_match(lit("B x"), lit("B.  y")))


def test_tagged_calls_and_templates(spark):
    from corpuswright.functions import conversation as C

    text = lit('<function=get_weather>\n<parameter=city>\nParis "x"\n</parameter>\n<parameter=days>3</parameter></function>')
    (call,) = one(spark, C.tagged_calls(text))
    import json

    assert call["name"] == "get_weather" and json.loads(call["arguments"]) == {"city": 'Paris "x"', "days": 3}
    tools = F.array(F.struct(lit("f").alias("name"), lit("does").alias("description"), F.create_map(lit("a"), F.struct(lit("int").alias("type"), lit("size").alias("description"))).alias("params")))
    assert one(spark, C.tool_text(tools)) == "> Tool Name: f\nTool Description: does\nTool Args:\n  - a (int): size"
    turns = F.array(*[F.struct(lit(r).alias("role"), lit(c).alias("content")) for r, c in (("user", "hi"), ("assistant", "yo"))])
    assert one(spark, C.render_with("chatml", turns, lit("sys"))) == "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    with pytest.raises(ValueError):
        C.register_template("plain", {})


@pytest.mark.parametrize("text,word,plain,every", [("Apples all\nBees buzz", "ab", True, True), ("apples do\nbees", "ab", True, False), ("apples", "ab", False, False), ("a\n\nb", "a b", True, True), ("a\nx\nb", "a b", False, False), ("**A**ll\nb", "ab", True, True)])
def test_acrostic(spark, text, word, plain, every):
    assert one(spark, S.acrostic(lit(text), word)) is plain and one(spark, S.acrostic(lit(text), word, every_word=True)) is every


def test_phrase_constraints(spark):
    text = lit("The cat sits. A concatenated dog (and a Cat) runs! No more?")
    for name, x, want in (("contains_any", ["bird", "dog"], True), ("contains_times", (["cat"], 2), True), ("contains_one_group", [["cat", "dog"], ["bird"]], True), ("contains_one_group", [["cat"], ["dog"]], False), ("in_sentence", (["cat"], 2), True), ("only_in_sentence", (["dog"], 2), True), ("only_in_sentence", (["cat"], 2), False), ("fewer_words", 13, True), ("more_words", 12, False)):
        assert one(spark, S.CONSTRAINTS[name](text, x)) is want, name
