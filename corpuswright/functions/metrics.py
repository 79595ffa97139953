"""Text metrics that need loops: ROUGE, BLEU, tree and transposition distances.

They are given as pandas UDFs over Arrow batches and as plain functions, so that the tests can
hold them to their definitions.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.binding import runs_of


def ngrams(tokens: Sequence, n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f1(matched: float, predicted: float, wanted: float) -> float:
    return 2 * matched / (predicted + wanted) if matched else 0.0


def rouge_n(prediction: Sequence, answer: Sequence, n: int) -> float:
    p, a = ngrams(prediction, n), ngrams(answer, n)
    return f1((p & a).total(), p.total(), a.total())


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, by bit rows: each bit is a place of a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for y in b:
        hit = row | where.get(y, 0)
        row = hit & ~(hit - ((row << 1) | 1)) & full
    return row.bit_count()


def rouge_l(prediction: Sequence, answer: Sequence) -> float:
    return f1(lcs(prediction, answer), len(prediction), len(answer))


def clipped(prediction: Sequence, answer: Sequence, top: int = 4) -> list[tuple[int, int]]:
    """(matched, predicted) n-grams for n = 1 .. top."""
    return [((ngrams(prediction, n) & ngrams(answer, n)).total(), max(0, len(prediction) - n + 1)) for n in range(1, top + 1)]


def bleu(counts: Sequence[tuple[int, int]], predicted: int, wanted: int, smooth: bool = True) -> float:
    """BLEU from clipped counts; with smoothing the k-th empty precision counts as 1 / 2**k
    matches, without it makes the score 0."""
    total, k = 0.0, 0
    for matched, n in counts:
        if n == 0 or (matched == 0 and not smooth):
            return 0.0
        if matched == 0:
            k += 1
            total += math.log(1 / (2**k * n))
        else:
            total += math.log(matched / n)
    brevity = 1.0 if predicted > wanted else math.exp(1 - wanted / predicted) if predicted else 0.0
    return brevity * math.exp(total / len(counts)) if counts[0][0] else 0.0


def transposition_distance(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours costs one (optimal string alignment)."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            now.append(best)
        two, one = one, now
    return one[-1]


def near_string(prediction: str, answer: str, least: float = 0.9) -> float:
    """Similarity of lower-case texts without articles; 0 below the threshold."""
    norm = lambda s: " ".join(w for w in s.lower().split() if w not in ("a", "an", "the"))
    p, a = norm(prediction), norm(answer)
    longest = max(len(p), len(a))
    sim = 1 - transposition_distance(p, a) / longest if longest else 1.0
    return sim if sim >= least else 0.0


def tree_distance(a: tuple, b: tuple, edge: Callable = lambda x: 1, change: Callable = lambda x, y: int(x != y)) -> int:
    """Edit distance of ordered trees (label, (children...)): adding or taking out a node costs
    `edge` of its label, renaming it `change` of both; by default each edit costs one."""

    def flat(t, labels, left, leaf):
        first = None
        for c in t[1]:
            got = flat(c, labels, left, leaf)
            first = got if first is None else first
        labels.append(t[0])
        left.append(len(labels) - 1 if first is None else first)
        return left[-1]

    la, xa, lb, xb = [], [], [], []
    flat(a, la, xa, None)
    flat(b, lb, xb, None)
    roots = lambda x: sorted({v: i for i, v in enumerate(x)}.values())
    dist = [[0] * len(lb) for _ in la]
    for i in roots(xa):
        for j in roots(xb):
            fi, fj = xa[i], xb[j]
            d = [[0] * (j - fj + 2) for _ in range(i - fi + 2)]
            for x in range(1, i - fi + 2):
                d[x][0] = d[x - 1][0] + edge(la[fi + x - 1])
            for y in range(1, j - fj + 2):
                d[0][y] = d[0][y - 1] + edge(lb[fj + y - 1])
            for x in range(fi, i + 1):
                for y in range(fj, j + 1):
                    u, v = x - fi + 1, y - fj + 1
                    edit = min(d[u - 1][v] + edge(la[x]), d[u][v - 1] + edge(lb[y]))
                    if xa[x] == fi and xb[y] == fj:
                        d[u][v] = min(edit, d[u - 1][v - 1] + change(la[x], lb[y]))
                        dist[x][y] = d[u][v]
                    else:
                        d[u][v] = min(edit, d[xa[x] - fi][xb[y] - fj] + dist[x][y])
    return dist[-1][-1]


def html_tree(html: str, marked: bool = False) -> tuple:
    """(label, children) of the tags of a fragment; text counts as a leaf. With `marked`, a third
    entry says whether the node is a tag."""
    root: list = ["root", [], True]
    stack = [root]
    for close, name, text in re.findall(r"<(/?)([a-zA-Z0-9]+)[^>]*>|([^<]+)", html):  # noqa: B007
        if text.strip():
            stack[-1][1].append([text.strip(), [], False])
        elif name and not close:
            node = [name.lower(), [], True]
            stack[-1][1].append(node)
            stack.append(node)
        elif name and len(stack) > 1:
            stack.pop()
    freeze = lambda n: (n[0], tuple(freeze(c) for c in n[1]), *[n[2]] * marked)
    return freeze(root)


def tree_size(t: tuple) -> int:
    return 1 + sum(map(tree_size, t[1]))


def tree_similarity(a: str, b: str) -> float:
    x, y = html_tree(a), html_tree(b)
    return 1 - tree_distance(x, y) / max(tree_size(x), tree_size(y))


def best_run(needle: str, hay: str) -> tuple[str, float, float, float, float, float, bool]:
    """The run of as many words of hay as needle has, with a word in common, that resembles it most: text,
    ratio, and precision, recall, F1, Jaccard and equality of its words. Of equals the first."""
    want, words = needle.split(), hay.split()
    n, wanted = len(want), set(want)
    best: tuple[float, list[str]] = (0.0, [])
    match = SequenceMatcher(None)
    match.set_seq2(needle)
    for i in range(len(words) - n + 1):
        run = words[i : i + n]
        if wanted.isdisjoint(run):
            continue
        match.set_seq1(" ".join(run))
        if match.real_quick_ratio() > best[0] and match.quick_ratio() > best[0] and (r := match.ratio()) > best[0]:
            best = (r, run)
    ratio, run = best
    if not run:
        return "", 0.0, 0.0, 0.0, 0.0, 0.0, False
    common = len(wanted & set(run))
    p, r = common / len(set(run)), common / len(wanted)
    return " ".join(run), ratio, p, r, 2 * p * r / (p + r) if common else 0.0, common / len(wanted | set(run)), run == want


RUN_SCHEMA = "text string, ratio double, precision double, recall double, f1 double, jaccard double, equal boolean"


def _best_run_batch(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_run(a or "", b or "") for a, b in zip(needles, hays)], columns=[x.split()[0] for x in RUN_SCHEMA.split(", ")])


def best_run_match(needle: Column | str, hay: Column | str) -> Column:
    return F.pandas_udf(_best_run_batch, RUN_SCHEMA)(needle, hay)


def gleu(prediction: Sequence, answer: Sequence, top: int = 4) -> float:
    """Matched n-grams of n = 1 .. top over the larger of both numbers of n-grams."""
    p, a = (Counter(g for n in range(1, top + 1) for g in ngrams(x, n).elements()) for x in (prediction, answer))
    most = max(p.total(), a.total())
    return (p & a).total() / most if most else 0.0


def _gleu_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([gleu((p or "").split(), (a or "").split()) for p, a in zip(predictions, answers)])


def gleu_score(prediction: Column | str, answer: Column | str) -> Column:
    return F.pandas_udf(_gleu_batch, "double")(prediction, answer)


def json_objects(text: str) -> list[str]:
    """Every JSON object that can be read from a text, outermost ones in their order."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, size = decoder.raw_decode(text[at:])
        except ValueError:
            at += 1
            continue
        out.append(json.dumps(value, ensure_ascii=False))
        at += size
    return out


def _json_objects_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([json_objects(t or "") for t in texts], dtype=object)


def embedded_objects(text: Column | str) -> Column:
    return F.pandas_udf(_json_objects_batch, "array<string>")(text)


def dedent(text: str) -> str:
    import textwrap

    return textwrap.dedent(text.replace("\r\n", "\n")).strip()


ROW_SCHEMA = "rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double"


def _text_scores_batch(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """ROUGE-1, -2 and -L over words and smoothed BLEU-4 over characters, in percent."""
    for predictions, answers in batches:
        rows = []
        for p, a in zip(predictions.fillna(""), answers.fillna("")):
            x, y = p.split(), a.split()
            rows.append([round(100 * v, 4) for v in (rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y), bleu(clipped(p, a), len(p), len(a)))])
        yield pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu_4"])


def text_scores(prediction: Column | str, answer: Column | str) -> Column:
    return F.pandas_udf(_text_scores_batch, ROW_SCHEMA)(prediction, answer)


def _near_string_score_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([near_string(p or "", a or "") for p, a in zip(predictions, answers)])


def near_string_score(prediction: Column | str, answer: Column | str) -> Column:
    return F.pandas_udf(_near_string_score_batch, "double")(prediction, answer)


def edit_distance(a: str, b: str) -> int:
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y)))
        one = now
    return one[-1]


def record_tree(value: object, name: str = "root") -> tuple:
    """The tree of a JSON record: fields in the order of their names' length and letters, entries of lists of
    objects as parts, values as leaves. Labels are (leaf, text). What is empty is left out."""
    if isinstance(value, dict):
        fields = [record_tree(value[k], k) for k in sorted(value, key=lambda k: (len(k), k))]
        return (False, name), tuple(t for t in fields if t[1])
    if isinstance(value, list) and all(isinstance(x, dict) for x in value):
        parts = [record_tree(x, "part") for x in value]
        return (False, name), tuple(t for t in parts if t[1])
    listed = value if isinstance(value, list) else [value]
    texts = [str(x).strip() for x in listed if not isinstance(value, list) or isinstance(x, (str, int, float)) and not isinstance(x, bool)]
    return (False, name), tuple(((True, t), ()) for t in texts if t)


def _node_cost(label: tuple[bool, str]) -> int:
    return len(label[1]) if label[0] else 1


def _change_cost(a: tuple[bool, str], b: tuple[bool, str]) -> int:
    if a[0] and b[0]:
        return edit_distance(a[1], b[1])
    if a[0] or b[0]:
        return 1 + len(a[1] if a[0] else b[1])
    return int(a[1] != b[1])


def record_accuracy(prediction: str, answer: str) -> float:
    """1 - the distance of both records' trees by that of an empty record from the answer, at least 0. A
    prediction that is no JSON counts as empty; null for an empty answer."""
    try:
        said = json.loads(prediction)
    except ValueError:
        said = {}
    p, a = (record_tree(x if isinstance(x, (dict, list)) else {}) for x in (said, json.loads(answer)))
    whole = tree_distance(record_tree({}), a, _node_cost, _change_cost)
    return max(0.0, 1 - tree_distance(p, a, _node_cost, _change_cost) / whole) if whole else math.nan


def _record_accuracy_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([record_accuracy(p or "{}", a or "{}") for p, a in zip(predictions, answers)])


def record_score(prediction: Column | str, answer: Column | str) -> Column:
    return F.nanvl(F.pandas_udf(_record_accuracy_batch, "double")(prediction, answer), F.lit(None))


def _tree_score_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([tree_similarity(p or "", a or "") for p, a in zip(predictions, answers)])


def without_text(t: tuple) -> tuple:
    """The tree of tags alone: leaves that are not tags go."""
    return (t[0], tuple(without_text(c) for c in t[1] if c[2]))


def structure_similarity(a: str, b: str) -> float:
    x, y = (without_text(html_tree(s, marked=True)) for s in (a, b))
    return 1 - tree_distance(x, y) / max(tree_size(x), tree_size(y))


def _structure_score_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([structure_similarity(p or "", a or "") for p, a in zip(predictions, answers)])


def structure_score(prediction: Column | str, answer: Column | str) -> Column:
    """Tree similarity of the tags, whatever the text in them."""
    return F.pandas_udf(_structure_score_batch, "double")(prediction, answer)


def tree_score(prediction: Column | str, answer: Column | str) -> Column:
    return F.pandas_udf(_tree_score_batch, "double")(prediction, answer)


def _dedented_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else dedent(t) for t in texts])


def dedented(text: Column | str) -> Column:
    return F.pandas_udf(_dedented_batch, "string")(text)


def _clipped_counts_batch(predictions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([[{"matched": m, "predicted": n} for m, n in clipped((p or "").split(), (a or "").split())] for p, a in zip(predictions, answers)])


def _clipped_counts(prediction: Column | str, answer: Column | str) -> Column:
    return F.pandas_udf(_clipped_counts_batch, "array<struct<matched: long, predicted: long>>")(prediction, answer)


def corpus_bleu(rows: DataFrame, by: Sequence[str], prediction: str, answer: str) -> DataFrame:
    """Corpus BLEU of each group: clipped counts by row, then sums and one formula."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    counted = rows.select(*by, _clipped_counts(prediction, answer).alias("c"), words(prediction).alias("p"), words(answer).alias("a"))
    sums = [F.sum(F.col("c")[i][k]).alias(f"{k[0]}{i}") for i in range(4) for k in ("matched", "predicted")]
    s = counted.groupBy(*by).agg(*sums, F.sum("p").alias("p"), F.sum("a").alias("a"))
    logs: Column = F.lit(0.0)
    low: Column = F.lit(True)
    for i in range(4):
        logs = logs + F.log(F.col(f"m{i}") / F.col(f"p{i}"))
        low = low & (F.col(f"m{i}") > 0)
    brevity = F.when(F.col("p") > F.col("a"), 1.0).otherwise(F.exp(1 - F.col("a") / F.col("p")))
    return s.select(*by, F.when(low, brevity * F.exp(logs / 4)).otherwise(0.0).alias("bleu"))


def cider_terms(rows: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """(key, gram, tf, idf weight): n-grams weighted by their inverse document frequency over
    all rows; two aggregations."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    tf = rows.select(key, F.explode(runs_of(w, n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    total = rows.select(key).distinct().count()
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    return tf.join(df, "gram").select(key, "gram", "tf", (F.col("tf") * F.log(F.lit(float(total)) / F.col("df"))).alias("weight"))


def cider(rows: DataFrame, key: str, prediction: Column, answer: Column, top: int = 4) -> DataFrame:
    """(key, cider) of each row, ten times the mean over n of the cosine of both texts' n-grams weighted by
    count and inverse frequency among the answers; counts of the prediction are cut at the answer's, and
    texts of different length cost a Gaussian of six words. Two aggregations over all rows.

    An n for which a side has no n-grams counts 0."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    sides = rows.select(F.col(key).alias("id"), words(prediction).alias("p"), words(answer).alias("a"))

    def tagged(side: str, n: int) -> Column:
        grams = F.coalesce(runs_of(F.col(side), n), F.array().cast("array<string>"))
        return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), g.alias("gram")))

    each = [tagged(side, n) for n in range(1, top + 1) for side in "pa"]
    both = sides.select("id", (F.size("p") - F.size("a")).alias("gap"), F.explode(F.concat(*each)).alias("g")).select("id", "gap", "g.*")
    counted = both.groupBy("id", "gap", "n", "gram").agg(F.count_if(F.col("side") == "p").alias("p"), F.count_if(F.col("side") == "a").alias("a"))
    total = rows.count()
    df = counted.filter("a > 0").groupBy("n", "gram").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(total))) - F.log(F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double"))
    weighed = counted.join(df, ["n", "gram"], "left").withColumn("w", idf)
    cut = F.least("p", "a") * F.col("w") * F.col("a") * F.col("w")
    sums = weighed.groupBy("id", "gap", "n").agg(F.sum(cut).alias("dot"), F.sqrt(F.sum(F.pow(F.col("p") * F.col("w"), 2))).alias("np"), F.sqrt(F.sum(F.pow(F.col("a") * F.col("w"), 2))).alias("na"))
    cosine = F.when((F.col("np") > 0) & (F.col("na") > 0), F.col("dot") / (F.col("np") * F.col("na"))).otherwise(0.0) * F.exp(-F.col("gap") * F.col("gap") / 72.0)
    return sums.groupBy("id").agg((F.sum(cosine) * 10 / top).alias("cider")).withColumnRenamed("id", key)
