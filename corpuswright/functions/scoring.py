"""Row scores by kind of answer: choices, numbers, lists, maps, boxes, points, constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswright.functions import answers as A
from corpuswright.functions import geometry as G

# Words for tens and scales.
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
TEENS = {"eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}


def _map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def single_choice(text: Column, options: Mapping[str, Column]) -> Column:
    """The letter that is named first: (X), X with a mark after it, X as a word, or an option's
    text; null where none is."""
    padded = F.concat(F.lit(" "), F.trim(text), F.lit(" "))

    def place(k: str, option: Column) -> Column:
        spots = [F.instr(padded, s) for s in (f"({k})", f" {k} ", f" {k}.", f" {k},", f" {k})")]
        text_at = F.call_function("instr", F.lower(padded), F.lower(option))
        found = F.array_min(F.filter(F.array(*spots, text_at), lambda p: p > 0))
        return F.when(found.isNotNull(), F.struct(found.alias("at"), F.lit(k).alias("letter")))

    return F.array_min(F.array_compact(F.array(*[place(k, o) for k, o in options.items()])))["letter"]


def order_answer(text: Column) -> Column:
    """An order of A to D: written together, or with other signs between; null otherwise."""
    only = F.regexp_replace(F.upper(text), "[^ABCD]", "")
    whole = F.length(only) == 4
    distinct = F.size(F.array_distinct(F.split(only, ""))) == 4
    return F.when(whole & distinct, only)


def true_false(text: Column) -> Column:
    """T or F where exactly one of the words true and false (or their letters) occurs."""
    hits = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(true|false|t|f)\b"), F.lit(1)), lambda x: F.upper(F.substring(x, 1, 1))))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def words_to_number(text: Column) -> Column:
    """A number in words (up to hundred thousands) or digits; null for other words."""
    values = _map({w: k for k, w in enumerate(A.NUMBER_WORDS)} | TEENS | TENS)
    tokens = F.filter(F.split(F.lower(F.translate(text, "-", " ")), r"\s+"), lambda w: (w != "") & (w != "and"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        v = F.coalesce(F.try_element_at(values, w).cast("long"), w.try_cast("long"))
        return (
            F.when(w == "hundred", F.struct(s["total"].alias("total"), (F.greatest(s["now"], F.lit(1)) * 100).alias("now"), s["ok"].alias("ok")))
            .when(w == "thousand", F.struct((s["total"] + F.greatest(s["now"], F.lit(1)) * 1000).alias("total"), F.lit(0).cast("long").alias("now"), s["ok"].alias("ok")))
            .otherwise(F.struct(s["total"].alias("total"), (s["now"] + F.coalesce(v, F.lit(0))).alias("now"), (s["ok"] & v.isNotNull()).alias("ok")))
        )

    return F.aggregate(tokens, start, step, lambda s: F.when(s["ok"] & (F.size(tokens) > 0), s["total"] + s["now"]))


def clean_answer(text: Column) -> Column:
    """Lower, trimmed, without parentheses' content, quotes, dollar and percent signs."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\s*\([^)]*\)", "")
    return F.trim(F.translate(bare, "\"'$%", ""))


def typed_score(prediction: Column, answer: Column, kind: Column) -> Column:
    """By kind: Int equal, Float within 1 % at any of three scales, Str by similarity, List
    as sorted parts of which the worst counts."""
    p, a = clean_answer(prediction), clean_answer(answer)
    whole = F.when(p.try_cast("bigint") == a.try_cast("bigint"), 1.0).otherwise(0.0)
    real = F.when(A.float_equal(p.try_cast("double"), a.try_cast("double")), 1.0).otherwise(0.0)
    parts = lambda t: F.array_sort(F.transform(F.split(F.translate(t, "[]", ""), ","), lambda x: F.trim(x)))
    each = F.zip_with(parts(p), parts(a), lambda x, y: A.anls(x, y))
    listed = F.when(F.size(parts(p)) != F.size(parts(a)), 0.0).otherwise(F.array_min(each))
    return F.when(kind == "Int", whole).when(kind == "Float", real).when(kind == "List", listed).otherwise(A.anls(p, a))


def ocr_score(prediction: Column, answers: Column) -> Column:
    """Best over the answers: short ones by containment, others by similarity of at least 0.5."""
    p = F.lower(F.trim(prediction))

    def one(a: Column) -> Column:
        t = F.lower(F.trim(a))
        near = 1 - F.levenshtein(p, t) / F.greatest(F.length(p), F.length(t), F.lit(1))
        return F.when(F.size(F.split(t, r"\s+")) < 5, F.when(F.contains(p, t), 1.0).otherwise(0.0)).otherwise(F.when(near >= 0.5, near).otherwise(0.0))

    return F.coalesce(F.array_max(F.transform(answers, one)), F.lit(0.0))


def counting_score(prediction: Column, answer: Column) -> Column:
    """1 where the answer is contained, else the closeness of the first number over 0.5."""
    n = F.regexp_extract(prediction, r"(\d+)", 1).try_cast("double")
    a = answer.try_cast("double")
    near = 1 - F.abs(n - a) / a
    return F.when(F.contains(prediction, answer), 1.0).when((a > 0) & (near > 0.5), near).otherwise(0.0)


def list_cell(text: Column) -> Column:
    """A list written in a cell, in single or double quotes; other texts are a list of one."""
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(F.startswith(F.trim(text), F.lit("[")) & parsed.isNotNull(), parsed).otherwise(F.array(text))


def field_by_keyword(fields: Column, keyword: str) -> Column:
    """The first value of a map whose normalised key contains the keyword; null for none."""
    hit = F.filter(F.map_entries(fields), lambda e: F.contains(A.key_normal(e["key"]), F.lit(keyword)))
    return F.get(hit, F.lit(0))["value"]


def fenced_lists(text: Column) -> Column:
    """The two JSON lists of a text with exactly two fenced blocks; null otherwise."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    ok = (F.size(blocks) == 2) & F.forall(blocks, lambda b: F.startswith(F.trim(b), F.lit("[")))
    return F.when(ok, F.transform(blocks, A.strip))


def pairs_to_json(keys: Sequence[str], values: Sequence[Column]) -> Column:
    """A JSON object of the fields that are not blank."""
    fields = [F.when(F.trim(v) != "", v).alias(k) for k, v in zip(keys, values)]
    return F.to_json(F.struct(*fields))


def options_map(names: Sequence[str]) -> Column:
    """Choices of a row: the option columns that are not null."""
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull())


def keypoint_score(p: Column, t: Column) -> Column:
    """Mean of exp(-10 d / sqrt 2) over ordered points (arrays of x, y structs); 0 where their
    numbers differ."""
    each = F.zip_with(p, t, lambda a, b: F.exp(-10 * F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / F.sqrt(F.lit(2.0))))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(t), F.lit(1))
    return F.when(F.size(p) != F.size(t), 0.0).otherwise(mean)


def _corners(b: Column) -> G.Box:
    return tuple(F.get(b, F.lit(i)) for i in range(4))  # type: ignore[return-value]


def box_list_score(p: Column, t: Column) -> Column:
    """Mean over predicted boxes (arrays of four numbers) of the best IoU with a target."""
    best = F.transform(p, lambda b: F.coalesce(F.array_max(F.transform(t, lambda c: G.iou(_corners(b), _corners(c)))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(p), F.lit(1))


def box_sequence_score(p: Column, t: Column) -> Column:
    """Mean IoU of ordered boxes; a box without a partner counts 0."""
    each = F.zip_with(p, t, lambda a, b: F.coalesce(G.iou(_corners(a), _corners(b)), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(p), F.size(t), F.lit(1))


def tagged_point(text: Column) -> Column:
    """x and y of a <point>x,y</point>; null otherwise."""
    pattern = r"<point>\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*</point>"
    x, y = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def tagged_box_score(text: Column, target: Column) -> Column:
    """IoU of the first <box>x1,y1,x2,y2</box> with the target; 0 where there is none."""
    n = r"\s*(-?[0-9.]+)\s*"
    pattern = rf"<box>{n},{n},{n},{n}</box>"
    box = F.array(*[F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2, 3, 4)])
    return F.coalesce(G.iou(_corners(box), _corners(target)), F.lit(0.0))


def tagged_point_distance(text: Column, x: Column, y: Column) -> Column:
    """Distance of the tagged point from a place; null where there is none."""
    p = tagged_point(text)
    return F.hypot(p["x"] - x, p["y"] - y)


def point_in_boxes(text: Column, boxes: Column) -> Column:
    """Whether the tagged point lies in one of the boxes, edges included."""
    p = tagged_point(text)
    return F.coalesce(F.exists(boxes, lambda b: G.contains_point(_corners(b), p["x"], p["y"])), F.lit(False))


def masked_rmse(p: Column, t: Column, top: float = 10.0) -> Column:
    """Root mean square difference of two arrays as a score: 1 at 0, 0 from `top` on."""
    sq = F.zip_with(p, t, lambda a, b: (a - b) * (a - b))
    rmse = F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(t), F.lit(1)))
    return F.when(F.size(p) != F.size(t), 0.0).otherwise(1 - F.least(rmse, F.lit(top)) / top)


def positive_int(p: Column, t: Column) -> Column:
    """Equality of positive whole numbers; -1 (to be ignored) where neither is positive."""
    return F.when((p <= 0) & (t <= 0), -1.0).when(p == t, 1.0).otherwise(0.0)


def token_accuracy(predictions: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of labels that the prediction one place before gives, ignored labels left out."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.filter(F.zip_with(F.slice(predictions, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda p, t: F.struct(p.alias("p"), t.alias("t"))), lambda x: x["t"] != ignore)
    return F.size(F.filter(pairs, lambda x: x["p"] == x["t"])) / F.nullif(F.size(pairs), F.lit(0))


def numbers_have_decimals(text: Column, n: int) -> Column:
    """Whether every number of a text has n decimals."""
    return F.forall(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.length(F.regexp_extract(x, r"\.(\d+)$", 1)) == n)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b\w+\b"))


def times_said(text: Column, phrases: Sequence[str]) -> Column:
    """How often phrases occur as whole words, cases alike and without marks of bold type. Words are taken
    as they stand: no other forms of them count."""
    bare = F.lower(F.replace(text, F.lit("**"), F.lit("")))
    return sum((F.regexp_count(bare, F.lit(rf"(?<!\w)\Q{p.lower()}\E(?!\w)")) for p in phrases), F.lit(0))


def sentences_with(text: Column, phrases: Sequence[str]) -> Column:
    """Numbers from 1 of the sentences that hold one of the phrases."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.array_compact(F.transform(parts, lambda s, i: F.when(times_said(s, phrases) > 0, i + 1)))


def acrostic(text: Column, word: str, every_word: bool = False) -> Column:
    """Whether the lines begin with the letters of a word, one a line (a blank is an empty line); with
    `every_word` all words of a line begin with its letter."""
    bare = F.lower(A.strip(F.replace(text, F.lit("**"), F.lit(""))))
    letters = F.array(*[F.lit(c) for c in word.lower()])

    def fits(line: Column, letter: Column) -> Column:
        own = F.trim(line)
        starts = F.forall(F.split(own, " "), lambda w: F.startswith(w, letter)) if every_word else F.startswith(own, letter)
        return F.when(letter == " ", own == "").otherwise((own != "") & starts)

    lines = F.split(bare, "\n")
    return (F.size(lines) == len(word)) & F.forall(F.zip_with(lines, letters, lambda x, c: F.coalesce(fits(x, c), F.lit(False))), lambda ok: ok)


#: Constraint checks by name: (text, argument) -> condition.
CONSTRAINTS = {
    "begins_with": lambda t, x: F.startswith(t, F.lit(x)),
    "ends_with": lambda t, x: F.endswith(t, F.lit(x)),
    "most_words": lambda t, x: F.size(A.words(t)) <= x,
    "least_words": lambda t, x: F.size(A.words(t)) >= x,
    "paragraphs": lambda t, x: F.size(F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(p) != "")) == x,
    "sentences": lambda t, x: F.regexp_count(t, F.lit(r"[.!?](\s|$)")) == x,
    "contains": lambda t, x: F.contains(F.lower(t), F.lit(str(x).lower())),
    "decimals": numbers_have_decimals,
    "fewer_words": lambda t, x: word_count(t) < x,
    "more_words": lambda t, x: word_count(t) > x,
    "contains_any": lambda t, x: times_said(t, x) > 0,
    "contains_times": lambda t, x: times_said(t, x[0]) == x[1],
    "contains_one_group": lambda t, x: sum(((times_said(t, group) > 0).cast("int") for group in x), F.lit(0)) == 1,
    "in_sentence": lambda t, x: F.array_contains(sentences_with(t, x[0]), x[1]),
    "only_in_sentence": lambda t, x: (F.size(sentences_with(t, x[0])) == 1) & F.array_contains(sentences_with(t, x[0]), x[1]),
    "acrostic": acrostic,
    "alliterating_acrostic": lambda t, x: acrostic(t, x, every_word=True),
}

#: Text metrics by name: (prediction, answer) -> score.
METRICS = {
    "exact": lambda p, a: (p == a).cast("double"), "exact_lower": lambda p, a: (F.lower(p) == F.lower(a)).cast("double"),
    "simple": lambda p, a: (A.simple_string(p) == A.simple_string(a)).cast("double"), "option": lambda p, a: A.option_exact(p, a).cast("double"),
    "code": lambda p, a: (A.code_block(p) == A.code_block(a)).cast("double"), "anls": A.anls, "bag_f1": A.bag_f1, "relaxed": lambda p, a: A.relaxed_match(p, a).cast("double"),
    "line_set": lambda p, a: A.set_equal(F.split(F.lower(p), "\n"), F.split(F.lower(a), "\n")).cast("double"), "comma_set": lambda p, a: A.set_equal(F.split(p, r"\s*,\s*"), F.split(a, r"\s*,\s*")).cast("double"),
    "jaccard": lambda p, a: A.jaccard(A.words(p), A.words(a)), "jaccard_lower": lambda p, a: A.jaccard(A.words(F.lower(p)), A.words(F.lower(a))),
}


def score_by(name: Column, prediction: Column, answer: Column) -> Column:
    """The metric each row names; null for an unknown one."""
    out = F.lit(None).cast("double")
    for k, fn in METRICS.items():
        out = F.when(name == k, fn(prediction, answer)).otherwise(out)
    return out


def any_phrase(prediction: Column, answers: Column) -> Column:
    """Whether the text holds one of several reference phrases, cases alike."""
    return F.exists(answers, lambda a: F.contains(F.lower(prediction), F.lower(a)))


def boxed(text: Column) -> Column:
    r"""The body of the first \boxed{...}, with one level of braces inside."""
    return F.regexp_extract(text, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1)


def general_numeric(prediction: Column, answer: Column, tolerance: float = 0.01) -> Column:
    """Numbers within the relative tolerance, else equal as simple strings; a boxed body
    counts for the whole reply."""
    body = boxed(prediction)
    p = F.when(body != "", body).otherwise(prediction)
    x, y = A.as_number(p), A.as_number(answer)
    near = F.abs(x - y) <= tolerance * F.greatest(F.abs(y), F.lit(1e-12))
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(A.simple_string(p) == A.simple_string(answer))


def map_box_score(p: Column, t: Column) -> Column:
    """Mean IoU over the keys of either map of boxes; a key of one map alone counts 0."""
    each = F.map_values(F.map_zip_with(p, t, lambda k, a, b: F.coalesce(G.iou(_corners(a), _corners(b)), F.lit(0.0))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(each), F.lit(1))


def box_guard(boxes: Column) -> Column:
    """The boxes of a list that have four numbers."""
    return F.filter(boxes, lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))


def letter_or_text_match(prediction: Column, label: Column) -> Column:
    """Whether the first letters agree, or the prediction holds the label's text after its
    letter and mark."""
    same = F.substring(prediction, 1, 1) == F.substring(label, 1, 1)
    rest = F.trim(F.substring(label, F.lit(5), F.length(label)))
    return same | ((F.length(rest) > 0) & F.contains(F.lower(prediction), F.lower(rest)))
