"""Column expressions that extract and compare answers. JVM-side only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswright.functions.binding import bind, in_any

# Marks that count as separators, phrases that refuse an answer, number words.
SEPARATORS = ".()[],:;!*#{}"
REFUSALS = ("Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer")
API_FAILURE = "Failed to obtain answer via API"
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
ARTICLES = ("a", "an", "the")


def strip(text: Column) -> Column:
    """Without white space at either end (all white space, not only blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs to one blank, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def spaced(text: Column, marks: str = SEPARATORS) -> Column:
    return F.translate(text, marks, " " * len(marks))


def words(text: Column) -> Column:
    """Non-empty words between blanks."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def choice_letter(answer: Column, letters: Sequence[str] = ("A", "B", "C", "D"), tail: int = 5) -> Column:
    """The one option letter that occurs as a word, in the last `tail` words; Z for a
    refusal; null where there is none, several, or the call failed."""
    tokens = words(spaced(answer))
    found = F.filter(F.array(*map(F.lit, letters)), lambda c: F.array_contains(tokens, c))
    only = F.element_at(found, 1)
    late = F.array_position(F.reverse(tokens), only) <= tail
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda r: F.contains(answer, r))
    return F.when(F.contains(answer, F.lit(API_FAILURE)), F.lit(None)).when(refused, F.lit("Z")).when((F.size(found) == 1) & late, only)


def choice_text(answer: Column, options: Mapping[str, Column]) -> Column:
    """The one option whose text the answer contains; null for none or several, and for answers
    of over twice the options' length."""
    low = F.lower(answer)
    total = sum((F.length(o) for o in options.values()), F.lit(0))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lower(F.trim(o))), F.lit(k)) for k, o in options.items()]))
    return F.when((F.length(answer) <= 2 * total) & (F.size(hits) == 1), F.element_at(hits, 1))


def choice(answer: Column, options: Mapping[str, Column]) -> Column:
    return F.coalesce(choice_letter(answer, tuple(options)), choice_text(answer, options))


def letter_set(text: Column) -> Column:
    """The letters A-Z of a text, distinct, sorted, joined."""
    only = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(only, ""), lambda c: c != ""))), "")


def yes_no(text: Column) -> Column:
    """Yes or No where exactly one of them is a word, else Unknown."""
    tokens = words(F.lower(spaced(text)))
    yes, no = F.array_contains(tokens, "yes"), F.array_contains(tokens, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def number_word(text: Column) -> Column:
    """The first number in a text: digits or a number word; null for none."""
    low = F.lower(text)
    hit = F.regexp_extract(low, r"\b(\d+|" + "|".join(NUMBER_WORDS) + r")\b", 1)
    values = F.create_map(*[x for k, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(k))])
    return F.when(hit != "", F.coalesce(F.expr("cast(null as int)"), F.try_element_at(values, hit), hit.try_cast("int")))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def as_number(text: Column) -> Column:
    """A number, with a percent sign as a hundredth; null otherwise."""
    bare = F.trim(text)
    percent = F.endswith(bare, F.lit("%"))
    return F.when(percent, F.regexp_replace(bare, "%$", "").try_cast("double") / 100).otherwise(bare.try_cast("double"))


def relaxed_match(prediction: Column, answer: Column, tolerance: float = 0.05) -> Column:
    """Whether numbers differ by at most the relative tolerance, or texts are equal but for
    case; an answer of zero is compared as text."""
    p, a = as_number(prediction), as_number(answer)
    return F.when(p.isNotNull() & a.isNotNull() & (a != 0), F.abs(p - a) / F.abs(a) <= tolerance).otherwise(F.lower(prediction) == F.lower(answer))


def vqa_normal(text: Column) -> Column:
    """Lower case, number words to digits, no articles, one blank between words."""
    values = F.create_map(*[x for k, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(str(k)))])
    tokens = F.filter(words(F.lower(spaced(text))), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(values, w), w)), " ")


def vqa_score(prediction: Column, answers: Column) -> Column:
    """Leave-one-out consensus: mean over the answers of min(1, equal others / 3)."""
    equal = F.transform(answers, lambda a: F.when(a == prediction, 1).otherwise(0))
    total = F.aggregate(equal, F.lit(0), lambda s, x: s + x)
    return F.aggregate(equal, F.lit(0.0), lambda s, x: s + F.least(F.lit(1.0), (total - x) / F.lit(3.0))) / F.greatest(F.size(answers), F.lit(1))


def anls(prediction: Column, answer: Column, threshold: float = 0.5) -> Column:
    """1 - edit distance / longer length on collapsed lower-case text; 0 at or below the threshold."""
    p, a = F.lower(collapse(prediction)), F.lower(collapse(answer))
    longest = F.greatest(F.length(p), F.length(a))
    sim = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(p, a) / longest)
    return F.when(sim <= threshold, 0.0).otherwise(sim)


def bag_f1(prediction: Column, answer: Column) -> Column:
    """F1 of word membership (not counts)."""

    def score(b: Column) -> Column:
        pr = F.size(in_any(b["p"], b["a"])) / F.greatest(F.size(b["p"]), F.lit(1))
        rc = F.size(in_any(b["a"], b["p"])) / F.greatest(F.size(b["a"]), F.lit(1))
        return bind(F.struct(pr.alias("pr"), rc.alias("rc")), lambda s: F.when(s["pr"] + s["rc"] > 0, 2 * s["pr"] * s["rc"] / (s["pr"] + s["rc"])).otherwise(0.0))

    return bind(F.struct(words(F.lower(prediction)).alias("p"), words(F.lower(answer)).alias("a")), score)


def simple_string(text: Column) -> Column:
    return F.lower(F.translate(text, " -\n\t.", ""))


def option_exact(prediction: Column, answer: Column) -> Column:
    """Equal texts, where a one-letter answer also meets (A), A. and A)."""
    letter = F.regexp_extract(F.trim(prediction), r"^\(?([A-Za-z])[.)]?$", 1)
    return F.when(F.length(answer) == 1, (letter == answer) | (F.trim(prediction) == answer)).otherwise(F.trim(prediction) == F.trim(answer))


def reciprocal_rank(answers: Column, text: Column) -> Column:
    """1 / rank of the first answer that the text contains; 0 for none."""
    rank = F.array_position(F.transform(answers, lambda a: F.contains(F.lower(text), F.lower(a))), True)
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_precision(p: Column, t: Column, empty: float = 1.0) -> Column:
    n = F.size(F.array_distinct(p))
    return F.when(n == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(p, t)) / n)


def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def sequence_accuracy(p: Column, t: Column) -> Column:
    """Share of equal places; 0 for lengths that differ."""
    same = F.size(F.filter(F.zip_with(p, t, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda ok: ok))
    return F.when(F.size(p) != F.size(t), 0.0).otherwise(same / F.greatest(F.size(t), F.lit(1)))


def prefix_ratio(p: Column, t: Column) -> Column:
    """Length of the common prefix by the target's length."""
    same = F.zip_with(p, t, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)) / F.greatest(F.size(t), F.lit(1))


def relative_closeness(p: Column, t: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(p - t) / F.abs(t))


def float_equal(p: Column, t: Column) -> Column:
    """Whether a number meets the target, its hundredth or its hundredfold within 1 %."""
    return F.exists(F.array(t / 100, t, t * 100), lambda x: F.abs(p - x) <= 0.01 * F.abs(x))


def map_jaccard(p: Column, t: Column) -> Column:
    """Share of the keys of either map on which both agree."""
    both = F.map_zip_with(p, t, lambda k, x, y: F.coalesce(x == y, F.lit(False)))
    n = F.size(F.map_keys(both))
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(F.map_values(both), lambda ok: ok)) / n)


def validated_pairs(payload: Column, levels: Mapping[int, str]) -> Column:
    """(level, question, answer) of a JSON list of pairs, one for each level in the order given: of a
    level that comes twice the last counts, a question that is missing is the level's own. Null where an
    answer is missing or the payload is no list (or an object with one as vqa_pairs, VQA or items)."""
    held = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("vqa_pairs", "VQA", "items")], payload)
    items = F.from_json(held, "array<map<string,string>>")
    any_of = lambda m, *names: F.coalesce(*[F.nullif(strip(F.try_element_at(m, F.lit(n))), F.lit("")) for n in names])

    def one(level: int, question: str) -> Column:
        last = F.element_at(F.filter(items, lambda m: F.coalesce(any_of(m, "level", "Level").try_cast("int") == level, F.lit(False))), -1)
        return F.struct(F.lit(level).alias("level"), F.coalesce(any_of(last, "question", "Q"), F.lit(question)).alias("question"), any_of(last, "answer", "A").alias("answer"))

    # element_at of an empty array raises, so an empty entry stands in front.
    items = F.concat(F.array(F.create_map(F.lit("level"), F.lit(""))), *[F.array(F.create_map(F.lit("level"), F.lit(str(k)))) for k in levels], items)
    pairs = F.array(*[one(k, q) for k, q in levels.items()])
    return bind(pairs, lambda p: F.when(items.isNotNull() & F.forall(p, lambda x: x["answer"].isNotNull()), p))


def map_equal(p: Column, t: Column) -> Column:
    """1 where both maps are equal, whatever their order."""
    return F.when(F.array_sort(F.map_entries(p)) == F.array_sort(F.map_entries(t)), 1.0).otherwise(0.0)


def _agreeing(p: Column, t: Column, same) -> Column:
    both = F.map_values(F.map_zip_with(p, t, lambda k, x, y: F.coalesce(same(x, y), F.lit(False))))
    return F.size(F.filter(both, lambda ok: ok))


def map_precision(p: Column, t: Column) -> Column:
    """Share of the predicted keys that have the target's value; 0 for none."""
    n = F.size(F.map_keys(p))
    return F.when(n == 0, 0.0).otherwise(_agreeing(p, t, lambda x, y: x == y) / n)


def map_recall(p: Column, t: Column) -> Column:
    """Share of the target's keys that the prediction has right; null for an empty target."""
    return _agreeing(p, t, lambda x, y: x == y) / F.nullif(F.size(F.map_keys(t)), F.lit(0))


def map_of_sets_equal(p: Column, t: Column) -> Column:
    """Share of the keys of either map whose lists are equal as sets; an absent list is empty."""
    none = F.array().cast("array<string>")
    same = lambda x, y: F.array_sort(F.array_distinct(F.coalesce(x, none))) == F.array_sort(F.array_distinct(F.coalesce(y, none)))
    keys = F.size(F.array_union(F.map_keys(p), F.map_keys(t)))
    return _agreeing(p, t, same) / F.nullif(keys, F.lit(0))


def after_thinking(text: Column) -> Column:
    """What follows the last closing thought tag."""
    return strip(F.element_at(F.split(text, "</think>"), -1))


def thinking(text: Column) -> Column:
    """The thought's body where there is exactly one pair of tags, else all before the last."""
    parts = F.split(text, "</think>")
    one = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    return F.when(F.size(parts) == 2, strip(F.when(one != "", one).otherwise(F.element_at(parts, 1)))).when(F.size(parts) > 2, strip(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "</think>"))).otherwise("")


def tag_body(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def json_payload(text: Column) -> Column:
    """The JSON in a reply: without a code fence, from the first bracket to the last."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)


def code_block(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)```", 1)
    return strip(F.when(body != "", body).otherwise(text))


def key_normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
