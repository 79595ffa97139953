"""Training rows of conversations as token arrays: supervised, pairwise, feedback, unsupervised.

`texts` are a conversation's turns as a template renders them, user side first; an encoder turns text
into an array of ids. Each function gives the columns of one row, and a condition for rows that are
kept. Where a cutoff is too short for both sides, `sequence_budget` shares it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswright.functions.binding import bind
from corpuswright.functions.templates import IGNORE, Encoder
from corpuswright.operators.ordering import sequence_budget

NONE = "array<int>"


def _first(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), n.cast("int"))


def _ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), n.cast("int"))


def word_ids(text: Column) -> Column:
    """An encoder without a tokenizer: a checksum for each word."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(49_000)).cast("int"))


def complete_prompt(prompt: Column) -> Column:
    """A prompt that the model is to answer: an odd number of turns."""
    return F.size(prompt) % 2 == 1


def keeps_supervised(prompt: Column, answers: Column) -> Column:
    return complete_prompt(prompt) & (F.size(answers) == 1)


def keeps_pairs(prompt: Column, answers: Column) -> Column:
    """For pairwise and feedback rows: at least two answers."""
    return complete_prompt(prompt) & (F.size(answers) >= 2)


def one_turn(texts: Column, encode: Encoder) -> Column:
    """source and target ids: all turns but the last, and the last."""
    n = F.size(texts)
    return F.struct(encode(F.array_join(F.slice(texts, F.lit(1), n - 1), "")).alias("source"), encode(F.element_at(texts, -1)).alias("target"))


def supervised(texts: Column, encode: Encoder, cutoff: int, train_on_prompt: bool = False, mask_history: bool = False) -> Column:
    """input_ids and labels of a conversation of user and model turns in pairs. Pairs share the cutoff in
    order, with `mask_history` from the last pair on, and then only the last pair is trained;
    pairs beyond the cutoff are left out."""

    def rows(pairs: Column) -> Column:
        order = F.reverse(pairs) if mask_history else pairs
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<input_ids:array<int>,labels:array<int>>>").alias("out"))

        def step(s: Column, p: Column) -> Column:
            room = F.lit(cutoff) - s["used"]
            a, b = sequence_budget_in(F.size(p["source"]), F.size(p["target"]), room)
            source, target = _first(p["source"], a), _first(p["target"], b)
            masked = _ignored(F.size(target)) if mask_history else target
            label = F.concat(source if train_on_prompt else _ignored(F.size(source)), F.when(F.size(s["out"]) == 0, target).otherwise(masked))
            new = F.struct(F.concat(source, target).alias("input_ids"), label.alias("labels"))
            return F.when(room <= 0, s).otherwise(F.struct((s["used"] + a + b).cast("int").alias("used"), F.array_append(s["out"], new).alias("out")))

        kept = F.aggregate(order, start, step, lambda s: F.reverse(s["out"]) if mask_history else s["out"])
        return bind(kept, lambda k: F.struct(F.flatten(F.transform(k, lambda x: x["input_ids"])).alias("input_ids"), F.flatten(F.transform(k, lambda x: x["labels"])).alias("labels")))

    n = F.floor(F.size(texts) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(encode(F.get(texts, i * 2)).alias("source"), encode(F.get(texts, i * 2 + 1)).alias("target")))
    return bind(F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<source:array<int>,target:array<int>>>")), rows)


def sequence_budget_in(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """`sequence_budget` with a cutoff that differs by row."""
    share = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff * (target / F.greatest(source + target, F.lit(1)))).cast("int"))
    kept = F.least(share, target)
    return F.least(F.greatest(cutoff - kept, F.lit(0)), source), kept


def pairwise(prompt: Column, chosen: Column, rejected: Column, encode: Encoder, cutoff: int) -> Column:
    """Ids and labels of a chosen and a rejected answer behind one prompt (texts). Both
    answers keep the length that the longer may have."""

    def rows(x: Column) -> Column:
        a, b = sequence_budget(F.size(x["p"]), F.greatest(F.size(x["c"]), F.size(x["r"])), cutoff)
        source = _first(x["p"], a)
        out = []
        for name, side in (("chosen", "c"), ("rejected", "r")):
            ids = _first(x[side], b)
            out += [F.concat(source, ids).alias(f"{name}_input_ids"), F.concat(_ignored(F.size(source)), ids).alias(f"{name}_labels")]
        return F.struct(*out)

    return bind(F.struct(encode(prompt).alias("p"), encode(chosen).alias("c"), encode(rejected).alias("r")), rows)


def feedback(prompt: Column, liked: Column, disliked: Column, kl_liked: Column, kl_disliked: Column, encode: Encoder, cutoff: int) -> Column:
    """Ids and labels of the answer that was given, of a mismatched one (the answer of another row)
    behind the same prompt, and whether the answer was liked. Of two answers that which is not
    empty was given."""

    def side(prompt_ids: Column, answer: Column, name: str) -> list[Column]:
        a, b = sequence_budget(F.size(prompt_ids), F.size(answer), cutoff)
        source, target = _first(prompt_ids, a), _first(answer, b)
        return [F.concat(source, target).alias(f"{name}input_ids"), F.concat(_ignored(F.size(source)), target).alias(f"{name}labels")]

    given, other = (F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(y) for x, y in ((liked, disliked), (kl_liked, kl_disliked)))
    ids = F.struct(encode(prompt).alias("p"), encode(given).alias("r"), encode(other).alias("k"), (F.coalesce(liked, F.lit("")) != "").alias("tag"))
    return bind(ids, lambda x: F.struct(*side(x["p"], x["r"], ""), *side(x["p"], x["k"], "kl_"), x["tag"].alias("kto_tag")))


def unsupervised(prompt: Column, answer: Column, encode: Encoder, cutoff: int) -> Column:
    """input_ids of the prompt alone and labels of the answer (empty for none)."""

    def rows(x: Column) -> Column:
        a, b = sequence_budget(F.size(x["p"]), F.size(x["a"]), cutoff)
        return F.struct(_first(x["p"], a).alias("input_ids"), _first(x["a"], b).alias("labels"))

    return bind(F.struct(encode(prompt).alias("p"), F.coalesce(encode(answer), F.array().cast(NONE)).alias("a")), rows)
