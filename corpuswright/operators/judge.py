"""Answers by rule first, by judge where rules fail, remembered by key.

A Python judge inside `when` would be called for every row; so rows are divided by what the rule
gave, only the rest goes through the judge in Arrow batches, and the parts are united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[str, int], str]  # (prompt, attempt) -> reply; may raise


def offline_judge(prompt: str, attempt: int) -> str:
    """A deterministic stand-in for a remote judge: a score from the prompt's hash, or no score."""
    v = (int(hashlib.md5(prompt.encode()).hexdigest()[:7], 16) + attempt) % 13
    return f"score: {v / 10}" if v <= 10 else "no idea"


def score_of(reply: str) -> float | None:
    """The first number of a reply, if it lies between 0 and 1."""
    found = re.search(r"\d+(?:\.\d+)?", reply)
    value = float(found[0]) if found else None
    return value if value is not None and 0 <= value <= 1 else None


def ask(prompt: str, judge: Judge, tries: int) -> tuple[float, str]:
    """Score and log of up to `tries` calls."""
    log: list[str] = []
    for k in range(tries):
        try:
            reply = judge(prompt, k)
            score = score_of(reply)
            log.append("ok" if score is not None else f"no score in {reply!r}")
        except Exception as e:  # a remote call may fail in any way
            score = None
            log.append(f"{type(e).__name__}: {e}")
        if score is not None:
            return score, "; ".join(log)
    return 0.0, "; ".join(log)


def judged(rows: DataFrame, prompt: Column, judge: Judge = offline_judge, tries: int = 5, at_once: int = 8) -> DataFrame:
    """Adds score and log: up to `tries` calls until a reply has a score, else 0.0 and the
    failures' log. A remote judge is waited for, so each task has `at_once` calls open; results keep
    their rows' order."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for prompts in batches:
                got = list(pool.map(lambda p: ask(p, judge, tries), prompts.fillna("")))
                yield pd.DataFrame(got, columns=["score", "log"])

    call = F.pandas_udf(run, "score double, log string")
    return rows.withColumn("__j", call(prompt)).select("*", "__j.score", "__j.log").drop("__j")


def rule_then_judge(rows: DataFrame, rule: Column, prompt: Column, judge: Judge = offline_judge, at_once: int = 8) -> DataFrame:
    """Rows with answer and basis: the rule's where it gives one, else the judge's reply."""
    marked = rows.withColumn("__rule", rule)
    easy = marked.filter(F.col("__rule").isNotNull()).withColumn("answer", F.col("__rule")).withColumn("basis", F.lit("rule"))

    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(at_once) as pool:
            for prompts in batches:
                yield pd.Series(list(pool.map(lambda p: judge(p or "", 0), prompts)), dtype=object)

    call = F.pandas_udf(replies, "string")
    hard = marked.filter(F.col("__rule").isNull()).withColumn("answer", call(prompt)).withColumn("basis", F.lit("judge"))
    return easy.unionByName(hard).drop("__rule")


def with_memory(rows: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Known results as they are, `work` only on keys that are not among them."""
    fresh = rows.join(done.select(key), key, "left_anti")
    return done.unionByName(work(fresh), allowMissingColumns=True)
