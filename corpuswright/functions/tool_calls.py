"""Tool calls in the dialects of chat formats: written from and read back to (name, arguments).

Reading goes through JSON parsers that must agree with how arguments are written (", " and ": " between
values, letters as they are), which Spark's own JSON functions do not offer, so it is a pandas UDF
over Arrow batches. A text that is not made of calls, or with a call that is no valid JSON, has no
calls and stays a text.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Call = tuple[str, str]


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _objects(text: str, key: str) -> list[Call]:
    """Calls of a JSON object or a list of them, with the arguments under `key`."""
    got = json.loads(text)
    return [(x["name"], _dump(x[key])) for x in (got if isinstance(got, list) else [got])]


def _actions(text: str) -> list[Call]:
    starts = list(re.finditer(r"Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*", text))
    ends = [m.start() for m in starts[1:]] + [len(text)]
    out = []
    for m, end in zip(starts, ends):
        body = text[m.end() : end].strip()
        out.append((m[1], _dump(json.loads(body.strip('"').strip("`")))))
    return out


def _name_and_line(text: str) -> list[Call]:
    name, line, body = text.partition("\n")
    return [(name, _dump(json.loads(body.strip())))] if line else []


def _tagged(text: str) -> list[Call]:
    return [c for body in re.findall(r"<tool_call>(.*?)</tool_call>", text, re.DOTALL) for c in _objects(body.strip(), "arguments")]


#: Dialects by name: how a text's calls are read.
READERS = {
    "actions": _actions,  # Action: name, Action Input: {...}
    "name_line": _name_and_line,  # the name on the first line, JSON below
    "parameters": lambda t: _objects(t.strip(), "parameters"),  # {"name": .., "parameters": {..}} or a list
    "arguments": lambda t: _objects(t.strip(), "arguments"),  # [{"name": .., "arguments": {..}}]
    "tagged": _tagged,  # <tool_call>{"name": .., "arguments": {..}}</tool_call>
}


def read(text: str | None, dialect: str) -> list[Call] | None:
    """The calls of a text, or None for a plain text."""
    try:
        return READERS[dialect](text or "") or None
    except (ValueError, KeyError, TypeError):
        return None


CALLS = "array<struct<name: string, arguments: string>>"


def calls(text: Column, dialect: str) -> Column:
    """(name, arguments) of the calls; null where the text is none."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (got := read(t, dialect)) is None else [{"name": n, "arguments": a} for n, a in got] for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, CALLS)(text)


def written(calls: Column, dialect: str) -> Column:
    """The text of calls in a dialect."""
    obj = lambda c, key: F.concat(F.lit('{"name": "'), c["name"], F.lit(f'", "{key}": '), c["arguments"], F.lit("}"))
    if dialect == "actions":
        return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("Action: "), c["name"], F.lit("\nAction Input: "), c["arguments"])), "\n")
    if dialect == "name_line":
        return F.concat(calls[0]["name"], F.lit("\n"), calls[0]["arguments"])
    if dialect == "tagged":
        return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("<tool_call>\n"), obj(c, "arguments"), F.lit("\n</tool_call>"))), "\n")
    listed = F.array_join(F.transform(calls, lambda c: obj(c, dialect)), ", ")
    many = F.concat(F.lit("["), listed, F.lit("]"))
    return many if dialect == "arguments" else F.when(F.size(calls) == 1, listed).otherwise(many)


def function_slot(content: Column, slot: str, dialect: str, thought: tuple[str, str] = ("<think>", "</think>")) -> Column:
    """A function message, JSON with or without a thought, in a dialect and a slot: the thought stays in
    front. Null for content that is no valid JSON."""
    from corpuswright.functions.templates import fill

    pattern = rf"(?s)\Q{thought[0]}\E.*?\Q{thought[1]}\E"
    mind = F.regexp_extract(content, pattern, 0)
    got = calls(F.replace(content, mind), "arguments")
    return fill(slot, content=F.concat(mind, written(got, dialect)))
