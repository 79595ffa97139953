"""Dataset registry: names to specifications, and specifications to canonical columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical column names and their defaults by format.
DEFAULTS = {
    "alpaca": {"prompt": "instruction", "query": "input", "response": "output", "history": None},
    "sharegpt": {"messages": "conversations"},
}
TAGS = {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system"}
MEDIA = ("system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
LOCATIONS = ("table", "script", "cloud", "file")  # in order of precedence


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lies and how its columns are called."""

    name: str
    kind: str
    location: str
    formatting: str = "alpaca"
    ranking: bool = False
    split: str = "train"
    num_samples: int | None = None
    columns: Mapping[str, str | None] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)

    def column(self, canonical: str) -> str | None:
        """The source column for a canonical one. A given block replaces all defaults: what it
        does not list is absent."""
        if self.columns:
            return self.columns.get(canonical)
        return DEFAULTS[self.formatting].get(canonical)

    def tag(self, name: str) -> str | None:
        """What a tag is called. A given block replaces all defaults, as with columns."""
        return self.tags.get(name) if self.tags else TAGS[name]


def load_specs(source: Mapping | str, names: list[str] | None = None) -> list[DatasetSpec]:
    """Specifications of the named datasets, from a mapping or JSON text; an unknown name, an
    unknown format or an entry without a location raises."""
    entries = json.loads(source) if isinstance(source, str) else dict(source)
    out = []
    for name in names if names is not None else entries:
        if name not in entries:
            raise ValueError(f"undefined dataset {name}")
        e = entries[name]
        found = [k for k in LOCATIONS if e.get(k)]
        if not found:
            raise ValueError(f"{name} has no location")
        formatting = e.get("formatting", "alpaca")
        if formatting not in DEFAULTS:
            raise ValueError(f"{name}: unknown formatting {formatting}")
        out.append(DatasetSpec(name, found[0], e[found[0]], formatting, bool(e.get("ranking")), e.get("split", "train"), e.get("num_samples"), e.get("columns", {}), e.get("tags", {})))
    return out


def to_canonical(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Source columns under canonical names; absent ones are typed nulls."""
    wanted = [*DEFAULTS[spec.formatting], *MEDIA]

    def one(canonical: str) -> Column:
        src = spec.column(canonical)
        return (F.col(f"`{src}`") if src and src in rows.columns else F.lit(None).cast("string")).alias(canonical)

    return rows.select(*[one(c) for c in wanted])


Converter = Callable[[DataFrame, DatasetSpec], DataFrame]
_CONVERTERS: dict[str, Converter] = {}


def register_converter(name: str, converter: Converter) -> None:
    if name in _CONVERTERS:
        raise ValueError(f"{name} is registered already")
    _CONVERTERS[name] = converter


def converter(name: str) -> Converter:
    if name not in _CONVERTERS:
        raise ValueError(f"no converter {name}")
    return _CONVERTERS[name]


def snippet(name: str, file: str) -> str:
    """A registry entry for a written conversation file."""
    entry = {"file": file, "formatting": "sharegpt", "columns": {"messages": "conversations", "images": "images"}}
    return json.dumps({name: entry}, indent=2, ensure_ascii=False)


def scan(spark: SparkSession, spec: DatasetSpec, root: str = "", seed: int = 42, order: str | None = None) -> DataFrame:
    """The rows of a file or folder dataset under canonical names; a folder's files are of one kind.
    `num_samples` rows are drawn: whole copies first, then the first by a hash of `order` (by default of
    the whole row)."""
    from corpuswright.operators.ordering import sample_exact
    from corpuswright.sources import files

    path = f"{root}/{spec.location}" if root else spec.location
    try:
        rows = files.read(spark, path)
    except ValueError:  # a folder: its files say what they are
        kinds = {files.kind_of(r.path) for r in files.listing(spark, path, exclude=["/_", "/."]).select("path").toLocalIterator()}
        if len(kinds) != 1:
            raise ValueError(f"{spec.name}: the files of a folder share one kind") from None
        rows = files.read(spark, path, kinds.pop())
    if spec.num_samples:
        rows = rows.withColumn("__key", F.col(order) if order else F.to_json(F.struct(*rows.columns)))
        rows = sample_exact(rows, "__key", spec.num_samples, seed).drop("__key")
    return to_canonical(rows, spec)


def check_merge(specs: list[DatasetSpec], ranking_stage: bool) -> None:
    """Ranking datasets fit ranking stages only, and the other way round."""
    for s in specs:
        if s.ranking != ranking_stage:
            raise ValueError(f"{s.name} does not fit the stage")


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
