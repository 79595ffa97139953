"""Readers and writers by suffix, directory scans and text-format scans.

Everything goes through Spark's readers, so any path that Spark can open will do. Schemas can
be given; without one, JSON and delimited files are read with all columns as strings rather
than by a second pass that guesses types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions.binding import bind

FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".md": "text"}


def kind_of(path: str) -> str:
    for suffix, kind in FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"no reader for {path}")


def read(spark: SparkSession, paths: str | Sequence[str], kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of one or more files of one kind; several kinds raise."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {kind or kind_of(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("all files of a dataset share one kind")
    kind = kinds.pop()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").option("primitivesAsString", schema is None).json(paths)
    if kind in ("csv", "tsv"):
        return reader.csv(paths, sep="\t" if kind == "tsv" else ",", header=True, multiLine=True, escape='"', nanValue="nan", nullValue="nan")
    return reader.text(paths) if kind == "text" else reader.format(kind).load(paths)


def write(rows: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    """The writer of the path's kind; delimited files quote every value."""
    kind, w = kind or kind_of(path), rows.write.mode(mode)
    if kind in ("csv", "tsv"):
        w.csv(path, sep="\t" if kind == "tsv" else ",", header=True, quoteAll=True, escape='"')
    elif kind in ("json", "jsonl"):
        w.json(path)
    else:
        w.format("text" if kind == "text" else kind).save(path)


def listing(spark: SparkSession, folder: str, include: Sequence[str] = (), exclude: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """path, size and modification time of files; every included text must be in the path and
    no excluded one. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")
    for text in include:
        files = files.filter(F.contains("path", F.lit(text)))
    for text in exclude:
        files = files.filter(~F.contains("path", F.lit(text)))
    return files


def binary_base64(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", F.base64("content").alias("base64"))


def kind_of_value(value: Column) -> Column:
    """What a cell holds: an embedded image, a link's media type, or text."""
    ext = F.lower(F.regexp_extract(value, r"\.([A-Za-z0-9]+)$", 1))
    media = F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(ext.isin("mp4", "avi", "mov"), "video").when(ext.isin("wav", "mp3"), "audio").otherwise("url")
    return F.when(F.startswith(value, F.lit("data:image")), "image").when(value.rlike("^https?://"), media).otherwise("text")


def yolo_lines(text: Column) -> Column:
    """class, centre and size of each line of exactly five numbers."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda y: y != "")), lambda p: F.size(p) == 5)
    num = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    return F.transform(rows, lambda p: F.struct(F.get(p, F.lit(0)).alias("label"), num(p, 1).alias("cx"), num(p, 2).alias("cy"), num(p, 3).alias("w"), num(p, 4).alias("h")))


def key_value(cells: Column) -> Column:
    """The first non-empty cell as key, the others joined by a blank as value; null unless both
    are there."""
    full = F.filter(F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), lambda c: c != "")
    rest = F.regexp_replace(F.array_join(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), " "), r"^[ :;,.]+|[ :;,.]+$", "")
    return F.when((F.size(full) > 1) & (rest != ""), F.struct(F.get(full, F.lit(0)).alias("key"), rest.alias("value")))


def transcript_turns(text: Column, human: str = "\n\nHuman: ", model: str = "\n\nAssistant: ") -> Column:
    """Turns of a transcript with speaker marks, in order."""
    marked = F.replace(F.replace(text, F.lit(human), F.lit("\x01user\x02")), F.lit(model), F.lit("\x01assistant\x02"))
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02")))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("role"), F.substring_index(p, "\x02", -1).alias("content")))


def transcript_pair(chosen: Column, rejected: Column, human: str = "\n\nHuman: ", model: str = "\n\nAssistant: ") -> Column:
    """history (query and response of each earlier exchange), instruction, chosen and rejected of two
    transcripts that differ in the last reply. A transcript is read from the right: what stands
    behind the last mark is the reply, before it the instruction."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def exchange(part: Column) -> Column:
        """Query and response of the text behind a human mark; null without a reply."""
        at = F.instr(part, model)
        reply = F.substring(part, at + len(model), F.length(part))
        return F.when(at > 0, F.struct(strip(F.substring(part, F.lit(1), at - 1)).alias("query"), strip(reply).alias("response")))

    def whole(parts: Column) -> Column:
        said = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), exchange)
        last = F.element_at(said, -1)
        earlier = F.filter(F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0))), lambda x: x.isNotNull())
        other = strip(F.element_at(F.split(rejected, rf"\Q{model}\E"), -1))
        return F.struct(earlier.alias("history"), last["query"].alias("instruction"), last["response"].alias("chosen"), other.alias("rejected"))

    return bind(F.split(chosen, rf"\Q{human}\E"), whole)


#: Which kind of file an artifact's suffix asks for.
ARTIFACTS = {"pkl": ("_tmp", "_response", "_processed"), "json": ("_rating", "_config", "_meta"), "csv": ("_acc", "_fine", "_metrics")}


def artifact_path(path: str, suffix: str, kind: str | None = None, otherwise: str = "xlsx") -> str:
    """Where an artifact of a results file lies: its suffix in front of the kind, which follows from
    the suffix unless it is given."""
    found = kind or next((k for k, names in ARTIFACTS.items() if suffix in names), otherwise)
    stem, dot, old = path.rpartition(".")
    return path.replace(f".{old}", f"{suffix}.{found}") if dot else path


def image_aliases(rows: DataFrame, index: str, image: str, longest: int = 64) -> DataFrame:
    """Image cells of at most `longest` characters name another row's index and take its image."""
    short = (F.length(image) <= longest) & (F.col(image) != "nan")
    target = rows.filter(~short).select(F.col(index).cast("string").alias("__i"), F.col(image).alias("__image"))
    out = rows.join(target, F.when(short, F.col(image)) == F.col("__i"), "left")
    return out.withColumn(image, F.when(short, F.col("__image")).otherwise(F.col(image))).drop("__i", "__image")


def latest_run(runs: DataFrame, by: Sequence[str], run: str, path: str) -> DataFrame:
    """For each key the path of the newest run."""
    return runs.groupBy(*by).agg(F.max_by(path, run).alias(path), F.max(run).alias(run))


def composite(parts: dict[str, DataFrame], index: str) -> DataFrame:
    """Union of benchmarks with their name, their own index and a new dense index. The new
    index is the rank within a part plus the sizes of the parts before it."""
    from corpuswright.operators.ordering import rank_all

    out, base = None, 0
    for name in sorted(parts):
        p = rank_all(parts[name].withColumnRenamed(index, "original_index"), ["original_index"], index).withColumn(index, F.col(index) + F.lit(base)).withColumn("SUB_DATASET", F.lit(name))
        base += parts[name].count()
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    assert out is not None
    return out


def append_rows(old: DataFrame, new: DataFrame, index: str, order: str) -> DataFrame:
    """new below old, with an index that goes on from old's largest."""
    from corpuswright.operators.ordering import rank_all

    top = old.agg(F.coalesce(F.max(index), F.lit(0))).first()[0]
    numbered = rank_all(new, [order], index).withColumn(index, F.col(index) + F.lit(top + 1))
    return old.unionByName(numbered, allowMissingColumns=True)


def flatten_json(rows: DataFrame, column: str, element: str) -> DataFrame:
    """Objects of JSON texts that hold an object or a list of them; the rest is dropped."""
    text = F.trim(F.col(column))
    many = F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<{element}>")).otherwise(F.array(F.from_json(text, element)))
    return rows.select(F.explode(many).alias("item")).filter("item IS NOT NULL").select("item.*")


def line_range(rows: DataFrame, order: str, first: int, last: int) -> DataFrame:
    from corpuswright.operators.ordering import rank_all

    return rank_all(rows, [order], "line").filter(F.col("line").between(first, last))
