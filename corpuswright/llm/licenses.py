"""Licence scans by sparse TF-IDF cosine to templates and inheritance along directories.

Every sentence or line, every block between blank lines (a header wrapped over lines is one) and the
text as a whole is a unit; units and templates are sparse TF-IDF vectors. A document's own
licence is that of its best unit's template at a cosine of `least` or more. Licence files give
theirs to the directory they lie in, and documents without a licence of their own take that
of the nearest ancestor directory, by equality joins on the ancestors' paths. DataFrame
operations only.

A token's weight follows the share of all documents that have it, counted over the whole table;
shares below `rare` count as `rare`, so weights do not drift with the table's size, and only tokens above it
are kept: at most (mean distinct tokens of a document) / rare of them, however large the table is.
No unit is left out that could reach `least`: by the inequality of Cauchy and Schwarz it must
have one of the template's heaviest tokens that together hold over 1 - least**2 of its square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions.binding import bind

from .common import join_one, materialise, remove
from .license_texts import templates as known_templates

SENTENCE = r"[.!?;]\s+|\n"
BLOCK = r"\n[^\p{L}\p{N}\n]*\n"  # a line without letters or digits ends a block, comment marks or not
TOKEN = r"[a-z0-9]+(?:[.-][0-9]+)*"
LEAST, RARE = 0.8, 0.01
MOST_COMMON = 2_000_000  # tokens above `rare` that may be broadcast
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

TEMPLATES = known_templates()


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license string, notice string")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Whole licence texts as templates: each file of a folder, named after its licence."""
    texts = spark.read.text(folder, wholetext=True)
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), r"\.txt$", "")
    return texts.select(name.alias("license"), F.col("value").alias("notice"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def times(tf: Column) -> Column:
    """The weight of a token that a unit has tf times."""
    return 1 + F.ln(tf)


def weight(share: Column) -> Column:
    return F.log1p(F.lit(1.0) / share)


def common_tokens(files: DataFrame, text_col: str, n: int, rare: float = RARE) -> tuple[DataFrame, str]:
    """token, idf of the tokens that over `rare` of the n files have; a stored table and its path."""
    seen = files.select(F.explode(F.array_distinct(tokens(F.col(text_col).cast("string")))).alias("token")).groupBy("token").count()
    share = F.col("count") / F.lit(float(n or 1))
    return materialise(seen.filter(share > rare).select("token", weight(share).alias("idf")), "common-tokens")


def template_vectors(templates: DataFrame, common: DataFrame, rare: float = RARE) -> list[tuple]:
    """(token, number, licence, weight) of the normalised template vectors. What comes to the
    driver is the templates and one number for each token of theirs."""
    known = sorted({(r["license"], tuple(sorted(r["t"]))) for r in templates.select("license", tokens(F.col("notice")).alias("t")).collect() if r["t"]})
    vocabulary = common.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts in known for t in ts})], "token string") if known else common.select("token")
    idf = {r["token"]: r["idf"] for r in common.join(F.broadcast(vocabulary), "token").collect()}
    vectors = []
    for number, (name, ts) in enumerate(known):
        w = {t: (1 + math.log(ts.count(t))) * idf.get(t, math.log1p(1 / rare)) for t in set(ts)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors += [(t, number, name, x / norm) for t, x in sorted(w.items())]
    return vectors


def signature(vectors: list[tuple], least: float) -> list[str]:
    """Tokens one of which every unit has that reaches `least` with some template: of each
    template the heaviest, until they hold over 1 - least**2 of its squared length."""
    own: dict[int, list] = {}
    for token, number, _, x in vectors:
        own.setdefault(number, []).append((-x * x, token))
    out = set()
    for parts in own.values():
        left = 1 - least * least + 1e-6
        for square, token in sorted(parts):
            out.add(token)
            left += square
            if left < 0:
                break
    return sorted(out)


def units(text: Column, wanted: list[str]) -> Column:
    """[(kind, line, last, tokens)] of the sentences, blocks and the whole text that have one of the
    wanted tokens. Texts without any are not cut up."""
    sought = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")

    def cut(kind: int, parts: Column) -> Column:
        number = lambda p: F.transform(p, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("line"), (i == F.size(p) - 1).alias("last"), tokens(s).alias("tokens")))
        return bind(parts, number)

    def cuts(trimmed: Column) -> Column:
        each = F.concat(cut(0, F.split(trimmed, SENTENCE)), cut(1, F.split(trimmed, BLOCK)), cut(2, F.array(trimmed)))
        return F.filter(each, lambda u: F.arrays_overlap(u["tokens"], sought))

    return F.when(F.arrays_overlap(tokens(text), sought), bind(F.regexp_replace(text, r"\s+$", ""), cuts))


def own_licences(terms: DataFrame, common: DataFrame, vectors: list[tuple], least: float, rare: float = RARE) -> DataFrame:
    """row, license, score, kind, line, last for the terms (row, kind, line, last, token, tf) of
    units. Weighted terms meet the templates' terms by equality on the token and are summed;
    the templates' side is broadcast, as its size is that of the templates, and so are the common tokens,
    up to MOST_COMMON."""
    key = ["row", "kind", "line", "last"]
    sides = terms.sparkSession.createDataFrame(vectors or [("", 0, "", 0.0)], "token string, t int, license string, x double")
    sides = sides.groupBy("token").agg(F.collect_list(F.struct("t", "license", "x")).alias("sides"))
    met = terms.join(F.broadcast(common) if common.count() <= MOST_COMMON else common, "token", "left").withColumn("w", times(F.col("tf")) * F.coalesce("idf", F.lit(math.log1p(1 / rare))))
    # Per unit, one row: the norm over all its terms, and its terms that templates have. The templates'
    # weights join only then, so that they are not shuffled.
    met = met.join(F.broadcast(sides.select("token", F.lit(True).alias("shared"))), "token", "left").groupBy(*key)
    parts = met.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("shared"), F.struct("token", "w"))).alias("met"))
    dots = parts.select(*key, "norm", F.explode(F.array_sort("met")).alias("m")).select(*key, "norm", "m.token", "m.w")
    dots = dots.join(F.broadcast(sides), "token").select(*key, "norm", "w", F.explode("sides").alias("x"))
    dots = dots.groupBy(*key, "norm", F.col("x.t").alias("t"), F.col("x.license").alias("license")).agg(F.sum(F.col("w") * F.col("x.x")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "line", "license", "last")).alias("b"))
    return best.select("row", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "b.kind", "b.line", "b.last")


def ancestors(path: Column) -> Column:
    """[(directory, distance)] of a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.array_join(F.slice(parts, 1, n - k), "/").alias("directory"), k.alias("distance")))


def scan(files: DataFrame, templates: DataFrame, is_licence_file: Column | None = None, least: float = LEAST, rare: float = RARE, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, score, basis (own, inherited or none) and origin (the directory
    it comes from) for each row of files.

    `is_licence_file` is a condition on path and on the best unit (kind: 0 sentence, 1 block, 2 whole
    text; line: its number among these; last); by default the file's name decides. Equal scores
    go to the smaller kind, the earlier unit, then the licence's name. Of several licence files in
    a directory the best score wins, then the smaller id, then the licence's name. Null paths
    lie in the root, null and empty texts have no licence. An empty table gives an empty result.
    """
    n = files.count()
    common, common_path = common_tokens(files, text_col, n, rare)
    vectors = template_vectors(templates, common, rare)
    text = F.col(text_col).cast("string")
    narrow = files.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), units(text, signature(vectors, least)).alias("units"), F.monotonically_increasing_id().alias("row"))
    base, base_path = materialise(narrow, "licence-units")
    each = base.select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.line", "u.last", F.explode("u.tokens").alias("token"))
    terms = each.groupBy("row", "kind", "line", "last", "token").agg(F.count("*").alias("tf"))
    found = own_licences(terms, common, vectors, least, rare)
    if is_licence_file is None:
        is_licence_file = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    rows, _ = materialise(base.select("doc_id", "path", "row").join(found, "row", "left").drop("row"), "licensed")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    given = rows.filter(F.col("license").isNotNull() & is_licence_file).groupBy(directory.alias("directory"))
    given = given.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("doc_id"), F.col("license"))).alias("g")).select("directory", F.col("g.license").alias("given"), (-F.col("g.s")).alias("given_score"))
    # Directories, not documents, look for their nearest licensed ancestor: a hot directory
    # is one row there, and comes back to its documents by a join that spreads hot keys.
    dirs = rows.select(directory.alias("dir")).distinct()
    chain = dirs.select("dir", F.explode(ancestors(F.concat("dir", F.lit("/")))).alias("a")).select("dir", "a.directory", "a.distance")
    chain = chain.join(given, "directory")
    nearest, _ = materialise(chain.groupBy("dir").agg(F.min(F.struct("distance", "directory", "given", "given_score")).alias("m")), "nearest")
    remove(files.sparkSession, common_path, base_path)
    out = join_one(rows.withColumn("dir", directory), nearest, "dir")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "m.given").alias("license"), F.coalesce("score", "m.given_score").alias("score"),
        F.when(own, "own").when(F.col("m.given").isNotNull(), "inherited").otherwise("none").alias("basis"), F.when(own, F.col("path")).otherwise(F.col("m.directory")).alias("origin"),
    )
