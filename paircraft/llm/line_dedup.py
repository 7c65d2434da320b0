"""Cross-site boilerplate lines.

A line's spread is the number of distinct sites whose documents hold it. Each
task sketches the sites of its lines with HyperLogLog; the sketches of a line's
hash merge by aggregation. Where the estimate is within ``MARGIN`` of the
threshold, which is far more than the sketch's error, the distinct sites are
counted exactly, so the outcome equals exact counts. Lines of at least
``MIN_SITES`` sites are boilerplate and are removed from every text. A
document that is boilerplate for the most part is a copy of another page
rather than a page with boilerplate, and stays whole.

Lines are parts between newlines without surrounding ASCII white space; lines
without a word are never boilerplate. A null site is one site of its own. Null
and empty texts stay as they are; repeated rows are treated alike; an empty
table gives no rows; extra columns are kept whatever their names.

Hot lines: sketches are aggregated partially, and the join of the lines with
the boilerplate's hashes is of narrow rows that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut

MIN_SITES = 8
MARGIN = 0.2
LG_K = 12
SPACE = " \t\n\x0b\f\r"


def lines_of(docs: DataFrame, text: Column, site: Column, key: Column) -> DataFrame:
    """(key, pos, hash, site) of every line that holds a word."""
    told = F.coalesce(site.cast("string"), F.lit("\x00none"))
    d = docs.select(key.alias("key"), told.alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    d = d.select("key", "pos", "site", F.btrim("line", F.lit(SPACE)).alias("line")).where("line <> ''")
    return d.select("key", "pos", "site", F.xxhash64("line").alias("hash"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(hash) of the lines with at least ``min_sites`` distinct sites. A line
    with fewer occurrences than that has no sketch to look at."""
    spread = (lines.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_sites).select("hash", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = cut(spread.where(F.col("sites") >= min_sites * (1 - margin)))
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("hash")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("hash")
    exact = (lines.join(near, "hash", "left_semi").select("hash", "site").distinct().groupBy("hash").count()
             .where(F.col("count") >= min_sites).select("hash"))
    return cut(sure.unionByName(exact))


def without(docs: DataFrame, site: Column, text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (doc, kept, n_lines, n_boilerplate): ``doc`` holds the input's
    columns, ``kept`` the text without boilerplate."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                    F.col(f"`{text_col}`").alias("t"), site.alias("site"))
    # equal rows of a table share a key and hold the same lines
    d = d.withColumn("key", F.xxhash64(F.to_json("doc")))
    lines = lines_of(d, F.col("t"), F.col("site"), F.col("key"))
    hit = lines.join(boilerplate(lines, min_sites), "hash", "left_semi")
    places = hit.groupBy("key").agg(F.collect_set("pos").alias("drop"))
    joined = d.join(places, "key", "left")
    drop = F.coalesce("drop", F.array().cast("array<int>"))
    some = F.size(drop) > 0
    rest = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains(drop, i)), "\n")
    joined = joined.select("doc", "t", F.size(drop).cast("bigint").alias("n_boilerplate"),
                           F.when(some, rest).otherwise(F.col("t")).alias("rest"))
    mostly = F.length(F.translate("rest", SPACE, "")) * 2 < F.length(F.translate("t", SPACE, ""))
    return joined.select(
        "doc", F.when((F.col("n_boilerplate") > 0) & mostly, F.col("t")).otherwise(F.col("rest")).alias("kept"),
        F.coalesce(F.size(F.split("t", "\n")), F.lit(0)).cast("bigint").alias("n_lines"), "n_boilerplate")


def dedup(docs: DataFrame, site: Column, text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the boilerplate lines removed from their texts."""
    d = without(docs, site, text_col, min_sites)
    return d.select(*[(F.col("kept") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, site: Column, id_col: str = "doc_id", text_col: str = "text",
           min_sites: int = MIN_SITES) -> DataFrame:
    """Per row: lines, boilerplate lines among them, and the digest of the text that is left."""
    return without(docs, site, text_col, min_sites).select(
        F.col(f"doc.`{id_col}`").alias(id_col), "n_lines", "n_boilerplate",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle(table: str = "documents", min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for ``report`` with site = source."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bare = lambda x: f"length(translate({x}, {space}, ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS site, text FROM {table}),
l AS (SELECT rid, site, i, trim(parts[i], {space}) AS line, parts[i] AS raw FROM
      (SELECT rid, site, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
       FROM d WHERE text IS NOT NULL)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
m AS (SELECT l.*, b.line IS NOT NULL AS bad FROM l LEFT JOIN b USING (line)),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (bad) AS n_boilerplate,
             coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT bad), '') AS rest FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate,
       sha256(coalesce(CASE WHEN n_boilerplate > 0 AND {bare('rest')} * 2 < {bare('text')} THEN text ELSE rest END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""
