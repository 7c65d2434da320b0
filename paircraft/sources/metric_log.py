"""Append-only metric log: write events (S5), build and parse log text
(S6, X25), find pending runs (S11).

A log line is ``timestamp,caller,pid=...,k=v,...``. Values may contain
commas and several records may end up on one physical line, so parsing
first puts a newline before every timestamp and then a separator before
every ``,key=`` (no look-ahead needed, so plain SQL engines can do the same).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS_RE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},)"
KEY_RE = r",([A-Za-z_][A-Za-z0-9_]*=)"
SEP = "\x01"


def append_events(df: DataFrame, root: str, kind: str, folder: str | None = None) -> None:
    """Append metric events (one row each, any columns) as log lines to
    ``root/kind=<kind>/folder=<folder>``: ``ts,caller,pid=..,k=v`` text, written
    in append mode so concurrent writers never rewrite old records (S5)."""
    kv = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns if c not in ("ts", "caller", "pid")]
    line = F.concat_ws(",", F.col("ts"), F.col("caller"), F.concat(F.lit("pid="), F.col("pid").cast("string")), *kv)
    out = os.path.join(root, f"kind={kind}", f"folder={folder or '_'}")
    df.select(line.alias("value")).write.mode("append").text(out)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All log text rows with their kind/folder partition columns."""
    return spark.read.text(root)


#: What a finished run's file, or the folder of its files, is called.
RUN_FILE = r"gate_([^/]+)_lr([0-9.]+)_ep([0-9]+)(?:[.]pt)?(?:/[^/]*)?$"


def found_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """(model, lr, epochs, path) of the run files that a glob finds (S11), from
    the listing of the files: their paths are read, not their contents. No
    match gives no rows; files of other names are left out."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "model string, lr double, epochs int, path string")
    name = F.col("path")
    part = lambda i: F.regexp_extract(name, RUN_FILE, i)
    return files.select("path").where(name.rlike(RUN_FILE)).select(
        part(1).alias("model"), part(2).cast("double").alias("lr"), part(3).cast("int").alias("epochs"), "path")


def without_file(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs (model, lr, epochs, ...) that no found file belongs to."""
    return runs.join(found.select("model", "lr", "epochs").distinct(), ["model", "lr", "epochs"], "left_anti").select(*runs.columns)


def log_lines(runs: DataFrame) -> DataFrame:
    """(value) log text built from the ``runs`` table: runs with epochs != 10
    are logged; every value ``note`` holds a comma; a run whose id ends in 1
    modulo 50 is glued to the line of the run before it (no newline)."""
    rid = F.col("run_id")
    ts = F.format_string("2025-06-04 %02d:%02d:%02d", (rid / 3600).cast("bigint") % 24,
                         (rid / 60).cast("bigint") % 60, rid % 60)
    line = F.concat(ts, F.lit(",bench.py,pid="), rid.cast("string"), F.lit(",model="), F.col("model"),
                    F.lit(",lr="), F.format_string("%.3f", "lr"), F.lit(",seconds="),
                    F.format_string("%.2f", "seconds"), F.lit(",note=n"), (rid % 5).cast("string"), F.lit(",x"))
    lines = runs.where(F.col("epochs") != 10).select(rid, line.alias("line"))
    g = rid - F.when(rid % 50 == 1, 1).otherwise(0)
    # groups hold at most two lines (a run and the one glued to it)
    return (lines.groupBy(g.alias("g"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "line"))),
                                          lambda s: s["line"]), "").alias("value"))
            .select("value"))


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """(ts, caller, pid, attrs map, + one column per common key) from raw
    log text rows."""
    recs = (lines.select(F.explode(F.split(F.regexp_replace(col, TS_RE, "\n$1"), "\n")).alias("rec"))
                 .where(F.col("rec") != ""))
    parts = F.split(F.regexp_replace("rec", KEY_RE, SEP + "$1"), SEP)
    p = recs.select(parts.alias("parts"))
    head = F.col("parts")[0]
    kv = F.slice("parts", 2, F.size("parts") - 1)
    attrs = F.map_from_entries(F.transform(kv, lambda e: F.struct(
        F.substring_index(e, "=", 1).alias("key"),
        F.substring(e, F.instr(e, "=") + 1, F.length(e)).alias("value"))))
    out = p.select(F.substring_index(head, ",", 1).alias("ts"),
                   F.substring(head, F.instr(head, ",") + 1, F.length(head)).alias("caller"),
                   attrs.alias("attrs"))
    at = lambda k: F.try_element_at(F.col("attrs"), F.lit(k))
    return out.select("ts", "caller", at("pid").alias("pid"), at("model").alias("model"), at("lr").alias("lr"),
                      at("seconds").try_cast("double").alias("seconds"), at("note").alias("note"), "attrs")


# ---------------------------------------------------------------- oracle SQL
LOG_LINES_SQL = """
_lines AS (SELECT run_id, concat(printf('2025-06-04 %02d:%02d:%02d', (run_id // 3600) % 24, (run_id // 60) % 60,
                  run_id % 60), ',bench.py,pid=', run_id, ',model=', model, ',lr=', printf('%.3f', lr),
                  ',seconds=', printf('%.2f', seconds), ',note=n', run_id % 5, ',x') AS line
           FROM runs WHERE epochs <> 10),
_glued AS (SELECT string_agg(line, '' ORDER BY run_id) AS text FROM _lines
           GROUP BY run_id - CASE WHEN run_id % 50 = 1 THEN 1 ELSE 0 END)
"""

_FIELD = "substr(list_filter(parts, lambda e: starts_with(e, '{k}='))[1], {n})"

PARSE_SQL_CTE = """,
_recs AS (SELECT unnest(string_split(regexp_replace(text, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2},)', chr(10) || '\\1', 'g'), chr(10))) AS rec
          FROM _glued),
_parts AS (SELECT string_split(regexp_replace(rec, ',([A-Za-z_][A-Za-z0-9_]*=)', chr(1) || '\\1', 'g'), chr(1)) AS parts
           FROM _recs WHERE rec <> ''),
_parsed AS (SELECT split_part(parts[1], ',', 1) AS ts, substr(parts[1], strpos(parts[1], ',') + 1) AS caller,
            """ + ", ".join(f"{_FIELD.format(k=k, n=len(k) + 2)} AS {k}" for k in ("pid", "model", "lr", "seconds", "note")) + """
            FROM _parts)
"""

PARSE_SQL = PARSE_SQL_CTE + """
SELECT ts, caller, pid, model, lr,
       CASE WHEN abs(TRY_CAST(seconds AS DOUBLE)) < 1e12 THEN floor(TRY_CAST(seconds AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0
            ELSE TRY_CAST(seconds AS DOUBLE) END AS seconds, note FROM _parsed"""
