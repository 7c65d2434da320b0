"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Every text is searched by the patterns below; matches of a kind are leftmost
and do not overlap. A match's place follows from the text between the matches
(``split`` by the same pattern), in code points, end exclusive.

Ownership: candidates of the broader kind ``owned`` (long tokens that mix
letters and digits) are hashed, and each hash's distinct owners and distinct
repositories (an owner's parts) are counted over the whole corpus. A token
that stays with few owners, and in few repositories of each, looks like a live
credential and its span is added; one that many owners share, or that an owner
has all over the place, is a copied example, an id or a checksum, and is not. Spans of the base kinds always stay; their ownership is told by
``n_live`` and ``n_example``.

Null texts are empty; repeated rows are scanned and returned each; a null
owner or repository is one value of its own; an empty table gives no rows.
Hot values: hashes are reduced to distinct (hash, owner, repository) by partial
aggregation, and the join back is of narrow rows that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut

#: The base patterns. ``value`` is the group that holds the secret.
ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs, so dropping short ones and not matching them is the same
#: The broader kind: a whole run of token characters that holds a digit.
OWNED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "owned")
#: Distinct owners, and repositories for each of them, up to which a value counts as owned.
MAX_OWNERS, REPOS_PER_OWNER = 2, 2


def is_owned(max_owners: int = MAX_OWNERS) -> Column:
    """Few owners, and few of their repositories: wider copies are examples."""
    return (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= REPOS_PER_OWNER * F.col("n_owners"))


def spans_of(text: Column, pattern: str, kind: str, least: int, value_group: int = 0) -> Column:
    """array<struct(start, kind_no, end, kind, value)> of a pattern's matches
    whose value has ``least`` characters. ``split`` drops nothing at limit -1,
    so piece i ends where match i begins."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.split(text, pattern, -1)
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["between"])
        e = s + F.length(x["found"])
        kept = F.struct(s.alias("s"), e.alias("e"), x["values"].alias("v"))
        return F.struct(e.alias("at"), F.when(F.length(x["values"]) >= least,
                                              F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"),
                          values.alias("values"))
    located = F.aggregate(zipped, blank, step, lambda acc: acc["out"])
    return F.transform(located, lambda m: F.struct(
        m["s"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), m["e"].alias("end"),
        F.lit(kind).alias("kind"), m["v"].alias("value")))


NO_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``wide``: sorted spans of the base kinds and
    of the broader one. Each pattern is applied only to texts that a plain
    test lets through."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(NO_SPANS)

    def guarded(test: str, *args) -> Column:
        return F.when(F.rlike(text, F.lit(test)), spans_of(text, *args)).otherwise(none)

    base = F.concat(guarded(r"(?i)passw|secret|token|api_?key", ASSIGN, "assign", ASSIGN_CHARS, 2),
                    F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, "access", ACCESS_CHARS)).otherwise(none),
                    guarded(HEX, HEX, "hex", HEX_CHARS))
    wide = guarded(OWNED, OWNED, "owned", 20)
    mixed = F.filter(wide, lambda m: F.rlike(m["value"], F.lit("[A-Za-z]")))
    return docs.withColumns({"base": F.array_sort(base), "wide": mixed})


def ownership(values: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) from rows (hash, owner, repo)."""
    pairs = values.distinct()
    return pairs.groupBy("hash").agg(F.count_distinct(F.struct("owner")).alias("n_owners"),
                                     F.count(F.lit(1)).alias("n_repos"))


def located(docs: DataFrame, text: Column, owner: Column, repo: Column, keep: Column,
            max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: (row, keep, base, spans, n_live, n_example).
    ``row`` numbers the rows. The scan's result is written once, so that the
    ownership pass does not search the texts again; rows without candidates
    take no part in the joins."""
    found = cut(scan(docs.select(text.alias("text"), owner.alias("owner"), repo.alias("repo"), keep.alias("keep")))
                .select(F.monotonically_increasing_id().alias("row"), "owner", "repo", "keep", "base", "wide"))
    some = (F.size("base") > 0) | (F.size("wide") > 0)
    one = (found.where(some).select("row", "owner", "repo", F.explode(F.concat("base", "wide")).alias("m"))
           .withColumn("hash", F.xxhash64("m.value")))
    told = one.join(ownership(one.select("hash", "owner", "repo")), "hash")
    live, wide = is_owned(max_owners), F.col("m.kind") == "owned"
    per_row = told.groupBy("row").agg(
        F.collect_list(F.when(live & wide, F.struct("m.start", "m.kind_no", "m.end", "m.kind"))).alias("added"),
        F.count_if(live & ~wide).alias("n_live"), F.count_if(~live & ~wide).alias("n_example"))
    base = F.transform("base", lambda m: F.struct(m["start"], m["kind_no"], m["end"], m["kind"]))
    # a candidate that meets a base span adds nothing
    added = F.filter("added", lambda a: ~F.exists("base", lambda m: (a["start"] < m["end"]) & (m["start"] < a["end"])))
    nothing = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    with_spans = found.where(some).join(per_row, "row").select(
        "row", "keep", base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"), "n_live", "n_example")
    return with_spans.unionByName(found.where(~some).select(
        "row", "keep", nothing.alias("base"), nothing.alias("spans"), F.lit(0).cast("bigint").alias("n_live"),
        F.lit(0).cast("bigint").alias("n_example")))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def report(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every row; ``owner`` and ``repo`` are expressions over ``docs``."""
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("bigint")
    return located(docs, F.col(text_col), owner, repo, F.col(id_col)).select(
        F.col("keep").alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        "n_live", "n_example")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each span; spans that meet share one mark."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        plain = F.concat(acc["out"], F.substr(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit(mark))
        fresh = m["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(fresh, plain).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def redact(docs: DataFrame, owner: Column, repo: Column, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows without spans, null
    texts among them, stay as they are."""
    found = located(docs, F.col(text_col), owner, repo, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    text = F.col(f"keep.`{text_col}`")
    clean = F.when(F.size("spans") > 0, masked(text, F.col("spans"), mark)).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col(f"keep.`{c}`")).alias(c) for c in docs.columns])


def oracle(table: str = "documents", max_owners: int = MAX_OWNERS) -> str:
    """DuckDB SQL for ``report`` with owner = source and repository = (source, lang)."""
    def kind_sql(no: int, kind: str, pattern: str, least: int, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""
SELECT rid, {no} AS kind_no, '{kind}' AS kind, unnest(range(1, len(found) + 1)) AS i, found, vals, between, {least} AS least
FROM (SELECT rid, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {group}) AS vals,
             regexp_split_to_array(t, '{p}') AS between FROM d WHERE regexp_matches(t, '{p}'))"""
    parts = [kind_sql(0, "assign", ASSIGN.replace(r"\x20", " "), ASSIGN_CHARS, 2), kind_sql(1, "access", ACCESS, ACCESS_CHARS),
             kind_sql(2, "hex", HEX, HEX_CHARS), kind_sql(3, "owned", r"[A-Za-z0-9+/_-]{20,}", 20)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM {table}),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT rid, kind_no, kind, vals[i] AS v,
        CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st,
        length(found[i]) AS n FROM m WHERE length(vals[i]) >= least
        AND (kind <> 'owned' OR (regexp_matches(vals[i], '[0-9]') AND regexp_matches(vals[i], '[A-Za-z]')))),
o AS (SELECT v, count(DISTINCT source) + max(CAST(source IS NULL AS INT)) AS owners, count(DISTINCT {{'s': source, 'l': lang}}) AS repos
  FROM s JOIN d USING (rid) GROUP BY v),
a AS (SELECT s.*, st + n AS en, owners <= {max_owners} AND repos <= {REPOS_PER_OWNER} * owners AS live FROM s JOIN o USING (v)),
k AS (SELECT * FROM a WHERE kind <> 'owned' OR (live AND NOT EXISTS (SELECT 1 FROM a b WHERE b.rid = a.rid AND b.kind <> 'owned'
      AND a.st < b.en AND b.st < a.en))),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, kind_no) FILTER (kind <> 'owned') AS base,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, kind_no) AS spans,
        count(*) FILTER (kind <> 'owned' AND live) AS n_live, count(*) FILTER (kind <> 'owned' AND NOT live) AS n_example
      FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)"""
