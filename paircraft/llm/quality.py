"""Quality rules as a learned decision list, in DataFrame functions only.

The measures of a text come from columns alone. ``learn`` grows an ordered
list of rules by sequential covering: the labelled rows are split by a hash in
a growing and a pruning part; a rule starts empty and takes, one at a time,
the threshold condition with the best gain (information gain over the bad
rows that stay covered); conditions are then dropped from its end while
the value on the pruning part does not fall; rows that the rule covers
leave both parts, and the next rule is grown, until no rule is precise
enough. The statistics behind every choice are counts of good and bad rows per
measure and threshold bin, one aggregation of ``measures x bins`` numbers
over all labelled rows. The list becomes one CASE expression.

Words are runs ``[^\\x20\\x09-\\x0D]+``. Null texts have no words and fail.
Labels that are null or not 0/1 are left out; a document labelled more than
once counts once per label. Without labels of both kinds the list is empty and
only the base rules hold. Repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paircraft.llm.common import cut

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: Parameters of the learner.
BINS, MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 32, 8, 3, 20, 0.9
SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"

MEASURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "distinct_share", "words_per_line", "stop_share"]


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def window_hashes(hashes: Column) -> Column:
    """Hashes of the 5-word windows, in text order, from the words' hashes."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) <= WINDOW, F.array().cast("array<bigint>")).otherwise(windows)


def placed_windows(windows: Column) -> Column:
    """The windows sorted by (hash, place), so that equal ones are neighbours."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def covered_words(placed: Column) -> Column:
    """Size of the union of the windows whose hash occurs again: their places,
    in order, each add the words that the window before did not cover.
    ``placed`` must be a column of its own, as the lambda reads it at each place."""
    again = F.filter(
        F.transform(placed, lambda x, j: F.when(
            (F.get(placed, j - 1)["h"] == x["h"]) | (F.get(placed, j + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull())
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(again), begin,
                       lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
                       lambda acc: acc["n"])


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, measures...); ``doc`` holds the input's columns."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    squeezed = F.translate("t", SPACE, "")
    d = d.select("doc", "t", word_list(F.col("t")).alias("w"), F.length(squeezed).alias("word_chars"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    d = d.select("doc", "t", "word_chars", F.size("w").alias("n_words"),
                 F.transform("w", lambda w: F.xxhash64(w)).alias("h"), lines.alias("l"))
    d = d.select("doc", "t", "word_chars", "n_words", F.size("l").alias("n_lines"),
                 (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
                 F.size(F.array_distinct("h")).alias("n_distinct"), window_hashes(F.col("h")).alias("win"))
    d = d.withColumn("placed", F.when(F.size("win") > F.size(F.array_distinct("win")), placed_windows(F.col("win"))))
    repeats = F.coalesce(covered_words(F.col("placed")), F.lit(0))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    d = d.select("doc", "word_chars", "n_words", "n_lines", "n_dup_lines", "n_distinct", repeats.alias("n_repeat_words"),
                 without(SYMBOLS).alias("n_symbols"),
                 without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"), without("0123456789").alias("digit"),
                 without(".!?").alias("stops"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words").cast("bigint") * 100
                                                > F.col("n_words").cast("bigint") * MAX_REPEATED)
    return d.select(
        "doc", long("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"), long("n_repeat_words"),
        failed.alias("base_failed"), F.struct(
            F.col("n_words").cast("double").alias("n_words"), share("word_chars", "n_words").alias("mean_word"),
            share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"),
            share("digit", "word_chars").alias("digit_share"), share("n_distinct", "n_words").alias("distinct_share"),
            share("n_words", "n_lines").alias("words_per_line"), share("stops", "n_words").alias("stop_share")).alias("m"))


@dataclass(frozen=True)
class Condition:
    """measure > limit (``above``) or measure <= limit; the limit is the
    measure's threshold number ``step``."""
    measure: str
    above: bool
    step: int
    limit: float

    def column(self) -> Column:
        c = F.col(f"m.{self.measure}")
        return c > self.limit if self.above else c <= self.limit

    def binned(self) -> Column:
        """The same over the array ``b`` of bin numbers."""
        c = F.col("b")[MEASURES.index(self.measure)]
        return c > self.step if self.above else c <= self.step


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are bad."""
    conditions: tuple[Condition, ...]

    def column(self, binned: bool = False) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & (c.binned() if binned else c.column())
        return out

    def text(self) -> str:
        return " and ".join(f"{c.measure} {'>' if c.above else '<='} {c.limit:.6g}" for c in self.conditions)


def verdict(rules: list[Rule], binned: bool = False) -> Column:
    """Ordered CASE: the first rule that fits makes a row bad, else it is good."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(r.column(binned), False).otherwise(out)
    return out


def edges_of(labelled: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Thresholds of each measure: its quantiles over the labelled rows."""
    row = labelled.agg(*[F.percentile_approx(f"m.{m}", [i / bins for i in range(1, bins)], 10_000).alias(m)
                         for m in MEASURES]).first()
    return {m: sorted(set(row[m] or [])) for m in MEASURES}


def bins_of(edges: dict[str, list[float]]) -> Column:
    """Array of each measure's bin number: how many thresholds the value exceeds."""
    def one(m: str) -> Column:
        limits = F.array(*[F.lit(e) for e in edges[m]]).cast("array<double>")
        return F.size(F.filter(limits, lambda e: e < F.col(f"m.{m}")))
    return F.array(*[one(m) for m in MEASURES])


def bin_counts(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per measure and threshold: the (bad, good) rows above it; at "" those of
    all rows. One aggregation for all measures; the driver sees measures x
    bins numbers."""
    found = (rows.select("bad", F.posexplode("b").alias("at", "bin")).groupBy("at", "bin", "bad").count()).collect()
    exact = {(r["at"], r["bin"], r["bad"]): r["count"] for r in found}
    over = lambda at, i, bad: sum(exact.get((at, j, bad), 0) for j in range(i + 1, len(edges[MEASURES[at]]) + 1))
    out = {m: [(over(at, i, 1), over(at, i, 0)) for i in range(len(edges[m]))] for at, m in enumerate(MEASURES)}
    out[""] = [(over(0, -1, 1), over(0, -1, 0))]
    return out


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Bad rows kept, times the information they gain."""
    if not p or not p0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def grow(rows: DataFrame, edges: dict[str, list[float]], max_conditions: int, min_cover: int) -> Rule:
    conditions: list[Condition] = []
    while len(conditions) < max_conditions:
        counts = bin_counts(rows.where(Rule(tuple(conditions)).column(True)), edges)
        p0, n0 = counts[""][0]
        if not n0:
            break
        best = (1e-9, None)
        for m in MEASURES:
            for i, (p, n) in enumerate(counts[m]):
                for above, (a, b) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                    if a + b >= min_cover and (g := gain(a, b, p0, n0)) > best[0]:
                        best = (g, Condition(m, above, i, edges[m][i]))
        if best[1] is None:
            break
        conditions.append(best[1])
    return Rule(tuple(conditions))


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the conditions with the highest (bad - good) / covered on
    the pruning part, longer ones first; with its bad and good rows there."""
    prefixes = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
    r = rows.agg(*[F.count_if(x.column(True) & (F.col("bad") == b)).alias(f"{i}:{b}")
                   for i, x in enumerate(prefixes) for b in (0, 1)]).first()
    value = lambda p, n: (p - n) / (p + n) if p + n else -1.0
    i = max(range(len(prefixes)), key=lambda i: (value(r[f"{i}:1"], r[f"{i}:0"]), -i))
    return prefixes[i], r[f"{i}:1"], r[f"{i}:0"]


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
          min_cover: int = MIN_COVER, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Decision list from rows (key bigint, bad 0/1, m); all rows count."""
    edges = edges_of(labelled)
    rows = cut(labelled.select("bad", bins_of(edges).alias("b"), (F.pmod(F.xxhash64("key"), F.lit(3)) < 2).alias("growing")))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(verdict(rules, True))
        rule = grow(left.where("growing"), edges, max_conditions, min_cover)
        if not rule.conditions:
            break
        rule, p, n = prune(left.where("not growing"), rule)
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(rule)
    return rules


def labelled_rows(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Measures of labelled documents that pass the base rules (the list is for the others)."""
    lab = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), (1 - F.col(label_col)).alias("bad"))
    own = measured.where("not base_failed").select(F.col(f"doc.`{id_col}`").alias("own"), "m")
    return own.join(lab, F.col("own") == F.col("key")).select("key", "bad", "m")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """Counts, base rules and the learned list's verdict per row. The measures
    are narrow and written once."""
    measured = cut(with_measures(docs.select(F.col(id_col), F.col(text_col).alias("text")))
                   .withColumn("doc", F.struct(F.col(f"doc.`{id_col}`").alias(id_col))))
    rules = learn(labelled_rows(measured, labels, id_col, label_col))
    return measured.select(F.col(f"doc.`{id_col}`").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
