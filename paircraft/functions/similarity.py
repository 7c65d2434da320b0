"""Pair similarity expressions (X8, X11 containment, X12, X16, X17).

Native column expressions; the edit-distance family (X10/X11) lives in
``paircraft.functions.edit`` because it needs an Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paircraft.functions.text import char_count, jaccard_token_set, word_count


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def set_jaccard(s1, s2) -> Column:
    """|A n B| / max(|A u B|, 1) over two token sets (empty/empty = 0)."""
    s1, s2 = _c(s1), _c(s2)
    inter = F.size(F.array_intersect(s1, s2))
    union = F.size(F.array_union(s1, s2))
    return (inter / F.greatest(union, F.lit(1))).cast("double")


def jaccard(q1, q2) -> Column:
    """Token-set Jaccard of two raw texts, stop words removed."""
    return set_jaccard(jaccard_token_set(q1), jaccard_token_set(q2))


def set_containment(s1, s2) -> Column:
    """|A n B| / min(|A|, |B|); 0 when either set is empty. Equals 1 exactly
    when one non-empty set contains the other (the short-cut of the
    token-set ratio, X11)."""
    s1, s2 = _c(s1), _c(s2)
    inter = F.size(F.array_intersect(s1, s2))
    m = F.least(F.size(s1), F.size(s2))
    return F.when(m == 0, F.lit(0.0)).otherwise(inter / m).cast("double")


def containment(q1, q2) -> Column:
    return set_containment(jaccard_token_set(q1), jaccard_token_set(q2))


def white_tokens(text) -> Column:
    """Distinct tokens between white space of a text; none for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda t: t != ""))


def token_set_parts(q1, q2) -> list[Column]:
    """Sizes of the three sets that the token-set ratio compares (X11): tokens
    of both texts, of the first only, of the second only."""
    a, b = white_tokens(q1), white_tokens(q2)
    return [F.size(F.array_intersect(a, b)).cast("bigint").alias("shared"), F.size(F.array_except(a, b)).cast("bigint").alias("only1"),
            F.size(F.array_except(b, a)).cast("bigint").alias("only2")]


def length_diffs(q1, q2) -> list[Column]:
    """|char count difference|, |word count difference|."""
    return [F.abs(char_count(q1) - char_count(q2)).alias("char_diff"),
            F.abs(word_count(q1) - word_count(q2)).alias("word_diff")]


def dot(u, v) -> Column:
    u, v = _c(u), _c(v)
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2norm(u) -> Column:
    return F.sqrt(dot(u, u))


def l2_normalize(u) -> Column:
    """Unit-length vector; the zero vector stays zero."""
    u = _c(u)
    n = l2norm(u)
    return F.transform(u, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def cosine(u, v) -> Column:
    """Cosine of two dense vectors; 0 when either has norm 0."""
    n = l2norm(u) * l2norm(v)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(u, v) / n)


def pair_vector(u, v, two_part: bool = False) -> Column:
    """[u, v, |u-v|, u*v] (or only [|u-v|, u*v]) as ``array<double>``."""
    u = F.transform(_c(u), lambda x: x.cast("double"))
    v = F.transform(_c(v), lambda x: x.cast("double"))
    ad = F.zip_with(u, v, lambda a, b: F.abs(a - b))
    pr = F.zip_with(u, v, lambda a, b: a * b)
    return F.concat(ad, pr) if two_part else F.concat(u, v, ad, pr)
