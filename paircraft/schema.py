"""Schemas and constants.

The Unicode fold tables are derived from a rule, never typed in; nothing here
reads a file or needs a session.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import types as T

# Pair table as read from CSV (declared, never inferred).
PAIR = T.StructType([
    T.StructField("qid1", T.LongType()),
    T.StructField("qid2", T.LongType()),
    T.StructField("question1", T.StringType()),
    T.StructField("question2", T.StringType()),
    T.StructField("is_duplicate", T.IntegerType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Right-closed length-difference bin edges, lowest edge included.
LEN_DIFF_EDGES = [0, 2, 4, 6, 8, 11, 16, 22, 31, 50, 1e6]
# Split: 80 / 10 / 10 of groups, seed 13.
SPLIT_SEED = 13
SPLIT_CUTS = (80, 90)
# Sample size and seed of the EDA sample.
SAMPLE_N = 32000
SAMPLE_SEED = 13
# Log-loss clipping: float32 machine epsilon.
LOGLOSS_EPS = 1.1920929e-07
# TF-IDF: word n-grams 1-2 with min_df 3 and sublinear tf; char n-grams 3-5 with min_df 10.
WORD_NGRAMS = (1, 2)
WORD_MIN_DF = 3
CHAR_NGRAMS = (3, 5)
CHAR_MIN_DF = 10
# Regular expressions of the cleaning chain.
MATH_RE = r"(?is)\[math\].*?\[/math\]"
HTML_RE = r"<[^>]+>"
BAD_CHR_RE = r"[^a-z0-9'? ]+"
TOKEN_RE = r"[a-z0-9']+|\?"
JACCARD_TOKEN_RE = r"[a-z0-9']+"
# Learning-rate grid of the gate search.
GATE_LR_GRID = [1e-3, 5e-3, 1e-2, 5e-2]


# Spark's English stop-word list, as
# ``StopWordsRemover.loadDefaultStopWords("english")`` returns it (a test compares them).
_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
"""


def stop_words() -> tuple[str, ...]:
    """English stop words (no file or session is needed)."""
    return tuple(_STOP_WORDS.split())


@functools.lru_cache(maxsize=None)
def ascii_fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(FROM, TO, MULTI) for the ASCII fold; FROM = single-letter folds
    followed by the Basic-Multilingual-Plane characters that fold to nothing
    (``translate`` deletes characters of FROM that have no partner in TO)."""
    src, dst, multi, drop = _fold_rule()
    return src + drop, dst, multi


@functools.lru_cache(maxsize=None)
def _fold_rule() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Rule: NFKD-decompose each code point and keep its ASCII part.

    Returns (FROM, TO, MULTI): code points whose ASCII part is one character go
    to ``translate(FROM, TO)``; those with a longer ASCII part (ligatures,
    fractions) are listed in MULTI as (char, replacement). Everything else
    non-ASCII is removed afterwards by a regex.
    """
    src, dst, multi, drop = [], [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        r = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode("ascii")
        if not r:
            if cp <= 0xFFFF:
                drop.append(c)
            continue
        if len(r) == 1:
            src.append(c)
            dst.append(r)
        else:
            multi.append((c, r))
    return "".join(src), "".join(dst), tuple(multi), "".join(drop)
