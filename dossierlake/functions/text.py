"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters dropped when requirement texts are compared
REQUIREMENT_NOISE = r"[\s·、,，.。\-–—/()\[\]{}「」『』\"':;!?~%]+"
# fixed values: characters dropped / split on when two runs are compared
RUN_NOISE = r"[\s·,.\-()\[\]'\"]+"
RUN_SPLIT = r"[\s·,./()\[\]'\"~:;|]+"
# fixed values: a number as written in prose
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(word: str) -> str:
    """A literal for a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+\-?^$|])", r"\\\1", word)


def any_of(words) -> str:
    return "|".join(quoted(w) for w in words)


def blank_to_null(c) -> Column:
    """Trimmed text; empty becomes NULL, as every truthiness test expects."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def nonzero(c) -> Column:
    """0 behaves as missing in area fallbacks."""
    return F.nullif(col(c), F.lit(0).cast("double"))


def squash(c, noise: str = REQUIREMENT_NOISE) -> Column:
    return F.lower(F.regexp_replace(col(c), noise, ""))


def ngrams(c, n: int) -> Column:
    """All character n-grams, in order, by one look-ahead scan over the text."""
    text = F.coalesce(col(c), F.lit(""))
    return F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))


def bigram_set(c) -> Column:
    """Distinct bigrams; a one-character text is its own bigram."""
    text = col(c)
    return (
        F.when(text.isNull() | (F.length(text) == 0), F.array().cast("array<string>"))
        .when(F.length(text) == 1, F.array(text))
        .otherwise(F.array_distinct(ngrams(text, 2)))
    )


def word_set(c) -> Column:
    """Distinct lower-case words split on white space."""
    # all white space becomes blanks first: a split at one plain character needs no pattern
    words = F.split(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\t\n\x0b\f\r", "     "), " ")
    return F.array_distinct(F.array_remove(words, ""))


def word_list(c, pattern: str = RUN_SPLIT, min_len: int = 2) -> Column:
    words = F.split(F.coalesce(col(c), F.lit("")), pattern)
    return F.transform(F.filter(words, lambda w: F.length(w) >= min_len), F.lower)


def jaccard(a, b) -> Column:
    """Size of intersection over size of union; 0 when either side is empty."""
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def containment(a, b) -> Column:
    """Size of intersection over the smaller side; 0 when either side is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    )


def first_marker(c, words) -> Column:
    """The marker that occurs first in the text, NULL when none does."""
    return F.nullif(F.regexp_extract(col(c), "(" + any_of(words) + ")", 1), F.lit(""))


def contains_any(c, words) -> Column:
    return col(c).rlike(any_of(words))


def squeeze(c) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def slug(c) -> Column:
    """Word characters, blanks and hyphens only; blanks become underscores."""
    kept = F.regexp_replace(col(c), r"(?U)[^\w\s가-힣-]", "")
    return F.regexp_replace(F.trim(kept), r"\s+", "_")


def record_id(number, name) -> Column:
    return F.concat_ws("_", slug(F.coalesce(col(number).cast("string"), F.lit(""))), slug(name))


def plain_number(c) -> Column:
    """'1,440' -> '1440', '30.0' -> '30', '18.30' -> '18.3', '007' -> '7'."""
    c = col(c)
    t = F.replace(c, F.lit(","), F.lit(""))
    t = F.regexp_replace(t, r"^0+(?=\d)", "")
    t = F.regexp_replace(t, r"(\.\d*?)0+$", "$1")
    written = F.contains(c, F.lit(",")) | F.contains(c, F.lit(".")) | F.startswith(c, F.lit("0"))
    # most numbers are plain as they stand
    return F.when(written, F.regexp_replace(t, r"\.$", "")).otherwise(c)


def overlapping_count(c, phrase: str) -> Column:
    """Occurrences of a phrase, overlaps included."""
    return F.regexp_count(col(c), F.lit("(?=" + quoted(phrase) + ")"))


def path_segments(c, sep: str = ">") -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda p: p != "")


def leaf(c, sep: str = ">") -> Column:
    parts = F.split(F.coalesce(col(c), F.lit("")), sep)
    return F.trim(F.element_at(parts, -1))


def cell_text(c, limit: int | None = None) -> Column:
    """Cell as one line: line breaks become blanks, pipes are escaped; cut to ``limit`` if one is given."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s*\n+\s*", " "))
    t = F.replace(t, F.lit("|"), F.lit("&#124;"))
    if limit is None:
        return t
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def strip_grade_tail(c) -> Column:
    """Drop a trailing '... B 수준' that stands at the end or before one last citation."""
    # fixed value: the tail as written
    tail = (
        r"\s*(?:되어|이\s*되어|으로|여)?\s*(?:[A-E]\s*~\s*)?[A-E]\s*수준"
        r"(?=\s*(?:[\(（][^)）]*[\)）])?\s*$)"
    )
    cut = F.trim(F.regexp_replace(col(c), tail, ""))
    return F.when(cut == "", col(c)).otherwise(cut)


def file_date(c) -> Column:
    """YYYYMMDD from a file name holding YYMMDD or YYYYMMDD; '' when there is none."""
    raw = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?<!\d)(\d{6}|\d{8})(?!\d)", 1)
    return F.when(F.length(raw) == 6, F.concat(F.lit("20"), raw)).otherwise(raw)


def legal_date(c) -> Column:
    """'20260713' -> '2026-07-13'; anything else -> ''."""
    raw = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(
        raw.rlike(r"^\d{8}$"),
        F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)),
    ).otherwise(F.lit(""))


def stamp(c) -> Column:
    """'20260508_190203' -> '2026-05-08 19:02:03'; anything else -> ''."""
    raw = col(c)
    ok = raw.rlike(r"^.{8}_.{6}$")
    text = F.regexp_replace(
        raw, r"^(.{4})(.{2})(.{2})_(.{2})(.{2})(.{2})$", "$1-$2-$3 $4:$5:$6"
    )
    return F.when(ok, text).otherwise(F.lit(""))
