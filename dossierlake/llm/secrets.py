"""Secrets in text: fixed patterns, and strings whose sliding windows have a high Shannon entropy.

DataFrame functions only; no Python runs in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order of the listing: pattern, least length, group that the length is taken from.
#: A run of one class that is too short has no longer match inside, so its least length may stand in
#: the pattern; the value of an assignment may hold another keyword, so its length is tested after.
#: Letters are spelt in both cases, since engines fold case differently beyond ASCII.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
BASE = {
    "assign": (rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": ("AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": ("[0-9a-f]{24,}", 24, 0),
}
#: Strings that the entropy looks at.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Character classes, the first that fits counts: kind, pattern of the whole string, window, least
#: bits a character in the best window.
CLASSES = [
    ("entropy_hex", "[0-9a-fA-F]*[0-9][0-9a-fA-F]*", 20, 3.0),
    ("entropy_letters", "[A-Za-z]+", 20, 3.9),
    ("entropy_mixed", ".*", 20, 3.6),
]
#: Strings that are let pass: one character only, words joined by signs, UUIDs, placeholders.
ALLOWED = [
    r"(.)\1*",
    "[+/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+[+/_=-]*",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    ".*([Ee]xample|EXAMPLE|[Pp]laceholder|[Cc]hangeme|[Dd]ummy|0123456789|1234567890|abcdefghij|ABCDEFGHIJ|xxxxxx|XXXXXX).*",
]
#: c * log2(c) in millionths, a whole number, so that sums do not depend on their order.
UNIT = 1_000_000
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def weights(window: int) -> list[int]:
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


def most_weight(window: int, bits: float) -> int:
    """The greatest sum of weights at which a window still has ``bits`` a character."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; an expression named inside another's lambda would
    be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array up to and with each place, by doubling steps: n log n work, however long."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    add = lambda sums, k: F.transform(
        sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("long"))
    )
    return F.aggregate(steps, values, add)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: array of
    (start, end, found), code points, end exclusive."""

    def placed(found):
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")), F.lit(1), F.size(found))
        ends = running_sums(F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
        return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))

    nothing = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    # most texts have none and are spared the second scan
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(nothing))


def _count(counts: Column, symbol: Column) -> Column:
    """A symbol's count: eight counts of a byte in every long."""
    packed = F.get(counts, F.floor(symbol / 8).cast("int"))
    return F.call_function("shiftrightunsigned", packed, symbol % 8 * 8).bitwiseAND(F.lit(255)).cast("int")


def _changed(counts: Column, symbol: Column, by: int) -> Column:
    one = F.call_function("shiftleft", F.lit(by).cast("long"), symbol % 8 * 8)
    return F.transform(counts, lambda v, slot: F.when(slot == F.floor(symbol / 8).cast("int"), v + one).otherwise(v))


def window_weight(found: Column, window: int) -> Column:
    """The least sum of c * log2(c) over the counts c of any window of a string, which is that of the
    window of the greatest entropy; null where the string is shorter than the window.

    One fold over the characters: the one that leaves and the one that enters each change one count,
    and the sum by the difference of two weights.
    """
    table = F.array(*[F.lit(w).cast("long") for w in weights(window)])
    zero = F.lit(0).cast("long")

    def step(state, move):
        """First the leaving character, then the entering one."""
        gone = F.when(
            move["leave"].isNotNull(),
            let(
                _count(state["counts"], move["leave"]),
                lambda c: F.struct(
                    _changed(state["counts"], move["leave"], -1).alias("counts"),
                    (state["sum"] + F.get(table, c - 1) - F.get(table, c)).alias("sum"),
                ),
            ),
        ).otherwise(F.struct(state["counts"].alias("counts"), state["sum"].alias("sum")))

        def come(now):
            return let(
                _count(now["counts"], move["enter"]),
                lambda c: let(
                    now["sum"] + F.get(table, c + 1) - F.get(table, c),
                    lambda total: F.struct(
                        _changed(now["counts"], move["enter"], 1).alias("counts"),
                        total.alias("sum"),
                        F.when(move["place"] >= window - 1, F.least(state["best"], total)).otherwise(state["best"]).alias("best"),
                    ),
                ),
            )

        return let(gone, come)

    start = F.struct(
        F.array_repeat(zero, math.ceil(len(SYMBOLS) / 8)).alias("counts"), zero.alias("sum"), F.lit(None).cast("long").alias("best")
    )
    symbols = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    moves = let(
        symbols,
        lambda s: F.transform(
            s, lambda x, i: F.struct(x.alias("enter"), F.when(i >= window, F.get(s, i - window)).alias("leave"), i.alias("place"))
        ),
    )
    return F.aggregate(moves, start, step, lambda s: s["best"])


def _entropy_kind(found: Column) -> Column:
    """The kind of a candidate whose best window reaches the bits of its class, else null."""
    whole = lambda pattern: found.rlike(f"^(?:{pattern})$")
    kind = F.when(F.lit(False), F.lit(""))
    for pattern in ALLOWED:
        kind = kind.when(whole(pattern), F.lit(None))
    for name, pattern, window, bits in CLASSES:
        enough = window_weight(found, window) <= most_weight(window, bits)
        kind = kind.when(whole(pattern), F.when(enough, F.lit(name)))
    return kind


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id, spans, an array of (start, kind, end, name) by start and
    kind; kinds are numbered as in ``BASE``, then as in ``CLASSES``. Places count code points, the
    end is exclusive.

    Fixed patterns first; a match that fails its test is dropped and not tried again. Then every
    string of 20 or more letters, digits and ``+/_=-`` whose best window has the bits of its
    character class and that no allow-list pattern covers.

    One row per row of the input, repeated and null ids included; a null or empty text has no
    spans. Work in a text grows with its length (and the logarithm of its number of matches), so a
    long text is whole. An empty table gives no rows. Only the two named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for number, (name, (pattern, least, group)) in enumerate(BASE.items()):
        kept = lambda m: F.length(F.regexp_extract(m["found"], pattern, group) if group else m["found"]) >= least  # noqa: B023, E731
        parts.append(F.transform(F.filter(matches(text, pattern), kept), lambda m: _span(m, F.lit(number), F.lit(name))))  # noqa: B023
    names = [c[0] for c in CLASSES]
    number = lambda kind: F.array_position(F.array(*[F.lit(n) for n in names]), kind).cast("int") + len(BASE) - 1
    judged = F.transform(matches(text, CANDIDATE), lambda m: let(_entropy_kind(m["found"]), lambda kind: _span(m, number(kind), kind)))
    parts.append(F.filter(judged, lambda s: s["name"].isNotNull()))
    return docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.concat(*parts)).alias("spans"))


def _span(match: Column, kind: Column, name: Column) -> Column:
    return F.struct(match["start"].alias("start"), kind.cast("int").alias("kind"), match["end"].alias("end"), name.alias("name"))
