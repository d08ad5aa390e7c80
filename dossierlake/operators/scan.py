"""Order-dependent logic over keys of any size.

The size of the largest key is checked first. Where no key has more than ``GROUP_LIMIT`` rows a
plain window is cheap and needs one exchange for a whole chain of scans. Beyond it the large keys
are cut into slices along their order, at quantiles of their own rows; each slice is scanned on its
own, and one summary row per slice is combined across the key, so that no task holds a large key.
Keys below the limit are one slice. Both plans give the same rows: keys are compared null-safely
and fractions are added as whole multiples of powers of two, whose sums are exact. ``hot`` is the largest
key's number of rows (0 below the limit), and is measured where it is not given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1_000_000
SLICE_ROWS, MIN_SLICES = 250_000, 8


def is_hot(df: DataFrame, keys: list[str], limit: int = GROUP_LIMIT) -> int:
    """Rows of the largest key if they are more than a window should take, else 0.

    A count per key, combined before its shuffle; one number reaches the driver. Operators
    measure their input once and hand the answer to every scan below it.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return largest if largest > limit else 0


def _measured(hot: int | bool | None, df: DataFrame, keys: list[str]) -> int | bool:
    return is_hot(df, keys) if hot is None else hot


def same_key(keys: list[str], left: str = "l", right: str = "r") -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


#: Fractions are cut into whole multiples of fixed powers of two, whose sums are exact: 30 bits each
#: from 2^120 down to 2^-120. What is larger, or is no number, is added as it is.
LEVELS, LEVEL_BITS, TOP = 8, 30, 120


def _parts(value: Column, kind: str) -> dict[str, Column]:
    """Columns whose sums do not depend on the order of the rows; ``_total`` turns them into the sum."""
    if kind not in ("double", "float"):
        return {"_v": value}
    value = value.cast("double")
    plain = F.abs(value) < F.lit(2.0**TOP)
    rest, out = F.when(plain, value).otherwise(F.lit(0.0)), {}
    for level in range(LEVELS):
        unit = F.lit(2.0 ** (TOP - LEVEL_BITS * (level + 1)))
        # truncated towards zero: the rest keeps its sign and is exact
        whole = (rest / unit).cast("long")
        out[f"_v{level}"] = whole
        rest = rest - whole * unit
    out["_v"] = F.when(plain, F.lit(0.0)).otherwise(value)
    return out


def _total(parts: dict[str, Column], kind: str) -> Column:
    if kind not in ("double", "float"):
        return parts["_v"]
    total = F.lit(0.0)
    for level in reversed(range(LEVELS)):
        total = total + parts[f"_v{level}"].cast("double") * F.lit(2.0 ** (TOP - LEVEL_BITS * (level + 1)))
    return (total + parts["_v"]).cast(kind)


def _kind(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("v")).schema["v"].dataType.simpleString()


def _limit(hot: int | bool | None) -> int:
    """``True`` stands for a test that wants every key sliced."""
    return 0 if hot is True else GROUP_LIMIT


# --- slices --------------------------------------------------------------------------


def slice_by_value(
    df: DataFrame, keys: list[str], lead: str, tie: str, descending: bool = False, slices: int | None = None,
    hot: int | bool = True, limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Slice number that respects the order (lead, tie) of two numeric columns.

    Only keys of more than ``limit`` rows are sliced, into about ``SLICE_ROWS`` rows each: the cut
    points are quantiles of the key's own rows, one bounded array per large key, and the large keys
    are few, being a bounded share of the rows each. A value that is itself a cut point gets a slice
    of its own, split again along the tie-break. The rows are exchanged once by (keys, slice).
    """
    slices = slices or max(MIN_SLICES, -(-int(hot) // SLICE_ROWS))
    points = [i / slices for i in range(1, slices)]

    def cut_points(c: str) -> Column:
        return F.array_distinct(F.percentile_approx(F.col(c).cast("double"), points))

    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    of_large = df.alias("l").join(large.alias("r"), same_key(keys)).select("l.*")
    cuts = of_large.groupBy(*keys).agg(F.struct(cut_points(lead).alias("lead"), cut_points(tie).alias("tie")).alias("_cuts"))
    cut = df.alias("l").join(cuts.alias("r"), same_key(keys), "left").select("l.*", "r._cuts")
    value, other = F.col(lead).cast("double"), F.col(tie).cast("double")
    below = F.size(F.filter(F.col("_cuts.lead"), lambda c: c < value))
    at_cut = F.coalesce(F.array_contains(F.col("_cuts.lead"), value), F.lit(False))
    first = (below * 2 + at_cut.cast("int")).cast("long")
    first = -first if descending else first
    if lead == tie:
        number = first
    else:
        second = F.when(at_cut, F.size(F.filter(F.col("_cuts.tie"), lambda c: c < other))).otherwise(F.lit(0))
        number = first * (slices + 1) + second
    small = F.col("_cuts").isNull()
    return cut.withColumn("_slice", F.when(small, F.lit(0)).otherwise(number).cast("long")).drop("_cuts").repartition(*keys, "_slice")


def _carried(sliced: DataFrame, keys: list[str], sums: dict[str, Column], carry: dict) -> DataFrame:
    """Join to every slice what the earlier slices of its key hand over."""
    summary = sliced.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in sums.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    handed = summary.select(*keys, "_slice", *[f(before).alias(n) for n, f in carry.items()])
    joined = sliced.alias("l").join(handed.alias("r"), same_key([*keys, "_slice"]), "left")
    return joined.select("l.*", *[f"r.{n}" for n in carry])


def _order(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _up_to_here(keys: list[str], ordinal: str) -> Window:
    return _order(keys, [F.col(ordinal)]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


# --- scans ---------------------------------------------------------------------------


def positions(
    df: DataFrame,
    keys: list[str],
    lead: str,
    tie: str,
    descending: bool = False,
    name: str = "pos",
    slices: int | None = None,
    hot: int | bool | None = None,
) -> DataFrame:
    """1-based position of every row inside its key, ordered by (lead, tie)."""
    order = [F.col(lead).desc() if descending else F.col(lead).asc(), F.col(tie).asc()]
    hot = _measured(hot, df, keys)
    if not hot:
        return df.withColumn(name, F.row_number().over(_order(keys, order)).cast("long"))
    sliced = slice_by_value(df, keys, lead, tie, descending, slices, hot, _limit(hot))
    joined = _carried(
        sliced, keys, {"_n": F.count(F.lit(1))}, {"_offset": lambda w: F.sum("_n").over(w)}
    )
    here = F.row_number().over(_order([*keys, "_slice"], order))
    return joined.withColumn(
        name, (here + F.coalesce("_offset", F.lit(0))).cast("long")
    ).drop("_offset", "_slice")


def running_sum(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    value: Column,
    name: str,
    before: bool = False,
    slices: int | None = None,
    hot: int | bool | None = None,
) -> DataFrame:
    """Sum of ``value`` from the start of the key up to this row (or up to the row before)."""
    hot = _measured(hot, df, keys)
    if not hot:
        value = F.coalesce(value, F.lit(0))
        kind = _kind(df, value)
        parts = _parts(value, kind)
        to = Window.currentRow - 1 if before else Window.currentRow
        window = _order(keys, [F.col(ordinal)]).rowsBetween(Window.unboundedPreceding, to)
        sums = {n: F.coalesce(F.sum(n).over(window), F.lit(0)) for n in parts}
        return df.withColumns(parts).withColumn(name, _total(sums, kind)).drop(*parts)
    sliced = slice_by_value(df, keys, ordinal, ordinal, slices=slices, hot=hot, limit=_limit(hot))
    return _sliced_sum(sliced, keys, ordinal, value, name, before).drop("_slice")


def _sliced_sum(
    sliced: DataFrame, keys: list[str], ordinal: str, value: Column, name: str, before: bool = False
) -> DataFrame:
    value = F.coalesce(value, F.lit(0))
    kind = _kind(sliced, value)
    parts = _parts(value, kind)
    joined = _carried(
        sliced.withColumns(parts), keys, {f"_s{n}": F.sum(n) for n in parts}, {f"_b{n}": (lambda w, n=n: F.sum(f"_s{n}").over(w)) for n in parts}
    )
    to = Window.currentRow - 1 if before else Window.currentRow
    window = _order([*keys, "_slice"], [F.col(ordinal)]).rowsBetween(Window.unboundedPreceding, to)
    sums = {n: F.coalesce(F.sum(n).over(window), F.lit(0)) + F.coalesce(f"_b{n}", F.lit(0)) for n in parts}
    return joined.withColumn(name, _total(sums, kind)).drop(*parts, *[f"_b{n}" for n in parts])


def carry_last(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    values: dict[str, Column],
    slices: int | None = None,
    hot: int | bool | None = None,
) -> DataFrame:
    """Latest non-null of each expression at or before the row, in order of the ordinal."""
    temp = {f"_v_{n}": e for n, e in values.items()}
    hot = _measured(hot, df, keys)
    if not hot:
        out = df.withColumns(temp)
        last = {n: F.last(f"_v_{n}", ignorenulls=True).over(_up_to_here(keys, ordinal)) for n in values}
        return out.withColumns(last).drop(*temp)
    sliced = slice_by_value(df, keys, ordinal, ordinal, slices=slices, hot=hot, limit=_limit(hot)).withColumns(temp)
    joined = _carried(
        sliced,
        keys,
        {
            f"_s{n}": F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(ordinal)))
            for n in temp
        },
        {
            f"_c{n}": (lambda w, n=n: F.last(F.col(f"_s{n}"), ignorenulls=True).over(w))
            for n in temp
        },
    )
    here = _up_to_here([*keys, "_slice"], ordinal)
    out = joined.withColumns(
        {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_c_v_{n}")) for n in values}
    )
    return out.drop("_slice", *temp, *[f"_c{n}" for n in temp])


def previous(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    values: dict[str, Column],
    slices: int | None = None,
    hot: int | bool | None = None,
) -> DataFrame:
    """Value of each expression on the row before, in order of the ordinal."""
    hot = _measured(hot, df, keys)
    if not hot:
        before = _order(keys, [F.col(ordinal)])
        return df.withColumns({n: F.lag(e).over(before) for n, e in values.items()})
    return _sliced_previous(slice_by_value(df, keys, ordinal, ordinal, slices=slices, hot=hot, limit=_limit(hot)), keys, ordinal, values).drop("_slice")


def _sliced_previous(sliced: DataFrame, keys: list[str], ordinal: str, values: dict[str, Column]) -> DataFrame:
    packed = sliced.withColumn("_row", F.struct(*[e.alias(n) for n, e in values.items()]))
    joined = _carried(
        packed,
        keys,
        {"_end": F.max_by("_row", F.col(ordinal))},
        {"_prev": lambda w: F.last("_end").over(w)},
    )
    lagged = F.coalesce(F.lag("_row").over(_order([*keys, "_slice"], [F.col(ordinal)])), F.col("_prev"))
    out = joined.withColumn("_lag", lagged)
    return out.withColumns({n: F.col("_lag")[n] for n in values}).drop("_row", "_prev", "_lag")


def runs(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    same_as_before: Column,
    values: dict[str, Column],
    name: str = "run",
    slices: int | None = None,
    hot: int | bool | None = None,
) -> DataFrame:
    """Number the runs of a key: a row opens one unless ``same_as_before`` holds.

    ``same_as_before`` may use the previous values, named by the keys of ``values``.
    """
    opens = F.when(F.coalesce(same_as_before, F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    hot = _measured(hot, df, keys)
    if not hot:
        looked = previous(df, keys, ordinal, values, hot=False)
        return running_sum(looked, keys, ordinal, opens, name, hot=False).drop(*values)
    # sliced once: both scans and their joins share one partitioning
    looked = _sliced_previous(slice_by_value(df, keys, ordinal, ordinal, slices=slices, hot=hot, limit=_limit(hot)), keys, ordinal, values)
    return _sliced_sum(looked, keys, ordinal, opens, name).drop("_slice", *values)


def group_any(df: DataFrame, keys: list[str], cond: Column, name: str, hot: int | bool | None = None) -> DataFrame:
    """Whether the condition holds for any row of the key."""
    cond = F.coalesce(cond, F.lit(False))
    if not _measured(hot, df, keys):
        return df.withColumn(name, F.max(cond).over(Window.partitionBy(*keys)))
    flags = df.groupBy(*keys).agg(F.max(cond).alias(name))
    joined = df.alias("l").join(flags.alias("r"), same_key(keys))
    return joined.select("l.*", f"r.{name}")
