"""Shared building blocks.

* ``frequencies``     all columns in one shuffle: unpivot, then group by (column, value)
* ``exact_quantiles`` linear-interpolated quantiles without collecting a group in one place
* ``running_counts``  rows below each value, ordered within bounded ranges; ``value_ranks`` on top of it
* ``sized_side``      broadcast side only after its size has been looked at

Exact quantiles and ranks never sort raw rows. Rows are first reduced to
(value, count), so a value held by a third of the table is one row. What is then
ordered is bounded: for quantiles by narrowing each value range until it holds a
fixed number of rows, for ranks by range partitions of a fixed length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import materialise

SMALL_SIDE_ROWS = 200_000
RANGE_ROWS = 50_000  # distinct values that one range orders
ORDERED_ROWS = 100_000  # rows that one value range may leave to be ordered
GRID = 500  # cut points of a range in one narrowing
MARGIN = 2  # of them, kept on either side: many times the sketch's error


def sized_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Prepare a join side: broadcast it when it has at most ``max_rows`` rows.

    The side is an aggregate of something large, so the planner cannot know its
    size. It is materialised once (and reused by the join); beyond the limit it
    stays an ordinary shuffled side, where AQE splits skewed partitions.
    """
    side = materialise(df)
    return F.broadcast(side) if side.count() <= max_rows else side


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null matches null; the right-hand keys are dropped."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__{k}"), keys, right)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def long_form(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], keys: Sequence[str] = (), cast: str = "string") -> DataFrame:
    """(keys, column, value): one row per input row and listed column."""
    named = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    wide = df.select(*keys, *[c.cast(cast).alias(n) for n, c in named.items()])
    return wide.unpivot(list(keys), list(named), "column", "value")


def frequencies(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], keep_nulls: bool = True) -> DataFrame:
    """(column, value, n) for all columns together; hot values combine before the shuffle."""
    long = long_form(df, columns)
    if not keep_nulls:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _brackets(long: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """Per key: row count and, for each probability, a value range sure to hold that quantile.

    The sketch guarantees a rank error of n / accuracy; four times that is left
    on both sides, and the ends of the scale use the true minimum and maximum.
    Groups of up to four times ``accuracy`` rows take their whole range, because
    there the slack may be less than the two neighbouring ranks interpolation needs.
    """
    slack = 4.0 / accuracy
    lows = [p - slack for p in probs]
    highs = [p + slack for p in probs]
    asked = sorted({x for x in (*lows, *highs) if 0.0 < x < 1.0})
    measures = [F.count("value").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")]
    if asked:
        sketch = F.percentile_approx("value", F.array(*[F.lit(x) for x in asked]), F.lit(accuracy))
        measures.append(sketch.alias("sketch"))
    grouped = long.groupBy(*keys).agg(*measures)

    def at(x: float) -> Column:
        if x <= 0.0:
            return F.col("lowest")
        if x >= 1.0:
            return F.col("highest")
        return F.col("sketch")[asked.index(x)]

    small = F.col("n") <= 4 * accuracy
    ends = [F.when(small, F.col("lowest")).otherwise(at(x)).alias(f"lo_{i}") for i, x in enumerate(lows)]
    ends += [F.when(small, F.col("highest")).otherwise(at(x)).alias(f"hi_{i}") for i, x in enumerate(highs)]
    return grouped.select(*keys, "n", "lowest", "highest", *ends)


def _narrowed(long: DataFrame, ranges: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """The same ranges, each cut down to a few of GRID parts of the rows strictly inside it.

    One pass: rows below or at the lower end are counted, rows inside are sketched, and the wanted rank says between which
    cut points to stay. A value that many rows share becomes an end of its range and is no longer counted inside it.
    """
    count = len(probs)
    value = F.col("value")
    cuts = F.array(*[F.lit(k / GRID) for k in range(1, GRID)])
    placed = null_safe_join(long, ranges.select(*by, *[f"{e}_{i}" for e in ("lo", "hi") for i in range(count)]), by)
    measures = []
    for i in range(count):
        inside = (value > F.col(f"lo_{i}")) & (value < F.col(f"hi_{i}"))
        measures += [
            F.count_if(value <= F.col(f"lo_{i}")).alias(f"before_{i}"), F.count_if(inside).alias(f"inside_{i}"),
            F.percentile_approx(F.when(inside, value), cuts, F.lit(max(accuracy, 10 * GRID))).alias(f"grid_{i}"),
        ]
    joined = null_safe_join(ranges, placed.groupBy(*by).agg(*measures), by)
    ends = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        before, size, grid = F.col(f"before_{i}"), F.col(f"inside_{i}"), F.col(f"grid_{i}")
        low, high = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        first, last = F.floor(position) - before, F.ceil(position) - before  # ranks among the rows inside
        left = (F.floor(first * GRID / size) - MARGIN).cast("int")
        right = (F.ceil((last + 1) * GRID / size) + MARGIN).cast("int")
        ends += [
            F.when(first >= size, high).when((first < 0) | (size == 0) | (left < 1), low).otherwise(F.get(grid, left - 1)).alias(f"lo_{i}"),
            F.when(last < 0, low).when((last >= size) | (size == 0) | (right > GRID - 1), high).otherwise(F.get(grid, right - 1)).alias(f"hi_{i}"),
        ]
    return joined.select(*by, "n", "lowest", "highest", *ends)


def _bounded_ranges(
    long: DataFrame, ranges: DataFrame, most: int, by: Sequence[str], probs: Sequence[float], accuracy: int, ordered_rows: int
) -> DataFrame:
    """Value ranges that leave at most about ``ordered_rows`` rows to be ordered for each key and probability.

    A sketch leaves 8 / ``accuracy`` of a key's rows. Keys for which that is too many, which only large keys are, have their
    ranges narrowed until it is not; each round leaves a hundredth. ``most``: rows of the largest key.
    """
    share = 8.0 / accuracy
    if most <= 4 * accuracy or most * share <= ordered_rows:
        return ranges
    wide = (F.col("n") > 4 * accuracy) & (F.col("n") * share > ordered_rows)
    narrow, left = ranges.filter(wide), most * share
    while left > ordered_rows:
        narrow = materialise(_narrowed(long, narrow, by, probs, accuracy))
        left *= (2 * MARGIN + 3) / GRID
    return ranges.filter(~wide).unionByName(narrow)


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int = 10_000,
    few_keys: bool = False,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per key and column.

    A first pass builds a mergeable sketch and turns it into one value range per probability; ranges that hold over
    ``ordered_rows`` rows are narrowed by further passes. The last pass counts: values inside a range keep their identity,
    values between ranges collapse to one row per gap. A running count over that table, whose length does not grow with the
    data, hits the wanted ranks exactly. If a rank fell outside its range the query would fail rather than return a neighbour.

    ``few_keys`` says the key combinations are bounded by construction (pairs times
    collapsed levels), so their ranges are broadcast without counting them first.

    Result: keys, ``column``, ``n``, ``lowest``, ``highest`` and one column per
    named probability.
    """
    names = sorted(probs, key=probs.get)
    ordered = [probs[name] for name in names]
    by = [*keys, "column"]
    ranked = ordered_values(df, columns, ordered, keys, accuracy, few_keys, ordered_rows)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")) & ~F.col("gap"), F.col("value")))

    measures = [F.max("n").alias("n"), F.max("lowest").alias("lowest"), F.max("highest").alias("highest")]
    for i, p in enumerate(ordered):
        position = (F.col("n") - 1) * F.lit(float(p))
        measures += [value_at(F.floor(position)).alias(f"a_{i}"), value_at(F.ceil(position)).alias(f"b_{i}")]
    found = ranked.groupBy(*by).agg(*measures)

    results = []
    for i, name in enumerate(names):
        position = (F.col("n") - 1) * F.lit(float(ordered[i]))
        low, high = F.col(f"a_{i}"), F.col(f"b_{i}")
        results.append(
            F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("quantile outside its range")).cast("double"))
            .otherwise(low + (high - low) * (position - F.floor(position)))
            .alias(name)
        )
    return found.select(*by, "n", "lowest", "highest", *results)


def ordered_values(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float], keys: Sequence[str], accuracy: int, few_keys: bool,
    ordered_rows: int,
) -> DataFrame:
    """Per key, the values near the wanted ranks and one row for each gap between them, with running counts."""
    by = [*keys, "column"]
    long = long_form(df, columns, keys, "double").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ranges = materialise(_brackets(long, by, probs, accuracy))
    size = ranges.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    ranges = _bounded_ranges(long, ranges, size["most"], by, probs, accuracy, ordered_rows)
    # Without keys there is one row per listed column, which is bounded by the schema.
    side = F.broadcast(ranges) if few_keys or not keys or size["keys"] <= SMALL_SIDE_ROWS else ranges
    placed = null_safe_join(long, side, by)

    value, count = F.col("value"), len(probs)
    inside = reduce(lambda a, b: a | b, [value.between(F.col(f"lo_{i}"), F.col(f"hi_{i}")) for i in range(count)])
    below = [F.when(F.col(f"hi_{i}") < value, F.col(f"hi_{i}")) for i in range(count)]
    coded = placed.select(
        *by, "n", "lowest", "highest",
        (~inside).alias("gap"),
        F.when(inside, value).otherwise(F.greatest(F.lit(float("-inf")), *below)).alias("value"),
    )
    counted = coded.groupBy(*by, "value", "gap").agg(
        F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"),
        F.first("lowest").alias("lowest"), F.first("highest").alias("highest"),
    )
    running = Window.partitionBy(*by).orderBy("value", "gap").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("rows").over(running)).withColumn("before", F.col("upto") - F.col("rows"))


def exact_medians(df: DataFrame, columns, keys: Sequence[str] = (), accuracy: int = 10_000, few_keys: bool = False) -> DataFrame:
    return exact_quantiles(df, columns, {"median": 0.5}, keys, accuracy, few_keys)


def running_counts(
    counts: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str = "value", range_rows: int = RANGE_ROWS, written: bool = False
) -> DataFrame:
    """Add ``below_<c>`` for each count column: the rows with a smaller value of the same key.

    Long tables are dealt to range partitions of (key, value), about ``range_rows`` distinct values each, so one key may take
    many partitions. They are written with their partition numbers; the running count is taken inside each (key, partition)
    and shifted by the totals of the key's partitions before it, which are joined, not sent to the driver. ``written`` says that
    ``counts`` is a written table already.
    """
    by = list(keys)
    counts = counts if written else materialise(counts)
    pieces = int(counts.count() // range_rows) + 1

    def running(over: Sequence[str]) -> dict[str, Column]:
        window = Window.partitionBy(*over).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return {f"below_{c}": F.sum(c).over(window) - F.col(c) for c in columns}

    if pieces == 1:
        return counts.withColumns(running(by))

    ranged = materialise(counts.repartitionByRange(pieces, *by, value).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    shifted = ranged.withColumns(running([*by, "__range"])).join(offsets, [*by, "__range"])
    return shifted.withColumns({f"below_{c}": F.col(f"below_{c}") + F.col(f"__{c}") for c in columns}).drop(
        "__range", *[f"__{c}" for c in columns]
    )


def numbered(df: DataFrame, order: Sequence[str], name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the place of each row in an order, from 1. Long tables are numbered by ranges of about ``range_rows`` rows and shifted."""
    df = materialise(df)
    pieces = int(df.count() // range_rows) + 1
    if pieces == 1:
        ranged = df.withColumn("__range", F.lit(0))
    else:
        ranged = materialise(df.repartitionByRange(pieces, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    shifted = ranged.withColumn("__place", place).join(offsets, "__range")
    return shifted.withColumn(name, (F.col("__place") + F.col("__before")).cast("int")).drop("__range", "__place", "__before")


def value_ranks(
    counts: DataFrame, keys: Sequence[str], value: str = "value", count: str = "n", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``avg_rank`` to a (keys, value, count) table: tied values share their mean rank."""
    placed = running_counts(counts, keys, [count], value, range_rows)
    return placed.withColumn("avg_rank", F.col(f"below_{count}") + (F.col(count) + 1) / F.lit(2.0)).drop(f"below_{count}")


def attach_by_value(
    rows: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, share: int = 1000
) -> DataFrame:
    """Join a rank table back by (keys, value) without letting a hot value build one large task.

    ``ranks`` carries ``n`` (rows of the value) and ``total`` (rows of the key).
    Values holding at least 1/``share`` of their key number at most ``share`` per
    key, so that part is a broadcast; the rest is a shuffled join in which no
    value is large.
    """
    on = [*keys, value]
    hot = F.col("n") * share >= F.col("total")
    columns = [*on, "avg_rank"]
    heavy = F.broadcast(ranks.filter(hot).select(*columns))
    light = ranks.filter(~hot).select(*columns)
    with_heavy = rows.join(heavy, on)
    with_light = rows.join(heavy.select(*on), on, "left_anti").join(light, on)
    return with_heavy.unionByName(with_light)
