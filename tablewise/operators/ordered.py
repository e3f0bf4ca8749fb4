"""Order-dependent work without a single-task window.

A window with no partition (or with one huge partition) runs in one task.  Here the rows are cut into
contiguous ranges of (partition keys, order keys); the cut points are literals taken from a bounded
sample, so any recomputation of a lost task sees the same ranges.  Windows run inside a range, and what
crosses a range boundary (a running total, the last value seen) travels through a summary frame that
holds one row per range and partition.  A partition with a third of all rows simply spans many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "__range"
BYTES_PER_RANGE = 128 << 20
ROWS_PER_RANGE = 500_000
COUNTED_BYTES = 4 << 20  # by Catalyst's estimate, which knows the files' compressed size only; plans below it are not counted
SAMPLE_PER_RANGE = 40
MAX_RANGES = 16384
CUTS_PER_BLOCK = 64


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job is run."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


SPREAD_BYTES_PER_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input over all cores before work that is heavy per row.

    A large scan has enough splits of its own and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPREAD_BYTES_PER_CORE else df


SLICE_BYTES = 8 << 20


def sliced(df: DataFrame) -> DataFrame:
    """Deal an input so that each slice has some 8 MB of its files, before work whose tasks hold a table of what a slice names."""
    n = -(-estimated_bytes(df) // SLICE_BYTES)
    if n <= df.sparkSession.sparkContext.defaultParallelism:
        return spread(df)
    return df.withColumn("__slice", F.monotonically_increasing_id()).repartition(n, "__slice").drop("__slice")


def takes_ranges(df: DataFrame, ranges: int | None = None) -> bool:
    """Whether a frame is cut into ranges, or at least counted for it; no job is run."""
    return ranges != 1 and ((ranges or 1) > 1 or estimated_bytes(df) >= COUNTED_BYTES)


def range_count(df: DataFrame, ranges: int | None = None) -> int:
    """At least ``ranges``, and so many that none is far beyond ROWS_PER_RANGE rows; 1 asks for a single range."""
    if not takes_ranges(df, ranges):
        return 1
    size = estimated_bytes(df)
    rows = df.count() if size >= COUNTED_BYTES else 0
    return max(ranges or 1, min(MAX_RANGES, max(size // BYTES_PER_RANGE, -(-rows // ROWS_PER_RANGE))))


def _sort_key(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    return F.col(name)


def _literal(df: DataFrame, keys: list[Column], values) -> Column:
    fields = [F.lit(v).alias(f"k{i}") for i, v in enumerate(values)]
    types = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema
    return F.struct(*[f.cast(types[i].dataType).alias(f"k{i}") for i, f in enumerate(fields)])


def with_ranges(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """Add the range number of every row; ranges follow the order of ``keys``.

    A frame small enough for a single range comes back unchanged, and plain windows do the rest.
    """
    n = range_count(df, ranges)
    if n == 1:
        return df
    key_columns = [_sort_key(df, k) for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    cuts = _cut_points(df.select(*[c.alias(a) for c, a in zip(key_columns, names)]), names, n)
    here = F.struct(*[c.alias(a) for c, a in zip(key_columns, names)])
    literals = [_literal(df, key_columns, c) for c in cuts]
    # Few cuts: a balanced tree of comparisons. Many: the tree finds a block of cuts, a short scan the place in it.
    step = 1 if len(cuts) <= 2 * CUTS_PER_BLOCK else CUTS_PER_BLOCK
    leads = literals[step - 1::step] if step > 1 else literals

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(here < leads[mid], search(low, mid)).otherwise(search(mid + 1, high))

    block = search(0, len(leads))
    if step == 1:
        return df.withColumn(RANGE, block)
    blocks = F.array(*[F.array(*literals[i:i + step]) for i in range(0, len(literals), step)])
    located = df.withColumn("__block", block).withColumn("__here", here)
    inside = F.size(F.filter(F.coalesce(F.get(blocks, F.col("__block")), F.array(literals[0])), lambda c: c <= F.col("__here")))
    last = F.col("__block") * step >= len(literals)
    return located.withColumn(RANGE, F.col("__block") * step + F.when(last, 0).otherwise(inside)).drop("__block", "__here")


def _cut_points(keys: DataFrame, names: list[str], n: int) -> list[tuple]:
    """At most ``n`` - 1 evenly spaced key tuples from a sample of bounded size."""
    rows = keys.count()
    share = min(1.0, n * SAMPLE_PER_RANGE * 1.2 / max(1, rows))
    sample = (keys if share >= 1.0 else keys.sample(fraction=share, seed=17)).orderBy(*names).collect()
    cuts: list[tuple] = []
    for i in range(1, n if sample else 1):
        cut = tuple(sample[min(len(sample) - 1, i * len(sample) // n)])
        if not cuts or cut != cuts[-1]:
            cuts.append(cut)
    return cuts


def _ordering(order_by, descending: bool = False) -> list[Column]:
    return [F.col(o).desc() if descending else F.col(o).asc() for o in order_by]


def _attach(df: DataFrame, summary: DataFrame, parts: list[str]) -> DataFrame:
    """Left join of the summary: one row per range, or per range and partition."""
    if not parts:
        # Never more rows than there are ranges.
        return df.join(F.broadcast(summary), RANGE, "left")
    renamed = summary.select(F.col(RANGE).alias("__s_r"), *[F.col(k).alias(f"__s_{i}") for i, k in enumerate(parts)],
                             *[c for c in summary.columns if c not in (RANGE, *parts)])
    on = [F.col(RANGE) == F.col("__s_r"), *[F.col(k).eqNullSafe(F.col(f"__s_{i}")) for i, k in enumerate(parts)]]
    return df.join(renamed, on, "left").drop("__s_r", *[f"__s_{i}" for i in range(len(parts))])


def running_total(df: DataFrame, weight: str | None, order_by: list[str], partition_by: list[str] = (),
                  name: str = "before", total: str | None = None, ranges: int | None = None, keep_range: bool = False) -> DataFrame:
    """Add the sum of ``weight`` (or the row count) over all earlier rows of the partition, and its total on request."""
    parts = list(partition_by)
    w = F.col(weight) if weight else F.lit(1)
    ranged = df if RANGE in df.columns else with_ranges(df, parts + list(order_by), ranges)
    if RANGE not in ranged.columns:
        earlier = Window.partitionBy(*parts).orderBy(*_ordering(order_by)).rowsBetween(Window.unboundedPreceding, -1)
        out = ranged.withColumn(name, F.coalesce(F.sum(w).over(earlier), F.lit(0)))
        return out.withColumn(total, F.sum(w).over(Window.partitionBy(*parts))) if total else out
    inside = Window.partitionBy(RANGE, *parts).orderBy(*_ordering(order_by))
    local = ranged.withColumn(name, F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_range = ranged.groupBy(RANGE, *parts).agg(F.sum(w).alias("__sum"))
    # One row per range (and partition): a partition cannot hold more rows here than there are ranges.
    across = Window.partitionBy(*parts).orderBy(RANGE) if parts else Window.orderBy(RANGE)
    whole = Window.partitionBy(*parts)
    offsets = per_range.withColumn("__off", F.coalesce(F.sum("__sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__sum").over(whole))
    out = _attach(local, offsets.drop("__sum"), parts)
    return out.withColumn(name, F.col(name) + F.col("__off")).drop("__off", *([] if keep_range else [RANGE]))


def carry(ranged: DataFrame, value: Column, order_by: list[str], partition_by: list[str] = (), before: str | None = "before",
          after: str | None = None) -> DataFrame:
    """Add the nearest non-null ``value`` at or before each row, at or after it, or both.

    The frame comes from ``with_ranges``; without a range column it is small and one window per direction suffices.
    """
    parts = list(partition_by)
    source = ranged.withColumn("__v", value)
    cut = [RANGE] if RANGE in ranged.columns else []
    place = F.when(F.col("__v").isNotNull(), F.struct(*[F.col(o) for o in order_by]))
    local, edges, handed = source, [], []
    for name, backward in ((before, False), (after, True)):
        if name is None:
            continue
        # Backward fills scan in descending order: a frame that runs to the end would be quadratic.
        inside = Window.partitionBy(*cut, *parts).orderBy(*_ordering(order_by, backward)).rowsBetween(Window.unboundedPreceding, 0)
        local = local.withColumn(name, F.last("__v", ignorenulls=True).over(inside))
        edges.append((F.min_by if backward else F.max_by)("__v", place).alias(f"__edge_{name}"))
        step = F.col(RANGE).desc() if backward else F.col(RANGE).asc()
        across = (Window.partitionBy(*parts).orderBy(step) if parts else Window.orderBy(step)).rowsBetween(Window.unboundedPreceding, -1)
        handed.append(F.last(f"__edge_{name}", ignorenulls=True).over(across).alias(f"__handed_{name}"))
    if not cut:
        return local.drop("__v")
    summary = source.groupBy(RANGE, *parts).agg(*edges).select(RANGE, *parts, *handed)
    out = _attach(local, summary, parts)
    for name in (before, after):
        if name is not None:
            out = out.withColumn(name, F.coalesce(name, f"__handed_{name}")).drop(f"__handed_{name}")
    return out.drop("__v")


def fill_forward(df: DataFrame, col: str, order_by: list[str], partition_by: list[str] = (), ranges: int | None = None) -> DataFrame:
    ranged = with_ranges(df, [*partition_by, *order_by], ranges)
    return carry(ranged, F.col(col), order_by, partition_by, "__f").withColumn(col, F.col("__f")).select(*df.columns)


def fill_backward(df: DataFrame, col: str, order_by: list[str], partition_by: list[str] = (), ranges: int | None = None) -> DataFrame:
    ranged = with_ranges(df, [*partition_by, *order_by], ranges)
    return carry(ranged, F.col(col), order_by, partition_by, None, "__b").withColumn(col, F.col("__b")).select(*df.columns)


def interpolate(df: DataFrame, col: str, order_by: list[str], partition_by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Linear by row position; the edges repeat the nearest value."""
    ranged = with_ranges(df, [*partition_by, *order_by], ranges)
    placed = running_total(ranged, None, order_by, partition_by, "__pos", ranges=1, keep_range=True)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col(col).cast("double").alias("v"), F.col("__pos").alias("p")))
    both = carry(placed, known, order_by, partition_by, "__f", "__b")
    before, after = F.col("__f"), F.col("__b")
    between = before["v"] + (after["v"] - before["v"]) * (F.col("__pos") - before["p"]) / (after["p"] - before["p"])
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(before.isNotNull() & after.isNotNull(), between).otherwise(F.coalesce(before["v"], after["v"]))
    return both.withColumn(col, filled).select(*df.columns)


def value_ranks(df: DataFrame, value: str, partition_by: list[str] = (), weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """One row per distinct value: how often it occurs, the average rank of its ties and the total count."""
    parts = list(partition_by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*parts, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt"))
    placed = running_total(counted, "cnt", [value], parts, "before", "total", ranges)
    return placed.withColumn("midrank", F.col("before") + (F.col("cnt") + 1) / 2)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = (), method: str = "exact") -> DataFrame:
    """Linear-interpolated (type 7) quantiles per group, by narrowing histograms at every size; ``approx`` takes Spark's sketch in one pass."""
    from tablewise.operators.narrowing import group_quantiles

    if method == "approx":
        return df.where(F.col(value).isNotNull()).groupBy(*by).agg(*[F.percentile_approx(value, p, 10000).alias(n) for n, p in probs.items()])
    return group_quantiles(df, value, probs, list(by))


def nth_row_sample(df: DataFrame, step: int, order_by: list[str], ranges: int | None = None) -> DataFrame:
    """Every ``step``-th row by position in the given order."""
    placed = running_total(df, None, list(order_by), name="__pos", ranges=ranges)
    return placed.where(F.pmod(F.col("__pos"), F.lit(step)) == 0).drop("__pos")
