"""Strictly trailing measures over a daily spine, as columns over a window by entity and day."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ROLL, BASELINE, MIN_DAYS, HALF_LIFE = 7, 84, 28, 42


def by_entity(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("entity",))).orderBy("day")


def trailing(n: int, *keys: str) -> WindowSpec:
    """The last n days, today included."""
    return by_entity(*keys).rowsBetween(-(n - 1), 0)


def running_sums(rows: DataFrame, order: str, columns: list[str], ranges: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with run_<column>, the sum up to and with each row in a global order of numbers, distinct within each ``by``, and all_<column>, the
    sum of all. Quantiles cut the order into ranges, each range is summed by itself and starts where the ones before it end, so no task has all rows.

    The rows are written once: they are read for the cuts, the starts and the sums, and the optimizer would put the expression behind ``order``
    into each comparison with a cut. The range is found by halving.
    """
    from tidewatch.operators.graph import _dir

    _dir(rows.sparkSession)
    rows = rows.checkpoint()
    keys = [F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(by)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(order, F.lit([k / ranges for k in range(1, ranges)]), F.lit(100 * ranges)).alias("_cuts"))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))))
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(order), at + step).otherwise(at))
    dealt = rows.join(F.broadcast(cuts), same or None).select(*rows.columns, below.alias("_range"))
    every = Window.partitionBy(*(f"_k{k}" for k in range(len(by))))  # over one row a range
    before = every.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, F.col("_range").alias("_at")).agg(*(F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)))
    sums = ((F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_b{k}"), F.sum(f"_s{k}").over(every).alias(f"all_{c}")) for k, c in enumerate(columns))
    starts = starts.select(*(f"_k{k}" for k in range(len(by))), "_at", *(x for pair in sums for x in pair))
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.select("*", *(F.sum(c).over(within).alias(f"_r{k}") for k, c in enumerate(columns))).join(F.broadcast(starts), [*same, F.col("_range") == F.col("_at")])
    return joined.select(*rows.columns, *((F.col(f"_b{k}") + F.col(f"_r{k}")).alias(f"run_{c}") for k, c in enumerate(columns)), *(f"all_{c}" for c in columns))


def at_least(value: Column, column: Column, w: WindowSpec, n: int) -> Column:
    """null where fewer than n values are there."""
    return F.when(F.count(column).over(w) >= n, value)


def roll_sum(c: Column, n: int, least: int = 1) -> Column:
    return at_least(F.sum(c).over(trailing(n)), c, trailing(n), least)


def roll_mean(c: Column, n: int, least: int = 1) -> Column:
    return at_least(F.avg(c).over(trailing(n)), c, trailing(n), least)


def roll_median(c: Column, n: int, least: int) -> Column:
    return at_least(F.percentile(c, F.lit(0.5)).over(trailing(n)), c, trailing(n), least)


def trailing_z(s: Column, baseline: int = BASELINE, least: int = MIN_DAYS) -> Column:
    """z of a (rolled) series against its own trailing baseline; a constant baseline gives null."""
    w = trailing(baseline)
    return at_least((s - F.avg(s).over(w)) / F.nullif(F.stddev_samp(s).over(w), F.lit(0.0)), s, w, least)


def ewm_z(s: Column, day_number: Column, half_life: float = HALF_LIFE, least: int = MIN_DAYS) -> Column:
    """z against the exponentially weighted mean and bias-corrected deviation of all days so far. ``day_number`` counts from the first day."""
    w = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(2.0), day_number / half_life)
    total, squares = F.sum(weight).over(w), F.sum(weight * weight).over(w)
    mean = F.sum(weight * s).over(w) / total
    variance = (F.sum(weight * s * s).over(w) / total - mean * mean) * total * total / F.nullif(total * total - squares, F.lit(0.0))
    constant = F.min(s).over(w) == F.max(s).over(w)
    return at_least(F.when(~constant & (variance > 0), (s - mean) / F.sqrt(variance)), s, w, least)


def pct_ranks(frame: DataFrame, names: dict[str, str], n: int = 365, least: int = 180) -> DataFrame:
    """frame (entity, day, ...) with, for each out: column of ``names``, the rank of today among the last n days as a share, ties averaged; null
    where today has no value or the days hold fewer than ``least``.

    One Arrow pass over each entity's days in order keeps the window sorted as values come and go, instead of sorting it anew every day.
    """
    import pyarrow as pa

    columns = list(names.values())

    def run(batches):
        entity, state = None, []
        for batch in batches:
            at = batch.schema.get_field_index("entity")
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            out: list[list] = [[] for _ in columns]
            for k, e in enumerate(batch.column(at).to_pylist()):
                if e != entity or not state:
                    entity, state = e, [(deque(), []) for _ in columns]
                for (past, order), column, found in zip(state, values, out, strict=True):
                    x = column[k]
                    past.append(x)
                    if x is not None:
                        insort(order, x)
                    if len(past) > n and (old := past.popleft()) is not None:
                        del order[bisect_left(order, old)]
                    if x is None or len(order) < least:
                        found.append(None)
                    else:
                        lo = bisect_left(order, x)
                        found.append((lo + (bisect_right(order, x, lo) - lo + 1) / 2) / len(order))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.float64()) for f in out)], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + "".join(f", `{k}` double" for k in names)
    return frame.repartition("entity").sortWithinPartitions("entity", "day").mapInArrow(run, schema)


def convexity_weights(n: int = 60) -> list[float]:
    t = (np.arange(n) - (n - 1) / 2) / n
    return np.linalg.pinv(np.stack([np.ones(n), t, t * t], 1))[2].tolist()


def log_convexity(x: Column, n: int = 60) -> Column:
    """Quadratic coefficient of ln(1 + x) over the last n days; null if any is missing."""
    past = F.collect_list(F.ln(1 + x)).over(trailing(n))
    dot = F.aggregate(F.zip_with(past, F.array(*map(F.lit, convexity_weights(n))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(past) == n, dot)


def crosses_above(z: Column, k: float) -> Column:
    return F.coalesce((z > k) & (F.lag(z).over(by_entity()) <= k), F.lit(False))


def crosses_below(z: Column, k: float) -> Column:
    return F.coalesce((z < k) & (F.lag(z).over(by_entity()) >= k), F.lit(False))


def newly(flag: Column) -> Column:
    flag = F.coalesce(flag, F.lit(False))
    return flag & ~F.coalesce(F.lag(flag).over(by_entity()), F.lit(False))


def delta(x: Column, n: int = 1) -> Column:
    return x - F.lag(x, n).over(by_entity())
