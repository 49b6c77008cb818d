"""Running values within links whose rows need not meet in one task: a prefix scan over ranges of time.

A link's rows are dealt into ranges of time. Within a (link, range) a window gives the running value, one small row per
(link, range) tells what the range adds, and a window over these carries it to the ranges after (or before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINK = ["namespace", "run", "step"]
#: Most ranges of time, and how many rows a range has at least.
RANGES, LEAST = 1024, 100_000


def time_ranges(rows: DataFrame, ts: str = "ts", most: int | None = None, least: int | None = None) -> Column | None:
    """The number of the range of time that a row lies in; ranges hold about equally many rows of the whole table.

    Their limits are approximate quantiles, at most ``most``. They come from a pass over one column. None: the table is
    small enough for one range.
    """
    most, least = most or RANGES, least or LEAST
    n = rows.select(F.count(ts)).first()[0]
    ranges = min(most, n // least)
    if ranges < 2:
        return None
    limits = rows.select(F.percentile_approx(F.unix_micros(ts), [k / ranges for k in range(1, ranges)], 10 * most)).first()[0]
    limits = sorted(set(limits))
    at = F.unix_micros(ts)

    def pick(low: int, high: int) -> Column:
        """A tree of comparisons: the number of limits that are not above the row's time."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at < limits[middle], pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(limits))


def carried(rows: DataFrame, ts: str, values: dict[str, tuple[str, Column]], *, key: list[str] = LINK, seq: str = "seq", number: Column | None = None) -> DataFrame:
    """Adds running values within a key, in the order of (ts, seq), each ("count" | "last" | "next", column).

    count: of non-null ones so far; last: the last non-null one so far, the row itself included in both; next: the
    first non-null one after the row. ``number`` is a row's range, by default by quantiles of the time.
    """
    number = time_ranges(rows, ts) if number is None else number
    within = key if number is None else [*key, "range_no"]
    marked = rows.withColumns({f"{n}_of": c for n, (_, c) in values.items()} | ({} if number is None else {"range_no": number}))
    so_far = Window.partitionBy(*within).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    # backwards in time, as a frame that grows costs one step a row and one that shrinks is read again for each row
    after = Window.partitionBy(*within).orderBy(F.desc(ts), F.desc(seq)).rowsBetween(Window.unboundedPreceding, -1)
    value = lambda n, how: F.count(f"{n}_of") if how == "count" else F.last(f"{n}_of", ignorenulls=True)
    local = marked.withColumns({n: value(n, how).over(after if how == "next" else so_far) for n, (how, _) in values.items()})
    drop = [f"{n}_of" for n in values]
    if number is None:
        return local.drop(*drop)
    first = lambda n: F.min_by(f"{n}_of", F.when(F.col(f"{n}_of").isNotNull(), F.struct(ts, seq)))
    last = lambda n: F.max_by(f"{n}_of", F.when(F.col(f"{n}_of").isNotNull(), F.struct(ts, seq)))
    sums = marked.groupBy(*key, "range_no").agg(*[(F.count(f"{n}_of") if how == "count" else last(n) if how == "last" else first(n)).alias(f"{n}_add") for n, (how, _) in values.items()])
    w = Window.partitionBy(*key).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    v = Window.partitionBy(*key).orderBy(F.desc("range_no")).rowsBetween(Window.unboundedPreceding, -1)
    brought = {n: (F.coalesce(F.sum(f"{n}_add").over(w), F.lit(0)) if how == "count" else F.last(f"{n}_add", ignorenulls=True).over(w if how == "last" else v)).alias(f"{n}_in") for n, (how, _) in values.items()}
    carry = sums.select(*[F.col(k).alias(f"{k}_of_range") for k in key], F.col("range_no").alias("of_range"), *brought.values())
    same = F.col("range_no") == F.col("of_range")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of_range"))
    both = local.join(carry, same, "left")
    out = {n: F.col(n) + F.col(f"{n}_in") if how == "count" else F.coalesce(n, f"{n}_in") for n, (how, _) in values.items()}
    return both.withColumns(out).drop("range_no", "of_range", *drop, *[f"{n}_in" for n in values], *[f"{k}_of_range" for k in key])
