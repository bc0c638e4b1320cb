"""Row-frame window primitives over one ordered series per key.

A series is a key with unique order values (one bar per stock and day), so a
partition never holds more rows than the calendar has days, whatever the size
of the panel. All primitives take the same partition and order: Spark then
needs one exchange and one sort for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import col, div

KEY, TS = "scode", "date"
FIRST = Window.unboundedPreceding
PACK = 1 << 20   # equal values below, distances above


def series(by=KEY, order=TS) -> WindowSpec:
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*by).orderBy(*order)


def over(agg: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Aggregate over the last n rows, partial frames included."""
    return agg.over((w or series()).rowsBetween(-(n - 1), 0))


def roll(agg, x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """Aggregate over the last n rows; null until the frame holds n non-null values."""
    x, fr = col(x), (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(fr) >= n, agg(x).over(fr))


def ahead(agg, x: Column | str, h: int, w: WindowSpec | None = None) -> Column:
    """Aggregate over rows t+1 .. t+h; null unless all h values are present."""
    x, fr = col(x), (w or series()).rowsBetween(1, h)
    return F.when(F.count(x).over(fr) >= h, agg(x).over(fr))


def lag(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), k).over(w or series())


def lead(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(x), k).over(w or series())


def diff(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return col(x) - lag(x, k, w)


def ffill(x, w: WindowSpec | None = None) -> Column:
    return F.last(col(x), ignorenulls=True).over((w or series()).rowsBetween(FIRST, 0))


def pct_change(x_filled, k: int = 1, w: WindowSpec | None = None) -> Column:
    """x / x[t-k] - 1. Pass a forward-filled column where gaps must be padded."""
    return div(x_filled, lag(x_filled, k, w)) - F.lit(1.0)


def roll_std0(x, n: int, w: WindowSpec | None = None) -> Column:
    return roll(F.stddev_pop, x, n, w)


def roll_beta(y, x, n: int, w: WindowSpec | None = None) -> Column:
    """cov(y, x) / var(x) over the last n rows; pairs must be complete."""
    y, x, fr = col(y), col(x), (w or series()).rowsBetween(-(n - 1), 0)
    pairs = F.count(F.when(y.isNotNull() & x.isNotNull(), F.lit(1))).over(fr)
    full_x = F.count(x).over(fr)
    return F.when((pairs >= n) & (full_x >= n), div(F.covar_samp(y, x).over(fr), F.var_samp(x).over(fr)))


def roll_skew(x, n: int, w: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness G1 (Spark's ``skewness`` is the population g1)."""
    g1 = roll(F.skewness, x, n, w)
    return F.nanvl(g1, F.lit(None).cast("double")) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


def roll_kurt(x, n: int, w: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis G2 (Spark's ``kurtosis`` is the population g2)."""
    g2 = F.nanvl(roll(F.kurtosis, x, n, w), F.lit(None).cast("double"))
    return (g2 * F.lit(float(n + 1)) + F.lit(6.0)) * F.lit((n - 1) / ((n - 2) * (n - 3)))


def roll_median(x, n: int, w: WindowSpec | None = None) -> Column:
    """Exact median of the last n values (``median`` itself takes no row frame)."""
    x, fr = col(x), (w or series()).rowsBetween(-(n - 1), 0)
    s = F.sort_array(F.collect_list(x).over(fr))
    mid = (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / F.lit(2.0)
    return F.when(F.count(x).over(fr) >= n, mid)


def roll_growth(r, n: int, w: WindowSpec | None = None) -> Column:
    """prod(1 + r) over the last n rows."""
    return roll(F.product, F.lit(1.0) + col(r), n, w)


def row_no(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or series())


def with_streak(df: DataFrame, change: str, name: str, w: WindowSpec | None = None) -> DataFrame:
    """Signed length of the current run of equal signs of ``change`` (0 while flat or unknown).

    A run ends where the sign differs from the previous row's; the row's place
    in the run is its row number minus the row number of the run's first row,
    so the scan keeps the series' partition and order.
    """
    df = df.withColumns({"_sg": F.coalesce(F.signum(col(change)), F.lit(0.0)), "_pos": row_no(w)})
    starts = F.when(~F.col("_sg").eqNullSafe(F.lag("_sg").over(w or series())), F.col("_pos"))
    df = df.withColumn("_start", starts)
    begin = F.last("_start", ignorenulls=True).over((w or series()).rowsBetween(FIRST, 0))
    df = df.withColumn(name, F.col("_sg") * (F.col("_pos") - begin + F.lit(1)))
    return df.drop("_sg", "_pos", "_start")


def rci_levels(x: str, periods: dict[str, int], w: WindowSpec | None = None) -> list[dict[str, Column]]:
    """Levels of columns for rank correlation indices (time order against price order, -100 .. 100).

    With v the prices of a frame of n rows, rank_i = (n+1)/2 + sum_j sign(v_i - v_j) / 2,
    so sum(pos * rank) only needs D = sum over pairs of sign(v_i - v_j) (i - j), and equal
    prices lower sum(rank^2) by sum(g^3 - g) / 12 over runs of g equal prices. Both
    change by integers when a row enters or leaves the frame: the entering row meets
    the n-1 rows before it, the leaving one the n-1 rows after it. Running sums of
these steps give every frame exactly, without sorting frames. Both meetings read one short
    array, the last max(n) + 1 values: one frame for all of them, where a lag and a lead for each
    distance would be a frame each. A step packs D and the number of equal values into one integer.
    """
    w = w or series()
    v, cuts = F.col(x).cast("double"), sorted(set(periods.values()))
    missing = F.lit(float("nan"))
    values = {"_vals": F.collect_list(F.coalesce(v, missing)).over(w.rowsBetween(-cuts[-1], 0)), "_known": F.count(x).over(w.rowsBetween(FIRST, 0))}
    latest = {"_near": F.reverse("_vals")}   # latest first, missing values as NaN, which is above every value

    def met(start, length, of, above, distance):
        """Packed sum over a slice of ``_near``: ``above`` times the distance for smaller values, minus it for greater ones, one for equal ones."""
        steps = F.transform(F.slice("_near", start, length), lambda y, i: F.when(y < of, distance(i) * above).when(y == of, 1)
                            .when(F.isnan(y), 0).otherwise(distance(i) * -above))
        return F.when(of.isNotNull(), F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)).otherwise(F.lit(0).cast("long"))

    steps, lo = {}, 1
    for n in cuts:   # each period extends the sums of the shorter one; the row that leaves meets the rows after it
        steps[f"_in{n}"] = met(lo + 1, n - lo, v, PACK, lambda i, lo=lo: (i + F.lit(lo)).cast("long"))
        gone = F.nanvl(F.get("_near", F.lit(n)), F.lit(None).cast("double"))
        steps[f"_out{n}"] = met(2, n - 1, gone, -PACK, lambda i, n=n: (F.lit(n - 1) - i).cast("long"))
        lo = n
    upto = w.rowsBetween(FIRST, 0)

    def moved(packed):
        return F.shiftright(packed, PACK.bit_length() - 1)

    def ties(packed):
        g = packed.bitwiseAND(F.lit(PACK - 1).cast("long"))
        return F.lit(3) * g * (g + F.lit(1))

    running = {}
    for n in cuts:
        entered, left = F.lit(0).cast("long"), F.col(f"_out{n}")
        for m in cuts[:cuts.index(n) + 1]:
            entered = entered + F.col(f"_in{m}")
        running |= {f"_c{n}": F.sum(moved(entered) - moved(left)).over(upto), f"_t{n}": F.sum(ties(entered) - ties(left)).over(upto),
                    f"_known{n}_past": F.lag("_known", n, 0).over(w)}
    final = {}
    for name, n in periods.items():
        d2 = F.lit(n * (n * n - 1) / 6.0) - F.col(f"_t{n}") / F.lit(12.0) - F.col(f"_c{n}")
        value = (F.lit(1.0) - F.lit(6.0) * d2 / F.lit(float(n * (n * n - 1)))) * F.lit(100.0)
        final[name] = F.when(F.col("_known") - F.col(f"_known{n}_past") >= n, value)
    return [values, latest, steps, running, final]


def with_rci(df: DataFrame, x: str, periods: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Add one rank correlation index per (name, frame length)."""
    levels = rci_levels(x, periods, w)
    for level in levels:
        df = df.withColumns(level)
    return df.drop(*[c for level in levels[:-1] for c in level])
