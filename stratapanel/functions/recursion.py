"""Recursive smoothing (EMA and Wilder averages) as a linear filter over windows.

y[t] = y[t-1] + alpha (x[t] - y[t-1]) is no window aggregate, but its closed form
is: with d = 1 - alpha, y[t] = sum over i <= t of d^(t-i) z[i], where z holds the
seed once and alpha x[i] afterwards. A running sum of z[i] d^(-i), scaled by
d^t, gives y without collecting a series, calling Python or folding arrays.

Positions count the non-null inputs of a series, so a row without an input neither
moves nor decays anything: the state stands over a gap and the next input goes on
from it. Rows without an input have no output.

d^(-i) would overflow on long series, so a series is cut into blocks of ``BLOCK``
rows, the same for all inputs: the running sum restarts in each block, and what the
earlier blocks leave is a short fold over their ends (inputs of the block, sum at its
end), one entry a block. Blocks of rows, and not of inputs, let every window of all
smoothers share one order (key, block, time): the rows are sorted once for the row
numbers and once for all the smoothing, however many inputs there are.

Seed rule: the first output is the plain mean of the first n non-null inputs;
earlier outputs are null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import div

BLOCK = 2000   # rows; decay >= 0.8 keeps d^-BLOCK below 1e200


def ema(out: str, x: str, n: int) -> tuple[str, str, int, float]:
    return out, x, n, 2.0 / (n + 1)


def wilder(out: str, x: str, n: int) -> tuple[str, str, int, float]:
    return out, x, n, 1.0 / n


def with_blocks(df: DataFrame, key: str, ts: str, block: int = BLOCK) -> DataFrame:
    """Add ``_blk``, the block of a row in its series, and ``_last``, whether the row ends it."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("_rn", rn).withColumns(
        {"_blk": F.floor((F.col("_rn") - F.lit(1)) / F.lit(block)).cast("int"), "_last": F.col("_rn") % F.lit(block) == 0}).drop("_rn")


def smooth(df: DataFrame, specs: Iterable[tuple[str, str, int, float]], key: str, ts: str,
           block: int = BLOCK) -> DataFrame:
    """Add one smoothed column per (output, input, n, alpha)."""
    return smooth_blocks(with_blocks(df, key, ts, block), specs, key, ts).drop("_blk", "_last")


def smooth_blocks(df: DataFrame, specs: Iterable[tuple[str, str, int, float]], key: str, ts: str) -> DataFrame:
    """``smooth`` for rows that have their blocks."""
    specs = list(specs)
    line = Window.partitionBy(key).orderBy("_blk", ts)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(key, "_blk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    xs = list(dict.fromkeys(x for _, x, _, _ in specs))
    df = df.withColumns({f"_k_{x}": F.count(x).over(upto) for x in xs} | {f"_a_{x}": F.avg(x).over(upto) for x in xs})
    df = df.withColumns({f"_j_{x}": F.count(x).over(inside).cast("double") for x in xs})   # inputs of the block so far

    def decay(x: str, alpha: float, sign: int = 1) -> Column:
        return F.pow(F.lit(1.0 - alpha), F.lit(float(sign)) * F.col(f"_j_{x}"))

    def carried(out: str, x: str, alpha: float) -> Column:   # the state at the end of the block before
        return F.aggregate("_ends", F.lit(0.0), lambda e, b: e * F.pow(F.lit(1.0 - alpha), b[f"_j_{x}"]) + b[f"_s_{out}"])

    sums = {}
    for out, x, n, alpha in specs:
        k = F.col(f"_k_{x}")
        z = F.when(k > n, F.lit(alpha) * F.col(x)).when(k == n, F.col(f"_a_{x}"))
        z = F.when(F.col(x).isNotNull(), z) * decay(x, alpha, -1)
        sums[f"_s_{out}"] = F.coalesce(F.sum(z).over(inside), F.lit(0.0)) * decay(x, alpha)
    df = df.withColumns(sums)
    end = F.struct(*[F.col(f"_j_{x}") for x in xs], *[F.col(s) for s in sums])
    df = df.withColumn("_ends", F.collect_list(F.when(F.col("_last"), end)).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    result = {}
    for out, x, n, alpha in specs:
        y = F.col(f"_s_{out}") + F.when(F.col("_blk") > 0, carried(out, x, alpha)).otherwise(F.lit(0.0)) * decay(x, alpha)
        result[out] = F.when((F.col(f"_k_{x}") >= n) & F.col(x).isNotNull(), y)
    return df.withColumns(result).drop(*[f"_{h}_{x}" for x in xs for h in "kaj"], *sums, "_ends")


def directional_inputs(high: Column, low: Column, close: Column, prev_high: Column,
                       prev_low: Column, prev_close: Column) -> dict[str, Column]:
    """True range, directional moves, gains and losses; null on the first row."""
    up, down = high - prev_high, prev_low - low
    change = close - prev_close
    known = prev_close.isNotNull()
    return {
        "_tr": F.when(known, F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))),
        "_pdm": F.when(known, F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))),
        "_mdm": F.when(known, F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0))),
        "_gain": F.when(known, F.greatest(change, F.lit(0.0))),
        "_loss": F.when(known, F.greatest(-change, F.lit(0.0))),
    }


def with_indicators(bars: DataFrame, key: str = "scode", ts: str = "date", block: int = BLOCK) -> DataFrame:
    """``bars`` plus _macd, _signal, _rsi9, _rsi14, _atr5, _atr14, _atr20 and _adx14.

    Bars may lack prices; see the module's note on gaps. All windows share the partitioning by ``key``
    and, but for the row numbers, one order.
    """
    c = F.col
    w = Window.partitionBy(key).orderBy("_blk", ts)
    prev = {f"_prev_{x}": F.lag(x).over(w) for x in ("high", "low", "close")}
    df = with_blocks(bars, key, ts, block).withColumns(prev)
    moves = directional_inputs(c("high"), c("low"), c("close"), *[c(p) for p in prev])
    df = df.withColumns(moves)
    df = smooth_blocks(df, [
        ema("_e12", "close", 12), ema("_e26", "close", 26),
        wilder("_atr5", "_tr", 5), wilder("_atr14", "_tr", 14), wilder("_atr20", "_tr", 20),
        wilder("_g9", "_gain", 9), wilder("_l9", "_loss", 9), wilder("_g14", "_gain", 14), wilder("_l14", "_loss", 14),
        wilder("_p14", "_pdm", 14), wilder("_m14", "_mdm", 14)], key, ts)
    hundred = F.lit(100.0)
    df = df.withColumns({
        "_macd": c("_e12") - c("_e26"),
        "_rsi9": hundred * div("_g9", c("_g9") + c("_l9")),
        "_rsi14": hundred * div("_g14", c("_g14") + c("_l14")),
        "_dx": hundred * div(F.abs(c("_p14") - c("_m14")), c("_p14") + c("_m14")),
    })
    df = smooth_blocks(df, [ema("_signal", "_macd", 9), wilder("_adx14", "_dx", 14)], key, ts)
    return df.drop("_blk", "_last", *prev, *moves, "_e12", "_e26", "_g9", "_l9", "_g14", "_l14", "_p14", "_m14", "_dx")
