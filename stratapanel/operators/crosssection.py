"""Cross-sectional columns: per date, or per date and sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalars import clip, div, probit, zero_to_null
from .groups import join_back
from .ranking import SPACING, average_ranks, order_statistics, pct_rank, rank_share

SECTOR = ["date", "sector33_code"]


def sector_z(df: DataFrame, names: list[str], keys: list[str] = SECTOR, bound: float = 3.0, source: DataFrame | None = None) -> DataFrame:
    """Add ``<name>_sector_z``: (x - mean) / sample std inside the group, clipped.

    A group of one row or without spread gives 0 for every row, null ones too. ``source``: the same
    rows for the statistics. Those of days and sectors are broadcast.
    """
    aggs = {"_n": F.count(F.lit(1))}
    for c in names:
        aggs |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    stats = (df if source is None else source).groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    # settled once a group, not at each row: the mean, the deviation, and 0 as the score of a group without spread
    group = []
    for c in names:
        flat = (F.col("_n") <= 1) | F.coalesce(F.col(f"_s_{c}") == 0.0, F.lit(False))
        group.append(F.struct(F.col(f"_m_{c}").cast("double").alias("m"), zero_to_null(f"_s_{c}").alias("s"), F.when(flat, F.lit(0.0)).alias("z")))
    df = join_back(df, stats.select(*keys, F.array(*group).alias("_g")), keys, few=keys == SECTOR)
    # one lambda for all columns: the code of a row does not grow with them
    scores = F.zip_with(F.array(*[F.col(c).cast("double") for c in names]), "_g",
                        lambda x, g: F.coalesce(g["z"], clip((x - g["m"]) / g["s"], -bound, bound)))
    df = df.withColumn("_z", scores)
    return df.withColumns({f"{c}_sector_z": F.col("_z")[i] for i, c in enumerate(names)}).drop("_g", "_z")


def fill_group_median(df: DataFrame, names: list[str], keys: list[str] = SECTOR) -> DataFrame:
    """Null values take the exact median of their group. Columns are stacked, so all medians come from one rank table and one join.

    Groups of days and sectors are small and their medians few: a day's values meet in one task, and the medians are broadcast.
    """
    if keys == SECTOR:
        values = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).repartition(keys[0])
        wide = values.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_median_{c}") for c in names])
        return with_medians(df, wide, names, keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "_name", "_v")
    q = order_statistics(long, "_v", [*keys, "_name"], [0.5])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("q"))).alias(f"_median_{c}") for c in names])
    return with_medians(df, wide, names, keys)


def with_medians(df: DataFrame, wide: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    out = join_back(df, wide, keys, few=keys == SECTOR)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_median_{c}").cast(df.schema[c].dataType)) for c in names}).drop(*[f"_median_{c}" for c in names])


# Columns the rank transform leaves alone
RANK_EXCLUDED = {
    "scode", "date", "close", "Entry_Price", "Future_High_Tac", "Future_Low_Tac", "Future_Close_Tac",
    "Future_High_Str", "Future_Low_Str", "Future_Close_Str", "target_tac_rank", "target_tac_gauss_rank",
    "target_tac_vol_scaled_residual", "target_tac_smoothed_return", "target_tac_linear_residual",
    "target_tac_tb_strategy_a", "target_tac_tb_strategy_b", "target_tac_tb_strategy_c", "target_str_risk_adj",
    "target_str_consistency", "target_str_vol_scale", "target_str_triple_barrier", "target_str_rank",
    "target_str_peer_alpha", "target_ret_5", "target_ret_60", "Sector_Return_Future", "market_vol_change",
    "market_segment", "overseas_flow_trend", "flow_accel", "Month", "DayOfMonth", "DayOfWeek", "Sin_DayOfWeek",
    "Cos_DayOfWeek", "Is_Gotobi", "Is_Month_End", "Is_Quarter_End", "Quarter", "time_idx", "sector33_code",
    "Sector_Momentum_5d", "sector_return", "sector_short_sell_ratio", "Volume_Log", "Abnormal_Volume",
    "Volume_Change", "Volume_Slope_5", "Log_Trading_Cap", "log_vol_change", "Vol_Ratio_5d", "Vol_Spike_Count_20",
    "EPS_Actual", "is_missing_eps", "log_days_since_pub", "log_market_cap", "turnover_ratio",
}
# Columns scored against their sector, and those that also stay as they are
Z_COLUMNS = [
    "accruals", "eps_growth_yoy", "equity_ratio", "log_pbr", "log_pcfr", "earnings_yield", "div_yield",
    "operating_profit_growth_yoy", "op_margin", "roa", "roe", "sales_growth_yoy", "revision_rate", "progress_rate",
    "ATR_Ratio", "ma_dev_25", "ma_dev_75", "ma_dev_200", "Return_20d", "Return_6m", "Return_12m", "RSI_14",
    "high_52w_dist", "downside_dev_60", "volatility_60", "margin_ratio", "margin_buy_impact",
]
Z_KEPT = ["Return_20d", "RSI_14", "ATR_Ratio", "margin_buy_impact", "margin_ratio", "sales_growth_yoy"]
MEDIAN_FILLED = ["EPS_Actual", "turnover_ratio", "log_market_cap"]
CLIP = 1e-6
PIECE = 12   # scores of a row put together at a time


def rank_columns(df: DataFrame) -> list[str]:
    """Numeric columns to transform; market-wide columns are recognised by prefix."""
    numeric = ("double", "float", "integer", "long", "short", "byte")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in numeric
            and f.name not in RANK_EXCLUDED and not f.name.startswith("Market_")]


def sector_relative(df: DataFrame, horizon: int = 5) -> DataFrame:
    """Sector momentum, relative returns and relative strength; rolling per stock."""
    return df.withColumns({
        "Sector_Momentum_5d": R.roll(F.avg, "sector_return", 5),
        "Sector_Rel": div("close", "sector_return"),
        "Rel_Sector_Return_1d": F.col("Log_Return") - F.col("sector_return"),
        "Rel_Sector_Return_5d": R.roll(F.sum, "Log_Return", 5) - R.roll(F.sum, "sector_return", 5),
        "sector_rel_strength_60": R.roll_growth("sector_return", 60) - R.roll_growth("Market_Return", 60),
        "sector_short_sell_ratio": F.col("selling_volume_ratio"),
        "Sector_Return_Future": R.ahead(F.sum, "sector_return", horizon),
    })


def z_features(df: DataFrame, columns: list[str] | None = None, written: bool = False) -> DataFrame:
    """``<name>_sector_z`` for the listed columns that exist; originals dropped unless kept.

    Rows of a ``written`` table lie in any order, where partial statistics would be as many as the rows: their values go to
    their group instead, without the other columns.
    """
    names = [c for c in (columns or Z_COLUMNS) if c in df.columns]
    return sector_z(df, names, source=df.select(*SECTOR, *names).repartition(*SECTOR) if written else None).drop(*[c for c in names if c not in Z_KEPT])


def gauss_rank_features(df: DataFrame, names: list[str], mask: Column,
                        keys: tuple[str, str] = ("scode", "date"), spacing: int = SPACING) -> DataFrame:
    """Replace columns by normal scores of their rank among the day's broad universe.

    Columns are stacked into (name, value), so ranking and scoring are one narrow pass whatever the number of columns. The
    rows of a day (one a stock) meet in one task as they are, unstacked: their columns are stacked, ranked and put together
    again there, so the values travel once. A lower ``spacing`` splits days for any number of stocks. Scores reach their
    stock's rows by the exchange of the fill: rows outside the universe take the stock's last score, or 0 before the first.
    """
    return fill_scores(df.drop(*names), day_scores(df.where(mask), names, keys, spacing), names, keys).select(*df.columns)


def fill_scores(df: DataFrame, scores: DataFrame, names: list[str], keys: tuple[str, str] = ("scode", "date"), kind: str = "double",
                beside: DataFrame | None = None) -> DataFrame:
    """``df`` with the stock's last of ``scores`` for each name, or 0, as ``kind``; ``beside`` has a row's further columns by the same keys.

    All come to the stock as rows of one union, scores packed: no join, one exchange.
    """
    stock, day = keys
    rows = df.withColumn("_row", F.lit(1)).unionByName(
        scores.select(stock, day, F.array(*[F.col(f"_g_{c}").cast(kind) for c in names]).alias("_g"), F.lit(0).alias("_row")), allowMissingColumns=True)
    more = [] if beside is None else [c for c in beside.columns if c not in keys]
    if more:
        rows = rows.unionByName(beside.select(stock, day, F.struct(*more).alias("_b"), F.lit(0).alias("_row")), allowMissingColumns=True)
    rows = rows.repartition(stock).withColumns({f"_g_{i}": F.col("_g")[i] for i in range(len(names))}).drop("_g")
    w = Window.partitionBy(stock).orderBy(day, "_row")   # what belongs to a day comes before its row
    out = rows.withColumns({f"_g_{i}": R.ffill(f"_g_{i}", w) for i in range(len(names))} | ({"_b": R.ffill("_b", w)} if more else {}))
    out = out.where(F.col("_row") == 1).withColumns({c: F.coalesce(F.col(f"_g_{i}"), F.lit(0.0).cast(kind)) for i, c in enumerate(names)})
    return out.select(*df.columns, *names, *[f"_b.{c}" for c in more])


def day_scores(df: DataFrame, names: list[str], keys: tuple[str, str] = ("scode", "date"), spacing: int = SPACING) -> DataFrame:
    """(stock, day, ``_g_<name>``): normal scores of each value's rank among the day's rows; null for null."""
    stock, day = keys
    values = df.select(stock, day, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    values = values.repartition(day) if spacing >= SPACING else values
    long = values.select(stock, day, F.posexplode(F.array(*[f"_x{i}" for i in range(len(names))])).alias("_name", "_v")).where(F.col("_v").isNotNull())
    if spacing >= SPACING:
        p = rank_share("_v", day, "_name")
    else:
        long, p = average_ranks(long, ["_v"], [day, "_name"], spacing), pct_rank("_v")
    long = long.select(stock, day, "_name", clip(p, CLIP, 1 - CLIP).alias("_p")).select(stock, day, "_name", probit("_p").alias("_g"))
    # put together in pieces, so a score meets PIECE aggregates and not one for each name
    piece, place = F.floor(F.col("_name") / F.lit(PIECE)).cast("int"), F.col("_name") % F.lit(PIECE)
    parts = long.groupBy(stock, day, piece.alias("_c")).agg(*[F.max(F.when(place == j, F.col("_g"))).alias(f"_p{j}") for j in range(min(PIECE, len(names)))])
    if len(names) > PIECE:
        held = F.array(*[f"_p{j}" for j in range(PIECE)])
        parts = parts.groupBy(stock, day).agg(*[F.first(F.when(F.col("_c") == i, held), ignorenulls=True).alias(f"_c{i}") for i in range(-(-len(names) // PIECE))])
        return parts.select(stock, day, *[F.col(f"_c{i // PIECE}")[i % PIECE].alias(f"_g_{c}") for i, c in enumerate(names)])
    return parts.select(stock, day, *[F.col(f"_p{i}").alias(f"_g_{c}") for i, c in enumerate(names)])
