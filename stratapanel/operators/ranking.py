"""Exact ranks (average ties) and order statistics, one plan for groups of any size and values of any distribution.

Equal values are combined first, so a value held by a third of all rows becomes one row. Distinct values are counted by the
leading bits of the double, sign and exponent: one histogram row per group and octave, with its least and greatest value. An
octave beyond ``spacing`` values is refined into equal parts between its own bounds, four times as many as full windows, and
what lies below an octave and below a part is added to what lies below a value inside its part. Outliers and heavy tails fall
into other octaves, clusters narrow their octave's bounds. No window holds a group; windows over histograms hold the octaves
of a group or the parts of an octave. No sampling, no list of splitters, nothing is counted while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import join_back

SPACING = 250_000   # distinct values of an octave that stay together
PARTS = 4           # parts of an octave per ``spacing`` values
SALTS = 1024


def octave(x: Column) -> Column:
    """Sign and exponent of a double as an integer that never falls while the value grows; NaN is last."""
    size = F.floor(F.least(F.log2(F.abs(F.nullif(x, F.lit(0.0)))), F.lit(2000.0))).cast("int") + F.lit(1100)
    return F.when(F.isnan(x), 9999).when(x > 0, size).when(x < 0, -size).otherwise(0)


def with_part(t: DataFrame, value: str, keys: list[str], sums: list[str], spacing: int) -> DataFrame:
    """Add the octave ``_o`` and its part ``_c`` of each distinct value, what lies below the octave (``_up_<name>``) and the
    group's whole (``_n_<name>``), for each of ``sums``."""
    x = F.col(value).cast("double")
    t = t.withColumn("_o", octave(x))
    # counted by a weight, so that every use of ``t`` reads the same columns and shares its exchange
    h = t.groupBy(*keys, "_o").agg(F.count(F.when(F.col(sums[0]) > 0, 1)).alias("_d"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), *[F.sum(s).alias(s) for s in sums])
    wg = Window.partitionBy(*keys)
    upto = wg.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    h = h.select(*keys, "_o", "_d", "_lo", "_hi", *[F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"_up_{s}") for s in sums],
                 *[F.sum(s).over(wg).alias(f"_n_{s}") for s in sums])
    parts = F.ceil(F.col("_d") / F.lit(spacing)) * PARTS
    place = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), parts - 1)
    cut = (F.col("_d") > spacing) & (F.col("_hi") > F.col("_lo")) & (F.abs("_o") < 2124)
    return join_back(t, h, [*keys, "_o"], "inner").withColumn("_c", F.when(cut, place).otherwise(F.lit(0).cast("long"))).drop("_lo", "_hi")


def rank_table(df: DataFrame, value: str, by: list[str], spacing: int = SPACING,
               extra: dict[str, Column] | None = None, weights: list[str] = ()) -> DataFrame:
    """One row per distinct non-null (by, value): ``ties``, ``rank`` (average), ``below``, ``n``.

    ``extra`` aggregates (sum, max, ...) are carried per distinct value; for those named in ``weights``, ``below_<name>`` and
    ``n_<name>`` add them up over smaller values and over the group. Text is ranked by one window.
    """
    extra = extra or {}
    sums = ["ties", *weights]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("ties"), *[a.alias(n) for n, a in extra.items()])
    grp = by or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))

    def inside(keys: list[str]) -> dict[str, Column]:
        w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)   # the hash tells cells apart at once
        return {f"_b_{s}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums}

    if dict(counts.dtypes)[value] == "string":
        ranked = counts.withColumns(inside(grp) | {f"_n_{s}": F.sum(s).over(Window.partitionBy(*grp)) for s in sums})
    else:
        cell = [*grp, "_o", "_c"]
        cut = with_part(counts, value, grp, sums, spacing)
        # parts of refined octaves; what lies below a part in its octave is a row of its own without a value, first in the part's
        # window, so it reaches the part by the part's exchange and nothing is broadcast, however many parts there are
        parts = cut.where(F.col("_d") > spacing).groupBy(*cell).agg(*[F.sum(s).alias(s) for s in sums])
        before = Window.partitionBy(*grp, "_o").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        kinds = {f.name: f.dataType for f in cut.schema.fields}
        parts = parts.select(*cell, *[F.sum(s).over(before).cast(kinds[s]).alias(s) for s in sums]).where(F.col("ties").isNotNull())
        ranked = cut.unionByName(parts, allowMissingColumns=True).repartition(*cell).withColumns(inside(cell)).where(F.col(value).isNotNull())
        ranked = ranked.withColumns({f"_b_{s}": F.col(f"_b_{s}") + F.col(f"_up_{s}") for s in sums})
    below = F.col("_b_ties")
    return ranked.select(*by, value, "ties", *extra, below.alias("below"), (below + (F.col("ties") + F.lit(1)) / F.lit(2.0)).alias("rank"), F.col("_n_ties").alias("n"),
                         *[F.col(f"_{k}_{w}").alias(f"{t}_{w}") for w in weights for k, t in (("b", "below"), ("n", "n"))])


def average_ranks(df: DataFrame, names: list[str], by: list[str], spacing: int = SPACING) -> DataFrame:
    """Add ``<name>__rank`` and ``<name>__n`` (null on null values): average ranks inside ``by``.

    Rows without a value match nothing; they are spread by a salt, so they do not meet in one join key.
    """
    out = df
    for c in names:
        t = rank_table(df, c, by, spacing).select(*by, c, F.col("rank").alias(f"{c}__rank"), F.col("n").alias(f"{c}__n"), F.lit(0).alias("_salt"))
        flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        salt = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(*flat), F.lit(SALTS)).cast("int") + F.lit(1)).otherwise(F.lit(0))
        # the value is the first key: sorts compare it by its leading bytes, which tell rows apart where those of a name or day do not
        out = join_back(out.withColumn("_salt", salt), t, [c, *by, "_salt"]).drop("_salt")
    return out


def rank_share(x: Column | str, *by: str) -> Column:
    """Rank share (0, 1] of a value (average ties) by one window over its group, null for null: for the rows of a day, one a stock.

    Rows that lie together by the first of ``by`` stay there, however many columns are ranked; ``average_ranks`` is for groups of any size.
    """
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    upto, n = F.count(x).over(w), F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))   # upto: ties included
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / F.lit(2.0) / n)


def pct_rank(name: str) -> Column:
    """Rank share (0, 1] of a column ranked by ``average_ranks``."""
    return F.try_divide(F.col(f"{name}__rank"), F.col(f"{name}__n").cast("double"))


def drop_ranks(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[f"{c}__{s}" for c in names for s in ("rank", "n")])


def wanted_spots(probs: list[float]) -> Column:
    """The quantiles with a neighbour among the ``ties`` rows that follow ``below`` of ``n`` sorted ones."""
    below, ties, n = F.col("below"), F.col("ties"), F.col("n")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])

    def touched(s):
        pos = s["p"] * (n - F.lit(1))
        return (F.floor(pos) < below + ties) & (F.least(F.floor(pos) + F.lit(1), n - F.lit(1)) >= below)

    return F.filter(wanted, touched)


def order_statistics(df: DataFrame, value: str, by: list[str], probs: list[float],
                     spacing: int = SPACING) -> DataFrame:
    """(by, ``p`` index, ``q``): exact linear quantiles from the rank table.

    Quantile p sits at position p (n - 1) of the sorted values; the two
    neighbours are found through cumulative counts, so no group is collected.
    """
    t = rank_table(df, value, by, spacing)
    # only runs of ties that hold a neighbour of the quantile go on
    spots = t.select(*by, value, "ties", "below", "n", F.inline(wanted_spots(probs)))
    return at_spots(spots, value, by)


def few_order_statistics(df: DataFrame, value: str, by: list[str], probs: list[float], spacing: int = SPACING) -> DataFrame:
    """``order_statistics`` for a few large groups over a written ``df``, which is read three times instead of exchanged.

    Rows are counted by octave, then those of the octaves that hold a neighbour of a quantile by part; only the rows of such
    parts are combined by value and sorted. The kept octaves and parts, at most two a group and quantile, are broadcast.
    """
    x = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("_o", octave(x))
    of, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    touched = F.size(wanted_spots(probs)) > 0
    h = rows.groupBy(*by, "_o").agg(F.count(F.lit(1)).alias("ties"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    h = h.withColumns({"below": F.coalesce(F.sum("ties").over(upto), F.lit(0)), "n": F.sum("ties").over(of)}).where(touched)
    h = h.withColumn("_parts", F.ceil(F.col("ties") / F.lit(spacing)) * PARTS).withColumnsRenamed({"ties": "_d", "below": "_up"})
    place = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts")), F.col("_parts") - 1)
    cut = (F.col("_d") > spacing) & (F.col("_hi") > F.col("_lo")) & (F.abs("_o") < 2124)
    rows = join_back(rows, F.broadcast(h), [*by, "_o"], "inner").withColumn("_c", F.when(cut, place).otherwise(F.lit(0).cast("long")))
    cell = [*by, "_o", "_c"]
    inside = Window.partitionBy(*by, "_o").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*cell, "_up", "n").agg(F.count(F.lit(1)).alias("ties"))
    parts = parts.withColumn("below", F.col("_up") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).where(touched)
    rows = join_back(rows.select(*cell, value, "n"), F.broadcast(parts.select(*cell, F.col("below").alias("_up"))), cell, "inner")
    t = rows.groupBy(*cell, "_up", "n", value).agg(F.count(F.lit(1)).alias("ties"))
    before = Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("below", F.col("_up") + F.coalesce(F.sum("ties").over(before), F.lit(0)))
    return at_spots(t.select(*by, value, "ties", "below", "n", F.inline(wanted_spots(probs))), value, by)


def at_spots(spots: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quantiles from the runs of ties that hold their neighbours."""
    below, ties, n = F.col("below"), F.col("ties"), F.col("n")
    pos = F.col("p") * (n - F.lit(1))
    lo = F.floor(pos)
    hi = F.least(lo + F.lit(1), n - F.lit(1))

    def at(k):   # value at 0-based position k, if it lies in this run of ties
        return F.max(F.when((k >= below) & (k < below + ties), F.col(value)))

    g = spots.groupBy(*by, "i").agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.max(pos - lo).alias("_w"))
    return g.select(*by, "i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("q"))
