"""Building blocks of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from stratapanel.functions import scalars as S
from stratapanel.sources.proxy import MARKETS

W = "PARTITION BY scode ORDER BY date"


def r(x: str, d: int = 6) -> str:
    """Same grid as ``scalars.snap``."""
    scale = f"{10 ** d}.0::DOUBLE"
    return f"floor(({x})::DOUBLE * {scale} + 0.4971::DOUBLE) / {scale}"


def cols(names, d: int = 6) -> str:
    return ", ".join(f"{r(n, d)} AS {n}" for n in names)


def over(agg: str, x: str, n: int, w: str = W) -> str:
    return f"{agg}({x}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, w: str = W) -> str:
    return f"(CASE WHEN {over('count', x, n, w)} >= {n} THEN {over(agg, x, n, w)} END)"


def ahead(agg: str, x: str, h: int, w: str = W) -> str:
    fr = f"OVER ({w} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"(CASE WHEN count({x}) {fr} >= {h} THEN {agg}({x}) {fr} END)"


def lag(x: str, k: int = 1, w: str = W) -> str:
    return f"lag({x}, {k}) OVER ({w})"


def lead(x: str, k: int = 1, w: str = W) -> str:
    return f"lead({x}, {k}) OVER ({w})"


def ffill(x: str, w: str = W) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b})::DOUBLE, 0))"


def ln(x: str) -> str:
    return f"ln(CASE WHEN ({x}) > 0 THEN ({x}) END)"


def pct(x: str, k: int = 1, w: str = W) -> str:
    return f"({div(x, lag(x, k, w))} - 1)"


def clip(x: str, lo, hi) -> str:
    y = x
    if lo is not None:
        y = f"greatest({y}, {lo}::DOUBLE)"
    if hi is not None:
        y = f"least({y}, {hi}::DOUBLE)"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {y} END)"


def pctrank(x: str, by: str) -> str:
    """Average-tie rank share of non-null values inside ``by``."""
    o = f"PARTITION BY {by} ORDER BY {x} NULLS LAST" if by else f"ORDER BY {x} NULLS LAST"
    p = f"PARTITION BY {by}" if by else ""
    rank = f"(rank() OVER ({o}) + (count({x}) OVER ({o} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"
    return f"(CASE WHEN {x} IS NOT NULL THEN {rank}::DOUBLE / count({x}) OVER ({p}) END)"


def avgrank(x: str, by: str) -> str:
    o = f"PARTITION BY {by} ORDER BY {x} NULLS LAST" if by else f"ORDER BY {x} NULLS LAST"
    return (f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({o}) + "
            f"(count({x}) OVER ({o} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)::DOUBLE END)")


def _poly(cs, x: str) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * pow({x}, {i})" if i else f"({c!r}::DOUBLE)" for i, c in enumerate(cs))


def probit(p: str) -> str:
    rr = f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    c = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    tail = (f"(CASE WHEN {rr} <= 5 THEN ({_poly(S.PPND_C, f'({rr} - 1.6)')}) / ({_poly(S.PPND_D, f'({rr} - 1.6)')}) "
            f"ELSE ({_poly(S.PPND_E, f'({rr} - 5)')}) / ({_poly(S.PPND_F, f'({rr} - 5)')}) END)")
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({p} - 0.5) <= 0.425 "
            f"THEN ({p} - 0.5) * ({_poly(S.PPND_A, c)}) / ({_poly(S.PPND_B, c)}) "
            f"ELSE sign({p} - 0.5) * {tail} END)")


def chain(base: str, stages: list[dict[str, str]], prefix: str = "st") -> tuple[str, str]:
    """CTEs adding columns level by level; returns (ctes, last name)."""
    prev, out = base, []
    for i, st in enumerate(stages):
        name = f"{prefix}{i}"
        body = ", ".join(f"{e} AS {n}" for n, e in st.items())
        out.append(f"{name} AS (SELECT *, {body} FROM {prev})")
        prev = name
    return ", ".join(out), prev


TRADES = """trades AS (
 SELECT l_suppkey AS scode, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, * FROM lineitem)"""
_K = "(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 1000000 {0}"
BARS = f"""{TRADES}, bars AS MATERIALIZED (
 SELECT scode, date, first(p * (1 - l_discount / 2) ORDER BY {_K.format('ASC')}) AS open,
  max(p * (1 + l_tax)) AS high, min(p * (1 - l_discount)) AS low,
  first(p * (1 + l_tax / 2) ORDER BY {_K.format('DESC')}) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS volume_p
 FROM trades GROUP BY scode, date)"""
SYMBOLS = "symbols AS (SELECT s_suppkey AS scode, CAST(s_nationkey AS VARCHAR) AS sector33_code FROM supplier)"
_M = ", ".join(f"'{m}'" for m in MARKETS)
MARKET_NAMES = f"markets AS (SELECT s_suppkey AS scode, ([{_M}])[s_nationkey % {len(MARKETS)} + 1] AS market FROM supplier)"
TOPIX_RAW = "topix_raw AS (SELECT date, avg(p) AS close FROM trades GROUP BY date)"
DW = "ORDER BY date"
TOPIX = f"""{TOPIX_RAW}, topix0 AS (SELECT *, ln(close / lag(close) OVER ({DW})) AS Market_Return FROM topix_raw),
topix AS MATERIALIZED (SELECT date, close AS close_mkt, Market_Return,
 close / {roll('avg', 'close', 25, DW)} AS Market_Trend_Idx, {roll('stddev_samp', 'Market_Return', 20, DW)} AS Market_HV_20 FROM topix0)"""
N225 = f"""n225_raw AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1),
n225_0 AS (SELECT *, {pct('close', 1, DW)} AS ret FROM n225_raw),
n225_1 AS (SELECT *, {roll('stddev_samp', 'ret', 20, DW)} AS hv FROM n225_0),
n225 AS MATERIALIZED (SELECT date, hv - lag(hv) OVER ({DW}) AS market_vol_change FROM n225_1)"""
INVESTORS = """investors_raw AS (SELECT (date_trunc('week', o_orderdate)::DATE + 11) AS PubDate,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS FrgnBuy,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END AS IndBuy FROM orders),
investors AS (SELECT PubDate, sum(FrgnBuy) AS Foreign_Net_Buy, sum(IndBuy) AS Individual_Net_Buy FROM investors_raw GROUP BY PubDate)"""
FIN_RAW = f"""fin0 AS (SELECT scode, date_trunc('month', date)::DATE AS m, sum(l_extendedprice) AS sales,
  sum(l_extendedprice * (l_discount - 0.02::DOUBLE)) AS operating_profit, avg(l_tax) AS tax, sum(l_quantity) * 100.0::DOUBLE AS shares_outstanding
  FROM trades GROUP BY scode, date_trunc('month', date)),
fin1 AS (SELECT *, last_day(m) + 10 AS published_date, operating_profit * 0.6::DOUBLE AS net_income, sales * 3.0::DOUBLE AS total_assets,
  sales * 3.0::DOUBLE * (0.5::DOUBLE - tax) AS equity FROM fin0),
fin_raw AS MATERIALIZED (SELECT published_date, scode,
  CASE WHEN month(m) % 3 <> 0 THEN {div('net_income', 'shares_outstanding')} END AS eps,
  {div('equity', 'shares_outstanding')} AS bps, {div('net_income', 'shares_outstanding')} * 0.3::DOUBLE AS dps,
  sales, operating_profit, CASE WHEN month(m) % 4 <> 0 THEN operating_profit * 1.1::DOUBLE END AS operating_profit_forecast,
  net_income, total_assets, equity, shares_outstanding,
  CASE WHEN month(m) % 2 = 0 THEN net_income * 0.8::DOUBLE END AS operating_cf FROM fin1)"""
_FW = "PARTITION BY scode ORDER BY published_date"
FIN_VALUES = ["eps", "bps", "dps", "sales", "operating_profit", "operating_profit_forecast", "net_income",
              "total_assets", "equity", "shares_outstanding", "operating_cf"]
FIN = f"""{FIN_RAW}, fin AS MATERIALIZED (SELECT published_date, scode,
  {", ".join((f"coalesce({ffill(c, _FW)}, 0)" if c == 'operating_cf' else ffill(c, _FW)) + f" AS {c}" for c in FIN_VALUES)} FROM fin_raw)"""
MARGIN = """margin AS MATERIALIZED (SELECT date_trunc('week', date)::DATE + 4 AS date, scode,
  coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS long_margin_trade_balance_share,
  coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS short_margin_trade_balance_share
  FROM trades GROUP BY 1, 2)"""
SHORTS = """shorts_raw AS (SELECT date, sector33_code AS S33,
  sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS SellExShortVa,
  sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_extendedprice END) AS ShrtWithResVa,
  sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_extendedprice END) AS ShrtNoResVa
  FROM trades JOIN symbols USING (scode) GROUP BY date, sector33_code),
shorts AS MATERIALIZED (SELECT date, S33 AS sector33_code, (coalesce(ShrtWithResVa, 0) + coalesce(ShrtNoResVa, 0)) / nullif(coalesce(SellExShortVa, 0), 0) AS selling_volume_ratio FROM shorts_raw)"""
SECTOR_RETURN = f"""secret0 AS (SELECT scode, date, {pct('close')} AS ret FROM bars),
sector_return AS MATERIALIZED (SELECT date, sector33_code, avg(ret) AS sector_return FROM secret0 JOIN symbols USING (scode) GROUP BY date, sector33_code)"""
SCORED = f"""daily AS (SELECT user_id AS scode, CAST(ts AS DATE) AS date, avg(value) AS value, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS label,
  max(value) AS hi, min(value) AS lo FROM events GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT scode, date, {r('value / 250.0::DOUBLE', 4)} AS score, label, lead(value) OVER (PARTITION BY scode ORDER BY date) AS target, hi, lo FROM daily)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c for c in ctes if c) + " "
