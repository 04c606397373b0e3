"""DuckDB text of the derived tables, one definition each, composed on demand."""

from __future__ import annotations

import re

from quantloom.operators.panel import BASE_FEATURES, RESIDUAL_FEATURES, RETURN_BARS, ZNORM_FEATURES
from quantloom.plans.derived import BOOKS

_TICKER = "'S' || lpad(CAST({} AS VARCHAR), 9, '0')"
_SUPP = _TICKER.format("l_suppkey")
_W = "(PARTITION BY ticker ORDER BY date)"


def w(n: int, part: str = "ticker") -> str:
    """Window text of the last n rows."""
    return f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prev(n: int, part: str = "ticker") -> str:
    return f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def rank_sql(c: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY {by} ORDER BY {c} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"
    )


def z_sql(c: str, by: str = "date", sd: str = "stddev_samp") -> str:
    return (
        f"CASE WHEN {sd}({c}) OVER (PARTITION BY {by}) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY {by}))"
        f" / {sd}({c}) OVER (PARTITION BY {by}) ELSE 0.0 END"
    )


def clip_sql(x: str, lo=None, hi=None) -> str:
    inner = x
    if hi is not None:
        inner = f"least({inner}, {hi})"
    if lo is not None:
        inner = f"greatest({inner}, {lo})"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {inner} END"


def steps_sql(value: str, rungs, otherwise=0.0) -> str:
    body = " ".join(f"WHEN {value} {op} {t} THEN {p}" for op, t, p in rungs)
    return f"(CASE WHEN {value} IS NULL THEN NULL {body} ELSE {otherwise} END)"


def above_sql(value: str, pairs, otherwise=0.0) -> str:
    return steps_sql(value, [(">", t, p) for t, p in pairs], otherwise)


def below_sql(value: str, pairs, otherwise=0.0) -> str:
    return steps_sql(value, [("<", t, p) for t, p in pairs], otherwise)


def mean_sql(items, default=50.0) -> str:
    total = " + ".join(f"coalesce({i}, 0)" for i in items)
    n = " + ".join(f"CASE WHEN {i} IS NULL THEN 0 ELSE 1 END" for i in items)
    return f"coalesce(CAST({total} AS DOUBLE) / nullif({n}, 0), {default})"


def _beta_part_sql(a: str, b: str, x: str) -> str:
    odd = f"-({a} + m - 1) * ({a} + {b} + m - 1) * {x} / (({a} + 2 * m - 2) * ({a} + 2 * m - 1))"
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    steps = "list_transform(range(300), lambda i: CAST(300 - i AS DOUBLE))"
    fraction = f"(1 / (1 + list_reduce({steps}, lambda v, m: ({odd}) / (1 + ({even}) / (1 + v)), 0.0::DOUBLE)))"
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) * {fraction} / {a}"


def student_sql(t: str, df: str) -> str:
    """Two-sided Student p-value of columns, by the continued fraction of the incomplete beta function."""
    a, b, x = f"({df} / 2.0::DOUBLE)", "0.5::DOUBLE", f"({df} / ({df} + {t} * {t}))"
    return (
        f"(CASE WHEN {t} IS NULL OR {df} <= 0 THEN NULL WHEN {t} = 0 THEN 1.0 WHEN {x} > ({a} + 1) / ({a} + 2.5) THEN 1 - {_beta_part_sql(b, a, f'(1 - {x})')}"
        f" ELSE {_beta_part_sql(a, b, x)} END)"
    )


def normal_sql(z: str) -> str:
    """P(Z > z) by Simpson's rule over 2,000 steps."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 - {z} / 6000.0 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: {weight} * exp(-pow({z} * i / 2000.0, 2) / 2))))"


_lags = ",\n".join(
    f"CASE WHEN row_number() OVER {_W} > {n} THEN adj_close / lag(adj_close, {n}) OVER {_W} - 1 END AS {c}"
    for c, n in RETURN_BARS.items()
)


def _z(c: str, n: int, name: str) -> str:
    return (
        f"CASE WHEN count(*) OVER {w(n)} >= {n} AND stddev_samp({c}) OVER {w(n)} > 0 THEN"
        f" ({c} - avg({c}) OVER {w(n)}) / stddev_samp({c}) OVER {w(n)} END AS {name}"
    )


CTES: dict[str, str] = {
    "prices": f"""SELECT {_SUPP} AS ticker, CAST(l_shipdate AS DATE) AS date,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS adj_close,
  CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2""",
    "bench": """SELECT 'SPY' AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close,
  avg(l_extendedprice) AS adj_close FROM lineitem GROUP BY 2""",
    "meta": f"""SELECT {_TICKER.format('s_suppkey')} AS ticker, s_name AS company_name, r_name AS sector, n_name AS industry,
  CASE WHEN s_acctbal > 0 THEN s_acctbal * 1e7 END AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fundq": f"""SELECT {_SUPP} AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, avg(l_extendedprice) AS ap,
  avg(l_quantity) AS aq, avg(l_discount) AS ad, avg(l_tax) AS tx, count(*) AS n, sum(l_extendedprice) AS rev,
  sum(l_extendedprice * l_discount) AS earn, sum(l_extendedprice * (l_discount - 0.05::DOUBLE)) AS fcf FROM lineitem GROUP BY 1, 2""",
    "fund": """SELECT ticker, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date,
  CASE WHEN n % 7 <> 0 THEN round(ap / 2000 + 1.371e-8::DOUBLE, 6) END AS pe_ratio, CASE WHEN n % 9 <> 0 THEN round(ap / 40000 + 1.371e-8::DOUBLE, 6) END AS peg_ratio,
  round(aq / 10 + 1.371e-8::DOUBLE, 6) AS pb_ratio, round(aq / 15 + 1.371e-8::DOUBLE, 6) AS ps_ratio, round(ap / 4000 + 1.371e-8::DOUBLE, 6) AS ev_to_ebitda,
  round(ad * 3 + 1.371e-8::DOUBLE, 6) AS roe, round(ad + 1.371e-8::DOUBLE, 6) AS roa, round(tx * 25 + 1.371e-8::DOUBLE, 6) AS debt_to_equity,
  CASE WHEN n % 8 <> 0 THEN round(ad * 2 + 1.371e-8::DOUBLE, 6) END AS profit_margin, round(ad * 2.5::DOUBLE + 1.371e-8::DOUBLE, 6) AS operating_margin,
  round(ad * 8 + 1.371e-8::DOUBLE, 6) AS gross_margin, round(n / 10::DOUBLE + 1.371e-8::DOUBLE, 6) AS current_ratio, round(n / 15::DOUBLE + 1.371e-8::DOUBLE, 6) AS quick_ratio,
  round(rev / lag(rev) OVER (PARTITION BY ticker ORDER BY q) - 1 + 1.371e-8::DOUBLE, 6) AS revenue_growth,
  round(earn / nullif(lag(earn) OVER (PARTITION BY ticker ORDER BY q), 0) - 1 + 1.371e-8::DOUBLE, 6) AS earnings_growth,
  CASE WHEN n % 13 = 0 THEN 0.0::DOUBLE ELSE round(tx + 1.371e-8::DOUBLE, 6) END AS dividend_yield,
  CASE WHEN n % 11 <> 0 THEN round(tx * 12 + 1.371e-8::DOUBLE, 6) END AS payout_ratio,
  CASE WHEN n % 10 <> 0 THEN CAST(round(fcf * 1000, 0) AS BIGINT) END AS free_cash_flow FROM fundq""",
    "uni": """SELECT CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS snapshot_date, ticker FROM prices
  GROUP BY 1, 2 HAVING count(*) >= 18""",
    "unimarks": """SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt,
  row_number() OVER (ORDER BY snapshot_date) AS k FROM (SELECT DISTINCT snapshot_date FROM uni)""",
    "changes": """SELECT coalesce(b.date, a.date) AS date, CASE WHEN b.ticker IS NULL THEN a.ticker END AS added,
  CASE WHEN a.ticker IS NULL THEN b.ticker END AS removed, 'bars per quarter' AS reason
  FROM (SELECT nxt AS date, ticker FROM uni JOIN unimarks USING (snapshot_date) WHERE nxt IS NOT NULL) b
  FULL JOIN (SELECT u.snapshot_date AS date, ticker FROM uni u JOIN unimarks m ON m.nxt = u.snapshot_date) a
  ON a.date = b.date AND a.ticker = b.ticker WHERE a.ticker IS NULL OR b.ticker IS NULL""",
    "news": f"""SELECT d.doc_id, {_TICKER.format('(d.doc_id % (SELECT count(*) FROM supplier) + 1)')} AS ticker,
  TIMESTAMP '1997-01-01' + to_hours(CAST(d.doc_id * 7919 % 26280 AS BIGINT)) AS published_at, split_part(text, chr(10), 1) AS title, text,
  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
  n_chars / (n_chars + 2000.0::DOUBLE) AS confidence, (d.doc_id % 10) / 10.0::DOUBLE AS relevance,
  CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END * (n_chars / (n_chars + 2000.0::DOUBLE)) AS sentiment
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "rets": f"SELECT *, adj_close / nullif(lag(adj_close) OVER {_W}, 0) - 1 AS ret FROM prices",
    "brets": f"SELECT date, adj_close / nullif(lag(adj_close) OVER (ORDER BY date), 0) - 1 AS spy_ret FROM bench",
    "mends": "SELECT max(date) AS date FROM prices GROUP BY date_trunc('month', date)",
    "cal": "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM prices)",
    "bar1": f"""SELECT ticker, date, adj_close, volume, row_number() OVER {_W} AS bar_no,
  adj_close / lag(adj_close) OVER {_W} - 1 AS ret, {_lags},
  lead(adj_close, 21) OVER {_W} / adj_close - 1 AS future_return,
  lead(adj_close, 42) OVER {_W} / adj_close - 1 AS future_return_2m, lead(date) OVER {_W} AS nxt FROM prices""",
    "bar2": f"""SELECT *, stddev_samp(ret) OVER {w(19)} * sqrt(252) AS volatility_20d, stddev_samp(ret) OVER {w(59)} * sqrt(252) AS volatility_60d,
  adj_close / avg(adj_close) OVER {w(50)} - 1 AS dist_from_sma_50, adj_close / avg(adj_close) OVER {w(200)} - 1 AS dist_from_sma_200,
  adj_close / max(adj_close) OVER {w(252)} - 1 AS dist_from_52w_high, adj_close / min(adj_close) OVER {w(252)} - 1 AS dist_from_52w_low,
  volume / nullif(avg(volume) OVER {w(20)}, 0) AS volume_ratio_20, volume / nullif(avg(volume) OVER {w(60)}, 0) AS volume_ratio_60,
  (volume - avg(volume) OVER {w(20)}) / nullif(stddev_samp(volume) OVER {w(20)}, 0) AS volume_zscore,
  avg(volume) OVER {w(5)} / nullif(avg(volume) OVER {w(20)}, 0) AS volume_5d_ratio,
  CASE WHEN count(ret) OVER {w(21)} = 21 THEN sum(ret) OVER {w(21)} END AS s21, CASE WHEN count(ret) OVER {w(63)} = 63 THEN sum(ret) OVER {w(63)} END AS s63,
  CASE WHEN count(ret) OVER {w(20)} = 20 THEN stddev_samp(ret) OVER {w(20)} * sqrt(252) END AS v20,
  CASE WHEN count(*) OVER {w(20)} = 20 THEN avg(volume) OVER {w(20)} END AS mv20 FROM bar1""",
    "bars": f"SELECT *, {_z('s21', 60, 'return_1m_zscore')}, {_z('s63', 120, 'return_3m_zscore')}, {_z('v20', 60, 'vol_zscore_rolling')}, {_z('mv20', 60, 'volume_zscore_rolling')} FROM bar2",
    "mkt": f"""SELECT date, market_volatility, market_trend, spy_return FROM (SELECT date,
  row_number() OVER (ORDER BY date) AS n, stddev_samp(r) OVER (ORDER BY date ROWS 18 PRECEDING) * sqrt(252) AS market_volatility,
  adj_close / lag(adj_close, 62) OVER (ORDER BY date) - 1 AS market_trend,
  lead(adj_close, 21) OVER (ORDER BY date) / adj_close - 1 AS spy_return
  FROM (SELECT date, adj_close, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS r FROM bench)) WHERE n >= 63""",
    "px": f"""SELECT * REPLACE (CASE WHEN spy_return IS NOT NULL THEN future_return END AS future_return), future_return - spy_return AS target_excess,
  return_1m * ln(1 + volume_ratio_20) AS mom_vol_interaction, -return_5d * volatility_20d AS reversal_vol_interaction,
  dist_from_sma_50 * ln(1 + volume_ratio_20) AS sma_vol_interaction, -dist_from_52w_high * return_3m AS high_mom_interaction,
  return_1m / (volatility_20d / nullif(market_volatility, 0) + 0.5) AS vol_regime_interaction
  FROM (SELECT m.date, b.date AS bar_date, b.* EXCLUDE (date, nxt), k.market_volatility, k.market_trend, k.spy_return, g.sector FROM bars b
  JOIN mends m ON m.date >= b.date AND (m.date < b.nxt OR b.nxt IS NULL) JOIN mkt k ON k.date = m.date LEFT JOIN meta g ON g.ticker = b.ticker WHERE bar_no >= 252)""",
    "scores": f"SELECT ticker, date, sector, return_6m, volatility_20d, market_volatility, future_return, target_excess, {rank_sql('return_6m')} AS score FROM px",
    "books": f"""SELECT *, inv / sum(inv) OVER (PARTITION BY strategy, date) AS weight FROM (SELECT strategy, slots, s.*,
  1 / greatest(coalesce(volatility_20d, median(volatility_20d) OVER (PARTITION BY strategy, date)), 0.10) AS inv
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS place FROM scores) s
  JOIN (VALUES {', '.join(f"('{k}', {n})" for k, n in BOOKS.items())}) v(strategy, slots) ON place <= slots)""",
    "plan": """SELECT d.date, c1.next_date AS entry_date, c2.next_date AS exit_date FROM
  (SELECT date, lead(date) OVER (ORDER BY date) AS following FROM (SELECT DISTINCT date FROM scores)) d
  JOIN cal c1 ON c1.date = d.date JOIN cal c2 ON c2.date = d.following WHERE c1.next_date IS NOT NULL AND c2.next_date IS NOT NULL""",
    "held": """SELECT b.*, entry_date, exit_date, CASE WHEN p1.date - entry_date <= 7 THEN p1.adj_close END AS entry_price,
  CASE WHEN p2.date - exit_date <= 7 THEN p2.adj_close END AS exit_price
  FROM books b JOIN plan USING (date) ASOF LEFT JOIN prices p1 ON p1.ticker = b.ticker AND p1.date >= plan.entry_date
  ASOF LEFT JOIN prices p2 ON p2.ticker = b.ticker AND p2.date >= plan.exit_date""",
    "hret": "SELECT *, CASE WHEN entry_price > 0 THEN coalesce(exit_price / entry_price - 1, -0.20) END AS hold_return FROM held",
    "pret": """SELECT strategy, date, sum(weight * hold_return) / sum(CASE WHEN hold_return IS NOT NULL THEN weight END) AS raw_return,
  count(hold_return) AS n_held FROM hret GROUP BY 1, 2 HAVING count(hold_return) > 0""",
    "spyret": """SELECT plan.date, coalesce(b2.adj_close / b1.adj_close - 1, 0) AS spy_return FROM plan
  LEFT JOIN bench b1 ON b1.date = entry_date LEFT JOIN bench b2 ON b2.date = exit_date""",
    "bookdates": """SELECT strategy, date, lead(date) OVER (PARTITION BY strategy ORDER BY date) AS nxt, row_number() OVER (PARTITION BY strategy ORDER BY date) AS k
  FROM (SELECT DISTINCT strategy, date FROM books)""",
    "bookdiff": """SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.date, b.nxt) AS date, coalesce(a.ticker, b.ticker) AS ticker,
  coalesce(a.weight, 0) AS weight_now, coalesce(b.weight, 0) AS weight_before FROM books a
  FULL JOIN (SELECT bk.strategy, nxt, ticker, weight FROM books bk JOIN bookdates d ON d.strategy = bk.strategy AND d.date = bk.date WHERE nxt IS NOT NULL) b
  ON a.strategy = b.strategy AND a.date = b.nxt AND a.ticker = b.ticker""",
    "hchange": """SELECT f.strategy, f.date, count(*) FILTER (weight_before = 0 AND weight_now <> 0) AS entered,
  count(*) FILTER (weight_now = 0 AND weight_before <> 0) AS exited,
  count(*) FILTER ((weight_now = 0) <> (weight_before = 0)) / (2.0::DOUBLE * CASE f.strategy WHEN 'top05' THEN 5 WHEN 'top10' THEN 10 ELSE 20 END) AS turnover
  FROM bookdiff f JOIN bookdates d ON d.strategy = f.strategy AND d.date = f.date WHERE k > 1 GROUP BY 1, 2""",
    "strat": """SELECT *, round(portfolio_return - spy_return, 6) AS excess_return FROM (
  SELECT strategy, p.date, year(p.date) AS year, round(round(0.1::DOUBLE * ln(1 + raw_return), 6) - cost, 6) AS gross_return,
  round(round(0.1::DOUBLE * ln(1 + raw_return), 6) - 0.04::DOUBLE - cost, 6) AS portfolio_return,
  round(0.1::DOUBLE * ln(1 + spy_return), 6) AS spy_return, turnover, market_volatility
  FROM (SELECT p.*, turnover, 0.001::DOUBLE + coalesce(0.001::DOUBLE + 0.001::DOUBLE * turnover, 0.0015::DOUBLE) AS cost
        FROM pret p LEFT JOIN hchange h ON h.strategy = p.strategy AND h.date = p.date) p
  JOIN spyret s ON s.date = p.date JOIN (SELECT date, max(market_volatility) AS market_volatility FROM scores GROUP BY 1) v ON v.date = p.date)""",
}
_rs = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY date, sector) AS {c}_resid" for c in RESIDUAL_FEATURES)
_zs = ", ".join(f"{z_sql(c)} AS {c}_znorm" for c in ZNORM_FEATURES)
_rk = ", ".join(f"{rank_sql(c)} AS {c}_rank" for c in BASE_FEATURES)
CTES["tgt1"] = """SELECT *, CASE WHEN future_return_2m IS NULL THEN future_return ELSE 0.6 * future_return + 0.4 * future_return_2m END AS future_return_smooth FROM px"""
CTES["tgt2"] = """SELECT *, CASE WHEN sector IS NOT NULL THEN future_return_smooth - avg(future_return_smooth) OVER (PARTITION BY date, sector) END AS future_return_resid FROM tgt1"""
CTES["tgt3"] = f"""SELECT *, {rank_sql('future_return_resid')} AS future_return_resid_rank, {rank_sql('future_return')} AS future_return_rank,
  future_return_resid / CASE WHEN volatility_20d IS NOT NULL THEN greatest(volatility_20d, 0.10) END AS tv FROM tgt2"""
CTES["tgt"] = f"""SELECT *, CASE WHEN sdv IS NULL THEN tv WHEN tv IS NOT NULL THEN greatest(least(tv, mv + 3 * sdv), mv - 3 * sdv) END AS target_vol_scaled FROM (
  SELECT *, avg(tv) OVER (PARTITION BY date) AS mv, stddev_samp(tv) OVER (PARTITION BY date) AS sdv,
  CASE WHEN round(future_return_resid_rank, 9) >= 0.9 THEN 1 WHEN future_return_resid_rank IS NOT NULL THEN 0 END AS target_binary,
  {z_sql('future_return_resid')} AS target_regression FROM tgt3)"""
CTES["xs"] = f"SELECT *, {_rs}, {_zs}, {_rk} FROM tgt"


def add_cte(name: str, text: str) -> None:
    if name in CTES:
        raise ValueError(f"duplicate derived table {name}")
    CTES[name] = text


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", text, flags=re.I))
    return [n for n in CTES if n in words]


def compose(body: str) -> str:
    """Prefix a query with the derived tables it reads, in dependency order."""
    order: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in _needs(text):
            if name in trail or name in order:
                continue
            visit(CTES[name], (*trail, name))
            order.append(name)

    visit(body, ())
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body
