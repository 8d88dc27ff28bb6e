"""Returns and risk figures."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, BENCHMARK, check
from tapewright.operators.returns import beta, daily_returns, historical_volatility, tail_risk
from tapewright.operators.tails import bar_returns, cell_states, merged_cells, tail_figures
from tapewright.plans import risk

LOOKBACK = 252
_DAY = "CAST(day AS VARCHAR) AS day"


def _returns(spark, folder):
    return daily_returns(base.candles(spark, folder))


@check("daily_returns", f" SELECT symbol, {_DAY}, close, round(ret, 9) AS ret FROM returns", "returns")
def daily_returns_(spark, folder):
    rows = base.rounded(_returns(spark, folder), "ret", digits=9)
    return rows.withColumn("day", F.col("day").cast("string"))


def _vol(n: int) -> str:
    window = f"OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(ret) {window} >= 2 THEN stddev_samp(ret) {window} END, 6) AS vol_{n}d"


@check("historical_volatility", f" SELECT symbol, {_DAY}, {_vol(30)}, {_vol(60)}, {_vol(90)} FROM returns", "returns")
def historical_volatility_(spark, folder):
    rows = base.rounded(historical_volatility(_returns(spark, folder)), "vol_30d", "vol_60d", "vol_90d")
    return rows.select("symbol", F.col("day").cast("string").alias("day"), "vol_30d", "vol_60d", "vol_90d")


def _period(n: int) -> str:
    rows = f"FILTER (day BETWEEN DATE '2024-01-31' - {n - 1} AND DATE '2024-01-31')"
    return f"round(CASE WHEN count(ret) {rows} >= 2 THEN stddev_samp(ret) {rows} END, 6)"


@check(
    "volatility_periods",
    f" SELECT symbol, {_period(7)} AS vol_7d, {_period(30)} AS vol_1m, {_period(365)} AS vol_1y FROM returns GROUP BY 1",
    "returns",
)
def volatility_periods(spark, folder):
    rows = risk.period_volatility(base.candles(spark, folder), AS_OF, "7d,1m,1y")
    return base.rounded(rows, "vol_7d", "vol_1m", "vol_1y")


@check(
    "stock_volatility",
    f""" SELECT m.symbol, unnest(['30d', '60d', '90d']) AS period, m.v AS volatility, i.name, i.sector
    FROM (SELECT symbol, max_by(volatility, ts) AS v FROM metric_points
        WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1) m
    LEFT JOIN instruments i ON upper(m.symbol) = i.symbol""",
    "metric_points",
    "instruments",
)
def stock_volatility(spark, folder):
    rows = risk.stock_volatility(base.metric_points(spark, folder), base.instruments(spark, folder), AS_OF)
    return rows.select("symbol", F.explode("periods").alias("period", "volatility"), "name", "sector")


_BETA = f"""
      SELECT r.symbol, covar_samp(r.ret, b.ret) / nullif(var_samp(b.ret), 0) AS beta, count(*) AS common_days
      FROM returns r JOIN returns b ON r.day = b.day AND b.symbol = '{BENCHMARK}' AND b.ret IS NOT NULL
      WHERE r.ret IS NOT NULL GROUP BY 1"""


@check("beta", f" SELECT symbol, round(beta, 6) AS beta, common_days FROM ({_BETA})", "returns")
def beta_(spark, folder):
    return base.rounded(beta(base.candles(spark, folder), BENCHMARK, AS_OF, LOOKBACK), "beta")


_CUTS = "SELECT symbol, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY 1"
_TAIL = f"""
      SELECT c.symbol, n AS observations, -any_value(q5) AS var_95, -any_value(q1) AS var_99,
        -avg(ret) FILTER (ret <= q5) AS cvar_95, -avg(ret) FILTER (ret <= q1) AS cvar_99
      FROM ({_CUTS}) c JOIN returns r ON r.symbol = c.symbol AND ret IS NOT NULL GROUP BY 1, 2"""


@check(
    "value_at_risk",
    f" SELECT symbol, observations, round(var_95, 6) AS var_95, round(var_99, 6) AS var_99 FROM ({_TAIL})",
    "returns",
)
def value_at_risk(spark, folder):
    rows = tail_risk(base.candles(spark, folder), AS_OF, LOOKBACK)
    return base.rounded(rows.select("symbol", "observations", "var_95", "var_99"), "var_95", "var_99")


@check(
    "conditional_var",
    f" SELECT symbol, round(cvar_95, 6) AS cvar_95, round(cvar_99, 6) AS cvar_99 FROM ({_TAIL})",
    "returns",
)
def conditional_var(spark, folder):
    rows = tail_risk(base.candles(spark, folder), AS_OF, LOOKBACK)
    return base.rounded(rows.select("symbol", "cvar_95", "cvar_99"), "cvar_95", "cvar_99")


_FIGURES = ("vol_30d", "vol_60d", "vol_90d", "beta", "var_95", "var_99", "cvar_95", "cvar_99")
_REPORT = f"""
      SELECT v.symbol, vol_30d, vol_60d, vol_90d, round(beta, 6) AS beta, round(var_95, 6) AS var_95, round(var_99, 6) AS var_99,
        round(cvar_95, 6) AS cvar_95, round(cvar_99, 6) AS cvar_99, i.name, i.exchange, i.sector
      FROM (SELECT symbol, {_period(30)} AS vol_30d, {_period(60)} AS vol_60d, {_period(90)} AS vol_90d
          FROM returns WHERE ret IS NOT NULL GROUP BY 1) v
        LEFT JOIN ({_BETA}) b ON b.symbol = v.symbol LEFT JOIN ({_TAIL}) t ON t.symbol = v.symbol
        LEFT JOIN instruments i ON i.symbol = v.symbol"""


@check("stock_risk_report", f" SELECT * FROM ({_REPORT})", "returns", "instruments")
def stock_risk_report(spark, folder):
    rows = risk.stock_risk(
        base.candles(spark, folder), base.instruments(spark, folder), AS_OF, lookback=f"{LOOKBACK}d", benchmark=BENCHMARK
    )
    return base.rounded(rows.select("symbol", *_FIGURES, "name", "exchange", "sector"), *_FIGURES)


@check(
    "stock_risk_from_summary",
    """ SELECT s.symbol, latest_volatility AS vol_30d, latest_volatility AS vol_90d, CAST(NULL AS DOUBLE) AS beta, i.name
    FROM summaries s LEFT JOIN instruments i ON s.symbol = i.symbol""",
    "summaries",
    "instruments",
)
def stock_risk_from_summary(spark, folder):
    rows = risk.stock_risk_from_summary(base.summaries(spark, folder), base.instruments(spark, folder), AS_OF)
    return rows.select("symbol", "vol_30d", "vol_90d", "beta", "name")


@check(
    "market_index_report",
    f""" SELECT r.*, m.v AS last_volatility FROM ({_REPORT}) r
    JOIN (SELECT symbol, max_by(volatility, ts) AS v FROM metric_points
        WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1) m ON m.symbol = r.symbol""",
    "returns",
    "instruments",
    "metric_points",
)
def market_index_report(spark, folder):
    rows = risk.market_index(
        base.candles(spark, folder), base.metric_points(spark, folder), base.instruments(spark, folder), AS_OF,
        lookback=f"{LOOKBACK}d", benchmark=BENCHMARK,
    )
    report = rows.select("symbol", *_FIGURES, "name", "exchange", "sector", F.col("periods")["30d"].alias("last_volatility"))
    return base.rounded(report, *_FIGURES)


_HOURLY = """
      SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret
      FROM (SELECT printf('SYM%04d', user_id) AS symbol, date_trunc('hour', ts) AS ts, max_by(value, ts) AS close FROM events WHERE value > 0 GROUP BY 1, 2)"""


def _tails_sql(key: str) -> str:
    rows = f"(SELECT {key} AS key, ret FROM ({_HOURLY}) WHERE ret IS NOT NULL)"
    cuts = f"(SELECT key, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1, count(*) AS n FROM {rows} GROUP BY 1)"
    return f"""SELECT key, observations, round(var_95, 6) AS var_95, round(var_99, 6) AS var_99, round(cvar_95, 6) AS cvar_95, round(cvar_99, 6) AS cvar_99
      FROM (SELECT c.key, n AS observations, -any_value(q5) AS var_95, -any_value(q1) AS var_99,
          -avg(ret) FILTER (ret <= q5) AS cvar_95, -avg(ret) FILTER (ret <= q1) AS cvar_99
        FROM {cuts} c JOIN {rows} r ON r.key = c.key GROUP BY 1, 2)"""


def _hourly(spark, folder):
    events = base.table(spark, folder, "events").where(F.col("value") > 0)
    bars = events.groupBy(base.symbol_of("user_id").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"))
    return bar_returns(bars.agg(F.max_by("value", "ts").alias("close")))


_TAILS = ("var_95", "var_99", "cvar_95", "cvar_99")


@check("intraday_tail_risk", f" {_tails_sql('symbol')}")
def intraday_tail_risk(spark, folder):
    rows = _hourly(spark, folder).withColumnRenamed("symbol", "key")
    return base.rounded(tail_figures(rows, ["key"]), *_TAILS)


@check("market_tail_risk", f" {_tails_sql('left(symbol, 3)')}")
def market_tail_risk(spark, folder):
    """A market is the letters its symbols begin with; its cells are merged from theirs."""
    rows = _hourly(spark, folder).withColumn("key", F.substring("symbol", 1, 3))
    states = merged_cells(cell_states(rows, ["key", "symbol"]), ["key"])
    return base.rounded(tail_figures(rows, ["key"], states=states), *_TAILS)
