"""Market analytics on ``events`` read as ticks: a user is a symbol, the value a price."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import plain, query, table
from orelode.operators import market


def ticks(spark, sf, symbol="user"):
    name = F.concat(F.lit("S"), F.col("user_id").cast("string")) if symbol == "user" else F.col("event_type")
    return table(spark, sf, "events").select(
        name.alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"))


def bars(spark, sf, symbol="user"):
    return market.daily_bars(ticks(spark, sf, symbol))


def bars_sql(symbol: str, name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


BARS = bars_sql("'S' || user_id")
METALS = bars_sql("event_type", "metals")
DAY = "date_diff('day', DATE '1970-01-01', d)"


@query("daily_bars", f"WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, open, high, low, close, volume FROM bars")
def daily_bars(spark, sf):
    return plain(bars(spark, sf))


@query("recent_n_summary", f"""WITH {BARS},
newest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 10)
SELECT symbol, count(*) AS n_bars, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day,
  arg_min(close, d) AS first_close, arg_max(close, d) AS last_close,
  round((arg_max(close, d) - arg_min(close, d)) / nullif(arg_min(close, d), 0), 6) AS pct_change,
  min(low) AS min_low, max(high) AS max_high, round(avg(close), 6) AS mean_close, CAST(sum(volume) AS BIGINT) AS sum_volume
FROM newest GROUP BY symbol""")
def recent_n_summary(spark, sf):
    return plain(market.recent_summary(bars(spark, sf), 10))


def mom_sql(h: int) -> str:
    return (f"round(close / nullif(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY {DAY} "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING), 0) - 1, 6) AS mom_{h}")


@query("momentum", f"""WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, {', '.join(mom_sql(h) for h in (1, 7, 30, 182, 365))}
FROM bars""")
def momentum(spark, sf):
    return plain(market.momentum(bars(spark, sf)).drop("open", "high", "low", "close", "volume"))


def rank_sql(h: int, k: int, kind: str | None) -> str:
    cond = f"AND kind = '{kind}'" if kind else ""
    return f"""WITH {BARS}, m AS (SELECT *, {mom_sql(7)}, {mom_sql(182)}, {mom_sql(h).replace(f'mom_{h}', 'momentum')} FROM bars),
newest AS (SELECT *, CASE WHEN mom_7 > 0 AND coalesce(mom_182 > 0, FALSE) THEN 'confirmed' WHEN mom_7 > 0 THEN 'potential'
  ELSE 'none' END AS kind FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1)
SELECT symbol, CAST(d AS VARCHAR) AS d, close, momentum, kind FROM newest WHERE momentum IS NOT NULL {cond}
ORDER BY momentum DESC, symbol LIMIT {k}"""


@query("momentum_rank", rank_sql(7, 50, None))
def momentum_rank(spark, sf):
    return plain(market.momentum_rank(bars(spark, sf), 7, 50))


@query("momentum_potential_top5", rank_sql(1, 5, "potential"))
def momentum_potential(spark, sf):
    return plain(market.momentum_rank(bars(spark, sf), 1, 5, "potential"))


@query("acceleration", f"""WITH {BARS}, r AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, CAST(d AS VARCHAR) AS d, close, round(ret, 6) AS ret,
  round(ret - lag(ret) OVER (PARTITION BY symbol ORDER BY d), 6) AS acceleration FROM r""")
def acceleration(spark, sf):
    return plain(market.acceleration(bars(spark, sf)))


ANOMALY = """z AS (
  SELECT symbol, d, volume, CASE WHEN count(*) OVER w >= 5
    THEN round((volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0), 6) END AS z
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("volume_anomaly", f"""WITH {BARS}, {ANOMALY}
SELECT symbol, CAST(d AS VARCHAR) AS d, volume, z, coalesce(z > 3, FALSE) AS is_anomaly FROM z""")
def volume_anomaly(spark, sf):
    return plain(market.volume_anomaly(bars(spark, sf)))


def span_sql(n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    slope = f"round(regr_slope(close, CAST({DAY} AS DOUBLE)) {w}, 6)"
    # one bar has no slope, which DuckDB calls NaN and sorts above zero
    return (f"CASE WHEN isnan({slope}) THEN 'flat' WHEN {slope} > 0 THEN 'up' WHEN {slope} < 0 THEN 'down' ELSE 'flat' END AS trend_{n}, "
            f"round(stddev_samp(log_ret) {w}, 6) AS volatility_{n}")


@query("trend_volatility", f"""WITH {BARS}, r AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) AS ratio FROM bars),
l AS (SELECT *, CASE WHEN ratio > 0 THEN ln(ratio) END AS log_ret FROM r)
SELECT symbol, CAST(d AS VARCHAR) AS d, close, {span_sql(7)}, {span_sql(30)} FROM l""")
def trend_volatility(spark, sf):
    return plain(market.trend_volatility(bars(spark, sf)))


RET = "close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) - 1"


@query("volatility_corr", f"""WITH {BARS}, {METALS},
a AS (SELECT symbol, d, {RET} AS ret FROM bars), b AS (SELECT symbol AS benchmark, d, {RET} AS bench_ret FROM metals)
SELECT symbol, benchmark, count(*) AS n_days, round(corr(ret, bench_ret), 6) AS correlation
FROM a JOIN b USING (d) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL GROUP BY ALL""")
def volatility_corr(spark, sf):
    return market.return_correlation(bars(spark, sf), bars(spark, sf, "metal"))


COMPOSITE = f"""WITH {BARS}, {ANOMALY}, m AS (SELECT symbol, d, {mom_sql(30)} FROM bars),
e AS (
  SELECT 'S' || user_id AS symbol, CAST(ts AS DATE) AS d, count(*) AS mentions,
    round(avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END), 6) AS mood FROM events GROUP BY ALL),
s AS (SELECT *, round(mood - lag(mood) OVER (PARTITION BY symbol ORDER BY d), 6) AS sentiment_delta FROM e),
daily AS (SELECT m.symbol, m.d, mom_30, z.z, mentions, sentiment_delta FROM m JOIN z USING (symbol, d) JOIN s USING (symbol, d)),
p AS (SELECT symbol, d, percent_rank() OVER (PARTITION BY d ORDER BY mom_30 NULLS FIRST) AS p1,
  percent_rank() OVER (PARTITION BY d ORDER BY z NULLS FIRST) AS p2,
  percent_rank() OVER (PARTITION BY d ORDER BY mentions NULLS FIRST) AS p3,
  percent_rank() OVER (PARTITION BY d ORDER BY sentiment_delta NULLS FIRST) AS p4 FROM daily)
SELECT symbol, CAST(d AS VARCHAR) AS d,
  round(CAST(CAST(0.4::DOUBLE * p1 + 0.2::DOUBLE * p2 + 0.2::DOUBLE * p3 + 0.2::DOUBLE * p4 AS VARCHAR) AS DECIMAL(25, 18)), 6)::DOUBLE AS score,
  CASE WHEN p3 >= 0.8 AND p1 < 0.5 THEN 'hype' WHEN p1 >= 0.8 AND p2 >= 0.5 THEN 'data_backed' ELSE 'mixed' END AS label
FROM p"""


@query("composite_momentum", COMPOSITE)
def composite_momentum(spark, sf):
    return plain(market.composite_momentum(measured(spark, sf)))


@query("composite_momentum_slices", COMPOSITE)
def composite_momentum_slices(spark, sf):
    return plain(market.composite_momentum(measured(spark, sf), slices=8))


def measured(spark, sf):
    from pyspark.sql import Window

    b = bars(spark, sf)
    mom = market.momentum(b, (30,)).select("symbol", "d", "mom_30")
    mood = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    talk = table(spark, sf, "events").groupBy(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol"), F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.avg(mood), 6).alias("mood"))
    w = Window.partitionBy("symbol").orderBy("d")
    talk = talk.withColumn("sentiment_delta", F.round(F.col("mood") - F.lag("mood").over(w), 6))
    z = market.volume_anomaly(b).select("symbol", "d", "z")
    return mom.join(z, ["symbol", "d"]).join(talk, ["symbol", "d"])


@query("compare_pivot", f"""WITH {METALS},
m AS (
  SELECT symbol, 'mean_close' AS measure, avg(close) AS value FROM metals GROUP BY symbol
  UNION ALL SELECT symbol, 'max_high', max(high) FROM metals GROUP BY symbol
  UNION ALL SELECT symbol, 'volume', CAST(sum(volume) AS DOUBLE) FROM metals GROUP BY symbol)
SELECT measure, {', '.join(f"round(max(value) FILTER (WHERE symbol = '{s}'), 6) AS {s}" for s in ('view', 'click', 'error', 'signup', 'purchase'))}
FROM m GROUP BY measure""")
def compare_pivot(spark, sf):
    per = bars(spark, sf, "metal").groupBy("symbol").agg(
        F.avg("close").alias("mean_close"), F.max("high").alias("max_high"), F.sum("volume").cast("double").alias("volume"))
    long = per.unpivot("symbol", ["mean_close", "max_high", "volume"], "measure", "value")
    return market.compare_symbols(long, ["view", "click", "error", "signup", "purchase"])


@query("watch_alerts", f"""WITH {BARS}, r AS (SELECT *, round({RET}, 6) AS ret FROM bars)
SELECT symbol, CAST(d AS VARCHAR) AS d, close, ret FROM r
WHERE abs(ret) >= 0.5 AND symbol IN (SELECT 'S' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def watch_alerts(spark, sf):
    watch = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("symbol"))
    return plain(market.watch_alerts(bars(spark, sf), watch, 0.5))


@query("status_changes", """WITH c AS (
  SELECT 'wf' || user_id AS target_name, ts, event_type AS status,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS previous_status FROM events)
SELECT target_name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS checked_at, status, previous_status FROM c
WHERE previous_status IS NOT NULL AND status <> previous_status""")
def status_changes(spark, sf):
    checks = table(spark, sf, "events").select(
        F.concat(F.lit("wf"), F.col("user_id").cast("string")).alias("target_name"), F.col("ts").alias("checked_at"),
        F.col("event_type").alias("status"))
    return plain(market.status_changes(checks))


@query("sensitivity_grid", """WITH e AS (SELECT c_name AS symbol, c_acctbal AS value, 0.5::DOUBLE + c_nationkey / 10.0::DOUBLE AS beta FROM customer)
SELECT symbol, value, beta, shock, round(value * (1 + shock * beta), 6) AS shocked_value
FROM e, (SELECT unnest([-0.2::DOUBLE, -0.1::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS shock)""")
def sensitivity_grid(spark, sf):
    exposures = table(spark, sf, "customer").select(
        F.col("c_name").alias("symbol"), F.col("c_acctbal").alias("value"),
        (F.lit(0.5) + F.col("c_nationkey") / F.lit(10.0)).alias("beta"))
    return market.sensitivity(exposures)


def two(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"


@query("quote_direction", f"""WITH {BARS}, q AS (
  SELECT symbol, close AS price, round((close - open) / nullif(open, 0) * 100, 6) AS c FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1)
SELECT symbol, {two('price')} AS price_text, CASE WHEN c >= 0 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN c >= 0 THEN '+' ELSE '' END || {two('c')} || '%' AS change_text FROM q""")
def quote_direction(spark, sf):
    from orelode.operators.ranking import latest_per

    newest = latest_per(bars(spark, sf), ["symbol"], [F.col("d").desc()])
    change = F.round(F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100, 6)
    return market.quote_direction(newest.select("symbol", F.col("close").alias("price"), change.alias("change_pct")))
