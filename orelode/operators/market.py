"""Analytics on daily bars. Bars are ``symbol, d, open, high, low, close, volume``.

Everything past ``daily_bars`` works on one row per symbol and day, so a window
over one symbol holds its trading days, whatever the number of ticks was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators.ranking import top_n_per, with_percent_rank
from orelode.session import settle

HORIZONS = (1, 7, 30, 182, 365)


def _round(c: Column) -> Column:
    return F.round(c, 6)


def _by_day():
    return Window.partitionBy("symbol").orderBy("d")


def daily_bars(ticks: DataFrame, volume: Column | None = None) -> DataFrame:
    """Bars from ticks (``symbol, ts, tick_id, price``); volume is the tick count if none is given.

    All measures are partial aggregates: a symbol's ticks are reduced in the map tasks.
    """
    place = F.struct("ts", "tick_id")
    return ticks.groupBy("symbol", F.to_date("ts").alias("d")).agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).alias("volume"))


def recent_summary(bars: DataFrame, n: int = 10) -> DataFrame:
    """Summary of the newest ``n`` bars of each symbol."""
    newest = top_n_per(bars, ["symbol"], [F.col("d").desc()], n)
    first, last = F.min_by("close", "d"), F.max_by("close", "d")
    return newest.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("d").alias("first_day"), F.max("d").alias("last_day"),
        first.alias("first_close"), last.alias("last_close"),
        _round(F.try_divide(last - first, first)).alias("pct_change"),
        F.min("low").alias("min_low"), F.max("high").alias("max_high"),
        _round(F.avg("close")).alias("mean_close"), F.sum("volume").alias("sum_volume"))


def momentum(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return against the newest close at least ``h`` days older, for each horizon."""
    day = F.datediff(F.col("d"), F.lit("1970-01-01").cast("date"))
    by_day = Window.partitionBy("symbol").orderBy(day)
    out = bars
    for h in horizons:
        before = F.last("close", ignorenulls=True).over(by_day.rangeBetween(Window.unboundedPreceding, -h))
        out = out.withColumn(f"mom_{h}", _round(F.try_divide(F.col("close"), before) - 1))
    return out


def momentum_rank(bars: DataFrame, horizon: int = 30, k: int = 50, kind: str | None = None) -> DataFrame:
    """Top ``k`` symbols by momentum on their newest day; ``kind`` is confirmed, potential or None."""
    scored = momentum(bars, sorted({7, 182, horizon}))
    newest = top_n_per(scored, ["symbol"], [F.col("d").desc()], 1)
    up7, up182 = F.col("mom_7") > 0, F.coalesce(F.col("mom_182") > 0, F.lit(False))
    labelled = newest.withColumn(
        "kind", F.when(up7 & up182, F.lit("confirmed")).when(up7, F.lit("potential")).otherwise(F.lit("none")))
    chosen = labelled.filter(F.col(f"mom_{horizon}").isNotNull())
    if kind:
        chosen = chosen.filter(F.col("kind") == kind)
    return chosen.select("symbol", "d", "close", F.col(f"mom_{horizon}").alias("momentum"), "kind").orderBy(
        F.col("momentum").desc(), "symbol").limit(k)


def daily_return(bars: DataFrame) -> DataFrame:
    prior = F.lag("close").over(_by_day())
    return bars.withColumn("ret", F.try_divide(F.col("close"), prior) - 1)


def acceleration(bars: DataFrame) -> DataFrame:
    """Change of the daily return."""
    prior, before = F.lag("close", 1).over(_by_day()), F.lag("close", 2).over(_by_day())
    ret = F.try_divide(F.col("close"), prior) - 1
    last_ret = F.try_divide(prior, before) - 1
    return bars.select("symbol", "d", "close", _round(ret).alias("ret"), _round(ret - last_ret).alias("acceleration"))


def volume_anomaly(bars: DataFrame, trailing: int = 20, least: int = 5, limit: float = 3.0) -> DataFrame:
    """Volume against the ``trailing`` bars before it, in standard deviations."""
    frame = _by_day().rowsBetween(-trailing, -1)
    z = F.try_divide(F.col("volume") - F.avg("volume").over(frame), F.stddev_samp("volume").over(frame))
    z = F.when(F.count(F.lit(1)).over(frame) >= least, _round(z))
    return bars.select("symbol", "d", "volume", z.alias("z")).withColumn(
        "is_anomaly", F.coalesce(F.col("z") > limit, F.lit(False)))


def trend_volatility(bars: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Slope sign of the close and deviation of log returns over the last bars."""
    day = F.datediff(F.col("d"), F.lit("1970-01-01").cast("date")).cast("double")
    ratio = F.try_divide(F.col("close"), F.lag("close").over(_by_day()))
    out = bars.withColumn("day_no", day).withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))
    for span in spans:
        frame = _by_day().rowsBetween(-(span - 1), 0)
        slope = F.regr_slope("close", "day_no").over(frame)
        out = out.withColumn(f"trend_{span}", F.when(_round(slope) > 0, F.lit("up")).when(_round(slope) < 0, F.lit("down"))
                             .otherwise(F.lit("flat")))
        out = out.withColumn(f"volatility_{span}", _round(F.stddev_samp("log_ret").over(frame)))
    return out.select("symbol", "d", "close", *[f"{m}_{s}" for s in spans for m in ("trend", "volatility")])


def return_correlation(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Correlation of each symbol's daily returns with those of benchmark symbols on equal days.

    ``benchmark`` is a table of bars of the few reference symbols, such as metals.
    """
    left = daily_return(bars).select("symbol", "d", "ret")
    right = daily_return(benchmark).select(F.col("symbol").alias("benchmark"), "d", F.col("ret").alias("bench_ret"))
    return left.join(right, "d").filter(F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()).groupBy(
        "symbol", "benchmark").agg(F.count(F.lit(1)).alias("n_days"), _round(F.corr("ret", "bench_ret")).alias("correlation"))


def composite_momentum(daily: DataFrame, slices: int | None = None) -> DataFrame:
    """Weighted percent ranks per day, and hype against data-backed momentum.

    ``daily`` has ``symbol, d, mom_30, z, mentions, sentiment_delta``; a missing
    measure ranks lowest. A task sorts a day; with ``slices`` it sorts a range of a day's values, for more symbols
    than a task holds. The result is the same.
    """

    def rank_of(c: str) -> Column:
        return F.percent_rank().over(Window.partitionBy("d").orderBy(F.col(c).asc_nulls_first()))

    measures = {"mom_30": "p_mom", "z": "p_z", "mentions": "p_mentions", "sentiment_delta": "p_sentiment"}
    if slices is None:
        ranked = daily.select("symbol", "d", *(rank_of(c).alias(p) for c, p in measures.items()))
    else:
        ranked = settle(daily.select("symbol", "d", *measures), "measures")
        for c, p in measures.items():
            ranked = with_percent_rank(ranked, "d", c, p, slices)
    score = 0.4 * F.col("p_mom") + 0.2 * F.col("p_z") + 0.2 * F.col("p_mentions") + 0.2 * F.col("p_sentiment")
    hype = (F.col("p_mentions") >= 0.8) & (F.col("p_mom") < 0.5)
    backed = (F.col("p_mom") >= 0.8) & (F.col("p_z") >= 0.5)
    return ranked.select(
        "symbol", "d", _round(score).alias("score"),
        F.when(hype, F.lit("hype")).when(backed, F.lit("data_backed")).otherwise(F.lit("mixed")).alias("label"))


def compare_symbols(measures: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Up to five symbols side by side; ``measures`` has ``symbol, measure, value``."""
    if len(symbols) > 5:
        raise ValueError("compare at most five symbols")
    return measures.filter(F.col("symbol").isin(list(symbols))).groupBy("measure").pivot("symbol", list(symbols)).agg(
        _round(F.max("value")))


def watch_alerts(bars: DataFrame, watchlist: DataFrame, threshold: float) -> DataFrame:
    """Days on which a watched symbol moved by at least ``threshold``."""
    watched = bars.join(watchlist.select("symbol"), "symbol", "left_semi")
    moves = daily_return(watched).withColumn("ret", _round(F.col("ret")))
    return moves.filter(F.abs("ret") >= threshold).select("symbol", "d", "close", "ret")


def status_changes(checks: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Checks (``target_name, checked_at, status``) whose status differs from the one before.

    Checks of one moment are taken in the order of their status.
    """
    rows = checks
    if watchlist is not None:
        rows = rows.join(watchlist.select("target_name"), "target_name", "left_semi")
    w = Window.partitionBy("target_name").orderBy("checked_at", "status")
    return rows.withColumn("previous_status", F.lag("status").over(w)).filter(
        F.col("previous_status").isNotNull() & (F.col("status") != F.col("previous_status")))


def sensitivity(exposures: DataFrame, shocks: Sequence[float] = (-0.2, -0.1, 0.1, 0.2)) -> DataFrame:
    """Value under price shocks; ``exposures`` has ``symbol, value, beta``."""
    shocked = exposures.withColumn("shock", F.explode(F.array(*[F.lit(s) for s in shocks])))
    return shocked.withColumn("shocked_value", _round(F.col("value") * (1 + F.col("shock") * F.col("beta"))))


def quote_direction(quotes: DataFrame) -> DataFrame:
    """Display form of a quote: direction, price and signed change with two decimals."""

    def two(c: str) -> Column:
        return F.col(c).cast("decimal(18,2)").cast("string")

    up = F.col("change_pct") >= 0
    return quotes.select(
        "symbol", two("price").alias("price_text"),
        F.when(up, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
        F.concat(F.when(up, F.lit("+")).otherwise(F.lit("")), two("change_pct"), F.lit("%")).alias("change_text"))
