"""Queries on prices, panels, books and returns, with DuckDB SQL for the same rows.

Floating-point results are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofworks.operators import asof, backtest, calendar, consensus, lifecycle, metrics, portfolio, returns, scoring, stats

from . import derived as D
from .derived import HEDGE, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Calendars and look-ups


@query(sql("SELECT as_of FROM months", "months"))
def month_calendar(spark, d):
    return D.months(spark, d)


@query(sql("SELECT as_of FROM months WHERE month(as_of) % 3 = 0", "months"))
def quarter_calendar(spark, d):
    return D.quarters(spark, d)


@query(sql("SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next_as_of FROM months", "months"))
def next_date_map(spark, d):
    return calendar.with_next(D.months(spark, d))


@query(sql("SELECT last_day(CAST(date_trunc('quarter', m) + INTERVAL 2 MONTH AS DATE)) AS as_of FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders) GROUP BY ALL HAVING last_day(CAST(date_trunc('quarter', min(m)) + INTERVAL 2 MONTH AS DATE)) <= (SELECT last_day(CAST(max(o_orderdate) AS DATE)) FROM orders)"))
def rebalance_quarters(spark, d):
    days = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    return calendar.rebalance_dates(calendar.span(days, "day"), every="quarter")


@query(sql("SELECT symbol, sector, date, close, oi, rate FROM market", "market"))
def market_close(spark, d):
    return D.market(spark, d)


@query(sql("SELECT symbol, as_of, max_by(close, date) AS close, max(date) AS close_date FROM market JOIN months ON date <= as_of GROUP BY ALL", "market", "months"))
def asof_close(spark, d):
    return asof.asof_by_calendar(D.prices(spark, d), D.months(spark, d))


@query(sql("SELECT symbol, as_of, max_by(close, date) AS close, max(date) AS close_date FROM market JOIN months ON date <= as_of GROUP BY ALL", "market", "months"))
def asof_close_merge(spark, d):
    span = calendar.span(D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day")  # one row
    firsts = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    probes = D.sectors(spark, d).select("symbol").join(F.broadcast(span)).select("symbol", "start", "end", F.explode(firsts).alias("_m")).withColumn("as_of", F.last_day("_m"))
    return asof.asof_by_merge(D.prices(spark, d), probes.where(F.col("as_of").between(F.col("start"), F.col("end"))))


@query(f"{sql('', 'market').rstrip()}, days AS (SELECT DISTINCT date AS as_of FROM market), grid_ AS (SELECT symbol, as_of FROM (SELECT DISTINCT symbol FROM market) CROSS JOIN days) SELECT g.symbol, g.as_of, m.close, m.date AS close_date FROM grid_ g ASOF JOIN market m ON g.symbol = m.symbol AND g.as_of >= m.date")
def asof_daily(spark, d):
    """Closes as of every day of the market: some 2,400 dates."""
    return asof.asof(D.prices(spark, d), D.market(spark, d).select(F.col("date").alias("as_of")))


@query("WITH hours AS (SELECT DISTINCT date_trunc('hour', ts) AS as_of FROM events), kinds AS (SELECT DISTINCT event_type FROM events), latest AS (SELECT event_type, ts, max(value) AS value FROM events GROUP BY ALL) SELECT k.event_type, h.as_of, l.value, l.ts AS value_date FROM (SELECT * FROM hours CROSS JOIN kinds) h JOIN kinds k USING (event_type) ASOF JOIN latest l ON l.event_type = k.event_type AND h.as_of >= l.ts")
def asof_hourly(spark, d):
    """The last value of each kind of event as of every full hour that has events."""
    e = D.table(spark, d, "events")
    latest = e.groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    return asof.asof(latest, e.select(F.date_trunc("hour", "ts").alias("as_of")), "value", "event_type", "ts")


@query(sql("SELECT symbol, as_of, oi FROM ois", "ois"))
def asof_open_interest(spark, d):
    return backtest.open_interest(D.market(spark, d), D.months(spark, d))


@query("SELECT user_id, as_of, max_by(value, (ts, event_id)) AS value, max(ts) AS value_at FROM events JOIN (SELECT DISTINCT CAST(ts AS DATE) AS as_of FROM events) c ON CAST(ts AS DATE) <= as_of GROUP BY ALL")
def asof_events(spark, d):
    e = D.table(spark, d, "events")
    days = e.select(F.to_date("ts").alias("as_of")).distinct()
    latest = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
    return asof.asof(latest, days, "last", "user_id").select("user_id", "as_of", "last.value", F.col("last.ts").alias("value_at"))


@query(sql("SELECT symbol, as_of, next_as_of, round(ret, 6) AS ret FROM monthly", "monthly"))
def forward_return(spark, d):
    return rounded(D.monthly(spark, d), "ret")


TRAILING = "SELECT b.symbol, p.as_of, p.days, CASE WHEN a.close > 0 AND b.close <> 0 THEN b.close / a.close - 1 END AS ret FROM probes p JOIN at_days b ON b.t = p.as_of JOIN at_days a ON a.t = p.start AND a.symbol = b.symbol"
WITH_TRAILING = "probes AS (SELECT as_of, days, CAST(as_of - CAST(days AS INTEGER) AS DATE) AS start FROM months CROSS JOIN (SELECT unnest([7, 30, 91, 182, 365, 730]) AS days)), at_days AS (SELECT symbol, t, max_by(close, date) AS close FROM market JOIN (SELECT as_of AS t FROM probes UNION SELECT start FROM probes) ON date <= t GROUP BY ALL), trail AS (" + TRAILING + ")"


def with_trailing(query_: str, *needs: str) -> str:
    base = sql("", "market", "months", *needs).rstrip()
    return f"{base}, {WITH_TRAILING} {query_}"


trailing = D.trailing


@query(with_trailing("SELECT symbol, as_of, days, round(ret, 6) AS ret FROM trail"))
def trailing_return_horizons(spark, d):
    return rounded(trailing(spark, d), "ret")


@query(with_trailing(f"SELECT t.symbol, as_of, days, round(t.ret - b.ret, 6) AS rel FROM trail t JOIN (SELECT as_of, days, ret FROM trail WHERE symbol = '{HEDGE}') b USING (as_of, days)"))
def relative_momentum(spark, d):
    return rounded(returns.relative_momentum(trailing(spark, d), HEDGE), "rel")


@query(with_trailing(f"SELECT as_of, CASE WHEN ret > 0.15 THEN 'bull' WHEN ret < -0.10 THEN 'bear' ELSE 'sideways' END AS regime FROM trail WHERE symbol = '{HEDGE}' AND days = 91"))
def regime_tags(spark, d):
    return returns.regime(trailing(spark, d, (91,)), HEDGE)


GATES = "SELECT symbol, as_of, max(CASE WHEN days = 30 THEN ret END) AS r1, max(CASE WHEN days = 91 THEN ret END) AS r3 FROM trail WHERE days IN (30, 91) GROUP BY ALL"


@query(with_trailing(f"SELECT symbol, as_of, coalesce(r1 >= 0.10, false) AS absolute, coalesce(r1 >= 0 AND r3 >= 0, false) AS dual FROM ({GATES})"))
def momentum_gates(spark, d):
    t = trailing(spark, d, (30, 91)).groupBy("symbol", "as_of").agg(F.max(F.when(F.col("days") == 30, F.col("ret"))).alias("r1"), F.max(F.when(F.col("days") == 91, F.col("ret"))).alias("r3"))
    no = F.lit(False)
    return t.select("symbol", "as_of", F.coalesce(F.col("r1") >= 0.10, no).alias("absolute"), F.coalesce((F.col("r1") >= 0) & (F.col("r3") >= 0), no).alias("dual"))


@query(sql("SELECT sector, as_of, round(avg(ret), 6) AS ret, count(ret) AS n FROM baskets JOIN monthly USING (symbol, as_of) GROUP BY ALL", "baskets", "monthly"))
def basket_forward_return(spark, d):
    return rounded(returns.basket_returns(D.baskets(spark, d), D.monthly(spark, d)), "ret")


@query(with_trailing("SELECT sector, as_of, days, round(avg(ret), 6) AS ret, count(ret) AS n FROM baskets JOIN trail USING (symbol, as_of) GROUP BY ALL", "baskets"))
def basket_trailing_return(spark, d):
    own = D.baskets(spark, d).join(trailing(spark, d), ["symbol", "as_of"])
    return rounded(own.groupBy("sector", "as_of", "days").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n")), "ret")


@query(sql(f"SELECT symbol FROM (SELECT symbol, max_by(oi, date) AS oi FROM market GROUP BY symbol) WHERE oi >= {D.FLOOR} AND symbol NOT IN ('NATION_3') UNION SELECT symbol FROM market WHERE symbol IN ('NATION_0', 'NATION_1')", "market"))
def universe_filter(spark, d):
    latest = D.market(spark, d).groupBy("symbol").agg(F.max_by("oi", "date").alias("oi"))
    return returns.universe(latest, D.FLOOR, ("NATION_3",), (HEDGE, "NATION_1"))


@query(sql("SELECT symbol, date, round(ret, 6) AS ret FROM daily", "daily"))
def daily_returns(spark, d):
    return rounded(returns.daily_returns(D.prices(spark, d)), "ret")


@query(sql("SELECT symbol, date, round(beta, 5) AS beta FROM rolling", "rolling"))
def rolling_beta(spark, d):
    return rounded(returns.rolling_beta(returns.daily_returns(D.prices(spark, d)), HEDGE, 60), "beta", digits=5)


@query(sql("SELECT symbol, round(max_by(beta, date), 5) AS beta FROM rolling WHERE beta IS NOT NULL GROUP BY symbol", "rolling"))
def latest_beta(spark, d):
    return rounded(returns.latest_beta(returns.rolling_beta(returns.daily_returns(D.prices(spark, d)), HEDGE, 60)), "beta", digits=5)


@query(sql("SELECT symbol, as_of, max_by(trend, date) AS trend FROM (SELECT symbol, date, CASE WHEN count(close) OVER w < 50 THEN 0 WHEN close >= avg(close) OVER w THEN 1 ELSE -1 END AS trend FROM market WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)) JOIN months ON date <= as_of GROUP BY ALL", "market", "months"))
def trend_signal(spark, d):
    return returns.trend(D.prices(spark, d), D.months(spark, d), 50)


@query(sql("SELECT symbol, as_of, round(max_by(vol, date), 6) AS vol FROM (SELECT symbol, date, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(21) ELSE 0.2 END AS vol FROM daily WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)) JOIN months ON date <= as_of GROUP BY ALL", "daily", "months"))
def realised_volatility(spark, d):
    return rounded(returns.realised_vol(returns.daily_returns(D.prices(spark, d)), D.months(spark, d)), "vol")


BASKET_VOL = "basket_daily AS (SELECT sector, date, avg(ret) AS ret FROM daily JOIN sectors USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL), vols AS (SELECT sector, as_of, max_by(vol, date) AS vol FROM (SELECT sector, date, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol FROM basket_daily WINDOW w AS (PARTITION BY sector ORDER BY date ROWS 90 PRECEDING)) JOIN months ON date <= as_of WHERE vol IS NOT NULL GROUP BY ALL)"


def with_vols(query_: str, *needs: str) -> str:
    return f"{sql('', 'daily', 'sectors', 'months', *needs).rstrip()}, {BASKET_VOL} {query_}"


@query(with_vols("SELECT sector, as_of, round(vol, 6) AS vol FROM vols"))
def basket_volatility(spark, d):
    return rounded(returns.basket_vol(returns.daily_returns(D.prices(spark, d)), D.sectors(spark, d), D.months(spark, d)), "vol")


# Panels and views


@query(sql("SELECT * FROM views", "views"))
def member_views(spark, d):
    return D.views(spark, d)


@query(sql("SELECT * FROM panel", "panel"))
def lifecycle_panel(spark, d):
    return D.panel(spark, d)


@query(sql("SELECT as_of, lifecycle_state, count(*) AS n, CAST(max(age) AS INTEGER) AS oldest FROM panel GROUP BY ALL", "panel"))
def lifecycle_counts(spark, d):
    return D.panel(spark, d).groupBy("as_of", "lifecycle_state").agg(F.count("*").alias("n"), F.max("age").alias("oldest"))


@query(sql("SELECT t, p.as_of, item, stance_sign, conviction FROM live p JOIN (SELECT t, max(as_of) AS as_of FROM (SELECT DISTINCT as_of FROM live) JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders) ON as_of <= t GROUP BY t) USING (as_of) WHERE item_type = 'sector'", "live"))
def asof_snapshot(spark, d):
    days = D.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    return asof.snapshot(D.live(spark, d), days).where("item_type = 'sector'").select("t", "as_of", "item", "stance_sign", "conviction")


DISPERSION = "SELECT as_of, item, count(*) AS coverage, stddev_pop(stance_sign) AS stance_dispersion, stddev_pop(conviction) AS conviction_spread, avg(stance_sign) AS mean_stance_sign, avg(conviction) AS mean_conviction, min_by(item_type, member) AS item_type, min_by(parent_sector, member) AS parent_sector, count(*) / any_value(members) AS coverage_frac FROM views JOIN (SELECT as_of, count(DISTINCT member) AS members FROM views GROUP BY as_of) USING (as_of) GROUP BY as_of, item"
DISPERSED = ("stance_dispersion", "conviction_spread", "mean_stance_sign", "mean_conviction", "coverage_frac")


@query(sql(f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in DISPERSED)}) FROM ({DISPERSION})", "views"))
def dispersion(spark, d):
    return rounded(D.dispersion(spark, d), *DISPERSED)


@query(sql(f"SELECT CASE WHEN coverage_frac <= 0.2 THEN 'thin' WHEN coverage_frac >= 0.4 THEN 'broad' ELSE 'middle' END AS band, count(*) AS n, round(avg(stance_dispersion), 6) AS mean_dispersion FROM ({DISPERSION}) GROUP BY ALL", "views"))
def coverage_split(spark, d):
    return D.dispersion(spark, d).groupBy(consensus.coverage_band(F.col("coverage_frac")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("stance_dispersion"), 6).alias("mean_dispersion"))


SIGNED = "SELECT as_of, CASE WHEN item_type = 'sector' THEN item ELSE parent_sector END AS sector, sum(stance_sign * conviction) AS score FROM {} WHERE item_type = '{}' GROUP BY ALL"


@query(sql("SELECT as_of, sector, CAST(sum(s) AS BIGINT) AS score FROM (SELECT as_of, CASE WHEN item_type = 'sector' THEN item ELSE parent_sector END AS sector, stance_sign * conviction AS s FROM items) GROUP BY ALL", "items"))
def signed_conviction(spark, d):
    return consensus.signed_conviction(D.items(spark, d))


def z_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT as_of, sector, CASE WHEN count(score) OVER w < 2 OR stddev_pop(score) OVER w = 0 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS z FROM ({SIGNED.format('items', kind)}) WINDOW w AS (PARTITION BY as_of))"


@query(f"{sql('', 'items').rstrip()}, {z_sql('za', 'sector')}, {z_sql('zb', 'token')} SELECT as_of, sector, round(coalesce(za.z, 0) + 0.5 * coalesce(zb.z, 0), 6) AS score FROM za FULL JOIN zb USING (as_of, sector)")
def zscore_blend(spark, d):
    i = D.items(spark, d)
    a, b = (consensus.signed_conviction(i.where(f"item_type = '{k}'")) for k in ("sector", "token"))
    return rounded(consensus.blend(a, b, 0.5), "score")


@query(sql("SELECT as_of, item FROM (SELECT *, max(kept) OVER (PARTITION BY as_of) AS any_kept FROM (SELECT n.as_of, item, CASE WHEN lag(p) OVER (PARTITION BY item ORDER BY p) = p - 1 THEN 1 ELSE 0 END AS kept FROM items JOIN numbered n USING (as_of) WHERE stance_sign > 0)) WHERE kept = 1 OR any_kept = 0", "items", "numbered"))
def persistence_filter(spark, d):
    return lifecycle.persistent(D.items(spark, d).where("stance_sign > 0"), D.months(spark, d))


@query(sql("SELECT DISTINCT as_of, item FROM views a WHERE stance_sign = 1 AND NOT EXISTS (SELECT 1 FROM views b WHERE b.stance_sign = -1 AND a.as_of = b.as_of AND a.item = b.item)", "views"))
def bullish_not_bearish(spark, d):
    v = D.views(spark, d)
    return portfolio.avoided(v.where("stance_sign = 1"), v.where("stance_sign = -1"))


@query(sql("SELECT m.member, d.as_of FROM (SELECT DISTINCT member FROM views) m CROSS JOIN months d WHERE NOT EXISTS (SELECT 1 FROM views v WHERE v.member = m.member AND v.as_of = d.as_of AND v.item_type = 'token')", "views", "months"))
def missing_tasks(spark, d):
    v = D.views(spark, d)
    return scoring.missing_tasks(v.where("item_type = 'token'"), v, D.months(spark, d))


@query(sql("SELECT DISTINCT a.as_of FROM views a JOIN views b ON a.as_of = b.as_of AND a.member = 'BUILDING' AND b.member = 'MACHINERY' AND a.stance_sign > 0 AND b.stance_sign < 0", "views"))
def common_dates(spark, d):
    """Months in which one member is bullish on something and another bearish."""
    v = D.views(spark, d)
    return scoring.common_dates(v.where("member = 'BUILDING' AND stance_sign > 0"), v.where("member = 'MACHINERY' AND stance_sign < 0"))


# Books


def finalize_sql(raw: str, cap: int | None = None) -> str:
    book = f"SELECT as_of, symbol, sum(w) AS w FROM ({raw}) GROUP BY ALL"
    if cap:
        book = f"SELECT as_of, symbol, w FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY round(abs(w), 9) DESC, symbol) AS n FROM ({book})) WHERE n <= {cap}"
    return f"SELECT as_of, symbol, w / total AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY as_of) AS total FROM ({book})) WHERE total <> 0"


def book_sql(book: str, digits: int = 12) -> str:
    return f"SELECT as_of, symbol, round(w, {digits}) AS w FROM ({book})"


SECTOR_RAW = "SELECT l.as_of, b.symbol, {} * stance_sign * conviction / 100.0 / members AS w FROM live l JOIN sized b ON b.sector = l.item AND b.as_of = l.as_of WHERE item_type = 'sector' AND stance_sign {}"
TOKEN_RAW = "SELECT as_of, item AS symbol, stance_sign * conviction / 100.0 AS w FROM live WHERE item_type = 'token' AND stance_sign <> 0"
BOTH_RAW = f"SELECT * FROM ({finalize_sql(SECTOR_RAW.format(1, '<> 0'))}) UNION ALL SELECT * FROM ({finalize_sql(TOKEN_RAW)})"
INTRA_RAW = "SELECT as_of, symbol, CASE WHEN n = 1 THEN 1.0 ELSE -1.0 / (members - 1) END AS w FROM (SELECT l.as_of, b.symbol, members, row_number() OVER (PARTITION BY l.as_of, b.sector ORDER BY coalesce(c.conviction, 50) DESC, b.symbol) AS n FROM live l JOIN sized b ON b.sector = l.item AND b.as_of = l.as_of LEFT JOIN (SELECT as_of, item, conviction FROM live WHERE item_type = 'token') c ON c.as_of = l.as_of AND c.item = b.symbol WHERE l.item_type = 'sector' AND stance_sign > 0 AND members >= 2)"
VERSUS_RAW = "SELECT as_of, unnest([symbol, item]) AS symbol, unnest([-w / n, w / n]) AS w FROM (SELECT l.as_of, item, b.symbol, stance_sign * conviction / 100.0 AS w, count(*) OVER (PARTITION BY l.as_of, item) AS n FROM live l JOIN baskets b ON b.sector = l.parent_sector AND b.as_of = l.as_of AND b.symbol <> l.item WHERE item_type = 'token' AND stance_sign <> 0)"
SECTOR_LS = finalize_sql(SECTOR_RAW.format(1, "<> 0"))


@query(sql(book_sql(SECTOR_LS), "live", "sized"))
def sector_ls_targets(spark, d):
    return rounded(portfolio.sector_ls(D.live(spark, d), D.baskets(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(SECTOR_RAW.format(-1, "<> 0"))), "live", "sized"))
def sector_fade_targets(spark, d):
    return rounded(portfolio.sector_ls(D.live(spark, d), D.baskets(spark, d), fade=True), "w", digits=12)


@query(sql(book_sql(finalize_sql(SECTOR_RAW.format(1, "= 1"))), "live", "sized"))
def long_only_targets(spark, d):
    return rounded(portfolio.long_only(D.live(spark, d), D.baskets(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(TOKEN_RAW)), "live"))
def token_ls_targets(spark, d):
    return rounded(portfolio.token_ls(D.live(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(INTRA_RAW)), "live", "sized"))
def intra_sector_targets(spark, d):
    return rounded(portfolio.intra_sector(D.live(spark, d), D.baskets(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(VERSUS_RAW)), "live", "baskets"))
def token_vs_sector_targets(spark, d):
    return rounded(portfolio.token_vs_sector(D.live(spark, d), D.baskets(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(BOTH_RAW)), "live", "sized"))
def both_targets(spark, d):
    return rounded(portfolio.both(D.live(spark, d), D.baskets(spark, d)), "w", digits=12)


@query(sql(book_sql(finalize_sql(TOKEN_RAW, 5)), "live"))
def capped_targets(spark, d):
    return rounded(portfolio.token_ls(D.live(spark, d), cap=5), "w", digits=12)


def hedged_sql(book: str, target: str = "0") -> str:
    return f"SELECT as_of, symbol, sum(w) AS w FROM (SELECT as_of, symbol, w FROM ({book}) UNION ALL SELECT as_of, '{HEDGE}', {target} - coalesce(sum(CASE WHEN symbol <> '{HEDGE}' THEN w * coalesce(beta, 1) END), 0) FROM ({book}) LEFT JOIN betas USING (symbol, as_of) GROUP BY as_of) GROUP BY ALL HAVING symbol <> '{HEDGE}' OR abs(sum(w)) >= 1e-12"


@query(sql(book_sql(hedged_sql(SECTOR_LS), 11), "live", "sized", "betas"))
def beta_neutral_book(spark, d):
    return rounded(portfolio.hedge_to(portfolio.sector_ls(D.live(spark, d), D.baskets(spark, d)), D.betas(spark, d), HEDGE), "w", digits=11)


@query(sql(book_sql(hedged_sql(SECTOR_LS, "0.5"), 11), "live", "sized", "betas"))
def target_beta_book(spark, d):
    return rounded(portfolio.hedge_to(portfolio.sector_ls(D.live(spark, d), D.baskets(spark, d)), D.betas(spark, d), HEDGE, 0.5), "w", digits=11)


AUM = 50_000_000.0


@query(sql(f"SELECT as_of, symbol, round(sum(w), 12) AS w FROM (WITH b AS (SELECT as_of, symbol, w, CASE WHEN symbol = '{HEDGE}' THEN w ELSE sign(w) * least(abs(w), 5 * 0.05 * coalesce(oi, 0) / {AUM}) END AS c FROM ({finalize_sql(TOKEN_RAW)}) LEFT JOIN ois USING (symbol, as_of)) SELECT as_of, symbol, c AS w FROM b UNION ALL SELECT as_of, '{HEDGE}', sum(abs(w) - abs(c)) FROM b GROUP BY as_of HAVING sum(abs(w) - abs(c)) > 1e-9) GROUP BY ALL", "live", "ois"))
def capacity_capped_book(spark, d):
    oi = backtest.open_interest(D.market(spark, d), D.months(spark, d))
    return rounded(portfolio.capacity(portfolio.token_ls(D.live(spark, d)), oi, HEDGE, AUM), "w", digits=12)


def bullish(spark, d):
    return D.live(spark, d).where("item_type = 'sector' AND stance_sign > 0").select("as_of", F.col("item").alias("sector"), "conviction")


BULLISH = "SELECT as_of, item AS sector, conviction FROM live WHERE item_type = 'sector' AND stance_sign > 0"
TOP2 = f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY conviction DESC, sector) AS INTEGER) AS rank FROM ({BULLISH}) WHERE conviction >= 40) WHERE rank <= 2"


@query(sql(TOP2, "live"))
def top_sectors(spark, d):
    return portfolio.top_sectors(bullish(spark, d), 2, 40)


@query(sql(book_sql(finalize_sql(f"SELECT as_of, symbol, 1.0 / members AS w FROM ({TOP2}) JOIN sized USING (sector, as_of)")), "live", "sized"))
def top_sector_book(spark, d):
    return rounded(portfolio.equal_baskets(portfolio.top_sectors(bullish(spark, d), 2, 40), D.baskets(spark, d)), "w", digits=12)


@query(sql("SELECT as_of, sector, round(w, 12) AS w FROM (SELECT as_of, sector, CASE WHEN b <= n THEN 0.5 / n ELSE 0 END - CASE WHEN s <= n THEN 0.5 / n ELSE 0 END AS w FROM (SELECT *, least(2, max(b) OVER (PARTITION BY as_of)) AS n FROM (SELECT as_of, item AS sector, row_number() OVER (PARTITION BY as_of ORDER BY conviction DESC, item) AS b, row_number() OVER (PARTITION BY as_of ORDER BY conviction, item) AS s FROM live WHERE item_type = 'sector'))) WHERE w <> 0", "live"))
def long_short_sectors(spark, d):
    return rounded(portfolio.long_short(D.live(spark, d).where("item_type = 'sector'").select("as_of", F.col("item").alias("sector"), "conviction"), 2), "w", digits=12)


@query(with_vols(
    "SELECT scheme, as_of, sector, round(CASE WHEN total = 0 THEN 1.0 / k ELSE x / total END, 12) AS w FROM (SELECT *, sum(x) OVER (PARTITION BY scheme, as_of) AS total, count(*) OVER (PARTITION BY scheme, as_of) AS k FROM (SELECT as_of, sector, unnest(['ew', 'cw', 'cw2', 'invvol', 'cw_invvol', 'rankdecay']) AS scheme, coalesce(unnest([1.0, c, c * c, i, c * i, n - o + 1]), 0) AS x FROM (SELECT as_of, sector, CAST(conviction AS DOUBLE) AS c, coalesce(1 / vol, quantile_cont(vol, 0.5) OVER w) AS i, count(*) OVER w AS n, row_number() OVER (PARTITION BY as_of ORDER BY conviction DESC, sector) AS o FROM (" + BULLISH + ") LEFT JOIN vols USING (sector, as_of) WINDOW w AS (PARTITION BY as_of))))", "live"))
def allocation_schemes(spark, d):
    vols = returns.basket_vol(returns.daily_returns(D.prices(spark, d)), D.sectors(spark, d), D.months(spark, d))
    chosen = bullish(spark, d).join(vols, ["sector", "as_of"], "left")
    return rounded(portfolio.allocations(chosen), "w", digits=12)


# Returns


def realize_sql(book: str, cost: float = 10.0, rates: bool = True) -> str:
    f = "coalesce(f.funding, 0)" if rates else "0"
    join = "LEFT JOIN funding f ON f.symbol = b.symbol AND f.as_of = b.as_of" if rates else ""
    return f"SELECT b.as_of, coalesce(sum(w * (ret - sign(w) * {f})), 0) - {cost} / 1e4 * sum(abs(w)) AS ret FROM ({book}) b LEFT JOIN monthly m ON m.symbol = b.symbol AND m.as_of = b.as_of {join} GROUP BY b.as_of"


FUNDING = "funding AS (SELECT symbol, as_of, sum(rate) / 100 AS funding FROM market JOIN pairs ON date > as_of AND date <= next_as_of GROUP BY ALL)"


def walk_sql(book: str, *needs: str, tail: str = "SELECT as_of, round(ret, 6) AS ret FROM walked") -> str:
    base = sql("", "live", "monthly", "market", "pairs", *needs).rstrip()
    return f"{base}, {FUNDING}, walked AS (SELECT as_of, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT as_of FROM live) JOIN pairs USING (as_of) LEFT JOIN ({realize_sql(book)}) USING (as_of)) {tail}"


def funding(spark, d):
    return backtest.period_funding(D.market(spark, d).select("symbol", "date", "rate"), D.pairs(spark, d))


def walked(spark, d, strategy="sector_ls", **options):
    return backtest.walk_forward(D.live(spark, d), D.months(spark, d), D.prices(spark, d), D.baskets(spark, d), HEDGE, strategy, funding=funding(spark, d), **options)


@query(f"{sql('', 'market', 'pairs').rstrip()}, {FUNDING} SELECT symbol, as_of, round(funding, 8) AS funding FROM funding")
def period_funding(spark, d):
    return rounded(funding(spark, d), "funding", digits=8)


@query(walk_sql(SECTOR_LS, "sized"))
def walk_forward_returns(spark, d):
    return rounded(walked(spark, d), "ret")


@query(walk_sql(hedged_sql(SECTOR_LS), "sized", "betas", tail="SELECT as_of, round(ret, 5) AS ret FROM walked"))
def walk_forward_neutral(spark, d):
    return rounded(walked(spark, d, hedge_mode="neutral", betas=D.betas(spark, d)), "ret", digits=5)


RISK = "risk AS (SELECT as_of, CASE WHEN avg(stance_sign) > 0.1 THEN 'risk_on' WHEN avg(stance_sign) < -0.1 THEN 'risk_off' ELSE 'neutral' END AS stance FROM views WHERE item_type = 'sector' GROUP BY as_of)"


def risk(spark, d):
    mean = D.views(spark, d).where("item_type = 'sector'").groupBy("as_of").agg(F.avg("stance_sign").alias("m"))
    return mean.select("as_of", F.when(F.col("m") > 0.1, "risk_on").when(F.col("m") < -0.1, "risk_off").otherwise("neutral").alias("stance"))


def market_trend(spark, d):
    return returns.trend(D.prices(spark, d).where(F.col("symbol") == HEDGE), D.months(spark, d), 50).select("as_of", "trend")


@query(f"{sql('', 'views', 'months', 'market').rstrip()}, {RISK}, trend AS (SELECT as_of, max_by(trend, date) AS trend FROM (SELECT date, CASE WHEN count(close) OVER w < 50 THEN 0 WHEN close >= avg(close) OVER w THEN 1 ELSE -1 END AS trend FROM market WHERE symbol = '{HEDGE}' WINDOW w AS (ORDER BY date ROWS 49 PRECEDING)) JOIN months ON date <= as_of GROUP BY as_of) SELECT as_of, (0.5 * coalesce(trend, 0) + CASE stance WHEN 'risk_on' THEN 0.5 WHEN 'risk_off' THEN -0.5 ELSE 0 END) / 2 AS target FROM trend FULL JOIN risk USING (as_of)")
def regime_target_beta(spark, d):
    return portfolio.target_beta(market_trend(spark, d), risk(spark, d), "combined")


@query(walk_sql(SECTOR_LS, "sized", tail="SELECT round(max_by(cum, as_of) - 1, 5) AS total, round(power(max_by(cum, as_of), 12.0 / count(*)) - 1, 5) AS ann, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 5) AS sharpe, round(min(cum / top - 1), 5) AS max_dd, count(*) AS n FROM (SELECT *, max(cum) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, product(1 + ret) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS cum FROM walked))"))
def perf_metrics(spark, d):
    return rounded(metrics.metrics(walked(spark, d), 12), "total", "ann", "sharpe", "max_dd", digits=5)


BENCH = f"SELECT as_of, coalesce(max(CASE WHEN symbol = '{HEDGE}' THEN ret END), 0) AS ret FROM monthly GROUP BY as_of"


@query(sql(f"SELECT as_of, round(ret, 6) AS hedge, round(mean, 6) AS mean FROM ({BENCH}) JOIN (SELECT as_of, coalesce(avg(ret), 0) AS mean FROM monthly GROUP BY as_of) USING (as_of)", "monthly"))
def benchmark_returns(spark, d):
    m = D.monthly(spark, d)
    a = backtest.benchmark(m, HEDGE).select("as_of", F.round("ret", 6).alias("hedge"))
    return a.join(backtest.benchmark(m).select("as_of", F.round("ret", 6).alias("mean")), "as_of")


@query(walk_sql(SECTOR_LS, "sized", tail=f"SELECT round(a * 12, 5) AS alpha, round(beta, 5) AS beta, round(a / nullif(sqrt(greatest(0, syy - sxy * sxy / nullif(sxx, 0)) / (n - 2) * (1.0 / n + mx * mx / nullif(sxx, 0))), 0), 4) AS t_alpha, n FROM (SELECT count(*) AS n, avg(b.ret) AS mx, regr_sxx(w.ret, b.ret) AS sxx, regr_syy(w.ret, b.ret) AS syy, regr_sxy(w.ret, b.ret) AS sxy, regr_slope(w.ret, b.ret) AS beta, regr_intercept(w.ret, b.ret) AS a FROM walked w JOIN ({BENCH}) b USING (as_of))"))
def jensen_alpha(spark, d):
    out = metrics.jensen(walked(spark, d), backtest.benchmark(D.monthly(spark, d), HEDGE))
    return out.select(r("alpha", 5), r("beta", 5), r("t_alpha", 4), "n")


@query(walk_sql(SECTOR_LS, "sized", tail="SELECT a.as_of, round(avg(b.ret) / stddev_samp(b.ret) * sqrt(12), 5) AS sharpe FROM walked a JOIN walked b ON a.as_of <> b.as_of GROUP BY a.as_of"))
def jackknife_sharpe(spark, d):
    return rounded(metrics.jackknife_sharpe(walked(spark, d)), "sharpe", digits=5)


@query(f"{walk_sql(SECTOR_LS, 'sized', 'months', tail='').rstrip()}, {WITH_TRAILING} SELECT regime, round(avg(ret), 6) AS mean_ret, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM walked JOIN (SELECT as_of, CASE WHEN ret > 0.15 THEN 'bull' WHEN ret < -0.10 THEN 'bear' ELSE 'sideways' END AS regime FROM trail WHERE symbol = '{HEDGE}' AND days = 91) USING (as_of) GROUP BY regime")
def regime_stats(spark, d):
    own = metrics.by_regime(walked(spark, d), returns.regime(trailing(spark, d, (91,)), HEDGE))
    return rounded(own, "mean_ret", "win_rate")


@query(walk_sql(SECTOR_LS, "sized", tail="(SELECT as_of, round(ret, 6) AS ret, 'best' AS side FROM walked ORDER BY walked.ret DESC, as_of LIMIT 5) UNION ALL (SELECT as_of, round(ret, 6) AS ret, 'worst' FROM walked ORDER BY walked.ret, as_of LIMIT 5)"))
def extreme_periods(spark, d):
    return rounded(metrics.extremes(walked(spark, d)), "ret")


@query(sql(f"SELECT symbol, round(pnl, 6) AS pnl, months, round(pnl / sum(pnl) OVER (), 4) AS share, row_number() OVER (ORDER BY round(pnl, 9) DESC, symbol) <= 3 AS top3 FROM (SELECT symbol, sum(w * ret) AS pnl, count(*) AS months FROM ({finalize_sql(TOKEN_RAW)}) JOIN monthly USING (symbol, as_of) WHERE ret IS NOT NULL GROUP BY symbol)", "live", "monthly"))
def attribution(spark, d):
    out = metrics.attribution(portfolio.token_ls(D.live(spark, d)), D.monthly(spark, d))
    return out.select("symbol", r("pnl"), "months", r("share", 4), "top3")


BASKET_RET = "basket_ret AS (SELECT sector, as_of, avg(ret) AS ret FROM baskets JOIN monthly USING (symbol, as_of) GROUP BY ALL)"
RANKED = f"SELECT as_of, sector, r.ret, rank, n, CASE WHEN n > 1 THEN (rank - 1) / (n - 1) END AS norm_rank, r.ret > b.ret AS beats FROM (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY round(ret, 9) DESC, sector) AS INTEGER) AS rank, count(*) OVER (PARTITION BY as_of) AS n FROM basket_ret WHERE ret IS NOT NULL) r LEFT JOIN ({BENCH}) b USING (as_of)"


def sector_ranks(spark, d):
    m = D.monthly(spark, d)
    return metrics.sector_ranks(returns.basket_returns(D.baskets(spark, d), m), backtest.benchmark(m, HEDGE))


@query(f"{sql('', 'baskets', 'monthly').rstrip()}, {BASKET_RET} SELECT * REPLACE (round(ret, 6) AS ret, round(norm_rank, 6) AS norm_rank) FROM ({RANKED})")
def sector_ranking(spark, d):
    return rounded(sector_ranks(spark, d), "ret", "norm_rank")


@query(f"{sql('', 'baskets', 'monthly', 'live').rstrip()}, {BASKET_RET} SELECT count(*) AS n, round(avg(norm_rank), 6) AS mean_norm_rank, round(avg(CASE WHEN norm_rank <= 1 / 3 THEN 1.0 WHEN norm_rank > 1 / 3 THEN 0.0 END), 6) AS top_third FROM ({RANKED}) JOIN (SELECT DISTINCT as_of, sector FROM ({BULLISH})) USING (as_of, sector)")
def pick_skill(spark, d):
    return rounded(metrics.pick_skill(sector_ranks(spark, d), bullish(spark, d)), "mean_norm_rank", "top_third")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"{sql('', 'baskets', 'monthly').rstrip()}, {BASKET_RET} SELECT as_of, " + ", ".join(f"round(max(CASE WHEN sector = '{x}' THEN ret END), 6) AS \"{x}\"" for x in REGIONS) + ", round(avg(CASE WHEN ret > m THEN 1.0 WHEN ret <= m THEN 0.0 END), 6) AS above_mean FROM (SELECT *, avg(ret) OVER (PARTITION BY as_of) AS m FROM basket_ret) GROUP BY as_of")
def sector_heat_map(spark, d):
    own = returns.basket_returns(D.baskets(spark, d), D.monthly(spark, d))
    return rounded(metrics.heat_map(own, REGIONS), *REGIONS, "above_mean")


COMBOS = "combos AS (SELECT k || '-' || g AS combo, k, g FROM (SELECT unnest([1, 2, 3]) AS k) CROSS JOIN (SELECT unnest([30, 50]) AS g))"
COMBO_RET = f"combo_ret AS (SELECT c.combo, m.as_of, coalesce(avg(ret), 0) AS ret FROM combos c CROSS JOIN pairs m LEFT JOIN (SELECT p.k, p.g, p.as_of, b.ret FROM (SELECT *, row_number() OVER (PARTITION BY k, g, as_of ORDER BY conviction DESC, sector) AS rank FROM ({BULLISH}) JOIN combos ON conviction >= g) p JOIN basket_ret b ON b.sector = p.sector AND b.as_of = p.as_of WHERE rank <= p.k) x ON x.k = c.k AND x.g = c.g AND x.as_of = m.as_of GROUP BY ALL)"


def combo_returns(spark, d):
    """(combo, as_of, ret) of a grid: the k most convinced bullish sectors with conviction of g at least, equally weighted."""
    combos = spark.createDataFrame([(f"{k}-{g}", k, g) for k in (1, 2, 3) for g in (30, 50)], "combo string, k int, g int")
    from pyspark.sql import Window as W

    ranked = bullish(spark, d).crossJoin(F.broadcast(combos)).where("conviction >= g").withColumn("rank", F.row_number().over(W.partitionBy("combo", "as_of").orderBy(F.col("conviction").desc(), "sector"))).where("rank <= k")
    own = ranked.join(returns.basket_returns(D.baskets(spark, d), D.monthly(spark, d)), ["sector", "as_of"]).groupBy("combo", "as_of").agg(F.avg("ret").alias("ret"))
    every = combos.select("combo").crossJoin(F.broadcast(D.pairs(spark, d).select("as_of")))
    return every.join(own, ["combo", "as_of"], "left").select("combo", "as_of", F.coalesce("ret", F.lit(0.0)).alias("ret"))


GRID = f"{sql('', 'baskets', 'monthly', 'live', 'pairs').rstrip()}, {BASKET_RET}, {COMBOS}, {COMBO_RET}"


@query(f"{GRID} SELECT combo, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 5) AS sharpe, count(*) AS n FROM combo_ret GROUP BY combo")
def parameter_landscape(spark, d):
    return metrics.metrics(combo_returns(spark, d), 12, ("combo",)).select("combo", r("sharpe", 5), "n")


@query(f"{GRID} SELECT as_of, combo, round(ret, 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY s DESC NULLS LAST, combo) AS k FROM (SELECT *, round(sum(ln(1 + ret)) OVER w, 9) AS s, count(*) OVER w AS n FROM combo_ret WINDOW w AS (PARTITION BY combo ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 12) WHERE k = 1")
def walk_forward_selection(spark, d):
    return rounded(backtest.choose_by_past(combo_returns(spark, d)), "ret")


ROTATION = f"""{sql('', 'baskets', 'monthly', 'live', 'months', 'sized', 'market', 'betas').rstrip()}, {WITH_TRAILING},
rel AS (SELECT sector, as_of, days, avg(ret) - any_value(h) AS rel FROM baskets JOIN trail USING (symbol, as_of) JOIN (SELECT as_of, days, ret AS h FROM trail WHERE symbol = '{HEDGE}') USING (as_of, days) WHERE days IN (30, 91) GROUP BY sector, as_of, days),
fit AS (SELECT b.as_of, b.sector, row_number() OVER (PARTITION BY b.as_of ORDER BY conviction DESC, b.sector) AS rank FROM ({BULLISH}) b JOIN rel x ON x.sector = b.sector AND x.as_of = b.as_of AND x.days = 30 AND x.rel >= 0 JOIN rel y ON y.sector = b.sector AND y.as_of = b.as_of AND y.days = 91 AND y.rel >= 0),
chosen AS ({finalize_sql("SELECT as_of, symbol, 1.0 / members AS w FROM fit JOIN sized USING (sector, as_of) WHERE rank <= 3")}),
falling AS (SELECT as_of FROM trail WHERE symbol = '{HEDGE}' AND days = 91 AND ret < -0.10),
book AS ({hedged_sql("SELECT * FROM chosen WHERE as_of IN (SELECT as_of FROM falling)")} UNION ALL SELECT * FROM chosen WHERE as_of NOT IN (SELECT as_of FROM falling) UNION ALL SELECT as_of, '{HEDGE}', 1.0 FROM months WHERE as_of NOT IN (SELECT as_of FROM chosen))"""


def rotation(spark, d):
    t = trailing(spark, d, (30, 91))
    return backtest.gated_rotation(bullish(spark, d), D.baskets(spark, d), t.where("days = 30").drop("days"), t.where("days = 91").drop("days"), HEDGE, D.months(spark, d), betas=D.betas(spark, d))


@query(f"{ROTATION} SELECT as_of, symbol, round(w, 11) AS w FROM book")
def gated_rotation_book(spark, d):
    return rounded(rotation(spark, d), "w", digits=11)


@query(f"{ROTATION} SELECT as_of, round(ret, 5) AS ret FROM ({realize_sql('SELECT * FROM book', rates=False)})")
def gated_rotation_returns(spark, d):
    return rounded(backtest.realize(rotation(spark, d), D.monthly(spark, d)), "ret", digits=5)


@query(sql("SELECT as_of, round(max(CASE WHEN symbol = 'NATION_1' THEN ret END), 6) AS ret FROM monthly WHERE as_of < DATE '1998-01-31' AND symbol = 'NATION_1' GROUP BY as_of UNION ALL SELECT as_of, round(ret, 6) FROM monthly WHERE symbol = 'NATION_2' AND as_of >= DATE '1997-06-30' AND as_of NOT IN (SELECT as_of FROM monthly WHERE symbol = 'NATION_1' AND as_of < DATE '1998-01-31')", "monthly"))
def spliced_returns(spark, d):
    m = D.monthly(spark, d)
    early = m.where("symbol = 'NATION_1' AND as_of < DATE '1998-01-31'")
    late = m.where("symbol = 'NATION_2' AND as_of >= DATE '1997-06-30'")
    return rounded(backtest.splice(early, late), "ret")


# Information coefficients

EVAL = "eval AS (SELECT l.as_of, l.item, l.item_type, stance_sign, stance_sign * conviction AS signal, delta_stance, m.ret FROM live l JOIN monthly m ON m.symbol = l.item AND m.as_of = l.as_of WHERE item_type = 'token' UNION ALL SELECT l.as_of, l.item, l.item_type, stance_sign, stance_sign * conviction, delta_stance, b.ret FROM live l JOIN basket_ret b ON b.sector = l.item AND b.as_of = l.as_of WHERE item_type = 'sector')"


def evaluation(spark, d):
    """Live rows with their forward return: tokens their own, sectors their basket's."""
    live, m = D.live(spark, d), D.monthly(spark, d)
    token = live.where("item_type = 'token'").join(m.select(F.col("symbol").alias("item"), "as_of", "ret"), ["item", "as_of"])
    sector = live.where("item_type = 'sector'").join(returns.basket_returns(D.baskets(spark, d), m).select(F.col("sector").alias("item"), "as_of", "ret"), ["item", "as_of"])
    return token.unionByName(sector).select("as_of", "item", "item_type", "stance_sign", (F.col("stance_sign") * F.col("conviction")).alias("signal"), "delta_stance", "ret")


EVALS = f"{sql('', 'live', 'monthly', 'baskets').rstrip()}, {BASKET_RET}, {EVAL}"
RANKS = "ranks AS (SELECT as_of, signal, rank() OVER (PARTITION BY {p} ORDER BY signal) + (count(*) OVER (PARTITION BY {q} signal) - 1) / 2 AS a, rank() OVER (PARTITION BY {p} ORDER BY ret) + (count(*) OVER (PARTITION BY {q} ret) - 1) / 2 AS b FROM {t} WHERE signal IS NOT NULL AND ret IS NOT NULL)"
PERIOD = "ics AS (SELECT as_of, count(*) AS n, CASE WHEN count(*) >= 4 AND count(DISTINCT signal) >= 2 THEN corr(a, b) END AS ic FROM ranks GROUP BY as_of)"


@query(f"{EVALS} SELECT * REPLACE (round(ret, 6) AS ret) FROM eval")
def evaluation_table(spark, d):
    return rounded(evaluation(spark, d), "ret")


@query(f"{EVALS}, {RANKS.format(p='1', q='', t='eval')} SELECT count(*) AS n, round(CASE WHEN count(*) >= 5 AND count(DISTINCT signal) >= 2 THEN corr(a, b) END, 6) AS ic FROM ranks")
def rank_ic(spark, d):
    return rounded(stats.rank_ic(evaluation(spark, d), "signal", "ret"), "ic")


@query(f"{EVALS}, {RANKS.format(p='as_of', q='as_of,', t='eval')}, {PERIOD} SELECT as_of, n, round(ic, 6) AS ic FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic)")
def period_ic(spark, d):
    return rounded(stats.period_ic(evaluation(spark, d), "signal", "ret"), "ic")


@query(f"{EVALS}, {RANKS.format(p='as_of', q='as_of,', t='eval')}, {PERIOD} SELECT count(ic) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_pos, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 5) AS t FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic)")
def ic_ttest(spark, d):
    out = stats.ic_summary(stats.period_ic(evaluation(spark, d), "signal", "ret"))
    return out.select("n", r("mean_ic"), r("sd_ic"), r("pct_pos"), r("t", 5))


P_VALUE = "u * exp(-z * z - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))))"


@query(f"{EVALS}, {RANKS.format(p='as_of', q='as_of,', t='eval')}, {PERIOD}, told AS (SELECT count(ic) AS n, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic)), halves AS (SELECT n, t, abs(t) / sqrt(2) AS z, 1 / (1 + 0.5 * abs(t) / sqrt(2)) AS u FROM told) SELECT n, round(t, 5) AS t, round({P_VALUE}, 6) AS p FROM halves")
def ic_pvalue(spark, d):
    return stats.ic_ttest(stats.period_ic(evaluation(spark, d), "signal", "ret")).select("n", r("t", 5), r("p"))


CONTROL = "SELECT e.as_of, e.signal AS s, e.ret, t.ret AS x FROM eval e JOIN trail t ON t.symbol = e.item AND t.as_of = e.as_of AND t.days = 91 WHERE t.ret IS NOT NULL"


@query(f"{sql('', 'live', 'monthly', 'baskets', 'market', 'months').rstrip()}, {BASKET_RET}, {EVAL}, {WITH_TRAILING}, controlled AS ({CONTROL}), resid AS (SELECT c.as_of, c.ret, round(s - my - coalesce(k, 0) * (x - mx), 9) AS signal FROM controlled c JOIN (SELECT as_of, CASE WHEN regr_sxx(s, x) > 0 THEN regr_slope(s, x) END AS k, avg(s) AS my, avg(x) AS mx FROM controlled GROUP BY as_of) USING (as_of)), {RANKS.format(p='as_of', q='as_of,', t='resid')}, {PERIOD} SELECT as_of, n, round(ic, 6) AS ic FROM ics WHERE ic IS NOT NULL AND NOT isnan(ic)")
def orthogonal_ic(spark, d):
    own = evaluation(spark, d).where("item_type = 'token'").join(trailing(spark, d, (91,)).select(F.col("symbol").alias("item"), "as_of", F.col("ret").alias("mom")), ["item", "as_of"])
    return rounded(stats.orthogonal_ic(own, "signal", "mom", "ret"), "ic")
