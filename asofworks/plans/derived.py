"""A market, members' views and calendars, derived from the order tables.

A symbol is a nation, its sector a region, a member a market segment. A day's
close is the mean order value of the nation's customers, open interest their
sum, the funding rate a share of urgent orders. A member is bullish on a nation
in a month with many urgent orders, and bearish with few.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofworks.operators import asof, backtest, calendar, consensus, lifecycle, returns

HEDGE = "NATION_0"
FLOOR = 100_000.0


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(f):
    """Derived tables that many queries share are small (a row a symbol and day at most) and are persisted once a session and folder."""

    @wraps(f)
    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, f.__name__)
        if key not in _kept:
            _kept[key] = f(spark, d).persist()
        return _kept[key]

    return get


def release(spark: SparkSession) -> None:
    """Frees the session's shared tables; they are made again when a query asks for them."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        _kept.pop(key).unpersist()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").substr(1, 1).isin("1", "2").alias("urgent"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("member"))
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("symbol"))
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


@kept
def market(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, sector, date, close, oi, rate)"""
    return trades(spark, d).groupBy("symbol", "sector", "date").agg(F.round(F.avg("o_totalprice"), 6).alias("close"), F.round(F.sum("o_totalprice"), 2).alias("oi"), F.round(F.avg(F.col("urgent").cast("double")) / 10, 6).alias("rate"))


@kept
def sectors(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


@kept
def months(spark: SparkSession, d: str) -> DataFrame:
    return calendar.month_ends(calendar.span(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day"))


def quarters(spark: SparkSession, d: str) -> DataFrame:
    return calendar.quarter_ends(calendar.span(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day"))


@kept
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return calendar.with_next(months(spark, d)).where("next_as_of IS NOT NULL")


@kept
def views(spark: SparkSession, d: str) -> DataFrame:
    """(as_of, member, item, item_type, parent_sector, stance_sign, conviction): tokens and sectors."""
    t = trades(spark, d).withColumn("as_of", F.last_day("date"))

    def of(item: str, kind: str, parent) -> DataFrame:
        own = t.groupBy("as_of", "member", F.col(item).alias("item"), parent.alias("parent_sector")).agg(F.count("*").alias("n"), F.sum(F.col("urgent").cast("int")).alias("u")).where("n >= 2")
        sign = F.when(F.col("u") * 2 > F.col("n"), 1).when(F.col("u") * 4 < F.col("n"), -1).otherwise(0)
        return own.select("as_of", "member", "item", F.lit(kind).alias("item_type"), "parent_sector", sign.alias("stance_sign"), F.least(F.lit(100), 20 + 7 * F.col("n")).cast("int").alias("conviction"))

    return of("symbol", "token", F.col("sector")).unionByName(of("sector", "sector", F.lit(None).cast("string")))


@kept
def items(spark: SparkSession, d: str) -> DataFrame:
    """(as_of, item, item_type, parent_sector, stance_sign, conviction, horizon): the members' sum of signed convictions."""
    v = views(spark, d).groupBy("as_of", "item", "item_type", "parent_sector").agg(F.sum(F.col("stance_sign") * F.col("conviction")).alias("s"), F.sum("conviction").alias("c"), F.count("*").alias("n"))
    return v.select("as_of", "item", "item_type", "parent_sector", F.signum("s").cast("int").alias("stance_sign"), F.floor(F.col("c") / F.col("n")).cast("int").alias("conviction"), F.when(F.col("n") > 3, "structural").otherwise("tactical").alias("horizon"))


@kept
def panel(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.lifecycle(items(spark, d), months(spark, d))


def live(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.live_rows(panel(spark, d))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).select("symbol", "date", "close")


@kept
def baskets(spark: SparkSession, d: str) -> DataFrame:
    return returns.basket_members(sectors(spark, d), backtest.open_interest(market(spark, d), months(spark, d)), FLOOR)


@kept
def closes(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, as_of, close, close_date) as of all months and all horizons before them: one look-up for all returns."""
    return asof.asof(prices(spark, d), asof.with_horizons(months(spark, d)))


@kept
def monthly(spark: SparkSession, d: str) -> DataFrame:
    return asof.forward_returns(prices(spark, d), pairs(spark, d), known=closes(spark, d))


def trailing(spark: SparkSession, d: str, horizons: tuple[int, ...] = asof.HORIZONS) -> DataFrame:
    return asof.trailing_returns(prices(spark, d), months(spark, d), horizons, known=closes(spark, d))


@kept
def betas(spark: SparkSession, d: str) -> DataFrame:
    """Point-in-time betas of 60 rows."""
    return returns.betas_as_of(returns.rolling_beta(returns.daily_returns(prices(spark, d)), HEDGE, 60), months(spark, d))


def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return consensus.dispersion(views(spark, d))


# The same tables in DuckDB's SQL, as common table expressions: each needs those named after it.
PARTS: dict[str, tuple[str, str]] = {
    "trades": ("", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date, substr(o_orderpriority, 1, 1) IN ('1', '2') AS urgent, c_mktsegment AS member, n_name AS symbol, r_name AS sector FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "market": ("trades", "SELECT symbol, sector, date, round(avg(o_totalprice), 6) AS close, round(sum(o_totalprice), 2) AS oi, round(avg(CAST(urgent AS DOUBLE)) / 10, 6) AS rate FROM trades GROUP BY ALL"),
    "sectors": ("", "SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "months": ("", "SELECT as_of FROM (SELECT last_day(CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS as_of, a, b FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)) WHERE as_of BETWEEN a AND b"),
    "numbered": ("months", "SELECT as_of, row_number() OVER (ORDER BY as_of) AS p FROM months"),
    "pairs": ("months", "SELECT * FROM (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next_as_of FROM months) WHERE next_as_of IS NOT NULL"),
    "views": ("trades", " UNION ALL ".join(f"SELECT as_of, member, item, '{k}' AS item_type, parent_sector, CASE WHEN u * 2 > n THEN 1 WHEN u * 4 < n THEN -1 ELSE 0 END AS stance_sign, CAST(least(100, 20 + 7 * n) AS INTEGER) AS conviction FROM (SELECT last_day(date) AS as_of, member, {c} AS item, {p} AS parent_sector, count(*) AS n, sum(CAST(urgent AS INTEGER)) AS u FROM trades GROUP BY ALL) WHERE n >= 2" for k, c, p in (("token", "symbol", "sector"), ("sector", "sector", "CAST(NULL AS VARCHAR)")))),
    "items": ("views", "SELECT as_of, item, item_type, parent_sector, CAST(sign(sum(stance_sign * conviction)) AS INTEGER) AS stance_sign, CAST(floor(sum(conviction) / count(*)) AS INTEGER) AS conviction, CASE WHEN count(*) > 3 THEN 'structural' ELSE 'tactical' END AS horizon FROM views GROUP BY ALL"),
    "stepped": ("items numbered", "SELECT i.*, p, lag(p) OVER w AS bp, lag(stance_sign) OVER w AS bs, lag(conviction) OVER w AS bc, lead(p) OVER w AS ap FROM items i JOIN numbered USING (as_of) WINDOW w AS (PARTITION BY item ORDER BY p)"),
    "islands": ("stepped", "SELECT *, sum(CASE WHEN bp = p - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY item ORDER BY p) AS island FROM stepped"),
    "panel": (
        "islands numbered",
        "SELECT as_of, item, item_type, parent_sector, CASE sign(stance_sign) WHEN 1 THEN 'bullish' WHEN -1 THEN 'bearish' ELSE 'neutral' END AS stance, stance_sign, conviction, horizon, CASE WHEN bp IS NULL OR bp <> p - 1 THEN 'NEW' WHEN stance_sign * bs < 0 THEN 'FLIPPED' ELSE 'SUSTAINED' END AS lifecycle_state, CASE WHEN bp = p - 1 THEN stance_sign - bs ELSE 0 END AS delta_stance, CASE WHEN bp = p - 1 THEN conviction - bc ELSE 0 END AS delta_conviction, CAST(row_number() OVER (PARTITION BY item, island ORDER BY p) AS INTEGER) AS age FROM islands"
        " UNION ALL SELECT n.as_of, item, item_type, parent_sector, 'neutral', 0, 0, 'structural', 'EXITED', -stance_sign, -conviction, 0 FROM islands i JOIN numbered n ON n.p = i.p + 1 WHERE ap IS NULL OR ap > i.p + 1",
    ),
    "live": ("panel", "SELECT * FROM panel WHERE lifecycle_state <> 'EXITED'"),
    "days_of": ("pairs", "SELECT as_of AS t FROM pairs UNION SELECT next_as_of FROM pairs"),
    "closes": ("market days_of", "SELECT symbol, t, max_by(close, date) AS close FROM market JOIN days_of ON date <= t GROUP BY ALL"),
    "monthly": ("closes pairs", "SELECT a.symbol, p.as_of, p.next_as_of, CASE WHEN a.close > 0 AND b.close <> 0 THEN b.close / a.close - 1 END AS ret FROM pairs p JOIN closes a ON a.t = p.as_of JOIN closes b ON b.t = p.next_as_of AND b.symbol = a.symbol"),
    "ois": ("market months", "SELECT symbol, as_of, max_by(oi, date) AS oi FROM market JOIN months ON date <= as_of GROUP BY ALL"),
    "baskets": ("ois sectors", f"SELECT sector, symbol, as_of FROM ois JOIN sectors USING (symbol) WHERE oi >= {FLOOR}"),
    "sized": ("baskets", "SELECT *, count(*) OVER (PARTITION BY sector, as_of) AS members FROM baskets"),
    "grid": ("market", "SELECT s.symbol, d.date, m.close FROM (SELECT DISTINCT symbol FROM market) s CROSS JOIN (SELECT DISTINCT date FROM market) d LEFT JOIN market m ON m.symbol = s.symbol AND m.date = d.date"),
    "padded": ("grid", "SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM grid"),
    "daily": ("padded", "SELECT symbol, date, p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM padded"),
    "paired": ("daily", f"SELECT d.symbol, d.date, CASE WHEN m.ret IS NOT NULL THEN d.ret END AS y, CASE WHEN d.ret IS NOT NULL THEN m.ret END AS x FROM daily d LEFT JOIN (SELECT date, ret FROM daily WHERE symbol = '{HEDGE}') m USING (date)"),
    "rolling": ("paired", "SELECT symbol, date, CASE WHEN count(y + x) OVER w = 60 THEN covar_samp(y, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM paired WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)"),
    "betas": ("rolling months", "SELECT symbol, as_of, max_by(beta, date) AS beta FROM rolling JOIN months ON date <= as_of WHERE beta IS NOT NULL GROUP BY ALL"),
}


def sql(query: str, *needs: str) -> str:
    """query after the common table expressions that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0].split():
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order) + " " if order else "") + query
