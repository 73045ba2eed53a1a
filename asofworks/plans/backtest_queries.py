"""Walk-forward queries over all strategies and hedge modes, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofworks.operators import portfolio, returns

from . import derived as D
from . import market_queries as M
from .derived import HEDGE, sql
from .market_queries import rounded, walked

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, oracle: str, f) -> None:
    f.__name__ = name
    QUERIES[name], ORACLES[name] = f, oracle


TAIL = "SELECT as_of, round(ret, 5) AS ret FROM walked"
BOOKS = {
    "long_only": M.finalize_sql(M.SECTOR_RAW.format(1, "= 1")),
    "token_ls": M.finalize_sql(M.TOKEN_RAW),
    "intra_sector": M.finalize_sql(M.INTRA_RAW),
    "token_vs_sector": M.finalize_sql(M.VERSUS_RAW),
    "both": M.finalize_sql(M.BOTH_RAW),
}
for _strategy, _book in BOOKS.items():
    add(f"walk_forward_{_strategy}", M.walk_sql(_book, "sized", tail=TAIL), lambda spark, d, s=_strategy: rounded(walked(spark, d, s), "ret", digits=5))

TREND = f"trend AS (SELECT as_of, max_by(trend, date) AS trend FROM (SELECT date, CASE WHEN count(close) OVER w < 50 THEN 0 WHEN close >= avg(close) OVER w THEN 1 ELSE -1 END AS trend FROM market WHERE symbol = '{HEDGE}' WINDOW w AS (ORDER BY date ROWS 49 PRECEDING)) JOIN months ON date <= as_of GROUP BY as_of)"
QUANT, SAID = "0.5 * coalesce(trend, 0)", "CASE stance WHEN 'risk_on' THEN 0.5 WHEN 'risk_off' THEN -0.5 ELSE 0 END"
TARGETS = {"quant": QUANT, "consensus": SAID, "combined": f"({QUANT} + {SAID}) / 2"}


def hedged(book: str, target: str) -> str:
    """The book with the hedge symbol's overlay up to each date's target."""
    overlay = f"SELECT b.as_of, '{HEDGE}' AS symbol, coalesce(max(t.target), 0) - coalesce(sum(CASE WHEN b.symbol <> '{HEDGE}' THEN w * coalesce(beta, 1) END), 0) AS w FROM ({book}) b LEFT JOIN betas x ON x.symbol = b.symbol AND x.as_of = b.as_of LEFT JOIN ({target}) t ON t.as_of = b.as_of GROUP BY b.as_of"
    return f"SELECT as_of, symbol, sum(w) AS w FROM (SELECT as_of, symbol, w FROM ({book}) UNION ALL {overlay}) GROUP BY ALL HAVING symbol <> '{HEDGE}' OR abs(sum(w)) >= 1e-12"


def with_regime(query: str) -> str:
    """A walk-forward's SQL with the trend and the risk stance before it."""
    return query.replace(f", {M.FUNDING}", f", {M.RISK}, {TREND}, {M.FUNDING}", 1)


for _mode, _target in TARGETS.items():
    _sql = f"SELECT as_of, {_target} AS target FROM trend FULL JOIN risk USING (as_of)"
    add(f"walk_forward_hedge_{_mode}", with_regime(M.walk_sql(hedged(M.SECTOR_LS, _sql), "sized", "betas", "views", "months", tail=TAIL)), lambda spark, d, m=_mode: rounded(walked(spark, d, hedge_mode=m, betas=D.betas(spark, d), trends=M.market_trend(spark, d), risk=M.risk(spark, d)), "ret", digits=5))
    if _mode != "combined":
        add(f"regime_target_{_mode}", f"{sql('', 'views', 'months', 'market').rstrip()}, {M.RISK}, {TREND} {_sql}", lambda spark, d, m=_mode: portfolio.target_beta(M.market_trend(spark, d), M.risk(spark, d), m))


def council(spark, d):
    """Hedge where the risk stance is off."""
    return M.risk(spark, d).select("as_of", F.when(F.col("stance") == "risk_off", "hedge").otherwise("no_hedge").alias("stance"))


_off = "SELECT as_of FROM risk WHERE stance = 'risk_off'"
_some = f"SELECT * FROM ({M.SECTOR_LS}) WHERE as_of IN ({_off})"
add("walk_forward_hedge_council", with_regime(M.walk_sql(f"{hedged(_some, 'SELECT as_of, 0 AS target FROM risk')} UNION ALL SELECT as_of, symbol, w FROM ({M.SECTOR_LS}) WHERE as_of NOT IN ({_off})", "sized", "betas", "views", "months", tail=TAIL)), lambda spark, d: rounded(walked(spark, d, hedge_mode="council", betas=D.betas(spark, d), risk=council(spark, d)), "ret", digits=5))


def scaled_book(spark, d):
    """The sector book at a gross exposure that follows the mean conviction of its sectors."""
    live = D.live(spark, d)
    return portfolio.scaled(portfolio.sector_ls(live, D.baskets(spark, d)), portfolio.conviction_gross(live.where("item_type = 'sector' AND stance_sign <> 0")))


add("conviction_scaled_book", sql(f"SELECT as_of, symbol, round(w * gross, 11) AS w FROM ({M.SECTOR_LS}) JOIN (SELECT as_of, least(1.2, avg(conviction) / 70) AS gross FROM live WHERE item_type = 'sector' AND stance_sign <> 0 GROUP BY as_of) USING (as_of)", "live", "sized"), lambda spark, d: rounded(scaled_book(spark, d), "w", digits=11))


def vol_targeted(spark, d):
    """The token book at a gross exposure by the hedge symbol's volatility."""
    vols = returns.realised_vol(returns.daily_returns(D.prices(spark, d)), D.months(spark, d)).where(F.col("symbol") == HEDGE)
    return portfolio.scaled_unless_alone(portfolio.token_ls(D.live(spark, d)), portfolio.vol_gross(vols), HEDGE)


_vols = f"SELECT as_of, max_by(vol, date) AS vol FROM (SELECT date, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(21) ELSE 0.2 END AS vol FROM daily WHERE ret IS NOT NULL AND symbol = '{HEDGE}' WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)) JOIN months ON date <= as_of GROUP BY as_of"
add("vol_targeted_book", sql(f"SELECT as_of, symbol, round(CASE WHEN max(CASE WHEN symbol <> '{HEDGE}' THEN 1 ELSE 0 END) OVER (PARTITION BY as_of) = 1 THEN w * coalesce(least(1, 0.15 / greatest(vol, 0.05)), 1) ELSE w END, 11) AS w FROM ({M.finalize_sql(M.TOKEN_RAW)}) LEFT JOIN ({_vols}) USING (as_of)", "live", "daily", "months"), lambda spark, d: rounded(vol_targeted(spark, d), "w", digits=11))
