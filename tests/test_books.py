"""Books, hedges, realised returns, figures and statistics."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofworks.operators import backtest, consensus, metrics, portfolio, stats

T, T2 = date(2024, 1, 31), date(2024, 2, 29)
LIVE = "as_of date, item string, item_type string, parent_sector string, stance_sign int, conviction int"


def book(df):
    return {r["symbol"]: pytest.approx(r["w"]) for r in df.collect()}


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([("s", "A", T), ("s", "B", T), ("u", "C", T), ("v", "D", T)], "sector string, symbol string, as_of date")


@pytest.fixture(scope="module")
def live(spark):
    return spark.createDataFrame([(T, "s", "sector", None, 1, 80), (T, "u", "sector", None, -1, 40), (T, "v", "sector", None, 0, 90), (T, "none", "sector", None, 1, 90), (T, "B", "token", "s", 1, 60), (T, "C", "token", "u", -1, 20)], LIVE)


def test_sector_books(live, baskets):
    assert book(portfolio.sector_ls(live, baskets)) == {"A": 1 / 3, "B": 1 / 3, "C": -1 / 3}
    assert book(portfolio.sector_ls(live, baskets, fade=True)) == {"A": -1 / 3, "B": -1 / 3, "C": 1 / 3}
    assert book(portfolio.sector_ls(live, baskets, conviction_weighted=False)) == {"A": 0.25, "B": 0.25, "C": -0.5}
    assert book(portfolio.long_only(live, baskets)) == {"A": 0.5, "B": 0.5}
    assert book(portfolio.token_ls(live)) == {"B": 0.75, "C": -0.25}
    assert book(portfolio.intra_sector(live, baskets)) == {"B": 0.5, "A": -0.5}  # 60 beats the default of 50
    assert book(portfolio.token_vs_sector(live, baskets)) == {"B": 0.5, "A": -0.5}  # C is alone in its sector
    both = book(portfolio.both(live, baskets))
    assert sum(abs(v.expected) for v in both.values()) == pytest.approx(1)


def test_cap_and_ties(spark):
    raw = spark.createDataFrame([(T, "A", 0.2), (T, "B", -0.5), (T, "C", 0.2), (T2, "A", 0.0)], "as_of date, symbol string, w double")
    assert book(portfolio.finalize(raw, cap=2)) == {"A": 0.2 / 0.7, "B": -0.5 / 0.7}


def test_hedges(spark):
    own = spark.createDataFrame([(T, "A", 0.6), (T, "B", -0.4), (T2, "A", 1.0)], "as_of date, symbol string, w double")
    betas = spark.createDataFrame([("A", 1.5)], "symbol string, beta double")
    hedged = portfolio.hedge_to(own.where(F.col("as_of") == T), betas, "H")
    assert book(hedged) == {"A": 0.6, "B": -0.4, "H": -0.5}
    assert portfolio.net_beta(hedged.withColumn("w", F.when(F.col("symbol") == "H", F.col("w")).otherwise(F.col("w"))), betas, "H").first()["net"] == pytest.approx(0.5)
    said = spark.createDataFrame([(T2, "hedge"), (T, "no_hedge")], "as_of date, decision string")
    when = {(r["as_of"], r["symbol"]): r["w"] for r in portfolio.neutralise_when(own, betas, "H", said).collect()}
    assert when == {(T, "A"): 0.6, (T, "B"): -0.4, (T2, "A"): 1.0, (T2, "H"): -1.5}
    trend = spark.createDataFrame([(T, 1), (T2, -1)], "as_of date, trend int")
    risk = spark.createDataFrame([(T, "risk_off"), (T2, "risk_off")], "as_of date, stance string")
    target = lambda mode: [r["target"] for r in portfolio.target_beta(trend, risk, mode).orderBy("as_of").collect()]
    assert target("quant") == [0.5, -0.5] and target("consensus") == [-0.5, -0.5] and target("combined") == [0, -0.5]


def test_realised_return_charges_funding_on_both_sides(spark):
    own = spark.createDataFrame([(T, "A", 0.5), (T, "B", -0.5), (T, "C", 0.2)], "as_of date, symbol string, w double")
    rets = spark.createDataFrame([(T, "A", 0.2), (T, "B", -0.1), (T, "C", None)], "as_of date, symbol string, ret double")
    fund = spark.createDataFrame([("A", T, 0.02), ("B", T, 0.04)], "symbol string, as_of date, funding double")
    got = backtest.realize(own, rets, fund, 10).first()["ret"]
    assert got == pytest.approx(0.5 * 0.18 + -0.5 * (-0.1 + 0.04) - 0.001 * 1.2)


def test_funding_bounds(spark):
    rates = spark.createDataFrame([("A", T, 1.0), ("A", date(2024, 2, 1), 2.0), ("A", T2, 4.0), ("A", date(2024, 3, 1), 8.0)], "symbol string, date date, rate double")
    pairs = spark.createDataFrame([(T, T2)], "as_of date, next_as_of date")
    assert backtest.period_funding(rates, pairs).first()["funding"] == pytest.approx(0.06)


def test_capacity_spills_to_the_hedge(spark):
    own = spark.createDataFrame([(T, "A", 0.6), (T, "B", 0.4)], "as_of date, symbol string, w double")
    oi = spark.createDataFrame([(T, "A", 100.0), (T, "B", 1e9)], "as_of date, symbol string, oi double")
    assert book(portfolio.capacity(own, oi, "H", 100.0)) == {"A": 0.25, "B": 0.4, "H": 0.35}


@pytest.mark.parametrize(("scheme", "want"), [("ew", [1 / 3] * 3), ("cw", [0.5, 0.3, 0.2]), ("rankdecay", [0.5, 1 / 3, 1 / 6]), ("invvol", [10 / 15.15, 5 / 15.15, 0.15 / 15.15])])
def test_allocation(spark, scheme, want):
    chosen = spark.createDataFrame([(T, "a", 50, 0.1), (T, "b", 30, 0.2), (T, "c", 20, None)], "as_of date, sector string, conviction int, vol double")
    got = {r["sector"]: r["w"] for r in portfolio.allocation(chosen, scheme).collect()}
    assert [got[k] for k in "abc"] == pytest.approx(want)


def series(spark, values, start=date(2020, 1, 31)):
    days = pd.date_range(start, periods=len(values), freq="ME")
    return spark.createDataFrame([(d.date(), float(v)) for d, v in zip(days, values, strict=True)], "as_of date, ret double")


def test_metrics(spark):
    got = metrics.metrics(series(spark, [0.1, -0.2, 0.3]), 4).first()
    cum = np.cumprod([1.1, 0.8, 1.3])
    assert got["total"] == pytest.approx(cum[-1] - 1) and got["max_dd"] == pytest.approx(-0.2) and got["n"] == 3
    assert got["ann"] == pytest.approx(cum[-1] ** (4 / 3) - 1)
    assert got["sharpe"] == pytest.approx(np.mean([0.1, -0.2, 0.3]) / np.std([0.1, -0.2, 0.3], ddof=1) * 2)
    flat = metrics.metrics(series(spark, [0.1] * 4), 4).first()
    assert flat["ann"] == pytest.approx(1.1**4 - 1) and flat["max_dd"] == 0
    assert metrics.metrics(series(spark, [-0.5, 0.1]), 4).first()["max_dd"] == 0  # a loss at first is no drawdown


# The published monthly returns of a strategy and of its benchmark.
PUBLISHED = [
    0.39244, -0.07865, -0.05326, -0.35866, 0.12038, 0.05178, -0.18094, -0.15696, 0.06336, 0.16577, 0.06364, -0.0019, 0.05256, 0.03669,
    0.39444, 0.24599, -0.14887, 0.02469, -0.07194, 0.11677, -0.04335, -0.11535, 0.03825, 0.28345, 0.44965, 0.26343, -0.10724, 0.43248,
    1.05443, -0.34154, 0.11105, -0.07507, 0.22282, 0.01358, -0.10463, -0.15803, 0.36646, -0.28529, 0.09106, -0.17882, 0.00034, -0.00147,
    0.10829, 0.02305, 0.07706, -0.06762, 0.05133, 0.89797, 0.09103, 0.06593, -0.0212, 0.09625, 0.11914,
]
PUBLISHED_BENCHMARK = [
    0.40076, -0.07129, -0.18893, -0.16818, 0.12269, 0.05448, -0.17342, -0.15464, -0.37343, 0.16898, -0.13948, -0.03142, 0.05514, -0.16252,
    0.39799, 0.00044, 0.23024, 0.02699, -0.06919, 0.11982, -0.04069, -0.11269, 0.03945, 0.28572, 0.08846, 0.12189, 0.00583, 0.43803,
    0.166, -0.1501, 0.11421, -0.07121, 0.02925, -0.08761, 0.07409, 0.11077, 0.37191, -0.03033, 0.0944, -0.1766, -0.02114, 0.14067,
    0.1107, 0.02432, 0.0804, -0.06473, 0.05342, -0.03888, -0.17559, -0.03003, -0.1016, -0.14954, 0.01949,
]


def test_published_figures(spark):
    """The published series have the published figures."""
    own, base = (metrics.metrics(series(spark, x), 12).first() for x in (PUBLISHED, PUBLISHED_BENCHMARK))
    assert (own["total"], own["sharpe"], own["max_dd"]) == (pytest.approx(12.6015, abs=1e-4), pytest.approx(1.0344, abs=1e-4), pytest.approx(-0.5448, abs=1e-4))
    assert (base["total"], base["sharpe"], base["max_dd"]) == (pytest.approx(0.6162, abs=1e-4), pytest.approx(0.4594, abs=1e-4), pytest.approx(-0.7204, abs=1e-4))
    got = metrics.jensen(series(spark, PUBLISHED), series(spark, PUBLISHED_BENCHMARK)).first()
    assert (got["alpha"], got["beta"], got["t_alpha"]) == (pytest.approx(0.7132, abs=1e-4), pytest.approx(0.7606, abs=1e-4), pytest.approx(1.9156, abs=1e-4))


def test_jensen_and_jackknife(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 0.1, 30)
    y = 0.01 + 0.7 * x + r.normal(0, 0.02, 30)
    got = metrics.jensen(series(spark, y), series(spark, x)).first()
    design = np.column_stack([np.ones(30), x])
    coef, res, *_ = np.linalg.lstsq(design, y, rcond=None)
    t = coef[0] / np.sqrt(res[0] / 28 * np.linalg.inv(design.T @ design)[0, 0])
    assert (got["alpha"], got["beta"], got["t_alpha"]) == (pytest.approx(coef[0] * 12), pytest.approx(coef[1]), pytest.approx(t))
    jack = [r["sharpe"] for r in metrics.jackknife_sharpe(series(spark, y)).orderBy("as_of").collect()]
    want = [np.delete(y, i).mean() / np.delete(y, i).std(ddof=1) * np.sqrt(12) for i in range(30)]
    assert jack == pytest.approx(want)


def test_rank_ic_matches_pandas(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"as_of": [T] * 20 + [T2] * 3, "signal": r.integers(-3, 4, 23).astype(float), "ret": r.normal(0, 1, 23).round(1)})
    df = spark.createDataFrame(pdf)
    got = stats.period_ic(df, "signal", "ret").collect()
    own = pdf[pdf.as_of == T]
    assert len(got) == 1 and got[0]["ic"] == pytest.approx(own.signal.rank().corr(own.ret.rank()))
    assert stats.rank_ic(df.withColumn("signal", F.lit(1.0)), "signal", "ret").first()["ic"] is None
    ics = spark.createDataFrame([(0.1,), (0.3,), (-0.1,)], "ic double")
    test = stats.ic_ttest(ics).first()
    assert test["t"] == pytest.approx(0.1 / (0.2 / np.sqrt(3))) and 0 < test["p"] < 1


def test_consensus(spark):
    v = spark.createDataFrame([(T, "m1", "x", "token", "s", 1, 40), (T, "m2", "x", "token", "s", 0, 80), (T, "m3", "y", "token", "s", -1, 50)], "as_of date, member string, item string, item_type string, parent_sector string, stance_sign int, conviction int")
    x = {r["item"]: r for r in consensus.dispersion(v).collect()}["x"]
    assert (x["coverage"], x["coverage_frac"], x["stance_dispersion"], x["conviction_spread"], x["mean_stance_sign"], x["mean_conviction"]) == (2, pytest.approx(2 / 3), 0.5, 20, 0.5, 60)
    z = consensus.zscore(spark.createDataFrame([(T, 1.0), (T, 3.0), (T2, 5.0)], "as_of date, score double"), "score").orderBy("as_of", "score")
    assert [r["z"] for r in z.collect()] == [-1, 1, 0]


def test_walk_forward_picks_from_the_past_only(spark):
    days = [d.date() for d in pd.date_range("2020-01-31", periods=6, freq="ME")]
    rows = [("a", d, 0.1) for d in days] + [("b", d, 0.0 if i < 4 else 9.0) for i, d in enumerate(days)]
    out = backtest.choose_by_past(spark.createDataFrame(rows, "combo string, as_of date, ret double"), least=2).orderBy("as_of").collect()
    assert [(r["combo"], r["ret"]) for r in out] == [("a", 0.1), ("a", 0.1), ("a", 0.1), ("b", 9.0)]


def test_strategies_by_name(spark, live, baskets):
    prices = spark.createDataFrame([(s, d, p) for s, p0 in (("A", 10.0), ("B", 10.0), ("C", 10.0), ("H", 5.0)) for d, p in ((T, p0), (T2, p0 * 1.1))], "symbol string, date date, close double")
    cal = spark.createDataFrame([(T,), (T2,)], "as_of date")
    for s in backtest.STRATEGIES:
        got = backtest.walk_forward(live, cal, prices, baskets, "H", s, cost_bps=0).collect()
        assert [r["as_of"] for r in got] == [T]
    assert backtest.walk_forward(live.limit(0), cal, prices, baskets, "H").count() == 0
