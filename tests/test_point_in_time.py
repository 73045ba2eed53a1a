"""As-of look-ups, returns, calendars and lifecycle, by hand-computed cases."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofworks.operators import asof, backtest, calendar, lifecycle, returns

D = date


@pytest.fixture(scope="module")
def prices(spark):
    rows = [("A", D(2024, 1, 1), 100.0), ("A", D(2024, 1, 31), 120.0), ("A", D(2024, 3, 1), 0.0), ("B", D(2024, 1, 15), 50.0), ("B", D(2024, 2, 20), None)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def dates(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "as_of date")


def test_asof_shapes_agree(spark, prices):
    cal = dates(spark, D(2023, 12, 31), D(2024, 1, 14), D(2024, 1, 31), D(2024, 2, 29))
    a = sorted(asof.asof_by_calendar(prices, cal).collect())
    probes = prices.select("symbol").distinct().crossJoin(cal)
    assert a == sorted(asof.asof_by_merge(prices, probes).collect())
    assert {(r["symbol"], r["as_of"]): r["close"] for r in a} == {("A", D(2024, 1, 14)): 100.0, ("A", D(2024, 1, 31)): 120.0, ("B", D(2024, 1, 31)): 50.0, ("A", D(2024, 2, 29)): 120.0, ("B", D(2024, 2, 29)): 50.0}


@pytest.mark.parametrize("days", [2_500, 10_000])
def test_long_calendars(spark, days):
    """A value of each symbol, early and late, as of every day: all dates, and none before the value."""
    first = date(1995, 1, 1)
    late = first + timedelta(days=days - 300)
    series = spark.createDataFrame([("A", first, 1.0), ("B", late, 2.0)], "symbol string, date date, close double")
    cal = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("as_of"))
    probes = series.select("symbol").join(cal)
    for found in (asof.asof(series, cal), asof.asof_by_calendar(series, cal), asof.asof_by_merge(series, probes)):
        n = {r["symbol"]: (r["n"], r["a"], r["b"]) for r in found.groupBy("symbol").agg(F.count("*").alias("n"), F.min("as_of").alias("a"), F.max("as_of").alias("b")).collect()}
        last = first + timedelta(days=days - 1)
        assert n == {"A": (days, first, last), "B": (300, late, last)}
        assert found.where("close_date > as_of").count() == 0


def test_probes_within_a_day(spark):
    r = random.Random(3)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=r.randrange(0, 4 * 24 * 60))
    series = spark.createDataFrame([(f"s{k % 3}", at(), float(k)) for k in range(60)], "symbol string, date timestamp, close double").dropDuplicates(["symbol", "date"])
    cal = spark.createDataFrame([(at(),) for _ in range(25)] + [(None,)], "as_of timestamp")
    probes = series.select("symbol").distinct().join(cal.where("as_of IS NOT NULL"))
    got = sorted(map(tuple, asof.asof(series, cal).collect()))
    assert got == sorted(map(tuple, asof.asof_by_merge(series, probes).collect())) and len(got) > 40


def test_funding_as_differences_of_running_sums(spark):
    rows = [("a", date(2024, 1, d), d / 7) for d in (1, 2, 5, 9, 20)] + [("b", date(2024, 1, 9), 3.0), ("a", date(2024, 1, 9), 0.5), ("b", date(2024, 1, 3), None)]
    spans = [(date(2024, 1, 1), date(2024, 1, 9)), (date(2024, 1, 9), date(2024, 1, 15)), (date(2024, 1, 15), date(2024, 2, 1)), (date(2024, 1, 20), None)]
    got = {(r["symbol"], r["as_of"]): r["funding"] for r in backtest.period_funding(spark.createDataFrame(rows, "symbol string, date date, rate double"), spark.createDataFrame(spans, "as_of date, next_as_of date")).collect()}
    want = {}
    for a, b in spans:
        for s, d, x in rows:
            if b is not None and a < d <= b and x is not None:
                want[s, a] = want.get((s, a), 0) + x / 100
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forward_return_and_zero_price(spark, prices):
    pairs = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 31)), (D(2024, 1, 31), D(2024, 3, 31))], "as_of date, next_as_of date")
    got = {(r["symbol"], r["as_of"]): r["ret"] for r in asof.forward_returns(prices, pairs).collect()}
    assert got[("A", D(2024, 1, 1))] == pytest.approx(0.2)
    assert got[("A", D(2024, 1, 31))] is None  # a price of 0 gives no return
    assert got[("B", D(2024, 1, 31))] == 0.0  # no limit of staleness


def test_nothing_after_a_date_changes_what_is_seen_there(spark, prices):
    cal = dates(spark, D(2024, 1, 31))
    later = prices.union(spark.createDataFrame([("A", D(2024, 2, 1), 999.0), ("C", D(2024, 2, 1), 1.0)], prices.schema))
    for f in (lambda p: asof.asof(p, cal), lambda p: asof.trailing_returns(p, cal), lambda p: returns.trend(p, cal, 2)):
        assert sorted(map(str, f(prices).collect())) == sorted(map(str, f(later).collect()))


def test_calendars(spark):
    own = calendar.one_row(spark, "2024-01-31", "2024-06-15")
    months = [r[0] for r in calendar.month_ends(own).orderBy("as_of").collect()]
    assert months == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30), D(2024, 5, 31)]
    assert [r[0] for r in calendar.quarter_ends(own).collect()] == [D(2024, 3, 31)]
    assert {r[0] for r in calendar.rebalance_dates(own, every="quarter").collect()} == {D(2024, 3, 31), D(2024, 6, 30)}
    day = spark.createDataFrame([(D(2023, 6, 30),), (D(2023, 7, 1),), (D(2023, 12, 31),), (D(2024, 1, 1),)], "d date")
    t = F.lit("2023-12-31").cast("date")
    assert [r[0] for r in day.where(calendar.in_window(F.col("d"), t, 6)).collect()] == [D(2023, 7, 1), D(2023, 12, 31)]
    assert [r[0] for r in day.where(calendar.held_out(F.col("d"), t, 1)).collect()] == [D(2024, 1, 1)]


ITEMS = "as_of date, item string, item_type string, parent_sector string, stance_sign int, conviction int"


def test_lifecycle_states(spark):
    p = [D(2024, m, 28) for m in range(1, 7)]
    rows = [(p[0], "x", "token", "s", 1, 50), (p[1], "x", "token", "s", 1, 60), (p[2], "x", "token", "s", -1, 40), (p[5], "x", "token", "s", 1, 10), (p[0], "y", "sector", None, 1, 5), (p[1], "y", "sector", None, 0, 5)]
    out = lifecycle.lifecycle(spark.createDataFrame(rows, ITEMS), dates(spark, *p))
    got = {(r["item"], r["as_of"]): (r["lifecycle_state"], r["delta_stance"], r["delta_conviction"], r["age"]) for r in out.collect()}
    assert got == {
        ("x", p[0]): ("NEW", 0, 0, 1), ("x", p[1]): ("SUSTAINED", 0, 10, 2), ("x", p[2]): ("FLIPPED", -2, -20, 3), ("x", p[3]): ("EXITED", 1, -40, 0), ("x", p[5]): ("NEW", 0, 0, 1),
        ("y", p[0]): ("NEW", 0, 0, 1), ("y", p[1]): ("SUSTAINED", -1, 0, 2), ("y", p[2]): ("EXITED", 0, -5, 0),
    }
    assert lifecycle.live_rows(out).count() == 6


def test_lifecycle_by_the_published_cases(spark):
    """New, sustained, flipped and exited as the signal's own documentation tells them."""
    p = [D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31)]
    rows = [(p[0], "zk", "sector", None, 1, 70, "structural"), (p[1], "zk", "sector", None, 1, 85, "structural"), (p[2], "zk", "sector", None, -1, 60, "tactical"), (p[0], "HYPE", "token", "perp-dex", 1, 70, "structural")]
    out = lifecycle.lifecycle(spark.createDataFrame(rows, ITEMS + ", horizon string"), dates(spark, *p)).orderBy("as_of").collect()
    zk = [r for r in out if r["item"] == "zk"]
    assert [r["lifecycle_state"] for r in zk] == ["NEW", "SUSTAINED", "FLIPPED", "EXITED"] and [r["age"] for r in zk] == [1, 2, 3, 0]
    assert [r["stance"] for r in zk] == ["bullish", "bullish", "bearish", "neutral"] and [r["horizon"] for r in zk] == ["structural", "structural", "tactical", "structural"]
    assert (zk[0]["delta_stance"], zk[0]["delta_conviction"], zk[1]["delta_conviction"], zk[2]["delta_stance"]) == (0, 0, 15, -2)
    gone = [r for r in out if r["item"] == "HYPE" and r["as_of"] == p[1]][0]
    assert (gone["lifecycle_state"], gone["conviction"], gone["stance"], gone["item_type"], gone["parent_sector"]) == ("EXITED", 0, "neutral", "token", "perp-dex")


def fold(items, periods):
    """The same rules, one period after the other."""
    out, last, age = [], {}, {}
    for t in periods:
        now = {i: (s, c) for d, i, s, c in items if d == t}
        for i, (s, c) in now.items():
            if i in last:
                b = last[i]
                age[i] += 1
                out.append((t, i, "FLIPPED" if s * b[0] < 0 else "SUSTAINED", s - b[0], age[i]))
            else:
                age[i] = 1
                out.append((t, i, "NEW", 0, 1))
        out += [(t, i, "EXITED", -last[i][0], 0) for i in last if i not in now]
        last = now
    return set(out)


def test_lifecycle_against_a_fold(spark):
    r = np.random.default_rng(3)
    periods = [D(2024, m, 28) for m in range(1, 13)]
    rows = [(t, f"i{k}", int(r.integers(-1, 2)), int(r.integers(0, 100))) for t in periods[:4] + periods[6:] for k in range(8) if r.random() < 0.6]
    df = spark.createDataFrame([(t, i, "token", "s", s, c) for t, i, s, c in rows], ITEMS)
    got = {(x["as_of"], x["item"], x["lifecycle_state"], x["delta_stance"], x["age"]) for x in lifecycle.lifecycle(df, dates(spark, *periods)).collect()}
    assert got == fold(rows, periods)


def test_persistence(spark):
    p = [D(2024, m, 28) for m in range(1, 5)]
    picks = spark.createDataFrame([(p[0], "a"), (p[1], "a"), (p[1], "b"), (p[3], "b")], "as_of date, item string")
    got = {tuple(r) for r in lifecycle.persistent(picks, dates(spark, *p)).collect()}
    assert got == {(p[0], "a"), (p[1], "a"), (p[3], "b")}


def test_daily_returns_pad_gaps_and_beta_matches_pandas(spark):
    r = np.random.default_rng(0)
    days = pd.date_range("2024-01-01", periods=60)
    wide = pd.DataFrame(100 * np.exp(np.cumsum(r.normal(0, 0.02, (60, 3)), axis=0)), index=days, columns=["M", "A", "B"])
    wide.loc[days[10:13], "A"] = np.nan
    rows = [(c, d.date(), float(v)) for c in wide for d, v in wide[c].dropna().items()]
    daily = returns.daily_returns(spark.createDataFrame(rows, "symbol string, date date, close double"))
    want = wide.ffill().pct_change(fill_method=None)
    got = daily.toPandas().pivot(index="date", columns="symbol", values="ret").astype(float)
    np.testing.assert_allclose(got[["M", "A", "B"]].to_numpy(), want.to_numpy(), atol=1e-12)
    beta = returns.rolling_beta(daily, "M", 20).toPandas().pivot(index="date", columns="symbol", values="beta").astype(float)
    for c in ("A", "B"):
        expect = want[c].rolling(20).cov(want["M"]) / want["M"].rolling(20).var()
        np.testing.assert_allclose(beta[c].to_numpy(), expect.to_numpy(), atol=1e-9)
    assert beta["M"].dropna().round(9).eq(1).all() and beta["M"].isna().sum() == 20


def test_basket_and_universe(spark):
    oi = spark.createDataFrame([("A", D(2024, 1, 31), 10.0), ("B", D(2024, 1, 31), 5.0), ("C", D(2024, 1, 31), 50.0)], "symbol string, as_of date, oi double")
    sectors = spark.createDataFrame([("A", "s"), ("B", "s"), ("C", "s")], "symbol string, sector string")
    members = returns.basket_members(sectors, oi, 10.0, ("C",))
    assert [r["symbol"] for r in members.collect()] == ["A"]  # the floor counts in
    symbols = spark.createDataFrame([("A", 10.0), ("B", None), ("C", 50.0)], "symbol string, oi double")
    assert {r[0] for r in returns.universe(symbols, 10.0, ("C",), ("B",)).collect()} == {"A", "B"}
