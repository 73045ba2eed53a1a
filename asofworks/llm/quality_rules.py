"""Quality rules whose cut-offs carry a guarantee.

Each rule rejects a text if a ratio lies above a cut-off, and a text goes if any
rule rejects it. For each stratum a path of ever stricter sets of cut-offs is
laid out: each step tightens the one rule that catches most more of the labelled
bad documents for the documents without a label that it costs. The labelled
good documents have no part in the path; they are the holdout. Along the path an
exact binomial test of the whole set of rules rejects "more than
max_false_rejection of the good documents are dropped", each step at the full
level of the stratum, until the first that is not certified (fixed sequence, so
nothing is split over rules and steps). The level is split over strata, and a
stratum whose whole path is certified passes its share on (Holm). So with
probability 1 - error no stratum drops more than its share of good documents.
The test needs independent documents, so texts that are equal but for case and
white space count once in a stratum. The last certified step is used; a stratum
without one rejects nothing.

Paths come from histograms, one small group for each stratum, and are joined to
the documents, so strata may be many; Spark chooses the join by their size.

Defined results: a null or empty text has no words and fails the base rule; a
text of any length is counted whole. A null stratum is a stratum of its own; one
without labels has no cut-offs. A document with several labels counts once, as
bad if any of them is bad. Repeated rows are judged alike; a ratio of exactly
the cut-off is kept. An empty table gives an empty result. Kept columns named
like a count are replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import Texts, annotate, checkpoint, sum_by_row
from .quality_gam import SPACE, marks, word_starts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = marks(b"#*$%&|<>")
#: A rule's ratio; its cut-offs are 0, 1/GRID, ... up to the ratio at LEVELS, so that small ratios are told apart most finely.
RATIOS = {
    "long_words": lambda: F.col("word_chars") / F.col("n_words") / 40,
    "symbols": lambda: F.col("n_symbols") / F.col("n_words") / 4,
    "dup_lines": lambda: F.col("n_dup_lines") / F.col("n_words"),
    "repeats": lambda: F.col("n_repeat_words") / F.col("n_words"),
}
GRID = 200


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of size words which the list has twice or more."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, last = 0, -1
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + size - 1 - max(last, i - 1)
            last = i + size - 1
    return covered


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def counts(texts: Texts) -> list[np.ndarray]:
    data, n = texts.data, len(texts)
    chars = ~SPACE[data] & ((data & 0xC0) != 0x80)
    dups, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, raw in enumerate(texts):
        dups[i] = dup_lines(raw) if b"\n" in raw else 0
        repeats[i] = repeat_words(raw.split())
    return [sum_by_row(texts, word_starts(data, texts.start)), sum_by_row(texts, chars), sum_by_row(texts, SYMBOLS[data]), dups, repeats]


def measure(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df), COUNTS and base_failed."""
    counted = annotate(df, [StructField(c, LongType()) for c in COUNTS], lambda: lambda b: [pa.array(x, pa.int64()) for x in counts(Texts(b.column(text_col)))], [text_col], df.columns if keep is None else keep, text_col)
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k)
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    top = terms.max()
    return min(1.0, math.exp(top) * float(np.exp(terms - top).sum()))


#: The step of a level that no step rejects.
NEVER = 1 << 30


#: A step of a path costs no more documents than this for each that it is thought to tell as bad.
MOST_COST = 2.0


def path(bad: np.ndarray, cost: np.ndarray, scale: float) -> np.ndarray:
    """For each rule and level the step from which on texts of that level are rejected (NEVER: by none).

    bad, cost: counts by rule and level of labelled bad documents and of those
    without a label. A step lowers one rule's cut-off to where it catches more
    of the bad: the one with most bad for each document that it costs, of equals
    the first rule and the mildest cut-off. scale: documents without a label for
    each with one, so a labelled bad document stands for as many others; a step
    that costs MOST_COST times that and more is none.
    """
    tail = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1].astype(float)
    bad_tail, cost_tail = tail(bad), tail(cost)  # at the level or above it
    rules, n = bad.shape
    at = np.full(rules, n)  # the lowest level that is rejected
    step = np.full((rules, n), NEVER)
    now = 0
    while True:
        best = None
        for r in range(rules):
            had, paid = (bad_tail[r, at[r]], cost_tail[r, at[r]]) if at[r] < n else (0.0, 0.0)
            for lower in range(at[r] - 1, 0, -1):  # level 0 is a text without what the rule counts
                gain, price = bad_tail[r, lower] - had, cost_tail[r, lower] - paid
                if bad[r, lower] and price <= MOST_COST * scale * gain and (best is None or gain / (price + 1) > best[0] + 1e-12):
                    best = (gain / (price + 1), r, lower)
        if best is None:
            return step
        now += 1
        _, r, lower = best
        step[r, lower : at[r]] = now
        at[r] = lower


def sequence(dropped: np.ndarray, n: int, risk: float) -> np.ndarray:
    """The level that each step of a path needs to be certified with all before it; dropped: good documents that go at each step, of n."""
    total = np.cumsum(dropped)
    known = {int(k): binomial_cdf(int(k), n, risk) if n else 1.0 for k in np.unique(total)}
    return np.maximum.accumulate([known[int(k)] for k in total]) if len(total) else np.zeros(0)


def level(rule: str):
    return F.least(F.lit(GRID), F.floor(F.coalesce(RATIOS[rule](), F.lit(0.0)) * GRID)).cast("int")


def plain_text(text_col: str) -> Column:
    """Equal for texts that are equal but for case and white space."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), r"\s+", " "))


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", label_col: str = "quality", max_false_rejection: float = 0.04, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the level above which the rule rejects; from all documents that pass the base rule. measured may have _same, equal for texts that count once."""
    own = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("good"))
    same = F.col("_same") if "_same" in measured.columns else F.monotonically_increasing_id()
    named = F.struct(F.col(stratum).isNull().alias("none"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("name"))
    passed = measured.where(~F.col("base_failed")).select(F.col(id_col).alias("label_id"), named.alias("stratum"), same.alias("_same"), *[level(r).alias(r) for r in RATIOS])
    both = passed.join(own, "label_id", "left")
    labelled = both.where("good IS NOT NULL").groupBy("stratum", "_same").agg(F.min("good").alias("good"), *[F.max(r).alias(r) for r in RATIOS])
    labelled = checkpoint(labelled)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("level")) for i, r in enumerate(RATIOS)])).alias("x")
    cost = both.where("good IS NULL").select("stratum", cells).groupBy("stratum", "x.rule", "x.level").agg(F.count("*").alias("cost"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("seen"))
    bad = labelled.select("stratum", "good", cells).groupBy("stratum", "x.rule", "x.level").agg(F.lit(0).cast("long").alias("cost"), F.count_if(F.col("good") != 1).alias("bad"), F.count("*").alias("seen"))

    def lay(pdf):  # at most a row a rule and level, twice
        counts = {c: np.zeros((len(RATIOS), GRID + 1), np.int64) for c in ("bad", "cost")}
        for c, x in counts.items():
            np.add.at(x, (pdf["rule"].to_numpy(), pdf["level"].to_numpy()), pdf[c].to_numpy())
        steps = path(counts["bad"], counts["cost"], counts["cost"][0].sum() / max(1, pdf["seen"][pdf["rule"] == 0].sum()))
        return pdf.iloc[:1][["none", "name"]].assign(steps=[steps.ravel().tolist()])

    kind = "none boolean, name string"
    keyed = cost.unionByName(bad).select("stratum.none", "stratum.name", "rule", "level", "cost", "bad", "seen")
    paths = checkpoint(keyed.groupBy("none", "name").applyInPandas(lay, f"{kind}, steps array<int>")).select(F.struct("none", "name").alias("stratum"), "steps")
    gone = F.least(*[F.element_at("steps", (F.lit(i * (GRID + 1) + 1) + F.col(r)).cast("int")) for i, r in enumerate(RATIOS)])
    good = labelled.where("good = 1").join(paths, "stratum").groupBy("stratum", gone.alias("step")).count()

    def certify(pdf):  # a row a step at most
        n, last = int(pdf["count"].sum()), max([0, *(int(x) for s in pdf["steps"][:1] for x in s if x != NEVER)])
        dropped = np.zeros(last + 1, np.int64)
        for step, k in zip(pdf["step"], pdf["count"], strict=True):
            if step != NEVER:
                dropped[int(step)] += k
        return pdf.iloc[:1][["none", "name", "steps"]].assign(needed=[sequence(dropped, n, max_false_rejection)[1:].tolist()])

    rows = good.join(paths, "stratum").select("stratum.none", "stratum.name", "steps", "step", "count")
    told = checkpoint(rows.groupBy("none", "name").applyInPandas(certify, f"{kind}, steps array<int>, needed array<double>"))
    # Holm over strata, a row each: a stratum whose whole path is certified leaves its level to the others
    strata = told.count()
    ranked = told.select(F.when(F.size("needed") > 0, F.try_element_at("needed", F.lit(-1))).otherwise(0.0).alias("whole")).withColumn("_n", F.row_number().over(W.orderBy("whole")))
    failed = ranked.where(F.col("whole") > error / (strata - F.col("_n") + 1)).agg(F.min("_n")).first()[0]
    share = error / max(1, strata - ((failed or strata + 1) - 1))
    last = F.size(F.filter("needed", lambda p: p <= share))
    cut = lambda i: F.size(F.filter(F.slice("steps", i * (GRID + 1) + 1, GRID + 1), lambda s: s > last)) - 1
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), cut(i).alias("cutoff")) for i, r in enumerate(RATIOS)])).alias("x")
    return told.select(F.when(~F.col("none"), F.col("name")).alias("stratum"), cells).select("stratum", "x.rule", "x.cutoff")


def apply_rules(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured and kept: not base_failed, and no rule's level above the cut-off of its stratum."""
    limits = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RATIOS])
    both = measured.join(limits, F.col(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
    fine = ~F.col("base_failed")
    for rule in RATIOS:
        fine = fine & (level(rule) <= F.coalesce(F.col(f"_{rule}"), F.lit(GRID)))
    return both.withColumn("kept", fine).select(*[F.col(f"`{c}`") for c in measured.columns if c != "kept"], "kept")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **risk: float) -> DataFrame:
    """id, stratum, COUNTS, base_failed and kept of every row; the counts are made once and kept in a checkpoint."""
    measured = checkpoint(measure(df.withColumn("_same", plain_text(text_col)), text_col, [id_col, stratum, "_same"]))
    return apply_rules(measured, calibrate(measured, labels, id_col, stratum, **risk), stratum).drop("_same")
