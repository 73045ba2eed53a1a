"""Point-in-time memory of vectors: inverted cells, a date bound inside the search, exact re-ranking.

Cells are centres of a bounded sample; every row of the memory is in one cell,
its nearest centre's. A query looks into the cells that lie nearest to it, at
rows that were known at its date, and ranks those by their exact similarity.
A second look takes every cell that could still hold a better
row (a row is no nearer than its centre less the cell's radius), so nothing is
missed; exact=False leaves it out. A cell with many rows is dealt over salts, so that no task holds it all.
Similarities are matrix products of such blocks; those near the best are summed
up again component by component, so that equal vectors score equally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .storage import saved

#: Rows of a cell and queries that one task compares, about, and pairs whose similarity it holds at once.
ROWS_A_SALT = 50_000
QUERIES_A_PART = 20_000
PAIRS = 1 << 21
#: Similarities by blocks differ by less from those that rank.
ROUNDING = 1e-9


@dataclass
class Cells:
    """centres (of length 1) and, once rows are indexed, each cell's radius and number of rows."""

    centres: np.ndarray
    radius: np.ndarray | None = None
    rows: np.ndarray | None = None

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * unit @ self.centres.T)) if len(self.centres) else np.zeros((len(unit), 0))


def whole(vector: str) -> Column:
    """Neither null nor empty nor of length 0, and no component null or not finite: only such vectors have a direction."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def unit(vector: str) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / length)


def fit(memory: DataFrame, vector: str = "vector", key: str = "id", cells: int = 64, sample: int = 20_000, rounds: int = 8) -> Cells:
    """Centres by spherical k-means of the rows with the smallest hashes of their key, `sample` at most: the bound on what comes to the driver."""
    rows = memory.where(whole(vector)).select(unit(vector).alias("u"), F.xxhash64(key).alias("h")).orderBy("h", "u").limit(sample).collect()
    if not rows:
        return Cells(np.zeros((0, 0)))
    x = np.array([r["u"] for r in rows])
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return Cells(centres)


def distances(cells: Cells) -> object:
    @F.pandas_udf(ArrayType(DoubleType()))
    def to_centres(u: pd.Series) -> pd.Series:
        return pd.Series(list(cells.distances(np.stack(u.to_numpy())))) if len(u) else pd.Series([], dtype=object)

    return to_centres


def index(memory: DataFrame, cells: Cells, vector: str = "vector") -> tuple[DataFrame, Cells]:
    """memory with _v (the vector) and _cell, of all rows that have a direction; and cells with their radius and rows."""
    d = distances(cells)
    rows = memory.where(whole(vector)).withColumn("_v", F.col(vector)).withColumn("_d", d(unit(vector)))
    rows = saved(rows.withColumn("_away", F.array_min("_d")).withColumn("_cell", F.array_position("_d", F.array_min("_d")).cast("int") - 1).drop("_d"))
    n = len(cells.centres)
    radius, count = np.zeros(n), np.zeros(n, np.int64)
    for r in rows.groupBy("_cell").agg(F.max("_away").alias("away"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["_cell"]], count[r["_cell"]] = r["away"], r["n"]
    return rows, Cells(cells.centres, radius, count)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(vectors.combine_chunks().flatten(), dtype=np.float64).reshape(len(vectors), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of equal places, summed up in the order of the components, as SQL does: equal vectors have equal scores wherever they stand."""
    both, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        both += x * y
        left += x * x
        right += y * y
    return np.clip(both / np.sqrt(left * right), -1, 1)


def nearest(asked: np.ndarray, t: np.ndarray, held: np.ndarray, day: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of rows, scores) of each query's k most similar rows with a day up to its t; ties by place."""
    one = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    order = np.argsort(day, kind="stable")
    known, units, turned = np.searchsorted(day[order], t, side="right"), one(held)[order].T, one(asked)
    by_day, wide = np.argsort(-known, kind="stable"), max(1, PAIRS // max(1, len(held)))
    for at in range(0, len(asked), wide):
        some = by_day[at : at + wide]
        n = int(known[some].max(initial=0))
        if not n:
            return
        score = turned[some] @ units[:, :n]
        score[np.arange(n) >= known[some][:, None]] = -9
        least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -5.0)
        q, r = np.nonzero(score >= np.maximum(least - ROUNDING, -5)[:, None])
        row = order[r]
        exact = np.concatenate([cosines(asked[some[q[a : a + PAIRS // 64]]], held[row[a : a + PAIRS // 64]]) for a in range(0, len(q), PAIRS // 64)])
        ranked = np.lexsort((row, -exact, q))
        q, row, exact = q[ranked], row[ranked], exact[ranked]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
        yield some[q[keep]], row[keep], exact[keep]


def compared(asked: DataFrame, rows: DataFrame, cells: Cells, key: str, day: str, k: int) -> DataFrame:
    """(query_id, key, score): of each query and each of its cells (_cells) the k most similar rows that were known at its t.

    A task holds some rows of a cell and some of the queries that look there.
    """
    salted = [max(1, -(-int(n) // ROWS_A_SALT)) for n in cells.rows]
    parts = max(1, -(-asked.count() // QUERIES_A_PART))
    salts, first = (F.array(*[F.lit(int(x)) for x in own]) for own in (salted, np.cumsum(salted) - salted))
    task = ((F.get(first, F.col("_cell")) + F.col("_salt")) * parts + F.col("_part")).cast("int").alias("_task")
    own = asked.select("query_id", "t", "_q", F.explode("_cells").alias("_cell")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.get(salts, F.col("_cell")) - 1)))
    own = own.withColumn("_part", F.pmod(F.xxhash64("query_id", "_q"), F.lit(parts))).select("query_id", "t", "_q", task)
    held = rows.where(F.col(day).isNotNull()).select(F.col(key).alias("_key"), F.col(day).alias("_day"), "_v", "_cell").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.get(salts, F.col("_cell"))))
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("_key", "_day", "_v", task)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.filter(left.column("t").is_valid()), right.take(pa.compute.sort_indices(right, sort_keys=[("_key", "ascending")], null_placement="at_start"))
        found = []
        if len(left) and len(right):
            days = pa.concat_arrays([*left.column("t").cast(right.schema.field("_day").type).chunks, *right.column("_day").chunks])
            order = pa.compute.rank(days, tiebreaker="dense").to_numpy()
            found = list(nearest(matrix(left.column("_q")), order[: len(left)], matrix(right.column("_v")), order[len(left) :], k))
        q, r, score = (np.concatenate([x[i] for x in found] or [np.zeros(0, int)]) for i in range(3))
        return pa.table([left.column("query_id").take(pa.array(q)), right.column("_key").take(pa.array(r)), pa.array(score, pa.float64())], names=["query_id", key, "score"])

    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(key, rows.schema[key].dataType), StructField("score", DoubleType())])
    tasks = max(1, sum(salted) * parts)
    return own.repartitionById(tasks, "_task").groupBy("_task").cogroup(held.repartitionById(tasks, "_task").groupBy("_task")).applyInArrow(lambda left, right: meet(left, right), schema)


def best(found: DataFrame, key: str, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, rows: DataFrame, cells: Cells, k: int = 10, probes: int = 8, exact: bool = True, key: str = "id", day: str = "day") -> DataFrame:
    """(query_id, key, score, rank) of queries (query_id, vector, t): the k most similar rows (cosine) with a day up to t; ties by the smaller key.

    rows, cells: as index returns them. Queries without a direction find nothing.
    """
    d = distances(cells)
    asked = queries.where(whole("vector")).select("query_id", "t", F.col("vector").alias("_q"), d(unit("vector")).alias("_d"))
    ordered = F.transform(F.sort_array(F.transform("_d", lambda x, i: F.struct(x.alias("d"), i.alias("cell")))), lambda s: s["cell"])
    asked = saved(asked.withColumn("_cells", F.slice(ordered, 1, probes)))
    found = best(compared(asked, rows, cells, key, day, k), key, k)
    if not exact:
        return found.select("query_id", key, "score", "rank")
    found = saved(found)
    worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("_worst"))
    # of vectors of length 1, by the distance; a little more for rounding
    far = F.when(F.col("_worst").isNull(), 3.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_worst")))) + 1e-6
    radius = F.array(*[F.lit(float(x)) for x in cells.radius])
    rest = F.filter(F.transform("_d", lambda x, i: F.when(~F.array_contains("_cells", i) & (x - F.get(radius, i) <= far), i)), lambda i: i.isNotNull())
    again = asked.join(worst, "query_id", "left").withColumn("_more", rest).select("query_id", "t", "_q", F.col("_more").alias("_cells"))
    return best(found.select("query_id", key, "score").unionByName(compared(again, rows, cells, key, day, k)), key, k).select("query_id", key, "score", "rank")
