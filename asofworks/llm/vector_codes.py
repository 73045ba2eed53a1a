"""Compression of vectors to codes: Lloyd's rounds with resident members.

A vector is cut into equal parts, and each part position has a codebook. The
parts live with their owners: partitions by (position, entry, salt), where the
salt cuts an entry's members into owners of a bounded number, so that an entry
with a third of all parts has as many owners as it needs. In each round owners
add up their resident members, one row an entry and task goes on, and the new
codebook comes back to all tasks (entries x components, whatever the corpus).
Owners then assign their members again; those that keep their entry stay where
they are, and only those that change it migrate in the next shuffle.

All arithmetic is on integers: distances in floating point only where they are
exact, means rounded down.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped. Vectors shorter than the longest, and a length that does
not divide into the parts, are filled up with zeros; components beyond 2^24
after scaling are held there. A null id comes before all others when the first
codebook is made, and rows of equal ids are taken by their vectors. Repeated
rows are rows: each has a code and counts in the means. With fewer rows than
entries the codebook has as many entries as rows. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, matrix, whole_vectors, written

SCALE = 1_024
LIMIT = 1 << 24
#: Members of an owner, about; an entry has no fewer owners than LEAST_SALTS.
MEMBERS = 100_000
LEAST_SALTS = 16


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (of equals the first) and its squared distance, exactly."""
    entry, error = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    exact = 4 * most * most * max(1, book.shape[1]) < 1 << 53
    own = (book * book).sum(axis=1)
    for at in range(0, len(parts), 1_024):
        p = parts[at : at + 1_024]
        cross = (p.astype(float) @ book.T.astype(float)).astype(np.int64) if exact else p @ book.T
        d = (p * p).sum(axis=1)[:, None] - 2 * cross + own
        entry[at : at + 1_024] = d.argmin(axis=1)
        error[at : at + 1_024] = d.min(axis=1)
    return entry, error


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).reshape(-1)))


def cut(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """A row for each part of rows (row, id, label, q): position, part, and its entry in the first codebook."""
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), positions * width)
            for p in range(positions):
                part = q[:, p * width : (p + 1) * width]
                entry, _ = nearest(part, books[p])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), pa.array(np.full(len(q), p, np.int32)), lists(part), pa.array(entry)], ["row", "id", "label", "position", "part", "entry"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("row", "id", "label"))
    return rows.mapInArrow(run, f"{kinds}, position int, part array<bigint>, entry int")


def housed(parts: DataFrame, salts: int) -> DataFrame:
    """parts at their owners."""
    return parts.repartition("position", "entry", F.pmod(F.xxhash64("row"), F.lit(salts)))


def means(home: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry its members' mean, rounded down; an entry without members stays."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, width + 1), np.int64)
        for batch in batches:
            at = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            part = matrix(batch.column("part"), width)
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[order], prepend=-1)) if len(at) else np.zeros(0, int)
            if len(heads):
                total[at[order][heads]] += np.add.reduceat(np.column_stack([part, np.ones(len(part), np.int64)])[order], heads, axis=0)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used), lists(total[used])], ["owner", "total"])

    sums = home.select("position", "entry", "part").mapInArrow(run, "owner bigint, total array<bigint>").select("owner", F.posexplode("total").alias("place", "x")).groupBy("owner", "place").agg(F.sum("x").alias("x"))
    total = np.zeros((positions * entries, width + 1), np.int64)
    for r in sums.collect():  # entries x components, whatever the corpus
        total[r["owner"], r["place"]] = r["x"]
    used = total[:, -1] > 0
    out = books.reshape(-1, width).copy()
    out[used] = total[used, :-1] // total[used, -1:]
    return out.reshape(books.shape)


def assigned(home: DataFrame, books: np.ndarray) -> DataFrame:
    """home with the entry that each part has in the codebooks, before (its entry until now) and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            part = matrix(batch.column("part"), books.shape[2])
            entry, error = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(position):
                own = position == p
                entry[own], error[own] = nearest(part[own], books[p])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "position", "part")), pa.array(entry), batch.column("entry"), pa.array(error)], ["row", "id", "label", "position", "part", "entry", "before", "error"])

    kinds = ", ".join(f"{c} {home.schema[c].dataType.simpleString()}" for c in ("row", "id", "label"))
    return home.mapInArrow(run, f"{kinds}, position int, part array<bigint>, entry int, before int, error bigint")


def rehoused(home: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """home after the next assignment: members that keep their entry lie where they lay, the others are shuffled to their new owners."""
    now = assigned(home, books).persist(StorageLevel.MEMORY_AND_DISK)
    stay = now.where("entry = before").select(*home.columns)
    gone = housed(now.where("entry <> before").select(*home.columns), salts)
    new = stay.unionByName(gone).persist(StorageLevel.MEMORY_AND_DISK)
    new.count()  # made before what it is made from goes
    now.unpersist()
    home.unpersist()
    return new


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over equal labels, nulls together."""
    own = coded.withColumn("_l", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType)).alias("label")))
    return looked_up(own, own.groupBy("_l").agg(F.sum("error").alias("label_error")), "_l").drop("_l")


def first_books(rows: DataFrame, positions: int, entries: int, width: int) -> np.ndarray:
    """Each position's first codebook: the parts of the smallest ids, in their order."""
    head = rows.select("id", "q").orderBy("id", "q").limit(entries).collect()  # entries rows, whatever the corpus
    q = np.zeros((len(head), positions * width), np.int64)
    for i, r in enumerate(head):
        q[i, : len(r["q"])] = r["q"]
    return q.reshape(len(head), positions, width).transpose(1, 0, 2)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positions: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): see the module."""
    own = whole_vectors(df, vector_col, SCALE, LIMIT, "_q").select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col("_q").alias("q"))
    rows = written(own.withColumn("row", F.monotonically_increasing_id()))  # numbered once, so that a lost task numbers no row anew
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    width = -(-longest // positions)
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = first_books(rows, positions, entries, width)
    salts = max(LEAST_SALTS, -(-n // MEMBERS))
    home = housed(cut(rows, books), salts).persist(StorageLevel.MEMORY_AND_DISK)
    for turn in range(rounds):
        if turn:
            home = rehoused(home, books, salts)
        books = means(home, books)
    now = assigned(home, books)
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    entry = lambda p: F.max(F.when(F.col("position") == p, F.col("entry")))
    codes = now.groupBy("row").agg(F.max("id").alias("id"), F.max("label").alias("label"), F.concat(*[F.lower(F.lpad(F.hex(entry(p)), 2, "0")) for p in range(positions)]).alias("code"), F.sum("error").alias("error"))
    coded = written(codes)
    home.unpersist()
    return label_errors(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = 4, positions: int = 4, entries: int = 256, width: int = 16) -> str:
    """The same rows in DuckDB's SQL, for vectors of positions x width components."""
    whole = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"own AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {whole})",
        f"parts AS (SELECT vec_id, CAST(p AS INTEGER) AS p, q[p * {width} + 1 : p * {width} + {width}] AS v FROM own, range({positions}) r(p))",
        f"book0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, v AS c FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    for r in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min_by(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT vec_id, parts.p, v, e, {distance} AS d FROM parts JOIN book{r} b ON b.p = parts.p) GROUP BY vec_id, p)")
        if r < rounds:
            floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"sums{r} AS (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM near{r}, range(1, {width + 1}) g(i) GROUP BY p, e, i)")
            steps.append(f"means{r} AS (SELECT p, e, list({floored} ORDER BY i) AS c FROM sums{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)")
    coded = f"SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id"
    book = f"SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) FROM book{rounds}"
    steps.append(f"coded AS ({coded})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({book}) AS codebooks_sha256 FROM coded JOIN own USING (vec_id)"
