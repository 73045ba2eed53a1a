"""Hard negatives of anchors by slots of scores.

Each anchor's positives set windows of scores for its negatives: at most the
positive's score, at least a share of it. The positives' scores, as upper
limits, cut the scores into disjoint slots; a row of another label goes to the
one slot that holds its score, and combiners keep the best few of each slot,
first within a block of rows, then within a task, then after the shuffle. What
a window asks for are the best of its own slot and all lower ones: the slots'
lists are merged from the lowest up, and each window reads the merge at its own
limit, however windows overlap.

Rows travel in blocks, and anchors in blocks of about ANCHORS: each pair of
blocks is one product of matrices. Anchors' blocks are sent to all tasks only
below BROADCAST_BYTES; beyond it, blocks of rows and of anchors meet in a
shuffle whose keys hold a bounded number of blocks of rows.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part. Missing components of a shorter vector count 0;
components beyond 2^26 after scaling are held there. Other rows of an anchor
are those with another id; a row that is repeated counts as often as it is
there, but an anchor that is repeated is one anchor. Ties go to the smaller id.
An anchor without positives has no rows, nor has a positive without negatives
in its window. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import matrix, whole_vectors, written

SCALE = 256
LIMIT = 1 << 26
#: Anchors of a block, about; rows of a block, at most.
ANCHORS = 1_024
ROWS = 4_096
#: Anchors that are compared with a block of rows at once.
STEP = 256
BROADCAST_BYTES = 32 << 20
#: Blocks of rows that meet a block of anchors under one key of a shuffle, about.
BLOCKS = 64
#: An upper limit that is none.
NONE = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def mining_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, q): the rows that take part, with the label that they have in the mining, and scaled components."""
    own = whole_vectors(df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), vector_col, SCALE, LIMIT, "_q")
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return own.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col("_q").alias("q"))


def packed(ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Rows as bytes, the components in the smallest type that holds them."""
    most = int(np.abs(q).max(initial=0))
    size = 2 if most < 1 << 15 else 4
    return ids.tobytes(), labels.tobytes(), q.astype(f"i{size}").tobytes(), size


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["q"], f"i{row['size']}").reshape(len(ids), -1)


PACKED = "ids binary, labels binary, q binary, size int"


def row_blocks(rows: DataFrame, width: int) -> DataFrame:
    """(block of rows' bytes): at most ROWS rows each, in order of their ids, as they lie in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list) -> pa.RecordBatch:
            ids, labels, q = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packed(ids[order], labels[order], q[order]), (pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["ids", "labels", "q", "size"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                if n + own.num_rows > ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append((own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("q"), width)))
                n += own.num_rows
        if n:
            yield block(held)

    return rows.select("id", "label", "q").mapInArrow(run, PACKED)


def anchor_blocks(anchors: DataFrame, n: int, width: int) -> DataFrame:
    """(block, rows' bytes): anchors, each once, dealt by a hash of their ids."""
    blocks = max(1, -(-n // ANCHORS))

    def pack(pdf):
        q = np.zeros((len(pdf), width), np.int64)
        for i, x in enumerate(pdf["q"]):
            q[i, : len(x)] = x
        ids, labels, q, size = packed(pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), q)
        return pdf.iloc[:1][["block"]].assign(ids=ids, labels=labels, q=q, size=size)

    return anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, f"block int, {PACKED}")


def meet(rows: DataFrame, n_rows: int, anchors: DataFrame, n_blocks: int, size: int) -> DataFrame:
    """Each block of rows with each block of anchors (whose columns begin with a_)."""
    own = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    every = rows.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if size <= BROADCAST_BYTES:
        return every.join(F.broadcast(own), "a_block")
    salts = max(1, n_rows // (ROWS * BLOCKS))
    every = every.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    return every.join(own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["a_block", "_salt"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b; exact: in floating point only where no sum can be rounded."""
    bound = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row among those that fit; of equals the first columns."""
    n = score.shape[1]
    if np.abs(score).max(initial=0) < 1 << 49:  # the place beside the score in one number: a partition tells all
        key = np.where(fits, score * ROWS + (ROWS - 1 - np.arange(n)), LEAST)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), score.shape)
        i, j = np.nonzero(np.take_along_axis(key, top, 1) != LEAST)
        return i, top[i, j]
    i, j = np.nonzero(fits)
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    fine = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[fine], j[fine]


def over_tiles(tiles: DataFrame, schema: str, names: list[str], f: Callable) -> DataFrame:
    """The rows (arrays in the order of names) that f makes of each pair of blocks; f gets the anchors from place `at` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a pair of blocks
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, labels, q = unpacked(row)
                a_ids, a_labels, a_q = unpacked({c[2:]: v for c, v in row.items() if c.startswith("a_")})
                for at in range(0, len(a_ids), STEP):
                    to = min(at + STEP, len(a_ids))
                    found = f(row, at, a_ids[at:to], a_labels[at:to], ids, labels, products(a_q[at:to], q))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(np.broadcast_to(x, found[1].shape))) for x in found], names)

    return tiles.mapInArrow(run, schema)


def leading(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key, by score and then id: kept by each task before the shuffle, and after it."""
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged_suffixes(slots: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, upper and best: the first k of the slot and all lower ones, by merging from the lowest slot up.

    slots: (keys, upper, items), items in order. A lower slot's scores are all
    below a higher one's, so a merge is a concatenation, cut to k.
    """
    order = F.sort_array(F.collect_list(F.struct("upper", "items")))  # a slot a positive, at most
    empty = F.slice(order, 1, 0)
    before = lambda done: F.when(F.size(done) > 0, F.element_at(done, -1)["items"]).otherwise(F.element_at(F.array(F.array().cast(slots.schema["items"].dataType)), 1))
    step = lambda done, s: F.concat(done, F.array(F.struct(s["upper"].alias("upper"), F.slice(F.concat(s["items"], before(done)), 1, k).alias("items"))))
    return slots.groupBy(*keys).agg(F.aggregate(order, empty, step).alias("_s")).select(*keys, F.inline("_s")).withColumnRenamed("items", "best")


def mine(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, q): see the module."""
    low, whole = least
    rows = written(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    anchors = rows.where(F.col("id") % anchor_every == 0).distinct()
    blocks = written(anchor_blocks(anchors, anchors.count(), width))
    n_blocks, size = blocks.agg(F.coalesce(F.max("block") + 1, F.lit(1)), F.coalesce(F.sum(F.length("ids") + F.length("labels") + F.length("q")), F.lit(0))).first()
    packed_rows = row_blocks(rows, width)

    def near(row, at, a_ids, a_labels, ids, labels, score):
        i, j = best(score, (a_labels[:, None] == labels) & (a_ids[:, None] != ids), positives)
        return np.int32(row["a_block"]), (at + i).astype(np.int32), a_ids[i], score[i, j], ids[j]

    found = over_tiles(meet(packed_rows, n, blocks, n_blocks, size), "block int, place int, anchor_id long, score long, id long", ["block", "place", "anchor_id", "score", "id"], near)
    own = written(leading(found, ["block", "place"], positives).select("block", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def limits(pdf):  # a block's anchors: upper limits in ascending order
        out = np.full((int(pdf["place"].max()) + 1, positives), NONE)
        for place, uppers in zip(pdf["place"], pdf["uppers"], strict=True):
            out[place, : len(uppers)] = uppers
        return pdf.iloc[:1][["block"]].assign(limits=out.tobytes())

    limited = own.groupBy("block", "place").agg(F.sort_array(F.collect_set("positive_score")).alias("uppers")).groupBy("block").applyInPandas(limits, "block int, limits binary")
    with_limits = blocks.join(written(limited), "block")

    def slotted(row, at, a_ids, a_labels, ids, labels, score):
        upper = np.full((at + len(a_ids), positives), NONE)
        told = np.frombuffer(row["a_limits"], np.int64).reshape(-1, positives)[: len(upper)]
        upper[: len(told)] = told
        upper = upper[at:]
        slot = (score[:, :, None] > upper[:, None, :]).sum(axis=2, dtype=np.int8) if score.size < 1 << 16 else sum((score > upper[:, [s]]).astype(np.int8) for s in range(positives))
        other = a_labels[:, None] != labels
        parts = []
        for s in range(positives):
            limit = upper[:, [s]]
            # what lies below the share of its own slot's limit lies below that of all higher ones
            wanted = (limit != NONE) & other & (slot == s) & (whole * score >= low * np.where(limit == NONE, 0, limit))
            if wanted.any():
                i, j = best(score, wanted, negatives)
                parts.append((i, j, upper[i, s]))
        i, j, u = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 3
        return np.int32(row["a_block"]), (at + i).astype(np.int32), u.astype(np.int64), score[i, j], ids[j]

    found = over_tiles(meet(packed_rows, n, with_limits, n_blocks, size), "block int, place int, upper long, score long, id long", ["block", "place", "upper", "score", "id"], slotted)
    key = ["block", "place"]
    kept = leading(found, [*key, "upper"], negatives).groupBy(*key, "upper").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("items"))
    items = F.coalesce("items", F.array().cast(kept.schema["items"].dataType))
    slots = own.select(*key, F.col("positive_score").alias("upper")).distinct().join(kept, [*key, "upper"], "left").withColumn("items", items)
    windows = own.join(merged_suffixes(slots, key, negatives).withColumnRenamed("upper", "positive_score"), [*key, "positive_score"])
    fit = F.filter("best", lambda x: x["score"] * whole >= F.col("positive_score") * low)
    out = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(fit).alias("_i", "x"))
    return out.select("anchor_id", "positive_id", (F.col("_i") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


#: The same rows as op12_hard_negatives in DuckDB's SQL (vectors of one length).
SQL = """
WITH own AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM own a JOIN own b ON b.id <> a.id WHERE a.id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, n.id AS negative_id, positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
