"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only the lengths matter to the packing, and there are at most `size` of them.
So the plan is made from the number of pieces of each length: a bin is filled
greedily with the longest pieces that fit; then its smallest piece is replaced
by two unpacked pieces that fill the widened gap more tightly, if there are
such. The bin's pattern is used as often as the pieces suffice, so every step
uses up a length and the plan has few patterns, however many documents there
are. Pieces then get a rank among those of their length, and with it a place
in the plan. The ranks come from windows over (length, hash bucket) and sums
over buckets, so that a length with a third of all pieces is dealt out.

Defined results: a null or empty text is one piece, the end token. Repeated
rows, and rows that share an id, are packed each. A longer document, however
long, is encoded whole and cut from its end, so its first piece may be the short
one. Ties: of two pairs that fill a gap equally the one with the longer piece is
taken; pieces of equal length are dealt by a hash of id, piece and content. An
empty table gives an empty result. Only id and text are read, so names of other
columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from .common import Texts, annotate, checkpoint
from .tokens import encoder

END = 2
BUCKETS = 1024


@dataclass
class Pattern:
    lengths: list[int]  # in the order of their places in the bin
    times: int


def greedy(count: np.ndarray, gap: int) -> list[int]:
    """The longest pieces, one after the other, that fit; count is not changed."""
    own, left = [], count.copy()
    while gap > 0:
        fit = np.flatnonzero(left[: gap + 1])
        if not len(fit):
            break
        n = int(fit[-1])
        take = min(int(left[n]), gap // n)
        own += [n] * take
        left[n] -= take
        gap -= n * take
    return own


def best_two(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two pieces of left whose sum comes closest to room from below; of equals those with the longer one."""
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return None
    # for each a the longest b <= room - a
    below = np.searchsorted(there, room - there, side="right") - 1
    a, b = there[below >= 0], there[below[below >= 0]]
    ok = (a != b) | (left[a] > 1)
    # a piece that is alone of its length cannot be used twice: the next shorter one instead
    alone = ~ok & (below[below >= 0] > 0)
    b = np.where(alone, there[np.maximum(below[below >= 0] - 1, 0)], b)
    ok |= alone
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    best = np.lexsort((np.maximum(a, b), a + b))[-1]
    return int(a[best]), int(b[best])


def plan(count: np.ndarray, size: int) -> list[Pattern]:
    """Patterns that use up count[n] pieces of each length n (1 to size)."""
    left, out = count.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[first] -= 1
        own = [first, *greedy(rest, size - first)]
        # the smallest piece gives way to two that fit its widened gap more tightly
        if len(own) > 1:
            smallest = own[-1]
            rest = left - np.bincount(own, minlength=len(left))
            room = size - sum(own) + smallest
            two = best_two(rest, room)
            if two and sum(two) > smallest:
                own = [*own[:-1], *sorted(two, reverse=True)]
        use = np.bincount(own, minlength=len(left))
        at = np.flatnonzero(use)
        times = int((left[at] // use[at]).min())
        left -= use * times
        out.append(Pattern(own, times))
    return out


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = END, path: str | None = None) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of all documents; each document is encoded whole, once."""

    def start():
        own = encoder(path)

        def f(batch: pa.RecordBatch) -> list:
            total, crcs = [], []
            for text in Texts(batch.column(text_col)).strings():
                ids = np.append(own.ids(text), np.uint32(end)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids), size), len(ids)] if len(ids) > first else [0, len(ids)]
                total.append(len(ids))
                crcs.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])
            return [pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]

        return f

    whole = annotate(df, [StructField("_tokens", LongType()), StructField("_crcs", ArrayType(LongType()))], start, [text_col], [id_col], text_col)
    first = (F.col("_tokens") - 1) % size + 1
    cut = whole.select(id_col, "_tokens", F.posexplode("_crcs").alias("piece", "ids_crc32"))
    begin = F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * size).cast("long")
    return cut.select(id_col, "piece", begin.alias("start"), F.when(F.col("piece") == 0, first).otherwise(size).cast("long").alias("length"), "ids_crc32")


def places(patterns: list[Pattern], size: int) -> tuple[np.ndarray, ...]:
    """For look-ups: each slot's first key (length * 2^44 + rank), and its pattern's first sequence, pieces of that length, and their offsets."""
    rows, sequence = [], 0
    used = np.zeros(size + 1, np.int64)
    for p in patterns:
        offset = np.concatenate([[0], np.cumsum(p.lengths)[:-1]])
        for n in sorted(set(p.lengths)):
            own = [int(o) for o, x in zip(offset, p.lengths, strict=True) if x == n]
            rows.append(((n << 44) + int(used[n]), sequence, len(own), own))
            used[n] += len(own) * p.times
        sequence += p.times
    rows.sort()
    starts = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int64)
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), starts[:-1], np.array([o for r in rows for o in r[3]], np.int64)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = END, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset there."""
    pieces = checkpoint(tokenized(df, id_col, text_col, size, end, path))
    count = np.zeros(size + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():  # at most `size` rows
        count[n] = k
    first_key, first_sequence, each, at, offsets = places(plan(count, size), size)

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    sums = dealt.groupBy("length", "_bucket").count().withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    own = W.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(sums.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_bucket"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_own") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = np.asarray(b.column("_rank"))
            slot = np.searchsorted(first_key, (np.asarray(b.column("length")) << 44) + rank, side="right") - 1
            within = rank - (first_key[slot] & ((1 << 44) - 1))
            sequence = first_sequence[slot] + within // each[slot]
            offset = offsets[at[slot] + within % each[slot]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
