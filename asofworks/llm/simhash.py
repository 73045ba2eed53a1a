"""SimHash near-duplicates, found with Burkhard-Keller trees.

A fingerprint has 64 bits; a bit is 1 if over half of the hashes of a text's
word shingles have it. Fingerprints link at RADIUS or fewer differing bits.

The search: equal fingerprints are one node. The 64 bits are cut into BLOCKS
blocks; two fingerprints that differ in at most RADIUS bits agree in at least
BLOCKS - RADIUS blocks. So for every choice of that many blocks a node goes to
the shard named by their values, and each linked pair meets in a shard. A shard
holds a tree: a child hangs under its parent at the edge of their Hamming
distance, and a search follows only edges within the radius of the query's own
distance. The trees of all shards of a task form one forest of arrays, walked
for all queries at once. A shard above MOST nodes is dealt in slices; each
slice's tree goes to the slices after it as well, so no task holds more
than two slices of a hot shard, and every pair of slices meets once. What
leaves a shard is a spanning forest of its links, never all pairs.

Trees travel to the tasks with the queries of their own shard, not to all
tasks: sending every tree everywhere would grow with the square of the corpus.

Defined results: a null or empty text, or one of white space only, has
fingerprint 0 and links like any other. Repeated rows and exact copies share
one node; rows that share an id are told apart by their texts. A text of any
length is read whole. A bit that exactly half of the hashes have is 0. An id of
null takes part; a component's id is its smallest non-null id. An empty table
gives an empty result. Kept columns named like a result are replaced.

Joins on fingerprints and roots may be skewed by masses of copies; their other
side has one row a key, so adaptive execution splits them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from .common import Texts, annotate
from .graph import components

RADIUS = 3
BLOCKS = 5
MOST = 4096
#: Pairs of a query and a node that a walk looks at together.
FRONT = 1 << 15
SEED = 42


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of a text's lower-cased shingles of width words, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[width - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 4096):
        ones += np.unpackbits(octets[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """keep (default: all columns of df) and the fingerprint as a signed long."""

    def f(batch: pa.RecordBatch) -> list:
        return [pa.array(np.array([fingerprint(raw) for raw in Texts(batch.column(text_col))], np.uint64).view(np.int64))]

    return annotate(df, [StructField(out, LongType())], lambda: f, [text_col], df.columns if keep is None else keep, text_col)


class Forest:
    """BK-trees of many shards as arrays; the first item of a shard is its tree's root."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        n = len(fp)
        self.child = {}  # level by level: sorted keys node * 65 + distance, and their child nodes
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.shards, self.roots = shard[first], first
        at = first[inverse.ravel()]  # every item's present node
        rest = np.flatnonzero(at != np.arange(n))
        keys, nodes = [], []
        while len(rest):
            key = at[rest] * 65 + np.bitwise_count(fp[rest] ^ fp[at[rest]])
            own, head, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(own)
            nodes.append(rest[head])
            at[rest] = rest[head][back.ravel()]
            rest = rest[at[rest] != rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        """Yields (query, node) index arrays of all nodes of the query's shard within radius."""
        place = np.searchsorted(self.shards, shard)
        place[place == len(self.shards)] = 0
        here = self.shards[place] == shard if len(self.shards) else np.zeros(len(shard), bool)
        query = np.flatnonzero(here)
        node = self.roots[place[query]] if len(query) else query
        near = np.arange(-radius, radius + 1)
        todo = [(query, node)]
        while todo:  # parts of the front, so that a dense shard takes no more memory than a sparse one
            query, node = todo.pop()
            if len(query) > FRONT:
                todo += [(query[k : k + FRONT], node[k : k + FRONT]) for k in range(0, len(query), FRONT)]
                continue
            if not len(query):
                continue
            distance = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            edge = distance[:, None] + near
            key = np.where((edge >= 0) & (edge <= 64), node[:, None] * 65 + edge, -1)
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            found = (self.keys[place] == key) if len(self.keys) else np.zeros(key.shape, bool)
            row, _ = np.nonzero(found)
            todo.append((query[row], self.nodes[place[found]]))


def spanning(n: int, batches) -> np.ndarray:
    """A spanning forest, as each item's smallest reachable item, of links that come as (a, b) index arrays."""
    root = np.arange(n)
    for a, b in batches:
        while True:
            low = np.minimum(root[a], root[b])
            high = np.maximum(root[a], root[b])
            differ = low != high
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(root, high[differ], low[differ])
            while (root != root[root]).any():
                root = root[root]
    return root


def shard_links(tables):
    """Spanning links (a, b) of the shards of a task. Rows: key (the shard and its pair of slices), side (0: in the tree, 1: asks only), fp."""
    for batch in tables:
        key, side, fp = (np.asarray(batch.column(c)) for c in ("key", "side", "fp"))
        fp = fp.view(np.uint64)
        tree = np.flatnonzero(side == 0)
        forest = Forest(key[tree], fp[tree])

        def hits(step: int = 8192):
            for at in range(0, len(fp), step):  # bounds the walk's front
                part = slice(at, at + step)
                for q, node in forest.search(key[part], fp[part], RADIUS):
                    yield q + at, tree[node]

        root = spanning(len(fp), hits())
        linked = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["a", "b"])


def masks() -> list[int]:
    """For each choice of blocks that a linked pair must share, the mask of their bits."""
    border = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(border, border[1:], strict=False)]
    return [sum(block[i] for i in own) for own in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def in_slices(keyed: DataFrame, columns: list[str], by: str = "fp") -> DataFrame:
    """Rows of shards of two and more: key (a shard and a pair of its slices), side (0: in the tree, 1: asks only), columns."""
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    # only shards of two and more; the slices of a shard come from a hash of by, so they are about equal
    own = keyed.join(sizes, "shard").withColumn("slices", F.ceil(F.col("n") / MOST).cast("int")).withColumn("slice", F.pmod(F.xxhash64(by, F.lit(1)), F.col("slices")).cast("int"))
    # slice i's tree is met by the queries of slices j >= i: one task for each pair (i, j)
    as_tree = F.transform(F.sequence(F.col("slice"), F.col("slices") - 1), lambda j: F.struct(F.col("slice").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_query = F.when(F.col("slice") > 0, F.transform(F.sequence(F.lit(0), F.col("slice") - 1), lambda i: F.struct(i.alias("i"), F.col("slice").alias("j"), F.lit(1).alias("side"))))
    dealt = own.select(*columns, "shard", F.explode(F.concat(as_tree, F.coalesce(as_query, F.array().cast("array<struct<i:int,j:int,side:int>>")))).alias("x"))
    dealt = dealt.select(F.xxhash64("shard", "x.i", "x.j").alias("key"), F.col("x.side").cast("int").alias("side"), *columns)
    return dealt


#: Rows of whole shards that a task compares at once, about, and their bytes: with the slices' bound this bounds what it holds.
HELD, HELD_BYTES = 1 << 15, 64 << 20


def by_key(rows: DataFrame) -> DataFrame:
    """rows with those of a key side by side, in one task."""
    return rows.repartition("key").sortWithinPartitions("key")


def whole_keys(batches):
    """A task's rows, in order of their keys, as batches of whole keys: about HELD rows or HELD_BYTES, or one key's."""
    held: list[pa.RecordBatch] = []
    n, size, wait = 0, 0, 1

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= wait * HELD or size >= wait * HELD_BYTES:
            whole = joined()
            key = np.asarray(whole.column("key"))
            before = np.flatnonzero(key != key[-1])
            cut = int(before[-1]) + 1 if len(before) else 0  # the last key may go on
            if cut:
                yield whole.slice(0, cut)
            held, n, size = [whole.slice(cut)], whole.num_rows - cut, whole.slice(cut).nbytes
            wait = 1 if cut else 2 * wait  # a large key's rows are not joined again and again
    if n:
        yield joined()


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints nodes(fp) as all pairs within RADIUS would."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])).alias("s")).select("fp", F.xxhash64("s.mask", "s.value").alias("shard"))

    def run(batches):
        for whole in whole_keys(batches):
            yield from shard_links([whole])

    return by_key(in_slices(keyed, ["fp"])).mapInArrow(run, "a long, b long")


# Near copies: five-word shingles, shards by min-hashes, an exact similarity at last

COPY_WIDTH = 5
#: Texts are near copies from this similarity on, as a fraction: the Jaccard index of their sets of five-word shingles.
COPY_SHARE = (4, 5)
#: What may keep a pair of similarity 0.8 from its exact comparison: no shared band (one pair in 640), or a fingerprint
#: or a sketch too far off (fewer than one in 1,500, simulated for 6 to 1,000 shingles).
BANDS, BAND_ROWS = 9, 3
COPY_RADIUS = 22
#: Bins of a sketch: the least hash of each bin, as one byte (0: none). Of two texts the share of equal bins among those
#: that either fills estimates their similarity, with a deviation of 0.025 at 0.8 and nearly exactly for short texts.
BINS = 256
COPY_LEAST = 0.7
MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k & (1 << 64) - 1 | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)


def shingle_hashes(raw: bytes) -> np.ndarray:
    """The hashes of a text's lower-cased five-word shingles, repeats included; a shorter text is one shingle."""
    words = raw.lower().split()
    joined = b" ".join(words)
    if len(words) <= COPY_WIDTH:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[COPY_WIDTH - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=False)], np.uint64)


def copy_print(raw: bytes) -> tuple[int, bytes, bytes]:
    """The fingerprint, the min-hashes and the sketch of a text's five-word shingles."""
    hashes = shingle_hashes(raw)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            part = hashes[at : at + 2048, None] * MULTIPLIERS
            part ^= part >> np.uint64(32)
            least = np.minimum(least, (part * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
    ordered = np.sort(hashes)
    place, first = np.unique(ordered >> np.uint64(56), return_index=True)
    sketch = np.zeros(BINS, np.uint8)
    sketch[place.astype(np.int64)] = 1 + (ordered[first] & np.uint64(0xFFFF)) % np.uint64(255)
    return majority(hashes) if raw.strip() else 0, (least >> np.uint64(32)).astype("<u4").tobytes(), sketch.tobytes()


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Are two sets, as sorted arrays, of a similarity of COPY_SHARE or more?"""
    part, whole = COPY_SHARE
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    place = np.searchsorted(a, b)
    place[place == len(a)] = 0
    both = int((a[place] == b).sum())
    return both * whole >= (len(a) + len(b) - both) * part


class WideForest(Forest):
    """A forest for wide radii: the edges to follow from a node are one range of its keys, not looked up one by one."""

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        place = np.searchsorted(self.shards, shard)
        place[place == len(self.shards)] = 0
        here = self.shards[place] == shard if len(self.shards) else np.zeros(len(shard), bool)
        query = np.flatnonzero(here)
        todo = [(query, self.roots[place[query]] if len(query) else query)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONT:
                todo += [(query[k : k + FRONT], node[k : k + FRONT]) for k in range(0, len(query), FRONT)]
                continue
            if not len(query):
                continue
            distance = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), side="right") - low
            child = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            todo.append((np.repeat(query, n), self.nodes[child]))


def candidates(b: pa.RecordBatch, done):
    """Yields (x, y) row arrays of the pairs in a task's shards that may be near copies, each pair in the first band that it shares; done(x, y) marks pairs to pass over."""
    key, side, band, fp = (np.asarray(b.column(c)) for c in ("key", "side", "band", "fp"))
    fp = fp.view(np.uint64)
    bands = np.asarray(b.column("bands").flatten()).reshape(-1, BANDS)
    sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    tree = np.flatnonzero(side == 0)
    forest = WideForest(key[tree], fp[tree])
    asks = np.flatnonzero((side == 1) | ~np.isin(key, key[side == 1]))  # a slice's own pairs are met where it stands alone
    for at in range(0, len(asks), 2048):
        part = asks[at : at + 2048]
        for q, found in forest.search(key[part], fp[part], COPY_RADIUS):
            a, c = part[q], tree[found]
            once = (side[a] == 1) | (a > c)
            a, c = a[once], c[once]
            for k in range(0, len(a), 16384):
                x, y = a[k : k + 16384], c[k : k + 16384]
                new = ~done(x, y)
                x, y = x[new], y[new]
                own = (bands[x] == bands[y]).argmax(axis=1) == band[x]
                x, y = x[own], y[own]
                u, v = sketch[x], sketch[y]
                same = ((u == v) & (u > 0)).sum(axis=1) >= COPY_LEAST * ((u | v) > 0).sum(axis=1)
                if same.any():
                    yield x[same], y[same]


def marked_rows(batches):
    """Of a task's rows those with a candidate: key, side, band, node."""
    for b in whole_keys(batches):
        found = np.zeros(b.num_rows, bool)
        for x, y in candidates(b, lambda x, y, found=found: found[x] & found[y]):
            found[x] = found[y] = True
        yield b.select(["key", "side", "band", "node"]).filter(pa.array(found))


def exact_links(batches):
    """Spanning links (a, b) of a task's near copies."""
    for b in whole_keys(batches):
        yield spanning_links(b)


def spanning_links(b: pa.RecordBatch) -> pa.RecordBatch:
    """Links (a, b) of the near copies of some shards, each pair decided by its sets of shingles unless others connect it."""
    node, text = np.asarray(b.column("node")), b.column("text")
    sets: dict[int, np.ndarray] = {}
    root = np.arange(b.num_rows)

    def own(i: int) -> np.ndarray:
        if node[i] not in sets:
            sets[node[i]] = np.unique(shingle_hashes(text[i].as_py().encode()))
        return sets[node[i]]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, c = [], []
    for xs, ys in candidates(b, lambda x, y: root[x] == root[y]):
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q and near(own(x), own(y)):
                root[max(p, q)] = min(p, q)
                a.append(node[x])
                c.append(node[y])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def copy_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect nodes (node, fp, bands, sketch) as all near copies that share a band would. texts: node, text.

    Two passes over the shards: the first finds the rows that have a candidate;
    only their texts travel to the second, which decides.
    """
    dealt = in_slices(nodes.select("node", F.posexplode("bands").alias("band", "shard")), ["node", "band"], "node")
    # fingerprints and sketches join late: only nodes that share a shard with others need theirs
    marked = by_key(dealt.join(nodes, "node")).mapInArrow(marked_rows, "key long, side int, band int, node long")
    return by_key(marked.join(nodes, "node").join(texts, "node")).mapInArrow(exact_links, "a long, b long")


def spaced(text: Column) -> Column:
    """A text's lower-cased (A-Z) words with one space between them, as in shingles; empty for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[\t\n\x0B\f\r ]+", " "))


def copy_node(text_col: str) -> Column:
    """The node of a text: texts of the same words in the same order share it."""
    return F.xxhash64(spaced(F.col(text_col)))


def copy_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, root, first_id) of every node: nodes of texts of a similarity of 0.8 or more on five-word shingles, directly or through others, have one root.

    Radius 3 on one fingerprint means a similarity of 0.98; a wider radius
    cannot be cut into blocks. So shards are named by bands of min-hashes, trees
    are searched within COPY_RADIUS and sketches compared to pass over pairs
    that are far apart, and what is left is decided by the sets of shingles.
    About one pair in 500 of a similarity of 0.8 is not compared, fewer above.
    """
    from .common import checkpoint

    def f(batch: pa.RecordBatch) -> list:
        prints = [copy_print(raw) for raw in Texts(batch.column(text_col))]
        return [pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64)), pa.array([p[1] for p in prints], pa.binary()), pa.array([p[2] for p in prints], pa.binary())]

    fields = [StructField("fp", LongType()), StructField("mins", BinaryType()), StructField("sketch", BinaryType())]
    named = df.withColumn("node", copy_node(text_col))
    marked = checkpoint(annotate(named, fields, lambda: f, [text_col], [id_col, "node"], text_col))
    nodes = checkpoint(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.min("mins").alias("mins"), F.min("sketch").alias("sketch"), F.min(id_col).alias("first_id")))
    width = 4 * BAND_ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("mins", i * width + 1, width)) for i in range(BANDS)])
    texts = named.groupBy("node").agg(F.min(spaced(F.col(text_col))).alias("text"))
    linked = components(copy_links(nodes.select("node", "fp", bands.alias("bands"), "sketch"), texts))
    rooted = nodes.select("node", "first_id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return marked.select(id_col, "node"), rooted


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: the smallest id among its near copies (copy_components)."""
    marked, rooted = copy_components(df, id_col, text_col)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("node", "component_id"), "node").select(id_col, "component_id")


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies one row: the smallest id, then the smallest hash of the text. An id with texts of several groups stands in each."""
    _, rooted = copy_components(df, id_col, text_col)
    own = "_node"
    while own in {c.lower() for c in df.columns}:
        own += "_"
    kept = rooted.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("k")).select(F.col("k.first_id").alias(id_col), F.col("k.node").alias(own))
    return df.withColumn(own, copy_node(text_col)).join(kept, [id_col, own], "left_semi").dropDuplicates([id_col, own]).select(*[F.col(f"`{c}`") for c in df.columns])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: the id), fingerprint (16 hex digits) and component_id (the smallest id linked, directly or through others)."""
    from .common import checkpoint

    keep = keep or [id_col]
    marked = checkpoint(fingerprints(df, text_col, keep))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = components(links(nodes.select("fp")))
    # a component's id: the smallest id of its fingerprints
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
