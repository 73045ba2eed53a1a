"""SentencePiece encoding and decoding: the best segmentation of whole texts over a piece vocabulary, as a max-plus scan.

A text becomes characters as SentencePiece does: spaces turn into the mark and
one mark is put before the text. Of all ways to cut it into pieces the one with
the largest sum of scores is taken (the unigram model's Viterbi search); a
character that is no piece costs the lowest score less 10 and is written as its
UTF-8 bytes. Sums are exact integers.

No piece goes on over a mark that follows another character, so words between
such places are solved each on its own, and remembered. Ties: in a word of up
to LONG_WORD characters the longest last piece is taken, from the end; in a
longer one the cut whose sum of tie weights (a hash of a piece's place in the
word and its length) is largest. Both depend on the word alone, so ids do not
depend on CHUNK (but for equal sums of 32-bit hashes).

Giant texts are cut into chunks of about CHUNK characters, at a word's start or
within a word of more than LONG_WORD. The state at a chunk's border is how many
characters beyond it the piece across it covers (0 to LONGEST - 1). A chunk
yields its transfer matrix in max-plus algebra (best sum, and of equal ones
best tie weight, from each entry state to each exit state); matrices combine
associatively, first within blocks of FAN chunks, then over a text's blocks; a
backward pass over the small matrices gives every chunk's entry and exit state,
and chunks are then cut into pieces each on its own.

Defined results: a null or empty text has no pieces and score 0. A mark that
stands in a text decodes to a space, as in SentencePiece. Repeated rows, and
rows that share an id, are encoded each. An empty table gives an empty result.
Only id and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .common import Texts, annotate, checkpoint, pieces

MARK = "▁"
CHUNK = 1 << 16
FAN = 64
#: A run of marks and what follows; the first may lack the marks.
WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
NEVER = -(1 << 60)
#: Longer words are solved one by one, not remembered.
LONG_WORD = 48


@dataclass
class Vocabulary:
    """id and score (in millionths, so that sums are exact) of each normal piece; ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, int]
    byte_ids: list[int]
    text_of: list[bytes]
    longest: int
    unknown: int

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        ids, scores, bytes_, text_of = {}, {}, [0] * 256, []
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            text_of.append(piece.replace(MARK, " ").encode())
            if own.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                text_of[-1] = bytes([int(piece[3:5], 16)])
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                text_of[-1] = b""
            else:
                ids[piece], scores[piece] = i, round(own.get_score(i) * 1_000_000)
        return cls(ids, scores, bytes_, text_of, max(map(len, ids)), min(scores.values()) - 10_000_000)


#: Substring hashes: sums of character codes times powers of an odd number, brought to a common power and mixed.
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.uint64(ODD if which == "up" else pow(ODD, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[which] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), step)]))
    return _powers[which][:n]


def running(codes: np.ndarray) -> np.ndarray:
    return np.cumsum((codes + np.uint64(1)) * powers(len(codes), "up"), dtype=np.uint64)


def mixed(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of substrings from their differences of running sums and their first places."""
    h = total * powers(int(at.max()) + 1 if len(at) else 1, "down")[at]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_of(piece: str) -> int:
    codes = np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(mixed(running(codes)[-1:], np.zeros(1, np.int64))[0])


class Solver:
    """Best cuts of character strings; remembers words."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 350_000):
        self.v, self.most, self.known = vocabulary, most_words, {}
        # a tree of characters: each node is its children and its score (None: no piece ends here)
        nested: dict = {}
        for piece, score in vocabulary.scores.items():
            at = nested
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        frozen = lambda node: ({c: frozen(x) for c, x in node.items() if c}, node.get(""))
        self.tree = frozen(nested)[0]
        self.score_of = np.zeros(len(vocabulary.text_of), np.int64)
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for piece, i in vocabulary.ids.items():
            self.score_of[i] = vocabulary.scores[piece]
            by_length.setdefault(len(piece), []).append((hash_of(piece), i, vocabulary.scores[piece]))
        self.is_byte, self.byte_of = np.zeros(len(self.score_of), bool), np.zeros(len(self.score_of), np.uint8)
        self.is_byte[vocabulary.byte_ids] = True
        self.byte_of[vocabulary.byte_ids] = np.arange(256)
        # for each length: sorted hashes of its pieces, their ids and scores, and a bit for each beginning of a hash
        self.pieces = {}
        for n, rows in by_length.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            if len(set(hashes.tolist())) != len(rows):
                raise ValueError("two pieces share a hash")
            there = np.zeros(1 << 18, bool)
            there[(hashes >> np.uint64(46)).astype(np.int64)] = True
            self.pieces[n] = hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), there

    def learn(self, words: list[str]) -> None:
        """Solves many words at once: all substrings are looked up by rolling hashes, and sums grow from place to place over all words."""
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        for at in range(0, len(words), 20_000):
            self.solve(words[at : at + 20_000])

    def solve(self, words: list[str]) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        start = end - size
        n = len(codes)
        left = np.repeat(end, size) - np.arange(n)  # characters to the word's end
        inside = np.arange(n) - np.repeat(start, size)
        # places: word w has size + 1 of them, from start[w] + w on
        node = np.arange(n) + np.repeat(np.arange(len(words)), size)
        total = n + len(words)
        best, back, which = np.full(total, NEVER, np.int64), np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        best[start + np.arange(len(words))] = 0
        with np.errstate(over="ignore"):
            rolled = np.concatenate([np.zeros(1, np.uint64), running(codes)])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
            single = np.zeros(n, bool)
            for length in sorted(self.pieces, reverse=True):
                hashes, ids, scores, there = self.pieces[length]
                at = np.flatnonzero(left >= length)
                h = mixed(rolled[at + length] - rolled[at], at)
                at, h = (x[there[(h >> np.uint64(46)).astype(np.int64)]] for x in (at, h)) if len(at) else (at, h)
                k = np.searchsorted(hashes, h)
                k[k == len(hashes)] = 0
                hit = hashes[k] == h
                at, k = at[hit], k[hit]
                if length == 1:
                    single[at] = True
                found.append((at, ids[k], scores[k], inside[at] + length, length))
        alone = np.flatnonzero(~single)
        found.append((alone, np.full(len(alone), -1), np.full(len(alone), self.v.unknown), inside[alone] + 1, 1))
        ordered = []
        for at, ids, scores, stop, length in found:
            order = np.argsort(stop, kind="stable")
            ordered.append((at[order], ids[order], scores[order], np.searchsorted(stop[order], np.arange(int(size.max()) + 2)), length))
        for e in range(1, int(size.max()) + 1):
            for at, ids, scores, border, length in ordered:
                a, b = border[e], border[e + 1]
                if a == b:
                    continue
                frm = node[at[a:b]]
                to = frm + length
                value = best[frm] + scores[a:b]
                better = value > best[to]
                to = to[better]
                best[to], back[to], which[to] = value[better], frm[better], ids[a:b][better]
        # backwards, a piece a step for all words
        now = end + np.arange(len(words))
        first = start + np.arange(len(words))
        steps, owners = [], []
        active = np.arange(len(words))
        while len(active):
            steps.append(np.stack([which[now[active]], back[now[active]]]))
            owners.append(active)
            now[active] = back[now[active]]
            active = active[now[active] > first[active]]
        owner, step = np.concatenate(owners), np.concatenate([np.full(len(o), k) for k, o in enumerate(owners)])
        found_ids, places = np.concatenate(steps, axis=1)
        order = np.lexsort((-step, owner))
        owner, ids, places = owner[order], found_ids[order], places[order]
        raw = ids.astype("<u4").tobytes()
        border = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        odd = set(owner[ids < 0].tolist())
        for w, (word, a, b) in enumerate(zip(words, border[:-1].tolist(), border[1:].tolist(), strict=True)):
            self.known[word] = raw[a:b] if w not in odd else self.slow(word)

    def forward(self, text: str, begin: int, end: int, beyond: int = 0, since: int = 0) -> tuple[list[int], list[int], list[int]]:
        """Within a word: best sums from begin to each place up to end + beyond over cuts before end, their tie weights, and the last piece's start for each.

        since: how far the word's start lies before begin.
        """
        n = end - begin
        best, ties, back = [NEVER] * (n + beyond + 1), [0] * (n + beyond + 1), [-1] * (n + beyond + 1)
        best[0] = 0
        tree, unknown, longest = self.tree, self.v.unknown, self.v.longest
        own = text[begin : end + beyond]
        for i in range(n):
            base = best[i]
            if base == NEVER:
                continue
            children, k, tie, place = tree, i, ties[i], (since + i) << 8
            single = False
            for c in own[i : i + longest]:
                node = children.get(c)
                if node is None:
                    break
                k += 1
                children, score = node
                if score is not None:
                    if k == i + 1:
                        single = True
                    score += base
                    if score >= best[k]:
                        weight = tie + (((place + k - i) * ODD & MASK) >> 32)
                        if score > best[k] or weight > ties[k]:
                            best[k], ties[k], back[k] = score, weight, i
            if not single and base + unknown >= best[i + 1]:
                weight = tie + (((place + 1) * ODD & MASK) >> 32)
                if base + unknown > best[i + 1] or weight > ties[i + 1]:
                    best[i + 1], ties[i + 1], back[i + 1] = base + unknown, weight, i
        return best, ties, back

    def ids_of(self, text: str, begin: int, back: list[int], at: int) -> bytes:
        out = []
        while at > 0:
            i = back[at]
            piece = text[begin + i : begin + at]
            code = self.v.ids.get(piece)
            if code is not None:
                out.append(code)
            else:
                out += [self.v.byte_ids[b] for b in reversed(piece.encode())]
            at = i
        out.reverse()
        return array("I", out).tobytes()

    def slow(self, word: str) -> bytes:
        back = self.forward(word, 0, len(word))[2]
        return self.ids_of(word, 0, back, len(word))

    def many(self, marked: list[str]) -> list[bytes]:
        """The ids of whole texts; their words are looked up or learned together."""
        cut = [WORD.findall(t) if MARK + MARK in t or t[:1] != MARK else [MARK + w for w in t[1:].split(MARK)] if t else [] for t in marked]
        new = set().union(*cut) - self.known.keys()
        long = {w for w in new if len(w) > LONG_WORD}
        own = {w: self.slow(w) for w in long}
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*cut)
        self.learn(list(new - long))
        get = (self.known | own).__getitem__ if own else self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def whole(self, marked: str) -> tuple[int, bytes]:
        ids = self.many([marked])[0] if marked else b""
        return self.score(ids, marked), ids

    def score(self, ids: bytes, marked: str) -> int:
        """The sum of scores of ids; a character written as bytes counts once."""
        own = np.frombuffer(ids, "<u4")
        total = int(self.score_of[own].sum())
        spelled = own[self.is_byte[own]]
        if len(spelled):  # UTF-8's first bytes are those that do not continue a character
            total += self.v.unknown * int(((self.byte_of[spelled] & 0xC0) != 0x80).sum())
        return total

    def chunks(self, marked: str, chunk: int) -> list[tuple[int, int, int, bool]]:
        """Of each chunk of a text: where it begins and ends, how far the word at its beginning has gone, and whether a word goes on over its end."""
        starts = np.array([0, *(m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", marked))])
        stops = np.append(starts[1:], len(marked))
        borders = [(0, 0)]
        for b in range(chunk, len(marked), chunk):
            w = int(np.searchsorted(starts, b, side="right")) - 1
            at = b if stops[w] - starts[w] > LONG_WORD else int(starts[w])
            if at > borders[-1][0]:
                borders.append((at, at - int(starts[w])))
        ends = [*borders[1:], (len(marked), 0)]
        return [(a, b, since, on > 0) for (a, since), (b, on) in zip(borders, ends, strict=True)]

    def parts(self, text: str, size: int, since: int, on: bool) -> tuple[int, int]:
        """Where a chunk's first whole word begins, and where the word begins that goes on over its end (size: none)."""
        starts = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text[:size])]
        first = 0 if not since else starts[0] if starts else size
        return first, (starts[-1] if starts else 0 if not since else size) if on else size

    def matrix(self, text: str, size: int, since: int, on: bool) -> np.ndarray:
        """Best sums, and their tie weights, from each entry to each exit state. text: the chunk's size characters and up to longest - 1 beyond."""
        s, states = self.v.longest, range(self.v.longest)
        out = np.stack([np.full((s, s), NEVER, np.int64), np.zeros((s, s), np.int64)])
        first, last = self.parts(text, size, since, on)
        if since and first == size:  # inside one word
            for k in states:
                if k <= size:
                    best, ties, _ = self.forward(text, k, size, s - 1 if on else 0, since + k)
                    out[0, k, : len(best) - size + k], out[1, k, : len(best) - size + k] = best[size - k :], ties[size - k :]
                else:
                    out[0, k, k - size] = 0
        else:
            middle = self.whole(text[first:last])[0] if last > first else 0
            ways_out = self.forward(text, last, size, s - 1) if on else ([0], [0], [])
            best, ties = (np.array(x[size - last :] if on else x) for x in ways_out[:2])
            for k in states if since else (0,):
                if k <= first:
                    into = self.forward(text, k, first, 0, since + k)
                    if into[0][-1] > NEVER // 2:
                        out[0, k, : len(best)], out[1, k, : len(best)] = into[0][-1] + middle + best, into[1][-1] + ties
        out[0][out[0] < NEVER // 2] = NEVER
        out[1][out[0] == NEVER] = 0
        return out

    def between(self, text: str, size: int, since: int, on: bool, entry: int, leave: int) -> bytes:
        """The ids of the pieces that begin in a chunk, given its states."""
        first, last = self.parts(text, size, since, on)
        if entry > size or (entry == size and leave == 0):
            return b""
        if since and first == size:
            back = self.forward(text, entry, size, leave, since + entry)[2]
            return self.ids_of(text, entry, back, size + leave - entry)
        head = self.ids_of(text, entry, self.forward(text, entry, first, 0, since + entry)[2], first - entry) if first > entry else b""
        middle = self.whole(text[first:last])[1] if last > first else b""
        tail = self.ids_of(text, last, self.forward(text, last, size, leave)[2], size + leave - last) if on else b""
        return head + middle + tail


def best_of(sums: np.ndarray, ties: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Along axis the largest sums, and of equal ones the largest tie weight."""
    top = sums.max(axis=axis, keepdims=True)
    return np.maximum(top.squeeze(axis), NEVER), np.where(sums == top, ties, -1).max(axis=axis)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: first a, then b."""
    return np.stack(best_of(a[0][:, :, None] + b[0][None], a[1][:, :, None] + b[1][None], 1))


def walk(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of each part on the best way from entry to leave."""
    ways = [matrices[0][:, entry]]
    for m in matrices[1:]:
        ways.append(np.stack(best_of(ways[-1][0][:, None] + m[0], ways[-1][1][:, None] + m[1], 0)))
    out, state = [], leave
    for i in range(len(matrices) - 1, -1, -1):
        if i == 0:
            before = entry
        else:
            sums = ways[i - 1][0] + matrices[i][0][:, state]
            before = int(np.where(sums == sums.max(), ways[i - 1][1] + matrices[i][1][:, state], -1).argmax())
        out.append((before, state))
        state = before
    return out[::-1]


def square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, np.int64)
    return m.reshape(2, round((len(m) / 2) ** 0.5), -1)


_solvers: dict = {}


def solver(path: str | None) -> Solver:
    if path not in _solvers:
        _solvers[path] = Solver(Vocabulary.load(path))
    return _solvers[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """id, ids (token ids as little-endian unsigned 32-bit bytes) and score (in millionths) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))
    is_giant = F.coalesce(F.length("text") >= chunk, F.lit(False))  # with the mark before it, more than a chunk

    def start_small():
        own = solver(path)

        def f(b: pa.RecordBatch) -> list:
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in Texts(b.column("text")).strings()]
            ids = own.many(marked)
            return [pa.array(ids, pa.binary()), pa.array([own.score(i, m) for i, m in zip(ids, marked, strict=True)], pa.int64())]

        return f

    small = annotate(source.where(~is_giant), [StructField("ids", BinaryType()), StructField("score", LongType())], start_small, ["text"], [id_col])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, n = solver(path), TaskContext.get().partitionId(), 0
        beyond = own.v.longest - 1
        for whole in batches:
            for b in pieces(whole, "text"):
                rows, at = [], []
                for i, text in enumerate(Texts(b.column("text")).strings()):
                    marked = MARK + text.replace(" ", MARK)
                    cut = own.chunks(marked, chunk)
                    for c, (begin, stop, since, on) in enumerate(cut):
                        piece = marked[begin : stop + beyond]
                        rows.append(((part << 40) + n, c, stop - begin, since, on, piece, own.matrix(piece, stop - begin, since, on).tobytes()))
                        at.append(i)
                    n += 1
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), *columns], [id_col, "row", "chunk", "size", "since", "on", "text", "matrix"])

    # the chunks of giant texts are written once: their rows' numbers must not change
    giant = checkpoint(source.where(is_giant).mapInArrow(cut, f"`{id_col}` {kind}, row long, chunk int, size int, since long, on boolean, text string, matrix binary")).withColumn("block", F.floor(F.col("chunk") / FAN).cast("int"))

    def block_matrix(pdf):
        pdf = pdf.sort_values("chunk")
        m = None
        for raw in pdf["matrix"]:
            m = square(raw) if m is None else combine(m, square(raw))
        return pdf.iloc[:1][["row", "block"]].assign(matrix=m.tobytes())

    def block_states(pdf):
        pdf = pdf.sort_values("block")
        ms = [square(raw) for raw in pdf["matrix"]]
        states = walk(ms, 0, 0)
        total = ms[0]
        for m in ms[1:]:
            total = combine(total[:, :1], m)
        return pdf[["row", "block"]].assign(entry=[s[0] for s in states], leave=[s[1] for s in states], score=int(total[0, 0, 0]))

    def chunk_states(pdf):
        pdf = pdf.sort_values("chunk")
        states = walk([square(raw) for raw in pdf["matrix"]], int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pdf[["row", "chunk", "score"]].assign(entry=[s[0] for s in states], leave=[s[1] for s in states])

    matrices = giant.select("row", "block", "chunk", "matrix")
    blocks = matrices.groupBy("row", "block").applyInPandas(block_matrix, "row long, block int, matrix binary")
    entered = blocks.groupBy("row").applyInPandas(block_states, "row long, block int, entry int, leave int, score long")
    states = matrices.join(entered, ["row", "block"]).groupBy("row", "block").applyInPandas(chunk_states, "row long, chunk int, score long, entry int, leave int")

    def start():
        own = solver(path)

        def f(b: pa.RecordBatch) -> list:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in ("text", "size", "since", "on", "entry", "leave")), strict=True):
                out.append(own.between(*row))
            return [pa.array(out, pa.binary())]

        return f

    solved = annotate(giant.drop("matrix", "block").join(states, ["row", "chunk"]), [StructField("ids", BinaryType())], start, ["text", "size", "since", "on", "entry", "leave"], [id_col, "row", "chunk", "score"])

    def join_ids(pdf):
        pdf = pdf.sort_values("chunk")
        return pdf.iloc[:1][[id_col, "score"]].assign(ids=b"".join(pdf["ids"]))[[id_col, "ids", "score"]]

    return small.unionByName(solved.groupBy("row").applyInPandas(join_ids, f"`{id_col}` {kind}, ids binary, score long"))


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df) and the text of the ids; bytes that are no UTF-8 become U+FFFD."""

    def start():
        table = solver(path).v.text_of

        def f(b: pa.RecordBatch) -> list:
            texts = []
            for raw in b.column(ids_col):
                joined = b"".join([table[i] for i in np.frombuffer(raw.as_py() or b"", "<u4").tolist()])
                texts.append(joined[joined[:1] == b" " :].decode("utf-8", "replace"))
            return [pa.array(texts, pa.string())]

        return f

    return annotate(df, [StructField(out, StringType())], start, [ids_col], df.columns if keep is None else keep, ids_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_pieces, ids_crc32, score, and the number and crc32 of the decoded text's characters and bytes."""
    decoded = decode(encode(docs, id_col, text_col, path), path=path)
    return decoded.select(id_col, (F.length("ids") / 4).cast(LongType()).alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), (F.col("score") / 1e6).alias("score"), F.length("decoded").cast("long").alias("n_decoded"), F.crc32("decoded").alias("decoded_crc32"))
