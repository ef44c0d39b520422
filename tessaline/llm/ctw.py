"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

A text is coded as its lower-cased words, each as its bytes and a space, and one end. The context of a byte
is the DEPTH bytes before it in the text, whatever words they belong to (before a text lie ends); a byte is
eight binary decisions. Every node (context of a depth, decisions so far) has the counts of what followed
it in the training texts, its Krichevsky-Trofimov block probability Pe and the weighted probability

    Pw = Pe at the greatest depth, 1/2 Pe + 1/2 product of the children's Pw above it.

The probability of a decision mixes the KT estimates of all depths of its context: at each depth the share
1/2 Pe / Pw of what is left stays there. Where a context was never seen in training, all that is left
goes to the deepest one that was.

A gram is a context and the byte after it. Chunks of texts count their distinct grams (and words, for the unigrams)
in numpy; packed sorted arrays of them are dealt by key to tasks that add up the counts of all chunks. Contexts of up
to FIRST bytes are aggregated and joined by Spark level by level; the levels below are worked out in numpy for whole
subtrees, of 2**24 grams each at most. The scores of grams go back to the chunks that have them, which read their
texts again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

#: Bytes of context at most, and those at which a subtree is handed to one task.
DEPTH, FIRST = 6, 4
#: Text bytes of a chunk, those whose grams are sorted or looked up at once, grams of a task.
CHUNK_BYTES, SORT_BYTES, LOOK_BYTES, TASK_GRAMS = 48 << 20, 4 << 20, 1 << 20, 400_000
#: Sorted pieces that are merged at once, text bytes that are coded at once, keys that are added up or looked up at once.
MERGED, CODE_BYTES, AT_ONCE = 4, 1 << 20, 1 << 18
#: Bytes of an Arrow batch of a chunk's rows on their way to Python, and of a row group of packed rows.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 8 << 20
SPACE, END = 32, 10
LN2 = math.log(2)
U = np.uint64


# --- the tree, in numpy -----------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series at x + 8."""
    y, p = x + 8, x.copy()
    for i in range(1, 8):
        p = p * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def shorter(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the contexts one byte shorter; keys: contexts, the latest byte highest, then eight bits of the next byte."""
    parent = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
    keys, back = np.unique(parent, return_inverse=True)
    return keys, np.bincount(back, n, len(keys))


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of the levels `depth` to `first` of whole subtrees."""
    levels = [(keys, n)]
    for _ in range(depth - first):
        levels.append(shorter(*levels[-1]))
    return levels


def nodes(levels: list[tuple[np.ndarray, np.ndarray]], b: int) -> list[dict[str, np.ndarray]]:
    """The nodes of each level after b decisions. Those of one b need none of another, so that one b at a time is in memory."""
    out = []
    for keys, n in levels:
        node = keys >> np.uint64(8 - b)
        one = (keys >> np.uint64(7 - b)) & np.uint64(1)
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        n1 = np.add.reduceat(n * one, start)
        n0 = np.add.reduceat(n, start) - n1
        pe, ids = log_block(n0, n1), node[start]
        if not out:
            pw, stay = pe, np.ones(len(ids))
        else:
            deep = out[-1]
            parent = ((deep["ids"] >> np.uint64(8 + b)) << np.uint64(b)) | (deep["ids"] & np.uint64((1 << b) - 1))
            pw = np.logaddexp(pe, np.bincount(np.searchsorted(ids, parent), deep["pw"], len(ids))) - LN2
            stay = np.exp(pe - LN2 - pw)
        out.append({"ids": ids, "n0": n0, "n1": n1, "pw": pw, "stay": stay, "kt": (n1 + 0.5) / (n0 + n1 + 1)})
    return out


def node_names(ids: np.ndarray, b: int) -> np.ndarray:
    """The nodes after b decisions as contexts, a one and the decisions: as Spark has them."""
    context, bits = ids >> np.uint64(b), ids & np.uint64((1 << b) - 1)
    return (context << np.uint64(8)) | np.uint64(1 << b) | bits


def log10_bytes(levels: list[tuple[np.ndarray, np.ndarray]], above: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 probability of the byte of each of the first level's keys in its context.

    above: for names of nodes of the last level what the shallower depths give: the sum so far, the share left,
    the estimate of the deepest seen.
    """
    keys = levels[0][0]
    out = np.zeros(len(keys))
    for b in range(8):
        one = (keys >> np.uint64(7 - b)) & np.uint64(1)
        found = nodes(levels, b)
        given = above(node_names(found[-1]["ids"], b))
        for i in range(len(levels) - 1, -1, -1):
            x = found[i]
            # a key's node at a depth i bytes shorter: its context without the i oldest bytes, and b decisions
            node = ((keys >> np.uint64(8 + 8 * i)) << np.uint64(b)) | ((keys & np.uint64(255)) >> np.uint64(8 - b))
            at = np.searchsorted(x["ids"], node)
            if i == len(levels) - 1:
                so_far, left, kt = (c[at] for c in given)
            seen = x["n0"][at] + x["n1"][at] > 0
            share = np.where(seen, left * x["stay"][at], 0)
            kt = np.where(seen, x["kt"][at], kt)
            so_far, left = so_far + share * kt, left - share
        p = so_far + left * kt
        out += np.log10(np.where(one == 1, p, 1 - p))
    return out


def coded(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of a batch's texts end to end, and the n + 1 offsets of the texts in them."""
    done, start = [], 0
    for piece in common.slices(batch, text, CODE_BYTES):
        data, at = _coded(piece.column(text))
        done.append((data, at[:-1] + start))
        start += int(at[-1])
    return np.concatenate([d[0] for d in done]), np.concatenate([*(d[1] for d in done), [start]])


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = (data == SPACE) | ((data >= 9) & (data <= 13))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    begin = at[:-1][np.diff(at) > 0]
    keep[begin] = ~blank[begin]
    ends = np.concatenate([[0], np.cumsum(keep)])[at]
    size = np.diff(ends)
    out = np.where(blank, np.uint8(SPACE), data)[keep]
    open_ = np.flatnonzero((size > 0) & (out[np.maximum(ends[1:] - 1, 0)] != SPACE if len(out) else False))
    extra = np.ones(n, np.int64)
    extra[open_] = 2
    ends = np.concatenate([[0], np.cumsum(size + extra)])
    whole = np.full(ends[-1], END, np.uint8)
    row = np.repeat(np.cumsum(extra) - extra, size)
    whole[np.arange(len(out)) + row] = out
    whole[ends[1:][open_] - 2] = SPACE
    return whole, ends


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The gram of each coded byte: the bytes before it, the latest highest, then the byte."""
    size = np.diff(at)
    inside = np.repeat(np.tile([False, True], len(size)), np.stack([np.full(len(size), depth), size], axis=1).ravel())
    padded = np.full(len(inside), END, np.uint8)
    padded[inside] = data
    key = np.zeros(max(len(padded) - depth, 0), U)
    for k in [*range(1, depth + 1), 0]:
        key <<= U(8)
        key |= padded[depth - k : len(padded) - k]
    return key[inside[depth:]]


def tokens(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens of coded bytes (words with their space, ends), and the number of each token's."""
    ends = np.flatnonzero((data == SPACE) | (data == END)) + 1
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)])
    found = pieces.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def token_keys(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), U, len(distinct)) >> U(1)


# --- the same at shallow depths, in Spark ------------------------------------------------------------------------


def _log_gamma(x: Column) -> Column:
    y, p = x + 8, x
    for i in range(1, 8):
        p = p * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(p)


def _weighted(nodes: DataFrame) -> DataFrame:
    """Adds pw, stay and kt to rows (node, n0, n1, deep): deep is the sum of the children's pw."""
    n0, n1 = F.col("n0"), F.col("n1")
    out = nodes.withColumn("pe", _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi))
    high, low = F.greatest("pe", "deep"), F.least("pe", "deep")
    out = out.withColumn("pw", high + F.log1p(F.exp(low - high)) - LN2)
    return out.withColumns({"stay": F.exp(F.col("pe") - LN2 - F.col("pw")), "kt": (n1 + 0.5) / (n0 + n1 + 1)}).drop("pe", "deep")


def _passed(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """Rows (node, so_far, left_, kt): the mixture down to this depth."""
    if above is None:
        rows = nodes.select("node", "n0", "n1", "stay", F.col("kt").alias("own"), F.lit(0.0).alias("s"), F.lit(1.0).alias("l"), F.lit(0.5).alias("k"))
    else:
        up = above.select(F.col("node").alias("parent"), F.col("so_far").alias("s"), F.col("left_").alias("l"), F.col("kt").alias("k"))
        rows = nodes.withColumn("parent", _parent(F.col("node"))).withColumnRenamed("kt", "own").join(up, "parent")
    seen = F.col("n0") + F.col("n1") > 0
    share = F.when(seen, F.col("l") * F.col("stay")).otherwise(0.0)
    kt = F.when(seen, F.col("own")).otherwise(F.col("k"))
    return rows.select("node", (F.col("s") + share * kt).alias("so_far"), (F.col("l") - share).alias("left_"), kt.alias("kt"))


def _parent(node: Column) -> Column:
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def gram_scores(counts: DataFrame, depth: int = DEPTH, first: int = FIRST, task_grams: int = TASK_GRAMS) -> DataFrame:
    """Rows (gram, logp) of rows (gram, n): log10 probability of the gram's byte in its context."""
    parts = max(1, -(-counts.count() // task_grams))
    # The context of `first` bytes, the latest highest, names the subtree; a subtree lies in one part.
    part = F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8 * (depth - first) + 8)), F.lit(parts))
    counts = counts.withColumn("part", part)

    def tops(table: pa.Table) -> pa.Table:
        keys, n = _sorted(table)
        ids, values = [], []
        levels = subtree(keys, n, depth, first)
        for b in range(8):
            x = nodes(levels, b)[-1]
            ids.append(node_names(x["ids"], b))
            values.append((x["n0"], x["n1"], x["pw"]))
        n0, n1, pw = (np.concatenate(v) for v in zip(*values))
        return pa.table({"node": np.concatenate(ids).view(np.int64), "n0": n0, "n1": n1, "pw": pw})

    top = common.written(counts.groupBy("part").applyInArrow(tops, "node long, n0 double, n1 double, pw double"), "ctw-top")
    levels, deep = [], top
    for d in range(first - 1, -1, -1):
        deep = deep.groupBy(_parent(F.col("node")).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("deep"))
        deep = common.written(_weighted(deep), f"ctw-level{d}")
        levels.append(deep)
    state = None
    for level in reversed(levels):
        state = _passed(level, state)
    up = state.select(F.col("node").alias("parent"), "so_far", "left_", "kt")
    above = top.select("node", _parent(F.col("node")).alias("parent")).join(up, "parent").drop("parent")
    above = above.withColumn("part", F.pmod(F.xxhash64(F.shiftright("node", 8)), F.lit(parts)))

    def bottom(table: pa.Table, above: pa.Table) -> pa.Table:
        keys, n = _sorted(table)
        node, *state = (above.column(c).to_numpy() for c in ("node", "so_far", "left_", "kt"))
        order = np.argsort(node)
        node = node[order].view(np.uint64)

        def given(names: np.ndarray) -> tuple[np.ndarray, ...]:
            at = order[np.searchsorted(node, names)]
            return tuple(s[at] for s in state)

        return pa.table({"gram": keys.view(np.int64), "logp": log10_bytes(subtree(keys, n, depth, first), given)})

    scores = counts.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(bottom, "gram long, logp double")
    scores = common.written(scores, "ctw-scores")
    common.discard(top, *levels)
    return scores


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


# --- chunks ------------------------------------------------------------------------------------------------------

#: kind: TEXTS (keys: a compressed batch of ids, folds and coded texts), GRAMS or WORDS (packed keys and their values).
TEXTS, GRAMS, WORDS = range(3)
PACKED = "chunk long, part long, kind int, keys binary, counts binary"


def _pack(x: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences."""
    return zlib.compress(_planes(np.diff(x, prepend=U(0))), 1)


def _unpack(raw: pa.BinaryScalar) -> np.ndarray:
    return np.cumsum(_from_planes(zlib.decompress(raw.as_buffer()), U), dtype=U)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all 64-bit values, then the second ones and so on: they compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes | pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total counts, and for each key its place among them."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, counts, len(distinct)).astype(np.int64), back


def _counted(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Distinct keys with the count of those not held, 255 at most, as their low byte; and what exceeds it, as pairs."""
    keys <<= U(1)
    keys |= held
    keys.sort()
    start = np.flatnonzero(np.r_[True, (keys[1:] ^ keys[:-1]) > U(1)]) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat((_low(keys) & 1) == 0, start, dtype=np.uint32) if len(keys) else start.astype(np.uint32)
    return _capped(keys[start] >> U(1), n)


def _low(keys: np.ndarray) -> np.ndarray:
    """The low bytes."""
    return keys.view(np.uint8)[::8]


def _capped(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_counted` gives them; gram becomes the keys."""
    at = np.flatnonzero(n > 255)
    over, more = gram[at], n[at].astype(np.int64) - 255
    gram <<= U(8)
    gram |= np.minimum(n, 255).astype(np.uint8)
    return gram, over, more


def _uncapped(packed: np.ndarray, over: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts of sorted keys that may repeat a gram; packed is used up."""
    start = np.flatnonzero(np.r_[True, (packed[1:] ^ packed[:-1]) > U(255)]) if len(packed) else np.zeros(0, np.int64)
    n = np.add.reduceat(_low(packed), start, dtype=np.uint32) if len(packed) else start.astype(np.uint32)
    gram = packed[start]
    gram >>= U(8)
    n[np.searchsorted(gram, over)] += more.astype(np.uint32)
    return gram, n


def _merged(counted: list[tuple]) -> list[tuple]:
    """Several results of `_counted` as one; counts lie in the keys, so that a plain sort brings equal grams together."""
    packed = np.concatenate([c[0] for c in counted])
    over, more, _ = _added_up(*(np.concatenate([c[k] for c in counted]) for k in (1, 2)))
    counted.clear()
    packed.sort()
    return [_capped(*_uncapped(packed, over, more))]


class Chunk:
    """The distinct grams and words of some texts with their counts in training texts."""

    def __init__(self, number: int, parts: int, depth: int) -> None:
        self.number, self.parts, self.depth, self.size = number, parts, depth, 0
        self.grams, self.words = [], []

    def add(self, data: np.ndarray, at: np.ndarray, held: np.ndarray) -> None:
        self.size += len(data)
        size = np.diff(at)
        first = 0
        while first < len(held):  # whole texts of about SORT_BYTES
            last = max(first + 1, int(np.searchsorted(at, at[first] + SORT_BYTES, side="right")) - 1)
            piece, offsets = data[at[first] : at[last]], at[first : last + 1] - at[first]
            self.grams.append(_counted(grams(piece, offsets, self.depth), np.repeat(held[first:last], size[first:last])))
            first = last
            if len(self.grams) == MERGED:
                self.grams = _merged(self.grams)
        distinct, code = tokens(data)
        owner = np.repeat(held, np.add.reduceat((data == SPACE) | (data == END), at[:-1], dtype=np.int64))
        self.words.append((token_keys(distinct), np.bincount(code, ~owner, len(distinct))))

    def _parts(self, kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        part = part_of(keys, self.parts)
        cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=self.parts))])
        order = np.argsort(part, kind="stable").astype(np.int32)  # keys stay sorted within a part
        del part
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                yield self.number, p, kind, _pack(keys[order[a:b]]), zlib.compress(counts[order[a:b]].astype("<u4").tobytes(), 1)

    def rows(self) -> Iterator[tuple]:
        """Rows PACKED of the counts."""
        (found,) = _merged(self.grams)
        yield from self._parts(GRAMS, *_uncapped(*found))
        del found
        keys, n, _ = _added_up(*(np.concatenate(x) for x in zip(*self.words)))
        yield from self._parts(WORDS, keys, n)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    kind = np.uint16 if parts <= 1 << 16 else np.int64
    return np.concatenate([np.zeros(0, kind), *(((k ^ (k >> U(13)) ^ (k >> U(29))) % U(parts)).astype(kind) for k in (keys[a : a + AT_ONCE] for a in range(0, len(keys), AT_ONCE)))])


def chunked(rows: DataFrame, parts: int, depth: int, chunk_bytes: int) -> DataFrame:
    """Rows PACKED of (id, held, text)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["chunk", "part", "kind", "keys", "counts"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        chunk = Chunk(first, parts, depth)
        for batch in batches:
            for piece in common.slices(batch, "text"):
                data, at = coded(piece, "text")
                held = piece.column("held").to_numpy(zero_copy_only=False).astype(bool)
                chunk.add(data, at, held)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(at), pa.py_buffer(data)])
                yield out([(chunk.number, 0, TEXTS, _written(pa.record_batch([piece.column("id"), piece.column("held"), texts], names=["id", "held", "text"])), b"")])
                if chunk.size >= chunk_bytes:
                    for row in chunk.rows():
                        yield out([row])
                    chunk = Chunk(chunk.number + 1, parts, depth)
        if chunk.size:
            for row in chunk.rows():
                yield out([row])
        del chunk
        common.trim()

    return rows.mapInArrow(run, PACKED)


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Lookup:
    """Values of distinct keys, found for many keys at once: open addressing in numpy, 1.5 slots a key that hold its place."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.keys, self.values, self.slots = keys, values, len(keys) + len(keys) // 2 + 16
        self.place = np.full(self.slots, -1, np.int32)
        for first in range(0, len(keys), AT_ONCE):
            rest = np.arange(first, min(first + AT_ONCE, len(keys)), dtype=np.int32)
            at = self._home(keys[rest])
            while len(rest):
                free = self.place[at] < 0
                self.place[at[free]] = rest[free]
                left = self.place[at] != rest
                rest, at = rest[left], self._next(at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((((keys * U(0x9E3779B97F4A7C15)) >> U(32)) * U(self.slots)) >> U(32)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return np.where(at + 1 < self.slots, at + 1, 0)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        place = self.place[at]
        rest = np.flatnonzero(self.keys[place] != keys)
        while len(rest):
            at[rest] = self._next(at[rest])
            place[rest] = self.place[at[rest]]
            rest = rest[self.keys[place[rest]] != keys[rest]]
        return place

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of keys, all of which must be there."""
        out = [np.empty(len(keys), v.dtype) for v in self.values]
        for first in range(0, len(keys), AT_ONCE):
            place = self._places(keys[first : first + AT_ONCE])
            for o, v in zip(out, self.values):
                o[first : first + AT_ONCE] = v[place]
        return out


def word_counts(packed: DataFrame) -> DataFrame:
    """Rows PACKED of the words: counts of all chunks instead of their own; and for each part its totals, as chunk -1."""

    def add(table: pa.Table) -> pa.Table:
        keys = [_unpack(k) for k in table.column("keys")]
        own = np.concatenate([np.frombuffer(zlib.decompress(c.as_buffer()), "<u4") for c in table.column("counts")])
        _, total, back = _added_up(np.concatenate(keys), own)
        ends = np.cumsum([len(k) for k in keys])
        counts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(total[back], ends[:-1])]
        out = pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "kind": table.column("kind"), "keys": table.column("keys"), "counts": pa.array(counts, pa.binary())})
        sums = np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()
        part = table.column("part")[0].as_py()
        return pa.concat_tables([out, pa.table([pa.array([-1]), pa.array([part]), pa.array([WORDS], pa.int32()), pa.array([b""], pa.binary()), pa.array([sums], pa.binary())], schema=out.schema)])

    return packed.where(F.col("kind") == WORDS).groupBy("part").applyInArrow(add, PACKED)


def _ranges(keys: list[np.ndarray]) -> Iterator[tuple[list[int], list[int]]]:
    """Where each of some sorted arrays begins and ends in ranges of keys with some AT_ONCE of them; equal keys are in one range."""
    most = max(keys, key=len)
    at = np.arange(1, sum(map(len, keys)) // AT_ONCE + 1) * len(most) // (sum(map(len, keys)) // AT_ONCE + 1)
    a = [0] * len(keys)
    for cut in np.unique(most[at]):
        b = [int(np.searchsorted(k, cut)) for k in keys]
        yield a, b
        a = b
    yield a, [len(k) for k in keys]


def gram_counts(packed: DataFrame) -> DataFrame:
    """Rows (gram, n): the counts of all chunks."""

    def add(table: pa.Table) -> pa.Table:
        keys = [_unpack(k) for k in table.column("keys")]
        own = [np.frombuffer(zlib.decompress(c.as_buffer()), "<u4") for c in table.column("counts")]
        out = []
        for a, b in _ranges(keys):
            distinct, total, _ = _added_up(np.concatenate([k[i:j] for k, i, j in zip(keys, a, b)]), np.concatenate([c[i:j] for c, i, j in zip(own, a, b)]))
            out.append(pa.table({"gram": distinct.view(np.int64), "n": total.astype(np.float64)}))
        return pa.concat_tables(out)

    return packed.where(F.col("kind") == GRAMS).groupBy("part").applyInArrow(add, "gram long, n double")


def gram_values(packed: DataFrame, scores: DataFrame, parts: int) -> DataFrame:
    """Rows PACKED of the grams: log10 probabilities instead of counts."""
    gram = F.col("gram")
    part = F.pmod(gram.bitwiseXOR(F.shiftrightunsigned(gram, 13)).bitwiseXOR(F.shiftrightunsigned(gram, 29)), F.lit(parts))

    def give(table: pa.Table, scores: pa.Table) -> pa.Table:
        known = Lookup(scores.column("gram").to_numpy().view(U), scores.column("logp").to_numpy())
        out = []
        for i in range(len(table)):  # a row is an Arrow batch of its own
            row = table.slice(i, 1)
            out.append(row.append_column("counts", pa.array([_planes(known.of(_unpack(row.column("keys")[0]))[0])], pa.binary())))
        del known
        common.trim()
        return pa.concat_tables(out)

    chunks = packed.where(F.col("kind") == GRAMS).drop("counts")
    return chunks.groupBy("part").cogroup(scores.withColumn("part", part).groupBy("part")).applyInArrow(give, PACKED)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of all texts.

    The model learns from texts whose crc32 of the id as text isn't held_fold modulo folds. base_score:
    add-one unigrams; score: log10 of the tree's probability of the text; bits_per_byte: its code length
    for each byte of words, spaces and end. A null text is empty and has its end only; a null id counts as
    the empty string; repeated rows are scored and counted as they come. An empty table gives no rows.
    Other columns of docs are ignored. Words are told apart by 63 bits of a hash. depth: 5 to 6, as a gram must
    fit a long beside its fold.
    """
    if not FIRST < depth <= 6:
        raise ValueError(f"depth must be over {FIRST} and 6 at most")
    fold = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold == held_fold).alias("held"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = -(-size // chunk_bytes) + 1 | 1
    # Fewer tasks than splits only: a chunk is one task's, and the more texts it has, the fewer grams repeat between chunks.
    packed = common.written(chunked(rows.coalesce(parts), parts, depth, chunk_bytes), "ctw-packed", GROUP_BYTES)
    words = common.written(word_counts(packed), "ctw-words", GROUP_BYTES)
    sums = np.array([np.frombuffer(r["counts"], "<i8") for r in words.where("chunk = -1").select("counts").toLocalIterator()]).reshape(-1, 2).sum(0)
    n_all, v = int(sums[0]), int(sums[1])
    counts = common.written(gram_counts(packed), "ctw-counts")
    common.release(docs.sparkSession)
    scores = gram_scores(counts, depth)
    common.discard(counts)
    values = gram_values(packed, scores, parts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        found, known = {GRAMS: [], WORDS: []}, {}
        for batch in batches:
            for kind, keys, raw in zip(batch.column("kind").to_pylist(), batch.column("keys"), batch.column("counts")):
                if kind == GRAMS:
                    found[GRAMS].append((_unpack(keys), _from_planes(raw.as_buffer(), np.float64)))
                elif kind == WORDS:
                    found[WORDS].append((_unpack(keys), np.frombuffer(zlib.decompress(raw.as_buffer()), "<i8")))
                else:
                    while found:  # texts come last
                        k, pieces = found.popitem()
                        columns = [list(c) for c in zip(*pieces)]
                        del pieces
                        known[k] = Lookup(*(np.concatenate(columns.pop(0)) for _ in range(2)))
                    with pa.ipc.open_stream(keys.as_buffer()) as stream:
                        whole = stream.read_next_batch()
                    for piece in common.slices(whole, "text", LOOK_BYTES):
                        yield scores_of(piece, known)
        del known
        common.trim()

    def scores_of(piece: pa.RecordBatch, known: dict[int, Lookup]) -> pa.RecordBatch:
        text = piece.column("text")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        logp = known[GRAMS].of(grams(data, ends, depth))[0]
        distinct, code = tokens(data)
        c = known[WORDS].of(token_keys(distinct))[0]
        n_tokens = np.add.reduceat((data == SPACE) | (data == END), ends[:-1], dtype=np.int64)
        first = np.cumsum(n_tokens) - n_tokens
        base = np.log10((c + 1) / (n_all + v + 1))
        total = np.add.reduceat(logp, ends[:-1])
        return pa.RecordBatch.from_pydict({
            id_col: piece.column("id"), "held_out": piece.column("held"), "n_tokens": n_tokens, "n_known": np.add.reduceat((c > 0)[code], first, dtype=np.int64),
            "train_tokens": np.full(len(piece), n_all), "base_score": np.add.reduceat(base[code], first), "score": total, "bits_per_byte": -total / math.log10(2) / np.diff(ends),
        })

    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    every = packed.where(F.col("kind") == TEXTS).unionByName(words.where("chunk >= 0")).unionByName(values)
    # A chunk's lookups are made before its texts come, which then pass one by one: no task holds a whole chunk.
    ordered = every.select("chunk", "kind", "keys", "counts").repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"))
    with common.setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        result = common.written(ordered.groupBy("chunk").applyInArrow(score, schema), "ctw-result")
    common.discard(packed, words, scores)
    return result
