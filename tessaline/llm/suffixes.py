"""Removal of byte strings that occur twice, by prefix doubling at sampled suffixes.

Ranking every byte position at every doubling would shuffle some hundred bytes for each byte of text. Here
the doubling runs on names of strings of 8, 16, 32 and 64 bytes within a task; only the smallest name in
each window of the threshold's length stands for the windows that it lies in (an anchor). Spark then sorts
anchors by name: a unique name ends all of its windows. The rest are sorted by longer and longer strings
around the anchor (the bytes that 64, 16, 4 windows and one window share: 137, 185, 197 and 200 bytes of a
threshold of 200), and a node of windows ends where its string is unique. Where all bytes that a node's
windows cover are found twice, all of them are repeated at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

#: Bytes whose names are made at once; arrays of their names stay in a core's cache.
PIECE = 1 << 18
#: Windows that a node of each level holds.
SIZES = (64, 16, 4, 1)
#: Low bits of a name that give way to the place of its string, the later first.
PLACE = np.uint64((1 << 20) - 1)
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29, S31, S32 = (np.uint64(x) for x in (29, 31, 32))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * K1
    x ^= x >> S29
    x += b * K2
    x ^= x >> S32
    x *= K1
    x ^= x >> S31
    return x


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of `length` (8 times a power of two) bytes from each place on, by doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    out = np.empty(n + length - 8, np.uint64)
    for o in range(8):
        words = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        lane = out[o::8]
        lane[:] = words[: len(lane)]
    k = 8
    while k < length:
        out = _pair(out[:-k], out[k:])
        k *= 2
    return out[:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, at: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, name, anchor, first, last): of each run of windows with one anchor.

    data: texts end to end, at: where they begin and end, most: windows wanted of each text. Equal windows
    have their anchor at the same place in them, as it depends on nothing else.
    """
    grain = 64
    while grain > 8 and grain > length // 2:
        grain //= 2
    w = length - grain + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    name = names(data, grain)
    place = np.arange(len(data), dtype=np.uint64)
    low = _sliding_min((name & ~PLACE) | (PLACE - place), w)
    anchor = (PLACE - (low & PLACE)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    valid = (start + length <= at[text + 1]) & (start - at[text] < most[text])
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])])
    last = np.append(cut[1:], len(anchor)) - 1
    cut, last = cut[valid[cut]], last[valid[cut]]
    return text[cut], name[anchor[cut]], anchor[cut], cut, last


#: at: anchor, and the least and greatest distance from a window's start to it, RANGE values each.
RUNS = "fp long, own long, id long, body long, at long"
RANGE = 1 << 10


def _pieces(rows: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Groups of (id, body, base, bytes, windows) with about PIECE bytes; long texts in overlapping pieces."""
    group, size = [], 0
    for i, body, raw in rows:
        for base in range(0, max(len(raw) - length + 1, 0), PIECE):
            part = raw[base : base + PIECE + length - 1]
            group.append((i, body, base, part, PIECE))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """Rows RUNS of (id, body, text): own names all bytes of the run's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [x.as_buffer() for x in part.column("text").cast(pa.large_binary())]
                out = []
                for group in _pieces(list(zip(part.column("id").to_pylist(), part.column("body").to_pylist(), map(memoryview, texts))), length):
                    joined = b"".join(g[3] for g in group)
                    at = np.cumsum([0, *(len(g[3]) for g in group)])
                    text, name, anchor, first, last = runs(np.frombuffer(joined, np.uint8), at, np.array([g[4] for g in group]), length)
                    view, one = memoryview(joined), xxhash.xxh3_64_intdigest
                    own = np.fromiter((one(view[a : b + length], c - a) for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist())), np.uint64, len(first))
                    shift = np.array([g[2] for g in group])[text] - at[text]
                    ids = pa.array([g[0] for g in group], pa.int64()).take(pa.array(text))
                    body = np.array([g[1] for g in group], np.int64)[text]
                    packed = ((anchor + shift) * RANGE + anchor - last) * RANGE + anchor - first
                    out.append([pa.array(name.view(np.int64)), pa.array(own.view(np.int64)), ids, pa.array(body), pa.array(packed)])
                if out:
                    columns = [pa.concat_arrays(c) for c in zip(*out)]
                    yield pa.record_batch(columns, names=["fp", "own", "id", "body", "at"])

    return rows.mapInArrow(run, RUNS)


def repeated_spans(docs: DataFrame, length: int, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Rows (id, body, spans) of (id, body, text): byte ranges covered by strings that also start elsewhere."""
    every = common.written(anchored(docs, length), "suffix-runs")
    # Small tables that are joined are written first: both sides are then plain exchanges, which adaptive execution splits where a name is frequent.
    twice = common.written(every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "suffix-twice")
    some = common.written(every.join(twice, "fp", "left_semi"), "suffix-candidates")
    common.discard(every, twice)

    # The whole range of an anchor's windows: one run stands for all with the same bytes.
    classes = some.groupBy("fp", "own").agg(F.count("*").alias("m"), F.min(F.struct("id", "body", "at")).alias("one"))
    classes = common.written(classes.select("fp", "own", "m", "one.*"), "suffix-classes")
    whole = some.join(classes.where("m > 1").select("fp", "own"), ["fp", "own"], "left_semi")
    spans = common.written(whole.select("id", "body", "at"), "suffix-whole")
    common.discard(some)
    mixed = common.written(classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "suffix-mixed")
    asked = classes.join(mixed, "fp", "left_semi").groupBy("id", "body").agg(F.collect_list(F.struct("fp", "m", "at")).alias("asked"))
    met = docs.join(asked, docs.id.eqNullSafe(asked.id) & (docs.body == asked.body)).select(docs.id, docs.body, "text", "asked")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column("text")[i].as_buffer())
                rows = batch.column("asked")[i].as_py()
                where = [(r["at"] // RANGE // RANGE, r["at"] // RANGE % RANGE, r["at"] % RANGE) for r in rows]
                yield pa.record_batch(
                    [pa.array([batch.column(c)[i].as_py()] * len(rows), pa.int64()) for c in ("id", "body")]
                    + [pa.array([r[c] for r in rows], pa.int64()) for c in ("fp", "m", "at")]
                    + [pa.array([bytes(raw[p - hi : p - lo + length]) for p, lo, hi in where], pa.binary())],
                    names=["id", "body", "fp", "m", "at", "bytes"],
                )

    packed, lo, hi = F.col("at"), F.expr(f"at div {RANGE} % {RANGE}"), F.expr(f"at % {RANGE}")
    ctx = met.mapInArrow(contexts, "id long, body long, fp long, m long, at long, bytes binary")
    ctx = common.written(ctx.select(F.xxhash64("fp", "id", "body", packed).alias("rid"), "*", lo.alias("lo"), hi.alias("hi")), "suffix-contexts")
    common.discard(classes)

    # Ever longer strings of ever fewer windows: d counts bytes from a window's start to its anchor; alone: not known to be repeated.
    cells = ctx.select("rid", "fp", "bytes", "hi", F.col("lo").alias("x"), F.col("hi").alias("y"), (F.col("m") == 1).alias("alone"))
    found, used = [], []
    for size in [s for s in sizes if s == 1 or s <= length // 3]:
        g = F.explode(F.sequence(F.floor(F.col("x") / size), F.floor(F.col("y") / size)))
        nodes = cells.select("*", g.alias("g")).withColumns({"a": F.greatest("x", F.col("g") * size), "b": F.least("y", F.col("g") * size + (size - 1))})
        # core: the bytes that all windows of a whole node share; key: the bytes that they cover, as far as asked.
        core = F.expr(f"substring(bytes, int(hi - g * {size} + 1), int({length - size + 1}))")
        named = F.expr(f"substring(bytes, int(hi - b + 1), int({length} + b - a))")
        nodes = nodes.select("rid", "alone", F.xxhash64(core, "fp", "g").alias("core"), F.xxhash64(named, "fp", "a", "b").alias("key"), (F.col("a") * RANGE + F.col("b")).alias("ab"))
        nodes = common.written(nodes, f"suffix-nodes{size}")
        kinds = nodes.groupBy("core", "key", "ab").agg(F.count("*").alias("c"), F.min("rid").alias("rid"), F.bool_and("alone").alias("alone"))
        kinds = common.written(kinds, f"suffix-kinds{size}")
        twice = kinds.where("c > 1").select("core", "key", "ab")
        found.append(common.written(nodes.where("alone").join(twice, ["core", "key", "ab"], "left_semi").select("rid", "ab"), f"suffix-found{size}"))
        if size > 1:
            mixed = common.written(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), f"suffix-mixed{size}")
            open_ = kinds.join(mixed, "core", "left_semi").select("rid", F.expr(f"ab div {RANGE}").alias("x"), F.expr(f"ab % {RANGE}").alias("y"), F.expr("alone and c = 1").alias("alone"))
            cells = open_.join(ctx.select("rid", "fp", "bytes", "hi"), "rid")
        used += [nodes, kinds]
    part = reduce(DataFrame.union, found).join(ctx.select("rid", "id", "body", "at"), "rid")
    anchor = F.expr(f"at div {RANGE} div {RANGE}")
    part = part.select("id", "body", (anchor - F.expr(f"ab % {RANGE}")).alias("a"), (anchor - F.expr(f"ab div {RANGE}") + length).alias("b"))
    whole = spans.select("id", "body", (anchor - hi).alias("a"), (anchor - lo + length).alias("b"))
    out = common.written(whole.union(part).groupBy("id", "body").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-removed")
    common.discard(spans, ctx, *found, *used)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_bytes: bool = False) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256) of all texts as UTF-8 bytes, and with `keep_bytes` kept.

    Each byte goes that a string of `length` bytes covers which also starts at another place, in the same
    text (overlaps count) or another. Judged on the input, so all copies go. A null text is empty; shorter
    texts lose nothing. Repeated rows are copies of each other; null ids are rows like others. An empty
    table gives no rows. Other columns of docs are ignored. Names have 64 bits, two of them for each string.
    """
    if not 16 <= length < RANGE:
        raise ValueError(f"length must be 16 to {RANGE} bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    spans = repeated_spans(rows, length)
    met = rows.join(spans, rows.id.eqNullSafe(spans.id) & (rows.body == spans.body), "left").select(rows.id, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for i, text, spans in zip(*(batch.column(c) for c in ("id", "text", "spans"))):
                raw, merged = memoryview(text.as_buffer() or b""), []
                if spans.is_valid:
                    pairs = spans.values.flatten()
                    a, b = (p.to_numpy(zero_copy_only=False) for p in pairs)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    merged = list(zip(a[new].tolist(), np.append(b[new[1:] - 1], b[-1]).tolist()))
                kept, done = [], 0
                for s, e in merged:
                    kept.append(raw[done:s])
                    done = e
                kept = b"".join([*kept, raw[done:]])
                out.append((i.as_py(), len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string(), pa.binary()])]
            labels = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.record_batch(arrays[: 6 if keep_bytes else 5], names=labels[: 6 if keep_bytes else 5])

    return met.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
