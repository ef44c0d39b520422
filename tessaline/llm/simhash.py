"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

SEED = 42
#: Shingles whose 64 bits are counted at once.
BLOCK = 1 << 16
#: Text bytes at once: words, their triples and hashes take some forty times as much.
SLICE_BYTES = 1 << 20


def _shingles(words: pa.Array, rows: np.ndarray, n: int, k: int) -> tuple[pa.Array, np.ndarray]:
    """Space-joined runs of k words and their rows; a shorter text gives all its words as one."""
    at = common.bounds(rows, n)
    count = np.diff(at)
    if len(words) >= k:
        first = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
        whole = [words.take(pa.array(first + i)) for i in range(k)]
        joined, owner = pc.binary_join_element_wise(*whole, pa.scalar(" ", pa.large_string())), rows[first]
    else:
        joined, owner = pa.array([], pa.large_string()), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        some = [" ".join(words.slice(at[r], count[r]).to_pylist()) for r in short]
        joined = pa.concat_arrays([joined, pa.array(some, pa.large_string())])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        joined, owner = joined.take(pa.array(order)), owner[order]
    return joined, owner


def _hashes(texts: pa.Array) -> np.ndarray:
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data, one = memoryview(texts.buffers()[2] or b""), xxhash.xxh64_intdigest
    return np.fromiter((one(data[a:b], SEED) for a, b in zip(offsets, offsets[1:])), np.uint64, len(texts))


def fingerprint_array(texts: pa.Array, k: int) -> np.ndarray:
    """Signed 64-bit fingerprints of texts: a bit is 1 if set in over half of the shingle hashes."""
    n = len(texts)
    words, rows = common.words_of(texts)
    joined, owner = _shingles(words, rows, n, k)
    ones = np.zeros((n, 64), np.int64)
    for start in range(0, len(joined), BLOCK):
        own = owner[start : start + BLOCK]
        h = _hashes(joined.slice(start, BLOCK))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=n)
    packed = np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.int64).reshape(n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Rows (id, fp): the SimHash of each text's k-word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                fp = fingerprint_array(part.column("text"), k)
                yield pa.record_batch([part.column("id"), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def masks(distance: int) -> list[int]:
    """All signed 64-bit words of at most `distance` set bits."""
    out = [0]
    for d in range(1, distance + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(64), d)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _edges(near: DataFrame) -> DataFrame:
    """Of rows (fp, word), edges (a, b) from the smallest that meets at a word to the others."""
    met = near.groupBy("word").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b").distinct()


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within `radius` bits.

    Each fingerprint is sent to every word within half the radius (the ball); two fingerprints within the
    radius meet at a word half-way. All that meet at one word lie within the radius of each other, and at
    most one ball's size of distinct fingerprints meets there, so a star to the smallest keeps the components.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: balls of half the radius must meet")
    ball = F.array(*[F.lit(m).cast("long") for m in masks(radius // 2)])
    # Each row becomes a ball: dealt over all partitions by another expression than distinct's, else the planner drops the exchange and merges small partitions.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = fps.select("fp").distinct().repartition(parts, F.xxhash64("fp")).select("fp", F.explode(F.transform(ball, lambda m: m.bitwiseXOR(F.col("fp")))).alias("word"))
    return _edges(near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """Rows (id, fingerprint, component_id) for every row of docs.

    Null ids keep their row but never name a component unless no other id is in it (then it is null); null
    and blank texts have fingerprint zero and are linked like any other. Repeated ids give repeated rows.
    An empty table gives no rows. Other columns of docs are ignored.
    """
    fps = common.written(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    roots = common.components(links(fps, radius), "simhash-links")
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.written(classes.join(named, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near copies of a stated similarity --------------------------------------------------------------------------

#: Words of a shingle and least similarity (shared share of all distinct shingles) of near copies.
WORDS, LEAST = 5, 0.8
#: Tables (one for each byte of the fingerprint), and sampled shingles that must agree in each.
TABLES, SAMPLED = 8, 2
_RANDOM = np.random.default_rng(42)
SALT = _RANDOM.integers(0, 1 << 63, TABLES * SAMPLED, np.uint64)
ODD = _RANDOM.integers(0, 1 << 63, TABLES * SAMPLED, np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes of a block; two blocks of a group are compared in one task.
NODES = 256


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets."""
    words, rows = common.words_of(texts)
    joined, owner = _shingles(words, rows, len(texts), k)
    h = np.concatenate([_hashes(joined.slice(a, BLOCK)) for a in range(0, len(joined), BLOCK)] or [np.zeros(0, np.uint64)])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
        h, owner = h[keep], owner[keep]
    return h, common.bounds(owner, len(texts))


def table_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x TABLES: a key of each table's sampled shingles (the least by two orders), its low byte the fingerprint's.

    Texts without shingles must not be among them.
    """
    n = len(at) - 1
    ones = np.zeros((n, 64), np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    for start in range(0, len(h), BLOCK):
        own = row[start : start + BLOCK]
        bits = np.unpackbits(h[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    byte = np.packbits((2 * ones > np.diff(at)[:, None]).astype(np.uint8), axis=1, bitorder="little")
    keys = np.zeros((n, TABLES), np.uint64)
    for i in range(TABLES * SAMPLED):
        low = np.minimum.reduceat((h ^ SALT[i]) * ODD[i], at[:-1])
        mixed = (keys[:, i // SAMPLED] ^ low ^ np.uint64(i)) * ODD[-1 - i]
        keys[:, i // SAMPLED] = mixed ^ (mixed >> np.uint64(29))
    return (keys & ~np.uint64(255)) | byte


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    """Rows (id, own, node, keys): node is the hash of the text's shingle set; no shingles, no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(part.column("text"), k)
                raw = memoryview(h.tobytes())
                node = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
                some = np.flatnonzero(np.diff(at))
                keys = table_keys(h, np.append(at[some], len(h))) if len(some) else np.zeros((0, TABLES), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(np.diff(at) > 0, TABLES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([part.column("id"), part.column("own"), pa.array(node.view(np.int64)), lists], names=["id", "own", "node", "keys"])

    return rows.mapInArrow(run, "id long, own long, node long, keys array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """Rows (node, shingles) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                h, at = shingle_sets(part.column("text"), k)
                raw = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([part.column("node"), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are at least so similar."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = 0
                if min(len(x), len(y)) >= least * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    # Sets of too different sizes can't be alike and are not sent on.
    size = F.octet_length
    short = pairs.join(sets.select(F.col("node").alias("a"), size("shingles").alias("m")), "a").join(sets.select(F.col("node").alias("b"), size("shingles").alias("n")), "b")
    short = short.where(F.least("m", "n") >= least * F.greatest("m", "n")).select("a", "b")
    return short.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.r_[True, h[1:] != h[:-1]]
    column, size = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(h)))
    kept = size[column] > 1
    column, owner = np.unique(column[kept], return_inverse=True)[1], owner[kept]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 14
    for start in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def _within(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect all alike nodes of each group, of rows (node, part, grp).

    A group is dealt over blocks of about NODES nodes; every two blocks meet in one task, which gives edges of a
    spanning forest, not all pairs. part: nodes of equal part are connected already.
    """
    n = groups.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(NODES)).cast("int").alias("blocks"))
    n = common.written(n, "near-groups")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = groups.join(n, "grp").select("grp", "node", "part", "blocks", block)
    dealt = dealt.select("grp", "node", "part", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    dealt = dealt.select("node", "part", F.xxhash64("grp", F.least("block", "met"), F.greatest("block", "met")).alias("cell"))

    def run(table: pa.Table) -> pa.Table:
        nodes, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(s) for s in found])
        both = _shared(found)
        root = np.unique(part, return_inverse=True)[1]
        out = []
        for i, j in zip(*np.nonzero(np.triu(both >= least * (size[:, None] + size - both) - 1e-3, 1))):
            if root[i] != root[j] and both[i, j] >= least * (size[i] + size[j] - both[i, j]):
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    return dealt.join(sets, "node").groupBy("cell").applyInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: float = LEAST, radius: int = 2) -> DataFrame:
    """Rows (id, own, root) for every row of docs: own is xxhash64 of its text ("" of a null), root its component.

    Texts are linked if at least the share `least` of all distinct k-word shingles of the two is in both; texts of
    equal shingle sets (all blank and null texts among themselves) are one node. Two texts so alike differ in about
    ten of 64 SimHash bits, beyond any ball, so each byte of the fingerprint is a table of its own: a text goes to
    all words within half of `radius` bits of the byte, beside two sampled shingles that keep strangers apart. A pair
    of similarity 0.8 misses all eight tables with probability 0.001. All pairs that meet are verified by their
    shingles, or lie in one component already: first each with the smallest that it meets, then those still apart
    in blocks. Repeated rows give repeated rows; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))
    prints = common.written(_sketches(rows, k), "near-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("first"), F.any_value("keys").alias("keys"))
    nodes = common.written(nodes.where(F.size("keys") > 0), "near-nodes")
    ball = F.array(*[F.lit(m).cast("long") for m in [0, *(sum(1 << b for b in bits) for d in range(1, radius // 2 + 1) for bits in combinations(range(8), d))]])
    keyed = nodes.select("node", F.explode(F.expr("transform(keys, (k, i) -> named_struct('k', k, 'i', i))")).alias("t"))
    words = keyed.select("node", F.explode(F.transform(ball, lambda m: F.xxhash64(m.bitwiseXOR(F.col("t.k")), F.col("t.i")))).alias("word"))
    lead = common.written(words.groupBy("word").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "near-leads")
    met = common.written(words.join(lead, "word"), "near-met")
    chosen = met.select("node").distinct().join(nodes, "node").select("node", F.col("first.id").alias("__id"), F.col("first.own").alias("__own"))
    texts = rows.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own"))).select("node", "text").dropDuplicates(["node"])
    sets = common.written(_sets(texts, k), "near-sets")
    stars = met.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    edges = common.written(_alike(common.written(stars, "near-stars"), sets, least), "near-edges")
    roots = common.components(edges, "near-links")
    parted = common.written(met.select("word", "node").join(roots, "node", "left").select("word", "node", F.coalesce("root", "node").alias("part")), "near-parts")
    apart = common.written(parted.groupBy("word").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("hub")).where("lo != hi").select("word", "hub"), "near-apart")
    rest = common.written(parted.join(apart, "word").select("node", "part", "hub").distinct(), "near-rest")
    groups = common.components(rest.select(F.col("hub").alias("a"), F.col("node").alias("b")), "near-hubs")
    groups = rest.select("node", "part", "hub").join(groups, "node", "left").select("node", "part", F.coalesce("root", "hub").alias("grp")).distinct()
    more = common.written(_within(common.written(groups, "near-grouped"), sets, least), "near-more")
    roots = common.components(edges.union(more), "near-links").withColumnRenamed("node", "of")
    common.discard(met, sets, parted, rest)
    return prints.join(roots, prints.node == roots.of, "left").select("id", "own", F.coalesce("root", "node").alias("root"))
