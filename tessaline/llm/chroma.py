"""Chroma fingerprints of recordings, and their alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

RATE, FRAME, HOP = 4000, 512, 256
#: Lowest and highest frequency that counts, filters of a code and frames that the widest one needs.
LOW, HIGH, FILTERS, SPAN = 55.0, 1800.0, 16, 16
#: Edges between a filter's four values, and their two bits (neighbours differ in one).
EDGES, GRAY = (-0.2, 0.0, 0.2), np.array([0, 1, 3, 2], np.uint32)
#: Recordings of a block of queries, codes of a group whose transforms are in memory at once, rows aligned at once.
BLOCK, GROUP_CODES, TOGETHER = 2000, 1 << 17, 32


@lru_cache(maxsize=4)
def _pitch_classes(rate: int) -> np.ndarray:
    """Bins x 12: the pitch class of each frequency; A is 0."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    at = np.flatnonzero((f >= LOW) & (f <= HIGH))
    out[at, np.round(12 * np.log2(f[at] / 55)).astype(int) % 12] = 1
    return out


@lru_cache(maxsize=1)
def filters() -> tuple[tuple[int, int, int, int], ...]:
    """(kind, pitch, height, width) by rule; kinds: pitch halves, time halves, diagonals, middle pitches, middle times."""
    out = []
    for i in range(FILTERS):
        height, width = (2, 4, 6, 12)[i % 4] * (3 if i % 5 == 3 and i % 4 == 0 else 1), (4, 8, 12, 16)[i // 4]
        kind = i % 5
        if kind == 3:
            height = 6 if height < 12 else 12
        if kind == 4:
            width = 12
        out.append((kind, (5 * i) % (12 - height + 1), height, width))
    return tuple(out)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12: energy of each pitch class, each frame of length one; silence is zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2 @ _pitch_classes(rate)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-9, energy / np.maximum(norm, 1e-9), 0)


def codes(frames: np.ndarray) -> np.ndarray:
    """A 32-bit code for each place where all filters fit: two bits of each, from areas of the integral image."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in filters():
        q, x = p + h, w // 2
        whole = area(0, w, p, q)
        if kind == 0:
            a = area(0, w, p + h // 2, q)
        elif kind == 1:
            a = area(x, w, p, q)
        elif kind == 2:
            a = area(0, x, p, p + h // 2) + area(x, w, p + h // 2, q)
        elif kind == 3:
            a = area(0, w, p + h // 3, q - h // 3)
        else:
            a = area(w // 3, w - w // 3, p, q)
        value = np.log((1 + a) / (1 + whole - a))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(EDGES, value, side="right")]
    return out


def samples_of(raw: bytes) -> np.ndarray:
    """Signed 16-bit little-endian samples as numbers from -1 to 1."""
    return np.frombuffer(raw, "<i2", len(raw) // 2) / 32768


def notes(values: np.ndarray, rate: int = RATE, beat: int = 2 * HOP) -> np.ndarray:
    """A recording of a row of numbers: one tone for each, of 24 pitches from 220 Hz by the number's place
    between its row's least and greatest. It stands in where a table has numbers but no sound."""
    if not len(values):
        return np.zeros(0)
    values = np.nan_to_num(np.asarray(values, np.float64))
    low, high = values.min(), values.max()
    pitch = np.minimum(np.floor(24 * (values - low) / (high - low)), 23) if high > low else np.zeros(len(values))
    t = np.arange(beat) / rate
    return np.sin(2 * np.pi * np.outer(220 * 2 ** (pitch / 12), t)).ravel()


def fingerprints(recordings: DataFrame, id_col: str, column: str, rate: int = RATE) -> DataFrame:
    """Rows (id, n_frames, codes) of recordings: a binary column of 16-bit samples, or numbers played as notes."""
    binary = dict(recordings.dtypes)[column] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, packed = [], []
            for x in batch.column("sound"):
                sound = np.zeros(0)
                if x.is_valid:
                    sound = samples_of(x.as_py()) if binary else notes(np.array([v if v is not None else 0.0 for v in x.as_py()], np.float64), rate)
                c = chroma(sound, rate)
                frames.append(len(c))
                packed.append(codes(c).view(np.int32))
            at = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int32)
            flat = np.concatenate(packed) if packed else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column("id"), pa.array(frames, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "n_frames", "codes"])

    sound = F.col(column) if binary else F.col(column).cast("array<double>")
    return recordings.select(F.col(id_col).cast("long").alias("id"), sound.alias("sound")).mapInArrow(run, "id long, n_frames long, codes array<int>")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlapping places, and the share of bits that differ, of codes a and b moved by offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    wrong = np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()
    return hi - lo, float(wrong) / (32 * (hi - lo))


def _whole(least: int) -> int:
    """The smallest 2**a or 3 * 2**a from 8 and `least` on: a length that transforms are fast at."""
    power = 1 << max(3, (least - 1).bit_length())
    return power * 3 // 4 if power * 3 // 4 >= max(8, least) else power


def _spectra(rows: list[np.ndarray], n: int, kind: type) -> np.ndarray:
    """Bins x rows x 32: transforms over n places of the codes' bits as -1 and 1, zero after the end."""
    x = np.zeros((len(rows), 32, n), kind)
    for out, r in zip(x, rows):
        out[:, : len(r)] = 2.0 * ((r >> np.arange(32, dtype=np.uint32)[:, None]) & 1) - 1
    return np.ascontiguousarray(np.fft.rfft(x, axis=2).transpose(2, 0, 1))


class Queries:
    """A block of query fingerprints, in groups of bounded size."""

    def __init__(self, ids: list[int], rows: list[np.ndarray]) -> None:
        self.ids, self.rows = ids, rows
        order = sorted(range(len(rows)), key=lambda q: len(rows[q]))
        self.groups, self.kept = [], {}
        for q in order:
            if not self.groups or (len(self.groups[-1]) + 1) * len(rows[q]) > GROUP_CODES:
                self.groups.append([])
            self.groups[-1].append(q)

    def _group(self, g: int, n: int, kind: type) -> np.ndarray:
        if len(self.groups) > 1:
            return _spectra([self.rows[q] for q in self.groups[g]], n, kind).conj()
        if n not in self.kept:
            self.kept = {n: _spectra([self.rows[q] for q in self.groups[g]], n, kind).conj()}
        return self.kept[n]

    def matches(self, row: np.ndarray, overlap: int, error: float) -> list[tuple[float, int, int, int]]:
        return self.matches_of([row], overlap, error)[0]

    def matches_of(self, rows: list[np.ndarray], overlap: int, error: float) -> list[list[tuple[float, int, int, int]]]:
        """For each of some equally long rows: (bit error, query id, offset, overlap) of the queries that it aligns with.

        Every offset with enough overlap is compared, all bits of it: equal less different bits of all offsets
        are one correlation. Of a query's offsets the one with the least error counts, of equals the one with
        the greatest overlap, then the smallest.
        """
        out: list[list[tuple[float, int, int, int]]] = [[] for _ in rows]
        size = len(rows[0]) if rows else 0
        for g, group in enumerate(self.groups if size else []):
            length = np.array([len(self.rows[q]) for q in group])
            n = _whole(size + int(length.max()) - max(overlap, 1))  # lags of less overlap may coincide
            # Sums are whole numbers of at most 32 n: single precision holds those of short rows exactly enough to round.
            kind = np.float32 if n <= 1024 else np.float64
            shift = np.arange(-int(length.max()) + 1, size)
            common_ = np.minimum(size, length[:, None] + shift) - np.maximum(0, shift)
            shift, common_ = shift[(common_ >= overlap).any(0)], common_[:, (common_ >= overlap).any(0)]
            if not len(shift):
                continue
            # Equal less different bits that the greatest error needs; more than there can be where the overlap is too short.
            least = np.where(common_ >= max(overlap, 1), 32 * common_ * (1 - 2 * error) - 0.5, np.inf).astype(kind).T
            place = shift % n
            mine, theirs = _spectra(rows, n, kind), self._group(g, n, kind)
            step = max(1, GROUP_CODES * 64 // (len(group) * n))
            for start in range(0, len(rows), step):
                some = mine[:, start : start + step] @ theirs.transpose(0, 2, 1)
                agree = np.fft.irfft(some, n, axis=0)
                hit = np.zeros(agree.shape[1:], bool)
                for at, enough in zip(place, least):
                    hit |= agree[at] >= enough
                for r, q in zip(*np.nonzero(hit)):
                    found = agree[place, r, q]
                    at = np.flatnonzero(found >= least[:, q])
                    both = common_[q, at]
                    wrong = (32 * both - np.rint(found[at].astype(np.float64))) / 2 / (32 * both)
                    k = np.lexsort((shift[at], -both, wrong))[0]
                    if wrong[k] <= error:
                        out[start + r].append((float(wrong[k]), self.ids[group[q]], int(shift[at[k]]), int(both[k])))
        return out


def search(recordings: DataFrame, id_col: str, column: str, every: int = 50, overlap: int = 32, error: float = 0.25, rate: int = RATE, block: int = BLOCK) -> DataFrame:
    """One row for each recording: (id, class_id, n_frames, n_codes, n_matches, best_query, best_offset, best_overlap, best_error).

    Recordings with the same codes form a class, named by its smallest id. Queries are the classes that hold
    an id divisible by `every`; each other class is aligned with all of them, a block of queries at a time.
    n_matches counts the query classes with `overlap` places or more in common and at most `error` of the bits
    different, at any offset; the best has the least error, then the smallest id. Nulls, silence and sounds shorter than a
    code have no codes, share a class and match nothing; null ids are in classes but name none unless alone;
    repeated rows are copies; an empty table gives no rows. Other columns are ignored.
    """
    prints = common.written(fingerprints(recordings, id_col, column, rate), "chroma-codes").withColumn("key", F.sha2(F.to_json(F.struct("codes")), 256))
    classes = prints.groupBy("key").agg(F.min("id").alias("class_id"), F.bool_or(F.col("id") % every == 0).alias("asked"), F.any_value("codes").alias("codes"))
    classes = common.written(classes, "chroma-classes")
    asked = classes.where("asked and size(codes) > 0 and class_id is not null").select("class_id", "codes").orderBy("class_id")
    spark, found = recordings.sparkSession, []
    schema = "key string, n_matches long, best struct<error:double,query:long,shift:long,overlap:long>"

    def scan(ids: list[int], rows: list[np.ndarray]) -> None:
        shared = spark.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value)
            for batch in batches:
                out = []
                keys, owners = batch.column("key").to_pylist(), batch.column("class_id").to_pylist()
                codes_of = [row.values.to_numpy().view(np.uint32) for row in batch.column("codes")]
                order = sorted(range(len(keys)), key=lambda k: len(codes_of[k]))
                alike = [list(x) for _, x in groupby(order, key=lambda k: len(codes_of[k]))]
                runs = [x[a : a + TOGETHER] for x in alike for a in range(0, len(x), TOGETHER)]
                for k, got in ((k, got) for x in runs for k, got in zip(x, queries.matches_of([codes_of[k] for k in x], overlap, error))):
                    got = [g for g in got if g[1] != owners[k]]
                    if got:
                        e, q, s, o = min(got)
                        out.append((keys[k], len(got), {"error": e, "query": q, "shift": s, "overlap": o}))
                if out:
                    a, b, c = zip(*out)
                    kind = pa.struct([("error", pa.float64()), ("query", pa.int64()), ("shift", pa.int64()), ("overlap", pa.int64())])
                    yield pa.record_batch([pa.array(a), pa.array(b, pa.int64()), pa.array(c, kind)], names=["key", "n_matches", "best"])

        found.append(classes.where("size(codes) > 0").select("key", "class_id", "codes").mapInArrow(run, schema))

    ids, rows = [], []
    for r in asked.toLocalIterator():
        ids.append(r["class_id"])
        rows.append(np.array(r["codes"], np.int32).view(np.uint32))
        if len(ids) == block:
            scan(ids, rows)
            ids, rows = [], []
    if ids:
        scan(ids, rows)
    every_match = reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
    best = every_match.groupBy("key").agg(F.sum("n_matches").alias("n_matches"), F.min("best").alias("best"))
    named = classes.select("key", "class_id").join(best, "key", "left")
    return prints.join(named, "key").select(
        F.col("id").alias(id_col), "class_id", "n_frames", F.size("codes").cast("long").alias("n_codes"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("best.query").alias("best_query"), F.col("best.shift").alias("best_offset"), F.col("best.overlap").alias("best_overlap"), F.col("best.error").alias("best_error"),
    )
