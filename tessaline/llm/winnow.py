"""Line deduplication by winnowing over line hashes."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

#: Karp-Rabin over runs of lines: modulus and base.
MODULUS, BASE = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
POSITIONS = "fp long, id long, own long, windows array<struct<first:int,last:int,key:binary>>"


def positions(text: str, least: int) -> dict[int, tuple[int, list[tuple[int, int, bytes]]]]:
    """Selected lines of a text: for each its hash and the windows (first, last, digest) that it stands for.

    A window is a shortest run of lines of at least `least` words from a line on, or up to a line. Of each
    window from a line on, the line with the smallest hash is selected, the last such. Every run of lines
    with that many words holds such a window, so equal runs hold equal selected lines; and the windows
    within a run, taken both ways, cover all of it. Time is linear in the text, however many lines a window has.
    """
    lines = text.split("\n")
    total = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    n = len(lines)
    last = np.searchsorted(total, total[:-1] + least).tolist()  # offset after the window from each line on
    first = (np.searchsorted(total, total[1:] - least, side="right") - 1).tolist()  # line where the window up to each line begins
    if last[0] > n:
        return {}
    wide = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    hashes = [h & (1 << 64) - 1 for h in wide]
    digest = _run_digests(wide, max(1, *(e - i for i, e in enumerate(last) if e <= n), *(j + 1 - b for j, b in enumerate(first) if b >= 0)))
    out: dict[int, tuple[int, list]] = {}

    def add(at: int, a: int, b: int) -> None:
        h = hashes[at]
        out.setdefault(at, (h - (1 << 64) if h >> 63 else h, []))[1].append((a, b, digest(a, b)))

    chosen: list[int] = []
    falling: deque[int] = deque()  # lines of the window that no later line of it undercuts or equals
    end = 0
    for i, e in enumerate(last):
        if e > n:
            break
        for j in range(end, e):
            while falling and hashes[falling[-1]] >= hashes[j]:
                falling.pop()
            falling.append(j)
        end = e
        while falling[0] < i:
            falling.popleft()
        chosen.append(falling[0])
        add(falling[0], i, e - 1)
    for j, b in enumerate(first):
        if b >= 0 and last[b] - 1 != j:
            add(chosen[b], b, j)
    return out


def _run_digests(wide: list[int], longest: int) -> Callable[[int, int], bytes]:
    """Digest of the run from line a to line b, each in constant time: Karp-Rabin over 128-bit line hashes."""
    heads, powers = [0], [1]
    for h in wide:
        heads.append((heads[-1] * BASE + h + 1) % MODULUS)
    for _ in range(longest):
        powers.append(powers[-1] * BASE % MODULUS)
    return lambda a, b: ((heads[b + 1] - heads[a] * powers[b + 1 - a]) % MODULUS).to_bytes(16, "little")


def selected(rows: DataFrame, least: int) -> DataFrame:
    """Rows (fp, id, own, windows) of the selected lines of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("key", pa.binary())]))]
        for batch in batches:
            for part in common.slices(batch, "text"):
                out = []
                for i, own, text in zip(*(part.column(c).to_pylist() for c in ("id", "own", "text"))):
                    out += [(fp, i, own, w) for fp, w in positions(text or "", least).values()]
                if out:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["fp", "id", "own", "windows"])

    return rows.mapInArrow(run, POSITIONS)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Rows (id, own, runs): the windows of each text that repeat an earlier one. own: the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))
    marks = common.written(selected(rows, least), "winnow-marks")
    # Written, as are the origins: both sides of the joins are then plain exchanges, which adaptive execution splits where a line is frequent.
    twice = common.written(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "winnow-twice")
    met = marks.join(twice, "fp", "left_semi").select("id", "own", F.explode("windows").alias("w"))
    met = common.written(met.select("id", "own", "w.*"), "winnow-windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own", "first")
    origin = met.groupBy("key").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    origin = common.written(origin, "winnow-origins")
    later = met.join(origin, "key").where(place != F.col("origin"))
    return later.groupBy("id", "own").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """The rows of docs, their text without the lines of later repeated runs, and n_lines, n_removed_lines.

    A line goes if it lies in a run of consecutive lines, at least `least` words in all, that equals a run
    which begins earlier: in the order of id (nulls last), text hash and line. The first occurrence stays,
    overlaps count. Rows with the same id and the same text stand for one place and lose the same lines. A
    null text stays null with no lines. Columns of docs keep their names; an n_lines or n_removed_lines in
    it is replaced. An empty table gives no rows.
    """
    runs = repeated_runs(docs, id_col, text_col, least).select(F.col("id").alias("__id"), F.col("own").alias("__own"), F.col("runs").alias("__runs"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    docs = docs.select(keep)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(runs, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__own")), "left").select(*keep, "__runs")
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed_lines": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = keep.index(text_col)
        for batch in batches:
            texts, counts, gone = batch.column(at).to_pylist(), [], []
            for r, (text, runs) in enumerate(zip(texts, batch.column(len(keep)).to_pylist())):
                counts.append(0 if text is None else text.count("\n") + 1)
                gone.append(0)
                if runs and text is not None:
                    lines = text.split("\n")
                    edge = np.zeros(len(lines) + 1, np.int64)
                    np.add.at(edge, [x["first"] for x in runs], 1)
                    np.add.at(edge, [x["last"] + 1 for x in runs], -1)
                    kept = [x for x, c in zip(lines, np.cumsum(edge)) if not c]
                    gone[-1], texts[r] = len(lines) - len(kept), "\n".join(kept)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "n_lines", "n_removed_lines"])

    for field in schema:
        field.nullable = True
    return joined.mapInArrow(run, schema)
