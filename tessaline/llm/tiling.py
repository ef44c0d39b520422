"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

#: Text bytes of test items that one pass over the documents carries; a longer benchmark takes more passes.
BLOCK_BYTES = 16 << 20
#: Stripped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}*#&%$|<>-_"
#: Karp-Rabin: modulus and base.
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without marks at their ends, and the row of each. A null has none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    rows, words = pc.list_parent_indices(lists), pc.utf8_trim(pc.list_flatten(lists), characters=MARKS)
    keep = pc.not_equal(words, "")
    return words.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def _rolling(codes: list[int], size: int) -> list[int]:
    """Karp-Rabin hashes of all runs of `size` codes."""
    if len(codes) < size:
        return []
    top, h, out = pow(BASE, size, MODULUS), 0, []
    for i, c in enumerate(codes):
        h = (h * BASE + c + 1) % MODULUS
        if i >= size:
            h = (h - (codes[i - size] + 1) * top) % MODULUS
        if i >= size - 1:
            out.append(h)
    return out


def _free(codes: list[int], marked: bytearray, shared: set[int], least: int) -> list[tuple[int, int]]:
    """Runs (begin, end) of at least `least` unmarked codes that both sides have."""
    runs, begin = [], 0
    for i, c in enumerate(codes):
        if marked[i] or c not in shared:
            if i - begin >= least:
                runs.append((begin, i))
            begin = i + 1
    return [*runs, (begin, len(codes))] if len(codes) - begin >= least else runs


def _matches(item: list[int], text: list[int], item_runs: list, text_runs: list, size: int) -> Iterator[tuple[int, list[int]]]:
    """In order of place, each place in item with an unmarked run of `size` and the places in text with its hash."""
    wanted = [(a + k, h) for a, b in item_runs for k, h in enumerate(_rolling(item[a:b], size))]
    hashes, places = {h for _, h in wanted}, {}
    for a, b in text_runs:
        for k, h in enumerate(_rolling(text[a:b], size)):
            if h in hashes:
                places.setdefault(h, []).append(a + k)
    return ((i, places[h]) for i, h in wanted if h in places)


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first, none overlapping another.

    The longest length at which unmarked runs agree is found by halving: runs that agree at a length agree at all
    shorter ones. There, runs found by their rolling hashes are compared token by token and marked in order of item then
    text place; then the longest length of what is left is sought, down to `least`.
    """
    marked_item, marked_text, tiles = bytearray(len(item)), bytearray(len(text)), []
    shared = set(item) & set(text)
    most = min(len(item), len(text))
    while True:
        item_runs, text_runs = _free(item, marked_item, shared, least), _free(text, marked_text, shared, least)

        def agree(size: int) -> bool:
            return any(item[i : i + size] == text[j : j + size] for i, found in _matches(item, text, item_runs, text_runs, size) for j in found)

        most = min(most, max((b - a for a, b in item_runs), default=0), max((b - a for a, b in text_runs), default=0))
        if most < least:
            return tiles
        if not agree(most):
            low, high = least - 1, most  # agree(low) or low < least; not agree(high)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if agree(middle) else (low, middle)
            most = low
        if most < least:
            return tiles
        for i, found in _matches(item, text, item_runs, text_runs, most):
            if 1 in marked_item[i : i + most]:
                continue
            for j in found:
                if 1 not in marked_text[j : j + most] and item[i : i + most] == text[j : j + most]:
                    marked_item[i : i + most] = marked_text[j : j + most] = b"\1" * most
                    tiles.append((i, j, most))
                    break


class Seeds:
    """A block of test items: their words and the hashed runs of `least` words that begin a match."""

    def __init__(self, ids: list, texts: list, least: int) -> None:
        words, rows = tokens_of(pa.array(texts, pa.large_string()))
        coded = words.dictionary_encode()
        self.vocabulary, self.least, self.ids = coded.dictionary, least, ids
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = common.bounds(rows, len(ids))
        self.items = [codes[a:b].tolist() for a, b in zip(at, at[1:])]
        first, hashes = self.runs(codes, rows)
        order = np.lexsort((rows[first], hashes))
        self.hashes, self.owner = hashes[order], rows[first][order]

    def runs(self, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `least` known words of one row."""
        k = self.least
        if len(codes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        unknown = np.concatenate([[0], np.cumsum(codes < 0)])
        first = np.flatnonzero((rows[: len(rows) - k + 1] == rows[k - 1 :]) & (unknown[k:] == unknown[:-k]))
        h = np.zeros(len(first), np.uint64)
        for i in range(k):
            h = (h ^ (codes[first + i].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return first, h

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, list[int]]]:
        """(row, item, codes): all that a row's text shares with an item, between -1s."""
        words, rows = tokens_of(texts)
        codes = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        first, h = self.runs(codes, rows)
        left = np.searchsorted(self.hashes, h)
        hit = np.flatnonzero(self.hashes[np.minimum(left, max(len(self.hashes) - 1, 0))] == h) if len(self.hashes) else np.zeros(0, int)
        if not len(hit):
            return
        right = np.searchsorted(self.hashes, h[hit], side="right")
        count = right - left[hit]
        place = np.repeat(first[hit], count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owner[np.repeat(left[hit], count) + step]
        order = np.lexsort((place, item, rows[place]))
        place, item, row = place[order], item[order], rows[place[order]]
        cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(cut, np.append(cut[1:], len(place))):
            shared, until = [], -1
            for p in np.unique(place[a:b]).tolist():
                if p > until:
                    shared.append(-1)
                shared += codes[max(p, until) : p + self.least].tolist()
                until = p + self.least
            yield int(row[a]), int(item[a]), shared


def _blocks(bench: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in bench.toLocalIterator(prefetchPartitions=False):
        ids.append(row[0])
        texts.append(row[1] or "")
        size += 4 * len(texts[-1]) + 16
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _items(bench: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return bench.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string"))


def clean_rows(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = 5, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that cover no test item (as `contaminated` has it), with all their columns: each row is judged by
    itself, whatever its id. Null and empty texts are clean; an empty benchmark leaves all rows."""
    out, at = docs, docs.columns.index(text_col)
    for ids, texts in _blocks(_items(bench, item_col, item_text_col), block_bytes):
        block = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*block.value, least)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                judged = pa.record_batch([batch.column(at).cast(pa.string()), pa.array(np.arange(len(batch)))], names=["text", "row"])
                for part in common.slices(judged, "text"):
                    rows = part.column("row").to_numpy()
                    for r, i, shared in seeds.matches(part.column("text")):
                        if keep[rows[r]] and sum(t[2] for t in tile(seeds.items[i], shared, least)) >= threshold * len(seeds.items[i]):
                            keep[rows[r]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: int = 5, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (id, item, item_tokens, covered, tiles, coverage) of documents that cover a test item.

    Tiles are runs of at least `least` words, in any order, so reordered passages count; a pair is reported
    if tiles cover at least `threshold` of the item's words. Test items travel to the documents in blocks
    of bounded size; each pair of document and item is judged once, in one task, from what they share.
    Items of fewer than `least` words, and null or empty texts, match nothing; null and repeated ids are
    reported as they come. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = _items(bench, item_col, item_text_col)
    schema = f"{id_col} long, {item_col} long, item_tokens long, covered long, tiles long, coverage double"
    spark, found = docs.sparkSession, []

    for ids, texts in _blocks(items, block_bytes):
        block = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*block.value, least)
            for batch in batches:
                out: list[tuple] = []
                for part in common.slices(batch, "text"):
                    for r, i, shared in seeds.matches(part.column("text")):
                        tiles = tile(seeds.items[i], shared, least)
                        n, covered = len(seeds.items[i]), sum(t[2] for t in tiles)
                        if covered >= threshold * n:
                            out.append((part.column("id")[r].as_py(), seeds.ids[i], n, covered, len(tiles), covered / n))
                if out:
                    columns = zip(*out)
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, item_col, "item_tokens", "covered", "tiles", "coverage"])

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
