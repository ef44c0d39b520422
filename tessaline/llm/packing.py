"""Concatenate-and-cut packing of token streams."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.llm import common

#: Distinct pieces of text whose ids a worker remembers before it starts anew.
REMEMBERED = 1 << 19
#: The word pattern of byte-level BPE with 50,257 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space outside ASCII: texts with it are encoded in one go.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: Kinds of bytes: white space, ASCII letters, other ASCII, and what may begin white space outside ASCII.
OTHER, SPACE, LETTER, MARK, WIDE = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = MARK
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = OTHER
KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = WIDE


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoder of a byte-level BPE file (JSON of the tokenizers library), ids in order of merging, and the ids
    of its added tokens, which the library looks for in texts before it encodes what lies between them."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file.get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must be plain strings")
    byte_of, vocab = _byte_of_char(), model["vocab"]
    for rank, pair in enumerate(model["merges"]):
        pair = pair.split(" ") if isinstance(pair, str) else pair
        if vocab["".join(pair)] != 256 + rank:
            raise ValueError("ids aren't in order of merging")
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if i < 256 + len(model["merges"])}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {t["content"]: t["id"] for t in added}


class Tokens:
    """Ids of many texts at once; the ids of each distinct stretch of white space and word are found once."""

    def __init__(self, path: str) -> None:
        self.bpe, self.added = encoder(path)
        # Longest first, as the library prefers the longest of those that begin at one place.
        names = sorted(self.added, key=len, reverse=True)
        self.marker = re.compile(b"|".join(re.escape(x.encode()) for x in names)) if names else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.size, self.flat = {}, array("q"), array("q"), array("I")
        for name, number in self.added.items():
            self._remember(name.encode(), [number])

    def _remember(self, piece: bytes, ids: list[int]) -> None:
        self.known[piece] = len(self.known)
        self.first.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """For each piece its number among the remembered ones."""
        known, encode = self.known, self.bpe.encode_ordinary
        for piece in pieces:
            if piece not in known:
                self._remember(piece, encode(piece.decode()))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _marked(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where added tokens begin and end in texts that lie end to end."""
        raw, begin = memoryview(data), 0
        while self.marker and (m := self.marker.search(raw, begin)):
            row_end = at[np.searchsorted(at, m.start(), side="right")]
            begin = m.end()
            if m.end() <= row_end:
                yield m.span()
            else:  # it runs into the next text
                begin = m.start() + 1

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and the n + 1 offsets of the texts in them.

        A token never holds characters from both sides of the point before a run of white space, nor of
        that between an ASCII letter and an ASCII mark, and the pattern doesn't look back, so texts can be
        cut there. An added token found in a text, the leftmost first, is a piece of its own.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind = KINDS[data]
        cut = kind == SPACE
        cut[1:] &= kind[:-1] != SPACE
        cut[1:] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
        if (kind == WIDE).any():
            for r in np.flatnonzero(pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)):
                cut[at[r] : at[r + 1]] = False
        for a, b in self._marked(data, at):
            cut[a + 1 : b] = False
            cut[a] = True
            if b < len(cut):
                cut[b] = True
        cut[at[:-1][np.diff(at) > 0]] = True
        begins = np.flatnonzero(cut)
        offsets = np.append(begins, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self._forget()
        number = self._places(coded.dictionary.to_pylist())
        number = number[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.frombuffer(self.size, np.int64)[number] if len(number) else np.zeros(0, np.int64)
        stop = np.cumsum(size)
        counts = np.diff(np.concatenate([[0], stop])[np.searchsorted(begins, at)])
        if len(number):
            shift = np.frombuffer(self.first, np.int64)[number] - (stop - size)
            ids = np.frombuffer(self.flat, np.uint32)[np.arange(stop[-1]) + np.repeat(shift, size)]
        else:
            ids = np.zeros(0, np.uint32)
        ends = np.cumsum(counts)
        return np.insert(ids, ends, np.uint32(end)), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


TOKENS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("id", T.LongType()), T.StructField("before", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """First pass: rows (part, id, before, n, ids): the partition, the tokens before the row in it, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, before = Tokens(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in common.slices(batch, "text"):
                ids, at = tokens.of(piece.column("text"), end)
                n, raw = len(piece), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * at.astype(np.int64)), raw])
                yield pa.record_batch(
                    [pa.array(np.full(n, part)), piece.column("id"), pa.array(before + at[:-1]), pa.array(np.diff(at)), stored.cast(pa.binary())],
                    names=TOKENS.names,
                )
                before += int(at[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, TOKENS)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Boundary records of concatenate-and-cut: one row for each piece of a document in a window.

    The first pass writes each row's ids and its place in its partition; the second adds up the partitions'
    totals (one row for each partition) to global places and cuts at multiples of `window`, so only the last
    sequence needs padding. Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    `keep_ids` ids (binary, little-endian unsigned 32 bits). A null or empty text is its end id alone; null and
    repeated ids are packed as they come; an empty table gives no rows. The string of a special token is that token, as
    the library has it. Other columns of docs are ignored.
    """
    rows = common.written(tokenized(docs, path, id_col, text_col, end), "packing-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    shift = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("shift"))
    # One row for each task of the first pass. Written, its size is known: the planner broadcasts it up to its own limit.
    placed = rows.join(common.written(shift, "packing-shifts"), "part").select("id", (F.col("shift") + F.col("before")).alias("place"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "n"))
            first, last = place // window, (place + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            begin = np.maximum(seq * window, place[row])
            stop = np.minimum((seq + 1) * window, place[row] + n[row])
            start, length = begin - place[row], stop - begin
            raw = batch.column("ids")
            views = [memoryview(raw[i].as_buffer()) for i in range(len(n))]
            parts = [views[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            crc = [zlib.crc32(p) for p in parts]
            out = [batch.column("id").take(pa.array(row)), *map(pa.array, (start, length, np.array(crc, np.int64), n[row], seq, begin - seq * window))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                out, names = [*out, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.record_batch(out, names=names)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return placed.mapInArrow(run, schema).withColumnRenamed("id", id_col)
