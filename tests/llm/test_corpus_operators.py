"""Corpus operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tessaline.llm")

from tessaline.llm import common, crf, ctw, packing, pii, simhash, suffixes, tiling, winnow  # noqa: E402
from tessaline.session import shared_folder  # noqa: E402

EXTRA = "doc_id long, text string, id long, fp long, part long, spans string, body string, key int, n_lines int"


def odd(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, 7, 7, "x", "y", 1, 2) for i, t in zip(ids, texts)], EXTRA).repartition(3)


LINE = "the quick brown fox jumps over the lazy dog near the river bank"
TEXTS = [
    None, "", "  \n\t ", "one", "one two", f"{LINE}\nsecond line with five words\nthird", f"{LINE}\nsecond line with five words\nother", f"x\n{LINE}", LINE, LINE,
    "word " * 3000, "word " * 3000, "Émile ÀÉ   naïve — “quotes” 12 3a, b2 don't I'll <|endoftext|>", "a" * 5000, "日本語 テキスト。", "A B\rC\x0bD",
    LINE.upper(), LINE.replace("dog", "cat"), "\n".join([LINE] * 5), "ab " * 400 + "end " * 100,
]


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(x))


# --- SimHash -----------------------------------------------------------------------------------------------------


def brute_fp(x, k=3):
    import xxhash

    w = words(x)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(z.encode(), 42) for z in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fp, ids, radius):
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = collections.defaultdict(list)
    for a in range(len(fp)):
        groups[find(a)].append(ids[a])
    return [min((i for i in groups[find(a)] if i is not None), default=None) for a in range(len(fp))]


def test_simhash(spark):
    ids = [*range(len(TEXTS) - 2), 3, None]
    got = simhash.near_duplicates(odd(spark, TEXTS, ids)).collect()
    fp = [brute_fp(t) for t in TEXTS]
    want = collections.Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fp, brute_components(fp, ids, 2)))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(odd(spark, [])).count() == 0


def test_ball_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 20)
    fps = {int(b) ^ ((1 << int(x)) | (1 << int(y))) for b in base for x, y in rng.integers(0, 63, (8, 2))} | {int(b) for b in base}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    roots = {r["node"]: r["root"] for r in common.components(got, "test").collect()}
    fps = sorted(fps)
    want = brute_components([f & (1 << 64) - 1 for f in fps], fps, 2)
    assert [roots.get(f, f) for f in fps] == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


# --- near copies -------------------------------------------------------------------------------------------------


def brute_kept(rows, k=5, least=0.8):
    """Of rows (id, text), the smallest (id, text) of each component of similar shingle sets; nulls last."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                part = [part[b] if p == part[a] else p for p in part]
    order = lambda r: (r[0] is None, r[0] or 0)
    return sorted((min((r for r, p in zip(rows, part) if p == q), key=order) for q in set(part)), key=order)


def test_near_copies_reach_their_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = []
    for n in (1, 4, 30, 60, 120, 120, 200, 200, 400, 400):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 8, 10):
            copy = list(base)
            for at in rng.integers(0, n, changes):
                copy[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(copy))
            base = copy if n == 120 else base  # chains: each step near, the ends far apart
    texts += [None, "", "  ", texts[20], texts[20].upper()]
    rows = [*enumerate(texts), (20, texts[20]), (20, texts[40]), (None, texts[50]), (None, "only a null id has this text here"), (None, "only a null id has this text here")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, odd(spark, [t for _, t in rows], [i for i, _ in rows]), "").collect()]
    want = brute_kept(rows)
    assert 20 < len(want) < len(rows) - 20
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(r[0] is None, r[0] or 0) for r in want]
    assert corpus_pipeline.near_dedup(spark, odd(spark, []), "").count() == 0


# --- packing -----------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, tokens = Tokenizer.from_file(path), packing.Tokens(path)
    rng = np.random.default_rng(11)
    mark = "<|endoftext|>"
    parts = [mark, mark, "<|endo", "ftext|>", "|>", "<", " ", "  ", "\n", "a", "don't", "12", "é", "\u00a0", "日本", "!!", "word", " Word", "\t"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + [f"a {mark} b", mark, mark + mark, f"x{mark}", "<|endo", "ftext|>", None]
    ids, at = tokens.of(pa.array(texts, pa.large_string()), 0)
    assert all(ids[a:b].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0] for x, a, b in zip(texts, at, at[1:]))


def test_packing_repeated_ids(spark):
    import public_tokenizers

    rows = packing.pack(odd(spark, ["one two three", "one two three", "four", None], [1, 1, 1, None]), public_tokenizers.path("byte_bpe_50k.json"), window=4).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 10 and sum(r["length"] for r in rows if r["doc_id"] is None) == 1
    assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)[0][:2] == (0, 0) and sum(r["length"] for r in rows) == 11


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = [*range(len(TEXTS) - 1), None]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in zip(ids, TEXTS)}
    rows = packing.pack(odd(spark, TEXTS, ids), path, window=64, keep_ids=True).collect()
    back = collections.defaultdict(dict)
    for r in rows:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["offset"] + r["length"] <= 64
        back[r["doc_id"]][r["start"]] = piece
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in back.items()} == want
    fill = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 64 for s in range(len(fill) - 1))
    assert packing.pack(odd(spark, []), path).count() == 0


# --- lines -------------------------------------------------------------------------------------------------------


def brute_lines(texts, least):
    seen, gone = {}, collections.defaultdict(set)
    order = sorted(range(len(texts)), key=lambda i: i)
    for i in order:
        lines = (texts[i] or "").split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= least:
                    first = seen.setdefault("\n".join(lines[a : b + 1]), (i, a))
                    if first != (i, a):
                        gone[i] |= set(range(a, b + 1))
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in enumerate(texts)]


def test_lines(spark):
    more = [*TEXTS, "a b\nc\nd e f", "a b\nc\nd e f\ng", "c\nd e f", "q\na b\n\nc", "a b\n\nc\nd e"]
    got = {r["doc_id"]: r for r in winnow.dedup_lines(odd(spark, more)).collect()}
    for i, (text, want) in enumerate(zip(more, brute_lines(more, 5))):
        assert (got[i]["text"] or "") == want and got[i]["body"] == "y"
    assert got[0]["text"] is None and got[0]["n_lines"] == 0
    assert winnow.dedup_lines(odd(spark, [])).count() == 0


def test_lines_among_blank_ones(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", "", "", " ", "a", "a b", "a b c", "d e f g h"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in winnow.dedup_lines(odd(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 5)


@pytest.mark.parametrize("line", [lambda i: "", lambda i: " " * (i % 300)])
def test_windows_of_many_blank_lines(line):
    text = "\n".join(line(i) for i in range(100_000)) + "\na b c d e f"
    began = time.process_time()
    windows = [w for _, some in winnow.positions(text, 5).values() for w in some]
    assert len(windows) == 100_001 and {b for _, b, _ in windows} == {100_000} and time.process_time() - began < 20


def test_lines_keep_null_and_repeated_ids(spark):
    rows = winnow.dedup_lines(odd(spark, [LINE, LINE, LINE, LINE], [None, 2, 2, 5])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows) == [(False, 2, LINE), (False, 2, LINE), (False, 5, ""), (True, 0, "")]


# --- tiles -------------------------------------------------------------------------------------------------------


def brute_tiles(item, text, least):
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        n, i, j = best
        free_i[i : i + n] = free_t[j : j + n] = [False] * n
        covered += n


def test_tiles_are_greedy():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = rng.integers(0, 4, 25).tolist(), rng.integers(0, 4, 40).tolist()
        tiles = tiling.tile(item, text, 3)
        assert all(item[i : i + n] == text[j : j + n] and n >= 3 for i, j, n in tiles)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles) == len({x for _, j, n in tiles for x in range(j, j + n)})
        assert (tiles[0][2] if tiles else 0) == max((n for *_, n in tiles), default=0)
        assert sum(n for *_, n in tiles) == brute_tiles(item, text, 3)
    item, text = list(range(20)), [9, *range(10, 20), 99, *range(10)]
    assert sum(n for *_, n in tiling.tile(item, text, 3)) == brute_tiles(item, text, 3)


def test_tiles_of_long_texts():
    rng = random.Random(6)
    item = [rng.randrange(300) for _ in range(300)]
    began = time.process_time()
    assert tiling.tile(item, [*(rng.randrange(300) for _ in range(100_000)), *item], 5)[0] == (0, 100_000, 300)
    assert tiling.tile(item, item * 300, 5)[0] == (0, 0, 300)
    assert len(tiling.tile([1] * 300, [*[1] * 6, -1] * 20_000, 5)) == 50
    assert time.process_time() - began < 20


def test_contamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    turned = "so lambda eta theta iota kappa lambda mu, alpha beta gamma delta epsilon zeta!"
    docs = odd(spark, [f"intro {passage} outro", turned, "alpha beta gamma delta something", None, "", f"{passage.upper()}."])
    bench = spark.createDataFrame([(1, passage, 0), (2, "alpha beta", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in tiling.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 1)} and got[1, 1]["tiles"] == 2 and got[1, 1]["covered"] == 12
    small = tiling.contaminated(docs, bench, block_bytes=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in small} == set(got)
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.contaminated(odd(spark, []), bench).count() == 0


# --- repeated bytes ----------------------------------------------------------------------------------------------


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if mask[i] and (not i or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [16, 40, 200])
def test_suffixes(spark, length):
    rng = np.random.default_rng(length)
    pool = ["".join(map(chr, rng.integers(97, 123, 700))) for _ in range(4)]
    cuts = [p[a : a + n] for p in pool for a, n in rng.integers(1, 400, (8, 2))]
    texts = [*TEXTS, *pool, *("é".join(rng.choice(cuts, 4)) for _ in range(20)), "z" * 700, pool[0] + pool[0]]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(odd(spark, texts), length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, length)


def test_suffixes_odd_rows(spark):
    text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 500)))
    rows = suffixes.remove_repeats(odd(spark, [text, text, None], [4, 4, None]), keep_bytes=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["kept"])) for r in rows) == [(0, 0, b""), (4, 500, b""), (4, 500, b"")]
    assert suffixes.remove_repeats(odd(spark, [])).count() == 0


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    raw = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    monkeypatch.setattr(suffixes, "PIECE", 700)
    got = []
    for group in suffixes._pieces([(1, 2, raw)], 100):
        at = np.cumsum([0, *(len(g[3]) for g in group)])
        text, _, anchor, first, last = suffixes.runs(np.frombuffer(b"".join(g[3] for g in group), np.uint8), at, np.array([g[4] for g in group]), 100)
        base = np.array([g[2] for g in group])[text] - at[text]
        got += [(s, a + b) for a, f, e, b in zip(anchor, first, last, base) for s in range(f + b, e + b + 1)]
    assert sorted(s for s, _ in got) == list(range(4901)) and all(s <= a <= s + 100 - 32 for s, a in got)


# --- context trees -----------------------------------------------------------------------------------------------


def brute_ctw(texts, held, depth):
    """Texts scored by a dictionary-based context tree."""
    train = collections.Counter(w for t, h in zip(texts, held) if not h for w in [*words(t), ""])
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(t):
        past = b"\n" * depth
        for c in "".join(f"{w} " for w in words(t)).encode() + b"\n":
            for b in range(8):
                yield past, (1 << b) | (c >> (8 - b)), c >> (7 - b) & 1
            past = past[1:] + bytes([c])

    for t, h in zip(texts, held):
        for past, node, bit in steps(t) if not h else ():
            for d in range(depth + 1):
                counts[past[depth - d :], node][bit] += 1
    kids = collections.defaultdict(set)
    for past, node in counts:
        if past:
            kids[past[1:], node].add(past)

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    pw = {}
    for past, node in sorted(counts, key=lambda k: -len(k[0])):
        p = pe(*counts[past, node])
        if len(past) < depth:
            s = sum(pw[k, node] for k in kids[past, node])
            p = max(p, s) + math.log1p(math.exp(-abs(p - s))) - math.log(2)
        pw[past, node] = p
    score = []
    for t in texts:
        total = 0.0
        for past, node, bit in steps(t):
            p, left, kt = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = past[depth - d :], node
                if key not in counts:
                    break
                a, b = counts[key]
                kt = (b + 0.5) / (a + b + 1)
                share = left if d == depth else left * math.exp(pe(a, b) - math.log(2) - pw[key])
                p, left = p + share * kt, left - share
            p += left * kt
            total += math.log10(p if bit else 1 - p)
        score.append(total)
    return train, score


@pytest.mark.parametrize("chunk_bytes", [1000, 64 << 20])
def test_ctw(spark, chunk_bytes):
    texts = [*TEXTS, "river stone light", "light river stone", "stone light river", "one two"]
    ids = [*range(len(texts) - 2), 3, None]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]
    train, score = brute_ctw(texts, held, ctw.DEPTH)
    n, v = sum(train.values()), len(train)
    got = collections.defaultdict(list)
    for r in ctw.scored(odd(spark, texts, ids), chunk_bytes=chunk_bytes).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    assert sum(map(len, got.values())) == len(texts)
    for i, h, t, want in zip(ids, held, texts, score):
        tokens = [*words(t), ""]
        r = min(got[i, len(tokens)], key=lambda r: abs(r["score"] - want))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(tokens), sum(w in train for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in tokens), rel=1e-12)
        assert r["score"] == pytest.approx(want, rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-want / math.log10(2) / (sum(len(w.encode()) + 1 for w in words(t)) + 1))
    three = [got[i, 4][0]["score"] for i, t in zip(ids, texts) if t and sorted(words(t)) == ["light", "river", "stone"]]
    assert len(set(three)) == 3  # order counts
    assert ctw.scored(odd(spark, [])).count() == 0


def test_lookup_finds_all():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000, dtype=np.uint64))
    assert (ctw.Lookup(keys, np.arange(len(keys))).of(keys[::-1])[0] == np.arange(len(keys))[::-1]).all()


def test_lookup_is_small():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 1_000_000, dtype=np.uint64))
    values = np.arange(len(keys))
    tracemalloc.start()
    try:
        found = ctw.Lookup(keys, values)
        assert tracemalloc.get_traced_memory()[1] < 24 * len(keys)
    finally:
        tracemalloc.stop()
    assert (found.of(keys[::-1])[0] == values[::-1]).all()


def test_ctw_pieces(monkeypatch):
    """What is done in pieces is as if done at once."""
    batch = pa.record_batch({"text": pa.array([*TEXTS, "a \t b", " ", "c"], pa.string())})
    rng = np.random.default_rng(0)
    keys = [np.unique(rng.integers(0, 90, n, dtype=np.uint64)) for n in (5, 60, 1, 40)]
    whole, at = ctw.coded(batch, "text")
    parts = ctw.part_of(whole.astype(np.uint64), 5)
    monkeypatch.setattr(ctw, "CODE_BYTES", 10)
    monkeypatch.setattr(ctw, "AT_ONCE", 7)
    assert all((x == y).all() for x, y in zip((whole, at), ctw.coded(batch, "text")))
    assert (ctw.part_of(whole.astype(np.uint64), 5) == parts).all()
    pieces = [[k[i:j] for k, i, j in zip(keys, a, b)] for a, b in ctw._ranges(keys)]
    assert len(pieces) > 5
    assert all((np.concatenate(p) == k).all() for p, k in zip(zip(*pieces), keys))
    assert (np.concatenate([np.unique(np.concatenate(p)) for p in pieces]) == np.unique(np.concatenate(keys))).all()
    found = ctw.Lookup(np.arange(50, dtype=np.uint64), np.arange(50) * 2)
    assert (found.of(np.arange(50, dtype=np.uint64))[0] == np.arange(50) * 2).all()


def test_ctw_tables_are_bounded(spark, monkeypatch):
    """Packed rows lie in row groups of some bytes, not by the hundred; only the result stays, and no setting."""
    limit, groups, folder = 64 << 10, [], Path(shared_folder(spark).removeprefix("file://"))
    before, plain = {p.name for p in folder.iterdir()}, common.written

    def written(df, label, *more):
        table = plain(df, label, *more)
        if label == "ctw-packed":
            for path in Path(table.written_to.removeprefix("file://")).glob("*.parquet"):
                meta = pq.ParquetFile(path).metadata
                groups.extend(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))
        return table

    monkeypatch.setattr(common, "written", written)
    monkeypatch.setattr(ctw, "GROUP_BYTES", limit, raising=False)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, rng = spark.conf.get(key), np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 2000))) for _ in range(40)]
    got = ctw.scored(odd(spark, texts), chunk_bytes=100_000)
    assert got.count() == len(texts)
    assert sum(groups) > 10 * limit and max(groups) < 5 * limit  # the row that fills a group is in it
    assert all(name.startswith("ctw-result") for name in {p.name for p in folder.iterdir()} - before)
    assert spark.conf.get(key) == was


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


# --- fields ------------------------------------------------------------------------------------------------------


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(2)
    m = crf.Model("abc")
    m.pairs, m.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    length = np.array([4, 1, 0, 3])
    e = rng.normal(size=(8, 3))
    got, at = m.decode(e, length), 0
    import itertools

    for n in length:
        def value(p):
            return m.first[p[0]] + sum(e[at + i, y] for i, y in enumerate(p)) + sum(m.pairs[a, b] for a, b in zip(p, p[1:]))

        if n:
            assert value(tuple(got[at : at + n])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
        at += n


def test_pii(spark):
    texts = [
        "write a.b@c-d.example.org or a@b@c.de.", "10.0.0.255 and 10.0.0.256, 1.2.3", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "+1 (555) 123-4567", "version 4.0 of 1999",
        "call 555-123-4567 now", "mail john [at] example [dot] com", None, "", "é +1 (269) 555-3296 4524132264652876 x",
    ]
    got = {r["doc_id"]: r for r in pii.find(odd(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = [(k, *m.span()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], t or "") if pii._holds(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
    assert got[4]["spans"] == "" and "phone" in got[5]["spans"] and "email" in got[6]["spans"] and got[9]["spans"].startswith("card")
    none = spark.createDataFrame([], "words array<string>, labels array<string>")
    assert pii.find(odd(spark, texts[:1]), none).first()["spans"] == pii.joined(pii.base_spans(texts[0]))
    assert pii.find(odd(spark, [])).count() == 0


def test_pii_query_counts_base_spans(spark, tmp_path):
    from tessaline.llm import queries

    texts = [
        "call 555-123-4567 now, or +1 (555) 123-4567", "mail john [at] example [dot] com or a@b.de", "ip 10.0.0.1, 10.0.0.2:80", "paid with 4111.1111.1111.1111", "ìip:1 é +1 (269) 555-3296 4524132264652876 x", "", None,
    ]
    odd(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = slow_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS], t
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert sum(bool(r["spans"]) and r["spans"].count(":") > r["base_spans"].count(":") for r in got.values()) >= 3


def slow_base(text):
    """The base rules read literally, a character at a time; nothing of the module."""
    digit, name, local = set("0123456789"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-"), None
    local = name | set("._%+")

    def run(at, letters):
        while at < len(text) and text[at] in letters:
            at += 1
        return at

    def email(i):
        j = run(i, local)
        if j == i or text[j : j + 1] != "@":
            return None
        k = run(j + 1, name)
        end = None
        while k > j + 1 and text[k : k + 1] == "." and run(k + 1, name) > k + 1:
            k = end = run(k + 1, name)
        return end

    def ip(i):
        j = run(i, digit)
        for _ in range(3):
            if j == i or text[j : j + 1] != "." or run(j + 1, digit) == j + 1:
                return None
            j = run(j + 1, digit)
        return j

    def card(i):
        if text[i] not in digit:
            return None
        j = i + 1
        while True:
            if text[j : j + 1] in digit and j < len(text):
                j += 1
            elif text[j : j + 1] in (" ", "-") and text[j + 1 : j + 2] in digit and j + 1 < len(text):
                j += 2
            else:
                return j if j > i + 1 else None

    def phone(i):
        if text[i] != "+" or text[i + 1 : i + 2] not in digit or i + 1 >= len(text):
            return None
        j = run(i + 2, digit | set(" ().-"))
        while j > i + 3 and text[j - 1] not in digit:
            j -= 1
        return j if j > i + 3 else None

    def luhn(x):
        return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(x))) % 10 == 0

    def good(kind, found):
        only = [c for c in found if c in digit]
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 16 <= len(only) <= 19 and luhn(only), "phone": lambda: 8 <= len(only) <= 15,
        }[kind]()

    out = []
    for kind, match in (("email", email), ("ip", ip), ("card", card), ("phone", phone)):
        i = 0
        while i < len(text):
            end = match(i)
            if end is None:
                i += 1
                continue
            if good(kind, text[i:end]):
                out.append((kind, i, end))
            i = end
    return out


def test_pii_base_spans_by_hand():
    rng = np.random.default_rng(12)
    parts = [*"0123456789", "10.0.0.1", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4111 1111 1111 1111", "+1 555 123 4567", "x@y.de", "é", "٣", "_", "%", "\n", "255", "256"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert pii.base_spans(text) == slow_base(text), text
    rows = [w for w, _ in pii.seed_rows(200, seed=5)]
    for w in rows:
        assert pii.base_spans(" ".join(w)) == slow_base(" ".join(w))


@pytest.mark.parametrize("text", [
    "7" * 5000 + ".1.1.1", "7" * 1_000_000, "1." * 500_000, "1 " * 500_000, "a@" * 300_000, "a." * 500_000 + "@", "+1" * 400_000, "+1 " + "(" * 900_000, "0" * 5000 + "1.2.3.4 x", "word " * 150_000,
    "10.0.0.1 " * 60_000,
])
def test_pii_long_texts(text):
    import time

    began = time.perf_counter()
    base = pii.base_spans(text)
    assert time.perf_counter() - began < 2
    if len(text) < 6000:
        assert ("ip" in {k for k, *_ in base}) == text.startswith("0")
    model = _pii_model()
    began = time.perf_counter()
    (found, every), = pii.spans_of(model, [text])
    assert found == base and set(base) <= set(every) and time.perf_counter() - began < 60


def _pii_model(cache=[]):  # noqa: B006
    if not cache:
        rows = pii.seed_rows()
        cache.append(pii.ruled(crf.Model(pii.LABELS).fit([pii.features(w) for w, _ in rows], [y for _, y in rows])))
    return cache[0]


def test_pii_added_spans_by_brute_force():
    """The best of all label paths over all words of short texts, special or not."""
    import itertools

    model, rng, checked = _pii_model(), np.random.default_rng(13), 0
    pool = ["call", "phone", "555-123-4567", "(555)", "123-4567", "john", "[at]", "example.org", "4111", "1111", "host", "10.0.0.1:80", "and", "2019", "bob(at)site.com", "x", "+49"]
    for _ in range(60):
        w = list(rng.choice(pool, 4))
        e = model.emissions(pii.features(w))
        paths = itertools.product(range(len(model.labels)), repeat=len(w))
        best = max(paths, key=lambda p: model.first[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(model.pairs[a, b] for a, b in zip(p, p[1:])))
        want, at, now = [], 0, None
        for word, y in zip([*w, ""], [*(model.labels[y] for y in best), "O"]):
            if now and y != f"I-{now[0]}":
                want.append(now)
                now = None
            if y[0] == "B":
                now = (y[2:], at, at + len(word))
            elif now:
                now = (now[0], now[1], at + len(word))
            at += len(word) + 1
        text = " ".join(w)
        want = [pii._trimmed(text, *x) for x in want]
        got = pii.added_spans(model, [text])[0]
        assert got == want, text
        checked += bool(want)
    assert checked > 20


#: Sentences written by hand: the text, and what is personal in it.
BY_HAND = [
    ("Please ring 0171 555 0182 before noon.", ["phone"]), ("My address is jane.doe [at] mailbox [dot] org, thanks", ["email"]), ("Reach us at (212) 555-0147 any day", ["phone"]),
    ("Chapter 12 was written in 1987 by two people", []), ("The ratio rose from 3.5 to 4.25 within 10 days", []), ("server 192.168.7.14:8080 answered", ["ip"]), ("Visa 4111.1111.1111.1111 exp 04/27", ["card"]),
    ("ISBN 978-3-16-148410-0 is out of print", []), ("on 2021-03-04 at 12:30 we met", []), ("call 1-800-555-0199 now!", ["phone"]), ("tom(at)fields.net wrote first", ["email"]), ("prices of $19.99 and 20% off", []),
]


def test_pii_scores_are_sums_over_words():
    model, rng = _pii_model(), np.random.default_rng(14)
    texts = [w for w, _ in pii.seed_rows(40, seed=3)] + [[], ["x"], ["Émile", "écrit,", "à", "Ça", "ÀB", "naïveté.", "call", "fax", "É"], list(rng.choice(["a", "call", "12", "visa."], 30))]
    want = np.concatenate([model.emissions(pii.features(t)) for t in texts])
    assert np.allclose(pii.Scorer(model).emissions(texts), want)


def test_pii_on_sentences_by_hand():
    found = [[k for k, *_ in every] for _, every in pii.spans_of(_pii_model(), [t for t, _ in BY_HAND])]
    assert sum(f == want for f, (_, want) in zip(found, BY_HAND)) >= len(BY_HAND) - 2, found
    assert not any(f for f, (_, want) in zip(found, BY_HAND) if not want)


def test_pii_null_and_repeated_ids(spark):
    rows = pii.find(odd(spark, ["a@b.de", "a@b.de", "10.0.0.1", None], [1, 1, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in rows) == [(0, ""), (0, "ip:0:8"), (1, "email:0:6"), (1, "email:0:6")]


def test_pii_field_on_held_out_rows():
    rows = pii.seed_rows()
    m = crf.Model(pii.LABELS).fit([pii.features(w) for w, _ in rows], [y for _, y in rows])
    right = total = 0
    for w, y in pii.seed_rows(100, seed=99):
        best = m.decode(m.emissions(pii.features(w)), np.array([len(w)]))
        right += sum(m.labels[a] == b for a, b in zip(best, y))
        total += len(y)
    assert right / total > 0.98


def test_slices_are_whole():
    batch = pa.record_batch([pa.array(["é" * k for k in range(200)])], names=["text"])
    parts = list(common.slices(batch, "text", 1000))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(len(p) == 1 or p.column("text").nbytes < 3000 for p in parts)
