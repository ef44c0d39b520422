"""Personal data by fixed patterns and by a conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import common
from tessaline.llm.crf import NEVER, Model

#: Kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PHONE = re.compile(PATTERNS["phone"])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'<>"
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Distances of the neighbours whose features a word has, and words that a worker remembers before it starts anew.
SIDES, REMEMBERED = (-2, -1, 1, 2), 1 << 19
#: A word of letters, at most the first a capital.
PLAIN = re.compile(r"([^\W\d_a-zß-öø-ÿ]?)([a-zß-öø-ÿ]+)")
#: Without any of these a text has nothing that `_plausible` lets through.
SIGNS = r"[0-9@]|(?i:[\[({]at[\])}])"
#: Rows of the labelled table that training takes at most.
MOST_LABELLED = 5000


# --- fixed patterns ----------------------------------------------------------------------------------------------


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _at_most_255(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number.lstrip("0") or "0") <= 255


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(_at_most_255, found.split(".")))
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


#: The same matches in time linear in the text: each run of letters that a match can begin in is read once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The spans that the kind's pattern finds from left to right.

    email: a match begins where a run of its first part does, at the first run that an address follows.
    ip: of a run of numbers between dots every four in turn. The other two begin once for each run.
    """
    if kind == "email":
        yield from (m.span() for m in LOCAL.finditer(text) if m[1]) if "@" in text else ()
    elif kind == "ip":
        for m in DOTTED.finditer(text):
            at = m.start()
            numbers = m[0].split(".") if "." in m[0] else ()
            for k in range(0, len(numbers) - 3, 4):
                size = sum(map(len, numbers[k : k + 4])) + 3
                yield at, at + size
                at += size + 1
    else:
        yield from (m.span() for m in (CARD if kind == "card" else PHONE).finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start."""
    return [(kind, a, b) for kind in KINDS for a, b in _matches(kind, text) if _holds(kind, text[a:b])]


# --- the field ---------------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Digits 0, capitals A, small letters a, runs of one kind of over four shortened."""
    s = re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_a-z]", "A", re.sub(r"[a-zß-öø-ÿ]", "a", word)))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", s)


def _own(word: str) -> list[str]:
    core = word.strip(EDGES)
    digits = sum(c.isdigit() for c in core)
    out = [f"s:{shape(core)}", f"d:{min(digits, 20)}", f"l:{min(len(core), 24) // 4}"]
    if not digits and "@" not in core:
        out.append("w:" + re.sub(r"\W", "", core.lower())[:12])
    for mark in "@.-+()/=_:%$#":
        if mark in core:
            out.append(f"m:{mark}")
    if core and digits == len(core):
        out.append(f"n:{len(core)}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?", core):
        out.append("quad")
    if core.isalnum() and digits and digits < len(core):
        out.append("mixed")
    if word[-1:] in EDGES:
        out.append("end")
    return out


def features(words: list[str]) -> list[list[str]]:
    """Of each word: its own shape and that of its neighbours, and the words up to three before."""
    own = [_own(w) for w in words]
    out = []
    for i in range(len(words)):
        f = ["bias", *own[i]]
        for k in SIDES:
            f += [f"{k}{x}" for x in (own[i + k] if 0 <= i + k < len(words) else ["edge"])]
        f += ["near:" + x for j in range(max(0, i - 3), i) for x in own[j] if x.startswith("w:")]
        out.append(f)
    return out


def seed_rows(n: int = 400, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: invented sentences, words with their labels, made by rule."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    low = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    quad = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "example.com"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"00{num(2)} {a} {num(7)}", f"0{num(3)} {num(6)}"])

    def email() -> str:
        a, b = low(3, 9), low(4, 9)
        return rng.choice([f"{a}.{num(2)}@{b}.{top()}", f"{a}@{b}.{top()}", f"{a} [at] {b} [dot] {rng.choice(['com', 'org'])}", f"{a}(at){b}.{top()}", f"{a} (at) {b} (dot) {rng.choice(['com', 'net'])}", f"{a} @ {b}.{top()}"])

    def card() -> str:
        d = [num(4) for _ in range(4)]
        return rng.choice([" ".join(d), "-".join(d), "".join(d), ".".join(d)])

    def nothing() -> str:
        return rng.choice([
            f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1900, 2030)}", f"${num(2)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}",
            f"password={hexa(18)}", f'token = "{hexa(40)}"', f"AKIA{low(16, 16).upper()}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}-{num(2)}-{num(2)}",
            f"{num(2)}%", f"section {num(1)}.{num(1)}", f"order {num(6)}", f"{num(2)}:{num(2)}", f"CC BY-NC {num(1)}.0.", f"{num(1)},{num(3)},{num(3)}", f"page {num(3)}", f"@{low(3, 8)}", f"ISBN {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{low(2, 5)}{num(3)}", f"id {num(10)}",
        ])

    makers = {"email": email, "ip": lambda: rng.choice([quad(), f"{quad()}:{num(4)}"]), "card": card, "phone": phone}
    cues = {"email": ["email", "write to", "contact"], "ip": ["host", "from ip", "server"], "card": ["card", "paid with", "visa"], "phone": ["call", "phone", "tel", "fax"]}
    rows = []
    for i in range(n):
        words: list[str] = []
        labels: list[str] = []
        for _ in range(rng.randint(1, 3)):
            plain = [low(2, 9) for _ in range(rng.randint(1, 6))]
            kind = rng.choice([*KINDS, None, None])
            if kind and rng.random() < 0.5:
                plain += rng.choice(cues[kind]).split()
            if rng.random() < 0.3:
                plain[0] = plain[0].capitalize()
            words += plain
            labels += ["O"] * len(plain)
            part = (makers[kind]() if kind else nothing()).split(" ")
            if rng.random() < 0.2:
                part[-1] += rng.choice(".,;")
            words += part
            labels += [("I-" if j else "B-") + kind if kind else "O" for j in range(len(part))]
        rest = [low(2, 9) for _ in range(rng.randint(0, 5))]
        rows.append((words + rest, labels + ["O"] * len(rest)))
    return rows


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled table as rows (words, labels)."""
    return spark.createDataFrame(seed_rows(), "words array<string>, labels array<string>")


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on at most `most` rows (words, labels), the smallest by hash; rows of unlike length are left out."""
    rows = labelled.where("size(words) = size(labels) and size(words) > 0").orderBy(F.xxhash64("words"), F.xxhash64("labels")).limit(most).collect()
    model = Model(LABELS)
    if rows:
        model.fit([features(r["words"]) for r in rows], [r["labels"] for r in rows])
    return ruled(model)


def ruled(model: Model) -> Model:
    """The model without paths on which a span goes on that didn't begin."""
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                model.pairs[i, j] = NEVER
        if a[0] == "I":
            model.first[i] = NEVER
    return model


class Scorer:
    """Emissions of all words of texts: what a word adds at each distance is found once for each kind of word.

    A word's features are its own and its neighbours', so a score is a sum of vectors of the words around. Plain
    words (letters, at most the first a capital) are of one kind if their features that the model knows are equal.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.kinds, self.known, self.rows = model, {}, {}, []
        e = model.emissions([["bias"], *([f"{k}edge"] for k in SIDES)])
        self.bias, self.edges = e[0], dict(zip(SIDES, e[1:]))

    def _kind(self, word: str) -> int:
        core = word.strip(EDGES)
        m = PLAIN.fullmatch(core)
        name = "w:" + core.lower()[:12]
        told = [f for k in ("", *SIDES, "near:") if (f := f"{k}{name}") in self.model.index] if m else None
        key = (bool(m[1]), min(len(m[2]), 5), min(len(core), 24) // 4, word[-1:] in EDGES, *told) if m else word
        if key not in self.kinds:
            own = _own(word)
            self.kinds[key] = len(self.rows)
            self.rows.append(self.model.emissions([own, *([f"{k}{x}" for x in own] for k in SIDES), [f"near:{x}" for x in own if x.startswith("w:")]]))
        return self.kinds[key]

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        """Scores (words x labels) of texts' words, one text after the other."""
        if len(self.known) > REMEMBERED:
            self.kinds, self.known, self.rows = {}, {}, []
        words = [w for t in texts for w in t]
        for w in set(words):
            if w not in self.known:
                self.known[w] = self._kind(w)
        if not words:
            return np.zeros((0, len(self.model.labels)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        table = np.stack(self.rows, axis=1)
        length = np.array([len(t) for t in texts])
        place = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - 1 - place
        out = table[0][at] + self.bias
        for i, k in enumerate(SIDES, 1):
            inside = np.flatnonzero(place >= -k if k < 0 else left >= k)
            add = np.tile(self.edges[k], (len(words), 1))
            add[inside] = table[i][at[inside + k]]
            out += add
        for k in (1, 2, 3):
            inside = np.flatnonzero(place >= k)
            out[inside] += table[-1][at[inside - k]]
        return out


def added_spans(model: Model, texts: list[str], scorer: Scorer | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans on the best path of each text, over all of its words, in their order."""
    spans = [[m.span() for m in WORD.finditer(text)] for text in texts]
    length = np.array([len(s) for s in spans], np.int64)
    e = (scorer or Scorer(model)).emissions([[text[a:b] for a, b in s] for text, s in zip(texts, spans)])
    best = model.decode(e, length)
    begin = np.cumsum(length) - length
    out: list[list] = [[] for _ in texts]
    outside = model.labels.index("O")
    for t in np.unique(np.repeat(np.arange(len(texts)), length)[best != outside]).tolist():
        now, labels = None, best[begin[t] : begin[t] + length[t]]
        inside = np.flatnonzero(labels != outside)
        for i in np.unique(np.concatenate([inside, inside + 1])).tolist():
            y = model.labels[labels[i]] if i < length[t] else "O"
            if now and y != "I-" + now[0]:
                out[t].append(_trimmed(texts[t], *now))
                now = None
            if y[0] == "B":
                now = (y[2:], *spans[t][i])
            elif y[0] == "I" and now:
                now = (now[0], now[1], spans[t][i][1])
    return out


def _trimmed(text: str, kind: str, a: int, b: int) -> tuple[str, int, int]:
    while a < b and text[a] in EDGES:
        a += 1
    while b > a and text[b - 1] in EDGES:
        b -= 1
    return kind, a, b


def _plausible(kind: str, found: str) -> bool:
    """Added spans must be possible: digits of a number of that kind, all of an address."""
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits) and not re.search(r"[^0-9 .-]", found)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/-]", found)
    if kind == "ip":
        m = re.match(r"[0-9.]+", found)
        return bool(m) and len(m[0].split(".")) == 4 and all(x and _at_most_255(x) for x in m[0].split("."))
    return bool(re.search(r"@|[\[({]at[\])}]", found, re.IGNORECASE)) and bool(re.search(r"[\w-] ?@ ?[\w-]|\w ?[\[({]at[\])}] ?\w", found, re.IGNORECASE))


def spans_of(model: Model, texts: list[str], scorer: Scorer | None = None) -> list[tuple[list, list]]:
    """(base spans, all spans) of texts; an added span never touches a base one or an earlier added one."""
    out = []
    for text, extra in zip(texts, added_spans(model, texts, scorer)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        more, until = [], 0
        for kind, a, b in extra:  # in the order of the text
            k = bisect_left(starts, b)
            if until <= a < b and (not k or ends[k - 1] <= a) and _plausible(kind, text[a:b]):
                more.append((kind, a, b))
                until = b
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans) of all texts.

    The patterns' matches stay; the field, trained on `labelled` (words, labels; else the small table above),
    adds spans where none is. Counts are of all spans. Time is linear in the text, digit runs of any length included. A null or empty text has none; null and repeated ids
    are rows like others; an empty table gives no rows; an empty labelled table adds none. Other columns of
    docs are ignored.
    """
    model = train(seed_table(docs.sparkSession) if labelled is None else labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            for part in common.slices(batch, "text"):
                text = pc.fill_null(part.column("text"), "")
                some = pc.match_substring_regex(text, SIGNS).to_numpy(zero_copy_only=False)
                n = len(part)
                counts = {k: np.zeros(n, np.int64) for k in KINDS}
                sha, every, fixed = [nothing] * n, [""] * n, [""] * n
                at = np.flatnonzero(some)
                for r, (base, all_) in zip(at, spans_of(model, text.take(pa.array(at)).to_pylist(), scorer)):
                    for kind, *_ in all_:
                        counts[kind][r] += 1
                    fixed[r], every[r] = joined(base), joined(all_)
                    sha[r] = hashlib.sha256(fixed[r].encode()).hexdigest()
                yield pa.record_batch(
                    [part.column("id"), *(pa.array(counts[k]) for k in KINDS), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(fixed, pa.string())],
                    names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans"],
                )

    schema = f"{id_col} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, base_spans string"
    return rows.mapInArrow(run, schema)
