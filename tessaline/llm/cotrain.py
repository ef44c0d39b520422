"""Quality classification by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import common

#: Slots that words are hashed to, and statistics of a text before them.
WORD_SLOTS, STATS = 1 << 18, 4
#: Letters of the beginnings of words that count like words.
BEGINNINGS = (4, 5)
#: Value of a word that a text has; words of fewer training rows than LEAST_ROWS have no weight.
WORD_VALUE, LEAST_ROWS = 0.3, 5
#: Slots of the metadata view: sources and languages, then lengths, then steps of each layout figure.
META_SLOTS, NAMED_SLOTS, LENGTHS, STEPS = 1 << 10, 768, 40, 16
#: Labelled rows that training takes at most (the smallest by hash of their id), and pseudo-labels that a view passes
#: on in a round at most: the surest of all unlabelled documents.
MOST_LABELLED, MOST_TAUGHT = 4000, 400
#: Kinds of bytes that the layout is made of: capitals, small letters, digits, stops, shouts, signs, bars, line feeds, blanks.
KINDS = np.zeros(256, np.uint8)
for _k, _letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"*#$%&@~^=<>", b"|", b"\n", b" \t"), 1):
    KINDS[np.frombuffer(_letters, np.uint8)] = _k
N_KINDS = 10


# --- views -------------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    """Sparse rows: slot and value of each entry, and n + 1 offsets."""

    slot: np.ndarray
    value: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.at))

    def common(self, slots: int, sparse_from: int) -> Rows:
        """Without entries of slots from sparse_from on that fewer than LEAST_ROWS rows have."""
        keep = (self.slot < sparse_from) | (np.bincount(self.slot, minlength=slots) >= LEAST_ROWS)[self.slot]
        ends = np.concatenate([[0], np.cumsum(keep)])
        return Rows(self.slot[keep], self.value[keep], ends[self.at])

    def take(self, which: np.ndarray) -> Rows:
        size = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(at[-1], dtype=np.int32) + np.repeat((self.at[:-1][which] - at[:-1]).astype(np.int32), size)
        return Rows(self.slot[index], self.value[index], at)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def unit(rows: Rows) -> Rows:
    """The rows of a text view, their words scaled to length one: for what a text is like, not what it holds."""
    words = rows.slot >= STATS
    norm = np.sqrt(np.maximum(np.bincount(rows.row, words, len(rows)), 1))
    return Rows(rows.slot, np.where(words, (1 / norm).astype(np.float32)[rows.row], rows.value), rows.at)


def _hashed(texts: pa.Array, seed: int) -> np.ndarray:
    """A slot for each text; equal ones are hashed once."""
    coded = texts.cast(pa.large_binary()).dictionary_encode()
    slots = np.fromiter((zlib.crc32(w, seed) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)) % WORD_SLOTS
    return slots[coded.indices.to_numpy(zero_copy_only=False)] if len(texts) else np.zeros(0, np.int64)


def views_of(text: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[Rows, Rows]:
    """The two views of documents.

    Text: a bias, how varied, repeated and long the words are, and the distinct words and beginnings of words,
    hashed. Metadata: source, language, length, and the layout in steps (shares of kinds of letters, length of lines),
    which tells nothing of the words.
    """
    n = len(text)
    texts = pc.fill_null(text.cast(pa.large_string()), "")
    words, row = common.words_of(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = coded.dictionary
    size = len(spelled) + 1
    slots = np.stack([_hashed(spelled, 0), *(_hashed(pc.utf8_slice_codeunits(spelled, 0, k), i) for i, k in enumerate(BEGINNINGS, 1))], axis=1)
    count = np.bincount(row, minlength=n)
    repeats = np.bincount(row[1:], (row[1:] == row[:-1]) & (codes[1:] == codes[:-1]), n) if len(row) else np.zeros(n)
    owner, code = np.divmod(_distinct(row * size + codes), size)
    kinds = np.bincount(owner, minlength=n)
    owner, slot = np.divmod(_distinct((owner[:, None] * WORD_SLOTS + slots[code]).ravel()), WORD_SLOTS)
    many = np.maximum(count, 1)
    stats = np.stack([np.ones(n), kinds / many, repeats / many, np.log1p(count) / 10], axis=1)
    found = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(found + STATS)])
    all_slots, values = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    head = (at[:-1, None] + np.arange(STATS)).ravel()
    all_slots[head], values[head] = np.tile(np.arange(STATS), n), stats.ravel()
    rest = np.ones(at[-1], bool)
    rest[head] = False
    all_slots[rest], values[rest] = slot + STATS, WORD_VALUE
    return Rows(all_slots, values, at), _meta_view(texts, source, lang, count)


def _meta_view(texts: pa.Array, source: pa.Array, lang: pa.Array, words: np.ndarray) -> Rows:
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    kind = np.bincount(np.repeat(np.arange(n) * N_KINDS, size) + KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS) if n else np.zeros((0, N_KINDS))
    named = []
    for name, values in (("source", source), ("lang", lang)):
        coded = pc.fill_null(values.cast(pa.large_string()), "\0").dictionary_encode()
        slots = np.array([1 + zlib.crc32(f"{name}:{v}".encode()) % (NAMED_SLOTS - 1) for v in coded.dictionary.to_pylist()], np.int64)
        named.append(slots[coded.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.int64))
    bits = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    share = kind[:, 1:] / np.maximum(size, 1)[:, None]
    lines = size / (kind[:, 8] + 1)
    figures = [*share.T, np.minimum(lines, 4096) / 4096, np.minimum(size / np.maximum(words, 1), 32) / 32]
    # Steps of a figure's square root: fine where it is small.
    steps = [np.minimum((np.sqrt(x) * STEPS).astype(np.int64), STEPS - 1) + NAMED_SLOTS + LENGTHS + STEPS * i for i, x in enumerate(figures)]
    slot = np.stack([np.zeros(n, np.int64), *named, NAMED_SLOTS + np.minimum(bits, LENGTHS - 1), *steps], axis=1)
    return Rows(slot.ravel(), np.ones(slot.size, np.float32), np.arange(0, slot.size + 1, slot.shape[1]))


# --- models ------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(rows: Rows, y: np.ndarray, slots: int, sparse_from: int, rounds: int = 60, rate: float = 0.5, decay: float = 2e-4, least: float = 3e-3) -> np.ndarray:
    """Weights of a logistic regression, the classes weighing the same, by AdaGrad on all rows.

    Slots from sparse_from on have an absolute prior of `least`, and none in fewer than LEAST_ROWS rows.
    """
    count = np.bincount(rows.slot, minlength=slots)
    kept = np.flatnonzero((count >= LEAST_ROWS) | ((np.arange(slots) < sparse_from) & (count > 0)))
    number = np.full(slots, -1, np.int32)
    number[kept] = np.arange(len(kept))
    used = number[rows.slot] >= 0
    slot, value, row = number[rows.slot][used], rows.value[used], rows.row[used]
    lasso = np.where(kept < sparse_from, 0, least)
    w, scale = np.zeros(len(kept)), np.full(len(kept), 1e-8)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for _ in range(rounds):
        miss = (y - _sigmoid(np.bincount(row, w[slot] * value, len(rows)))) * share
        g = np.bincount(slot, miss[row] * value, len(kept)) - decay * w
        scale += g * g
        step = rate / np.sqrt(scale)
        w += step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
    out = np.zeros(slots)
    out[kept] = w
    return out


def margin(rows: Rows, w: np.ndarray) -> np.ndarray:
    return np.bincount(rows.row, w[rows.slot] * rows.value, len(rows))


def calibration(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Bias and slopes of a logistic regression on few dense columns, by Newton's method with a small prior."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(x.shape[1])
    prior = np.eye(x.shape[1]) * 1e-2
    for _ in range(min(rounds, 30)):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (y - p) - prior @ w)
    return w


@dataclass
class CoTrained:
    """Two views' weights, their calibrations, and how the calibrated views combine; None without two classes."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    of_text: np.ndarray = field(default_factory=lambda: np.zeros(2))
    of_meta: np.ndarray = field(default_factory=lambda: np.zeros(2))
    both: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float = 0.5

    def logits(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of each view."""
        if self.text is None:
            return np.full(len(text), np.nan), np.full(len(text), np.nan)
        return self.of_text[0] + self.of_text[1] * margin(text, self.text), self.of_meta[0] + self.of_meta[1] * margin(meta, self.meta)

    def views(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both."""
        if self.text is None:
            return tuple(np.full(len(text), self.prior) for _ in range(3))
        a, b = self.logits(text, meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both[0] + self.both[1] * a + self.both[2] * b)

    def sure(self, confidence: float, lift: float) -> tuple[float, float]:
        """Log odds from which a view is sure of class 1, and those of class 0.

        A view must be `confidence` sure and `lift` times surer than the share of the class makes it: one that tells
        the classes no better than chance teaches nothing, however rare a class is.
        """
        odds = np.log(max(self.prior, 1e-9) / max(1 - self.prior, 1e-9))
        least = np.log(confidence / (1 - confidence))
        return max(least, odds + np.log(lift)), max(least, -odds + np.log(lift))


def fitted(text: Rows, meta: Rows, y: np.ndarray, fold: np.ndarray, given: tuple[np.ndarray, np.ndarray]) -> CoTrained:
    """Fits both views, each on its own labels `given` (-1: none).

    y: the true labels (-1: none). fold: 0 calibrates the views and tells how sure they are, 1 fits their combination;
    neither is trained on.
    """
    known, first, second = y >= 0, (y >= 0) & (fold == 0), (y >= 0) & (fold == 1)
    train = known & (fold > 1)
    if min((y[part] == label).sum() for part in (train, first, second) for label in (0, 1)) == 0:
        return CoTrained(prior=float(y[known].mean()) if known.any() else 0.5)
    models, maps, logits = [], [], []
    for rows, slots, sparse_from, labels in ((text, STATS + WORD_SLOTS, STATS, given[0]), (meta, META_SLOTS, META_SLOTS, given[1])):
        at = np.flatnonzero(labels >= 0)
        models.append(logistic(rows.take(at), labels[at], slots, sparse_from))
        m = margin(rows, models[-1])
        maps.append(calibration(m[first][:, None], y[first]))
        logits.append(maps[-1][0] + maps[-1][1] * m)
    both = calibration(np.column_stack([x[second] for x in logits]), y[second])
    return CoTrained(*models, *maps, both, float(y[train].mean()))


def own_labels(y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What both views are trained on before any exchange."""
    train = np.where((y >= 0) & (fold > 1), y, -1)
    return train.copy(), train.copy()


# --- the operator ------------------------------------------------------------------------------------------------

TASKS = ("quality", "toxic")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), have("source").alias("source"), have("lang").alias("lang"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"))


def _views(part: pa.RecordBatch) -> tuple[Rows, Rows]:
    return views_of(part.column("text"), part.column("source"), part.column("lang"))


def _of_task(task: int, text: Rows) -> Rows:
    """quality: what a text is like, its words scaled; toxic: what it holds."""
    return unit(text) if task == 0 else text


@dataclass
class Training:
    """Training rows on the driver: both views, ids, and the labels of each task (-1: none)."""

    text: Rows
    meta: Rows
    ids: np.ndarray
    labels: list[np.ndarray]

    def joined(self, other: Training) -> Training:
        both = [Rows(*(np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("slot", "value")), np.concatenate([a.at, b.at[1:] + a.at[-1]])) for a, b in ((self.text, other.text), (self.meta, other.meta))]
        return Training(*both, np.concatenate([self.ids, other.ids]), [np.concatenate(x) for x in zip(self.labels, other.labels)])


def _brought(rows: DataFrame, chosen: DataFrame, columns: list[str]) -> tuple[Training, list[np.ndarray]]:
    """The views of the chosen rows (id, own, and int columns), each once: their number is bounded by parameters."""
    met = rows.join(F.broadcast(chosen), ["id", "own"])
    # Equal ids and texts may differ in source or lang: the smallest counts.
    met = met.groupBy("id", "own").agg(F.min(F.struct("text", "source", "lang")).alias("d"), *(F.max(c).alias(c) for c in columns)).select("id", "own", "d.*", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                lists = []
                for view in _views(part):
                    at = pa.array(view.at.astype(np.int32))
                    lists += [pa.ListArray.from_arrays(at, pa.array(view.slot.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(view.value.astype(np.float32)))]
                yield pa.record_batch([*(part.column(c) for c in ("id", "own", *columns)), *lists], names=["id", "own", *columns, "ts", "tv", "ms", "mv"])

    out = met.mapInArrow(run, "id long, own long, " + "".join(f"{c} int, " for c in columns) + "ts array<int>, tv array<float>, ms array<int>, mv array<float>")
    table = out.orderBy("id", "own").toArrow().combine_chunks()
    views = []
    for s, v in (("ts", "tv"), ("ms", "mv")):
        lists = table.column(s).combine_chunks()
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        views.append(Rows(lists.flatten().to_numpy(), table.column(v).combine_chunks().flatten().to_numpy(), at))
    ints = [pc.fill_null(table.column(c), -1).to_numpy() for c in columns]
    return Training(*views, pc.fill_null(table.column("id"), 0).to_numpy(), []), ints


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, most: int) -> Training:
    """At most `most` labelled rows, the smallest by hash of their id; of a repeated id the text of the smallest hash."""
    known = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    ids = rows.where("id is not null").groupBy("id").agg(F.min("own").alias("own"))
    chosen = common.written(ids.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(most), "cotrain-labelled")
    out, ints = _brought(rows, chosen, list(TASKS))
    out.text = out.text.common(STATS + WORD_SLOTS, STATS)
    out.labels = ints
    return out


def taught(rows: DataFrame, known: DataFrame, models: list[CoTrained], most: int, confidence: float, lift: float) -> DataFrame:
    """Rows (id, own, and what each view is to learn: to_text_quality, ... of 0 or 1): the surest of all unlabelled rows.

    Every unlabelled row is scored by both views. All unlabelled rows are dealt into pools by a hash, `most` for each task
    and view, divided among the classes as the labels are; of each pool the surest row is taken, if any is sure.
    Ties go by id and text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                text, meta = _views(part)
                ids, own = part.column("id"), part.column("own")
                for task, model in enumerate(models):
                    if model.text is None:
                        continue
                    bounds = model.sure(confidence, lift)
                    for view, x in enumerate(model.logits(_of_task(task, text), meta)):
                        for label, odds, least in ((1, x, bounds[0]), (0, -x, bounds[1])):
                            at = np.flatnonzero(odds >= least)
                            if len(at):
                                kind = np.full(len(at), (task * 2 + view) * 2 + label)
                                yield pa.record_batch([ids.take(pa.array(at)), own.take(pa.array(at)), pa.array(kind), pa.array(odds[at])], names=["id", "own", "kind", "odds"])

    free = rows.join(known, "id", "left_anti")
    sure = free.mapInArrow(run, "id long, own long, kind long, odds double").dropDuplicates(["id", "own", "kind"])
    pools = F.lit(1)
    for task, model in enumerate(models):
        for view in (0, 1):
            for label, part in ((1, model.prior), (0, 1 - model.prior)):
                pools = F.when(F.col("kind") == (task * 2 + view) * 2 + label, max(1, int(np.ceil(most * part)))).otherwise(pools)
    # Pools by hash: the surest of each, so that what is taught is as varied as the documents are.
    first = F.min(F.struct((-F.col("odds")).alias("odds"), "id", "own")).alias("s")
    best = sure.groupBy("kind", F.pmod(F.xxhash64("id", "own"), pools).alias("pool")).agg(first).select("kind", "s.id", "s.own")
    # View 0 is the text: it teaches the metadata view, and the other way round.
    columns = [F.max(F.when(F.expr(f"kind div 2 = {2 * task + 1 - view}"), F.col("kind") % 2)).cast("int").alias(f"to_{name}_{TASKS[task]}") for task in (0, 1) for view, name in enumerate(("text", "meta"))]
    return best.groupBy("id", "own").agg(*columns)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, most_taught: int, rounds: int, confidence: float = 0.95, lift: float = 10.0, share: float = 0.1) -> list[CoTrained]:
    """Co-trained models of quality and toxic.

    Each round fits both views, scores all unlabelled documents with both, and adds the surest to what the other view is
    trained on: `share` as many as there are training rows in the first round, twice as many in the second and so on,
    `most_taught` at most. A document may be taught once by each view; labels in the labels table are never overruled.
    """
    rows = _columns(docs, id_col, text_col)
    training = labelled(rows, labels, id_col, most)
    known = labels.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    known = common.written(known, "cotrain-known")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in training.ids.tolist()], np.int64)
    given = [own_labels(y, fold) for y in training.labels]
    models = []
    for turn in range(rounds + 1):
        models = [fitted(_of_task(t, training.text), training.meta, y, fold, g) for t, (y, g) in enumerate(zip(training.labels, given))]
        if turn == rounds or all(m.text is None for m in models):
            break
        columns = [f"to_{v}_{t}" for t in TASKS for v in ("text", "meta")]
        pools = min(most_taught, int(np.ceil(share * (turn + 1) * (fold > 1).sum())))
        chosen = common.written(taught(rows, known, models, pools, confidence, lift), f"cotrain-taught{turn}")
        if chosen.isEmpty():
            break
        more, ints = _brought(rows, chosen, columns)
        # What was taught in earlier rounds is chosen anew by better models.
        n, k = int((fold >= 0).sum()), len(more.ids)
        base = Training(training.text.take(np.arange(n)), training.meta.take(np.arange(n)), training.ids[:n], [y[:n] for y in training.labels])
        more.labels = [np.full(k, -1, base.labels[0].dtype) for _ in TASKS]
        training = base.joined(more)
        fold = np.concatenate([fold[:n], np.full(k, -1)])
        given = [tuple(np.concatenate([own, told]) for own, told in zip(own_labels(base.labels[t], fold[:n]), ints[2 * t : 2 * t + 2])) for t in (0, 1)]
    if models[1].text is None and not (training.labels[1] >= 0).any():
        models[1].prior = 0.0
    return models


def _scorer(models: list[CoTrained], good: float, bad: float):
    def score(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        text, meta = _views(part)
        a, b, q = models[0].views(_of_task(0, text), meta)
        t = models[1].views(_of_task(1, text), meta)[2]
        return a, b, q, t, (q >= good) & (t < bad)

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, most_taught: int = MOST_TAUGHT, rounds: int = 3, good: float = 0.5, bad: float = 0.8) -> DataFrame:
    """Rows (id, p_text, p_meta, quality, toxic, accepted) for every row of docs.

    labels: rows (id, quality, toxic) of 0 or 1. The co-trained pair is fitted on at most `most` labelled documents
    (the smallest by hash of their id; repeated labels: the worse) and what the views teach each other of all the
    others, once for quality and once for toxic; every document is scored. p_text and p_meta are the calibrated views of
    quality, quality and toxic the combined probabilities; accepted if quality is `good` or more and toxic below `bad`.
    Where labels lack a class, all get the share of the other (0.5 without labels; without toxic labels toxic is 0). A
    null text is empty; a missing or null source or lang is a value of its own; null and repeated ids are scored as
    they come; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col, most, most_taught, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, good, bad)
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield pa.record_batch([part.column("id"), *map(pa.array, score(part))], names=[id_col, "p_text", "p_meta", "quality", "toxic", "accepted"])

    rows = _columns(docs, id_col, text_col).drop("own")
    return rows.mapInArrow(run, f"{id_col} long, p_text double, p_meta double, quality double, toxic double, accepted boolean")


def accepted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = 0.5, bad: float = 0.8) -> DataFrame:
    """The rows of docs that `classify` accepts, with all their columns: each row is judged by itself, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col, MOST_LABELLED, MOST_TAUGHT, 3))
    names = docs.columns
    at = {c: names.index(c) for c in ("source", "lang") if c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value, good, bad)
        for batch in batches:
            text = batch.column(names.index(text_col)).cast(pa.string())
            none = pa.nulls(len(batch), pa.string())
            judged = pa.record_batch([text, *(batch.column(at[c]).cast(pa.string()) if c in at else none for c in ("source", "lang")), pa.array(np.arange(len(batch)))], names=["text", "source", "lang", "row"])
            keep = np.zeros(len(batch), bool)
            for part in common.slices(judged, "text"):
                keep[part.column("row").to_numpy()] = score(part)[4]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
