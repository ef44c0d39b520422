"""Linear-chain conditional random fields on binary features, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

#: Score of what a model rules out.
NEVER = -1e4


class Model:
    """Weights of named features for each label, of label pairs and of first labels."""

    def __init__(self, labels: Sequence[str]) -> None:
        self.labels, self.index = list(labels), {}
        s = len(self.labels)
        self.weights, self.pairs, self.first = np.zeros((0, s)), np.zeros((s, s)), np.zeros(s)

    def _ids(self, features: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        known = [[self.index[f] for f in token if f in self.index] for token in features]
        sizes = np.array([len(k) for k in known], np.int64)
        return np.array([i for k in known for i in k], np.int64), sizes

    def emissions(self, features: Sequence[Sequence[str]]) -> np.ndarray:
        """Scores (tokens x labels); unknown features count nothing."""
        ids, sizes = self._ids(features)
        out = np.zeros((len(features), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(sizes)), sizes), self.weights[ids])
        return out

    def fit(self, sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[str]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3, least: int = 3) -> Model:
        """Maximum likelihood with a Gaussian prior, by AdaGrad on all sequences at once; deterministic.

        Features of fewer than `least` tokens are left out.
        """
        flat = [token for seq in sequences for token in seq]
        seen = Counter(f for token in flat for f in token)
        self.index = {name: i for i, name in enumerate(sorted(f for f, c in seen.items() if c >= least))}
        s = len(self.labels)
        self.weights = np.zeros((len(self.index), s))
        ids, sizes = self._ids(flat)
        token = np.repeat(np.arange(len(flat)), sizes)
        number = {x: i for i, x in enumerate(self.labels)}
        gold = np.array([number[y] for seq in labels for y in seq], np.int64)
        length = np.array([len(x) for x in sequences])
        begin = np.cumsum(length) - length
        n, t = len(sequences), int(length.max())
        inside = np.arange(t) < length[:, None]
        place = np.minimum(begin[:, None] + np.arange(t), len(flat) - 1)
        target = np.zeros((len(flat), s))
        target[np.arange(len(flat)), gold] = 1
        want_pairs = np.zeros((s, s))
        follows = np.ones(len(flat), bool)
        follows[begin] = False
        at = np.flatnonzero(follows)
        np.add.at(want_pairs, (gold[at - 1], gold[at]), 1)
        want_first = np.bincount(gold[begin], minlength=s).astype(float)
        scale = [np.full_like(w, 1e-8) for w in (self.weights, self.pairs, self.first)]
        for _ in range(rounds):
            e = np.zeros((len(flat), s))
            np.add.at(e, token, self.weights[ids])
            e = np.where(inside[:, :, None], e[place], 0)
            alpha, beta = np.zeros((n, t, s)), np.zeros((n, t, s))
            alpha[:, 0] = self.first + e[:, 0]
            for i in range(1, t):
                step = _log_sum(alpha[:, i - 1, :, None] + self.pairs, 1) + e[:, i]
                alpha[:, i] = np.where(inside[:, i, None], step, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                step = _log_sum(self.pairs + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(inside[:, i + 1, None], step, 0)
            total = _log_sum(alpha[:, -1], 1)
            single = np.exp(alpha + beta - total[:, None, None])[inside]
            double = np.zeros((s, s))
            for i in range(1, t):
                p = np.exp(alpha[:, i - 1, :, None] + self.pairs + (e[:, i] + beta[:, i])[:, None, :] - total[:, None, None])
                double += p[inside[:, i]].sum(0)
            miss = target - single
            grad = np.zeros_like(self.weights)
            np.add.at(grad, ids, miss[token])
            first = np.exp(alpha[:, 0] + beta[:, 0] - total[:, None]).sum(0)
            grads = (grad, want_pairs - double, want_first - first)
            for w, g, h in zip((self.weights, self.pairs, self.first), grads, scale):
                g = g / n - decay * w
                h += g * g
                w += rate * g / np.sqrt(h)
        return self

    def decode(self, emissions: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi for many sequences, one after the other in `emissions`: the best label number of each token.

        Sequences of like length are decoded together, a step of all at a time.
        """
        out = np.zeros(len(emissions), np.int64)
        begin = np.cumsum(length) - length
        order = np.argsort(length, kind="stable")
        for group in np.array_split(order, max(1, -(-len(order) // 512))):
            group = group[length[group] > 0]
            if not len(group):
                continue
            size, t = length[group], int(length[group].max())
            place = np.minimum(begin[group][:, None] + np.arange(t), len(emissions) - 1)
            inside = np.arange(t) < size[:, None]
            best = self.first + emissions[place[:, 0]]
            back = np.zeros((t, len(group), len(self.labels)), np.int8)
            for i in range(1, t):
                paths = best[:, :, None] + self.pairs
                back[i] = np.where(inside[:, i, None], paths.argmax(1), np.arange(len(self.labels)))
                best = np.where(inside[:, i, None], paths.max(1) + emissions[place[:, i]], best)
            label = best.argmax(1)
            for i in range(t - 1, -1, -1):
                here = inside[:, i]
                out[place[here, i]] = label[here]
                label = back[i, np.arange(len(group)), label]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
