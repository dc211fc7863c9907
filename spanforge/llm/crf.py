"""A linear-chain conditional random field in numpy."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class LinearChain:
    """Binary features per position, weights per (feature, label), transitions per (label, label)."""

    def __init__(self, labels: list[str], vocabulary: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.labels, self.vocabulary = labels, vocabulary
        self.weights, self.transitions, self.start = weights, transitions, start

    @classmethod
    def fit(cls, sequences: list[list[list[str]]], tags: list[list[str]], labels: list[str], epochs: int = 8, rate: float = 0.1,
            l2: float = 1e-4, seed: int = 7) -> LinearChain:
        """Maximum conditional likelihood by Adagrad over shuffled sequences."""
        vocabulary: dict[str, int] = {}
        coded = [[[vocabulary.setdefault(f, len(vocabulary)) for f in set(fs)] for fs in seq] for seq in sequences]
        of = {t: i for i, t in enumerate(labels)}
        gold = [[of[t] for t in ts] for ts in tags]
        k, rng = len(labels), np.random.default_rng(seed)
        model = cls(labels, vocabulary, np.zeros((len(vocabulary), k)), np.zeros((k, k)), np.zeros(k))
        seen_w, seen_t, seen_s = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        for _ in range(epochs):
            for n in rng.permutation(len(coded)):
                seq, y = coded[n], gold[n]
                emit = np.array([model.weights[fs].sum(axis=0) for fs in seq])
                node, pair = model._marginals(emit)
                for i, t in enumerate(y):
                    node[i, t] -= 1.0
                ds = node[0].copy()
                dt = pair.sum(axis=0) if len(y) > 1 else np.zeros((k, k))
                for a, b in zip(y, y[1:]):
                    dt[a, b] -= 1.0
                for i, fs in enumerate(seq):
                    g = node[i] + l2 * model.weights[fs]
                    seen_w[fs] += g * g
                    model.weights[fs] -= rate * g / np.sqrt(seen_w[fs])
                seen_t += dt * dt
                model.transitions -= rate * dt / np.sqrt(seen_t)
                seen_s += ds * ds
                model.start -= rate * ds / np.sqrt(seen_s)
        return model

    def _marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = emit.shape
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        alpha[0] = self.start + emit[0]
        for i in range(1, n):
            alpha[i] = emit[i] + _logsumexp(alpha[i - 1][:, None] + self.transitions, 0)
        for i in range(n - 2, -1, -1):
            beta[i] = _logsumexp(self.transitions + (emit[i + 1] + beta[i + 1])[None, :], 1)
        z = _logsumexp(alpha[-1], 0)
        node = np.exp(alpha + beta - z)
        pair = np.exp(alpha[:-1, :, None] + self.transitions[None] + (emit + beta)[1:, None, :] - z) if n > 1 else np.zeros((0, k, k))
        return node, pair

    def save(self, path) -> None:
        np.savez_compressed(path, labels=np.array(self.labels), features=np.array(list(self.vocabulary)), weights=self.weights.astype(np.float32), transitions=self.transitions, start=self.start)

    @classmethod
    def load(cls, path) -> LinearChain:
        with np.load(path) as f:
            return cls(f["labels"].tolist(), {x: i for i, x in enumerate(f["features"].tolist())}, f["weights"].astype(np.float64), f["transitions"], f["start"])

    def decode(self, sequence: list[list[str]]) -> list[str]:
        """The most likely labels (Viterbi)."""
        return self.decode_all([sequence])[0]

    def decode_all(self, sequences: list[list[list[str]]]) -> list[list[str]]:
        """The most likely labels of many sequences (Viterbi), position by position for all that are so long."""
        known, none = self.vocabulary.get, len(self.weights)
        rows = [[v for f in fs if (v := known(f)) is not None] or [none] for seq in sequences for fs in seq]
        if not rows:
            return [[] for _ in sequences]
        weights = np.vstack([self.weights, np.zeros((1, len(self.labels)))])
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        emit = np.add.reduceat(weights[np.fromiter((v for r in rows for v in r), np.int64, int(sizes.sum()))], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        score = np.zeros((len(sequences), len(self.labels)))
        back: list[np.ndarray] = []
        for t in range(int(lengths.max())):
            live = order[: int((lengths > t).sum())]
            if t == 0:
                score[live] = self.start + emit[first[live]]
                continue
            through = score[live][:, :, None] + self.transitions
            pointers = np.zeros((len(sequences), len(self.labels)), np.int8)
            pointers[live] = through.argmax(axis=1)
            back.append(pointers)
            score[live] = through.max(axis=1) + emit[first[live] + t]
        best, out = score.argmax(axis=1), []
        for i, n in enumerate(lengths):
            path = [int(best[i])] if n else []
            for t in range(int(n) - 2, -1, -1):
                path.append(int(back[t][i, path[-1]]))
            out.append([self.labels[x] for x in reversed(path)])
        return out
