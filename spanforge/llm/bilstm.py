"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Parameters: emb (ids, E); for each direction W (E, 4H), U (H, 4H), b (4H); out (2H, K), ob (K);
    trans (K, K), start (K). Gates in the order input, forget, output, candidate."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = {k: np.ascontiguousarray(v, dtype=F32) for k, v in params.items()}
        self.hidden = self.p["Uf"].shape[0]
        self._tables()

    @classmethod
    def new(cls, ids: int, tags: int, emb: int = 24, hidden: int = 48, seed: int = 3) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        u = lambda *s: rng.uniform(-1, 1, s) / np.sqrt(s[0])
        p = {"emb": rng.normal(0, 0.3, (ids, emb)), "out": u(2 * hidden, tags), "ob": np.zeros(tags), "trans": np.zeros((tags, tags)), "start": np.zeros(tags)}
        for d in "fb":
            p |= {f"W{d}": u(emb, 4 * hidden), f"U{d}": u(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden)}
            p[f"b{d}"][hidden : 2 * hidden] = 1.0
        return cls(p)

    def _tables(self) -> None:
        """The input part of the gates for every id, and the weights scaled so that one tanh serves all
        gates: sigmoid(x) = tanh(x / 2) / 2 + 1 / 2."""
        scale = np.ones(4 * self.hidden, F32)
        scale[: 3 * self.hidden] = 0.5
        self.table = {d: ((self.p["emb"] @ self.p[f"W{d}"] + self.p[f"b{d}"]) * scale).astype(F32) for d in "fb"}
        self.rec = {d: np.ascontiguousarray(self.p[f"U{d}"] * scale, dtype=F32) for d in "fb"}

    def _run(self, ids: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """Hidden states (T, B, H); ids is (T, B). Padding has id 0 and keeps the state at zero; where the
        columns are in order, the longest first, no work is done on it."""
        t_max, b = ids.shape
        h_dim, table, rec = self.hidden, self.table[d], self.rec[d]
        hs = np.zeros((t_max, b, h_dim), F32)
        h, c = np.zeros((b, h_dim), F32), np.zeros((b, h_dim), F32)
        if keep is not None:
            keep |= {"gates": np.zeros((t_max, b, 4 * h_dim), F32), "c": np.zeros((t_max, b, h_dim), F32), "tc": np.zeros((t_max, b, h_dim), F32)}
        mask = ids != 0
        live = mask.sum(axis=1)
        ordered = bool((mask[:, 1:] <= mask[:, :-1]).all()) and keep is None
        buffers = [np.empty((b, n * h_dim), F32) for n in (4, 4, 1, 1)]
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            k = live[t] if ordered else b
            z, x, tc, u = (a[:k] for a in buffers)
            now = c[:k]
            np.dot(h[:k], rec, out=z)
            z += np.take(table, ids[t, :k], axis=0, out=x, mode="clip")
            np.tanh(z, out=z)
            s = z[:, : 3 * h_dim]
            s *= 0.5
            s += 0.5
            now *= z[:, h_dim : 2 * h_dim]
            now += np.multiply(z[:, :h_dim], z[:, 3 * h_dim :], out=u)
            if live[t] < k:
                now *= mask[t][:, None]
            np.tanh(now, out=tc)
            h = hs[t]
            np.multiply(z[:, 2 * h_dim : 3 * h_dim], tc, out=h[:k])
            if keep is not None:
                keep["gates"][t], keep["c"][t], keep["tc"][t] = z, c, tc
        return hs

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, K) scores of the tags."""
        h = self.hidden
        t, b = ids.shape
        e = self._run(ids, "f").reshape(t * b, h) @ self.p["out"][:h]
        e += self._run(ids, "b").reshape(t * b, h) @ self.p["out"][h:]
        return (e + self.p["ob"]).reshape(t, b, -1)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags (T, B), margin (T, B)): Viterbi paths, 0 beyond the length, and how far the score of the
        chosen tag is above that of tag 0. Columns whose best path is provably all 0 are not searched:
        no tag gains there on tag 0 even with the best transitions."""
        emit = self.emissions(ids)
        t_max, b, k = emit.shape
        trans, start = self.p["trans"], self.p["start"]
        valid = np.arange(t_max)[:, None] < lengths[None, :]
        gain = max(float((trans - trans[0, 0]).max()), float((start - start[0]).max()), 0.0)
        lead = (emit[:, :, 1:].max(axis=2) - emit[:, :, 0] + 2 * gain) * valid
        tags = np.zeros((t_max, b), np.int8)
        search = np.flatnonzero((lead > 0).any(axis=0))
        if len(search):
            e, n = np.ascontiguousarray(emit[:, search].transpose(0, 2, 1)), lengths[search]
            scores = np.empty((t_max, k, len(search)), F32)
            scores[0] = start[:, None] + e[0]
            for t in range(1, t_max):
                np.add((scores[t - 1][:, None, :] + trans[:, :, None]).max(axis=0), e[t], out=scores[t])
            now = scores[n - 1, :, np.arange(len(search))].argmax(axis=1)
            for t in range(t_max - 1, -1, -1):
                if t < t_max - 1:
                    now = np.where(t + 1 < n, (scores[t] + trans.T[now].T).argmax(axis=0), now)
                tags[t, search] = np.where(t < n, now, 0)
        margin = np.take_along_axis(emit, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - emit[:, :, 0]
        return tags, margin

    def gradients(self, ids: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per sequence, and its gradients by back-propagation through time."""
        h_dim, p = self.hidden, self.p
        t_max, b = ids.shape
        kept: dict[str, dict] = {"f": {}, "b": {}}
        hs = {d: self._run(ids, d, kept[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        emit = both @ p["out"] + p["ob"]
        k = emit.shape[2]
        live = (np.arange(t_max)[:, None] < lengths[None, :]).astype(F32)
        alpha, beta = np.zeros((t_max, b, k), F32), np.zeros((t_max, b, k), F32)
        alpha[0] = p["start"] + emit[0]
        for t in range(1, t_max):
            new = _logsumexp(alpha[t - 1][:, :, None] + p["trans"], 1) + emit[t]
            alpha[t] = np.where(live[t][:, None] > 0, new, alpha[t - 1])
        z = _logsumexp(alpha[-1], 1)
        for t in range(t_max - 2, -1, -1):
            new = _logsumexp(p["trans"] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[t + 1][:, None] > 0, new, 0)
        node = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        rows = np.arange(b)
        d_emit = node.copy()
        score = p["start"][gold[0]] + emit[0, rows, gold[0]]
        d_trans, d_start = np.zeros_like(p["trans"]), node[0].sum(axis=0)
        np.add.at(d_start, gold[0], -1)
        for t in range(t_max):
            d_emit[t, rows, gold[t]] -= live[t]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + p["trans"] + (emit[t] + beta[t])[:, None, :] - z[:, None, None]) * live[t][:, None, None]
                d_trans += pair.sum(axis=0)
                np.add.at(d_trans, (gold[t - 1], gold[t]), -live[t])
                score = score + live[t] * (p["trans"][gold[t - 1], gold[t]] + emit[t, rows, gold[t]])
        d_emit /= b
        g = {"trans": d_trans / b, "start": d_start / b, "out": np.einsum("tbh,tbk->hk", both, d_emit, optimize=True), "ob": d_emit.sum(axis=(0, 1)), "emb": np.zeros_like(p["emb"])}
        d_both = d_emit @ p["out"].T
        for d, part in (("f", d_both[:, :, :h_dim]), ("b", d_both[:, :, h_dim:])):
            gates, cs, tcs = (kept[d][x] for x in ("gates", "c", "tc"))
            dz = np.zeros_like(gates)
            dh, dc = np.zeros((b, h_dim), F32), np.zeros((b, h_dim), F32)
            order = list(range(t_max)) if d == "f" else list(range(t_max - 1, -1, -1))
            for i in range(t_max - 1, -1, -1):
                t = order[i]
                gi, gf, go, gc = (gates[t][:, j * h_dim : (j + 1) * h_dim] for j in range(4))
                dh = dh + part[t]
                dc = (dc + dh * go * (1 - tcs[t] ** 2)) * live[t][:, None]
                before = cs[order[i - 1]] if i else np.zeros_like(dc)
                dz[t, :, :h_dim] = dc * gc * gi * (1 - gi)
                dz[t, :, h_dim : 2 * h_dim] = dc * before * gf * (1 - gf)
                dz[t, :, 2 * h_dim : 3 * h_dim] = dh * tcs[t] * go * (1 - go) * live[t][:, None]
                dz[t, :, 3 * h_dim :] = dc * gi * (1 - gc**2)
                dh = dz[t] @ p[f"U{d}"].T
                dc = dc * gf
            flat = dz.reshape(-1, 4 * h_dim)
            earlier = np.zeros_like(hs[d])
            if d == "f":
                earlier[1:] = hs[d][:-1]
            else:
                earlier[:-1] = hs[d][1:]
            g[f"U{d}"] = earlier.reshape(-1, h_dim).T @ flat
            x = p["emb"][ids.ravel()]
            g[f"W{d}"] = x.T @ flat
            g[f"b{d}"] = flat.sum(axis=0)
            np.add.at(g["emb"], ids.ravel(), flat @ p[f"W{d}"].T)
        return float((z - score).mean()), g


class Adam:
    def __init__(self, model: BiLstmCrf, rate: float = 3e-3):
        self.model, self.rate, self.n = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        factor = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = (g * factor).astype(F32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.model.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(F32)
        self.model._tables()
