"""A bidirectional LSTM over sequences of blocks, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of a padded batch (batch, time, ...) back to front."""
    at = lengths[:, None] - 1 - np.arange(x.shape[1])[None, :]
    at = np.where(at >= 0, at, np.arange(x.shape[1])[None, :])
    return x[np.arange(len(x))[:, None], at]


def _run(pre: np.ndarray, u: np.ndarray, h: np.ndarray, c: np.ndarray, keep: bool = False):
    """The cell over ``pre``, (batch, time, 4 hidden); padding comes last, so
    what the cell makes of it reaches nothing."""
    n = u.shape[0]
    out = np.empty((*pre.shape[:2], n), pre.dtype)
    steps = []
    for t in range(pre.shape[1]):
        z = pre[:, t] + h @ u
        gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        before, below = c, h
        c = gates[:, n : 2 * n] * c + gates[:, :n] * g
        tc = np.tanh(c)
        h = gates[:, 2 * n :] * tc
        out[:, t] = h
        if keep:
            steps.append((gates, g, before, below, tc))
    return out, h, c, steps


def _back(grad: np.ndarray, u: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``pre`` and ``u`` from those of the outputs."""
    n = u.shape[0]
    dpre = np.empty((*grad.shape[:2], 4 * n), grad.dtype)
    du, dh, dc = np.zeros_like(u), np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    for t in range(grad.shape[1] - 1, -1, -1):
        gates, g, before, below, tc = steps[t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        dpre[:, t] = dz
        du += below.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dpre, du


@dataclass
class BlockLabeller:
    """``parts``: for each direction the input matrix, bias and recurrent matrix,
    then the output vector and its bias."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def fresh(n_inputs: int, hidden: int, seed: int) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        parts = {}
        for way in ("f", "b"):
            parts["w" + way] = rng.normal(0, 1 / np.sqrt(n_inputs), (n_inputs, 4 * hidden))
            parts["c" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
            parts["u" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        parts["v"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden)
        parts["d"] = np.zeros(1)
        return BlockLabeller({k: v.astype(np.float32) for k, v in parts.items()})

    @property
    def hidden(self) -> int:
        return len(self.parts["v"]) // 2

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of content of each block of a padded batch."""
        p, zero = self.parts, np.zeros((len(x), self.hidden), np.float32)
        forward = _run(x @ p["wf"] + p["cf"], p["uf"], zero, zero)[0]
        backward = _run(_reversed(x @ p["wb"] + p["cb"], lengths), p["ub"], zero, zero)[0]
        both = np.concatenate([forward, _reversed(backward, lengths)], 2)
        return _sigmoid(both @ p["v"] + p["d"])

    def long_scores(self, features, n: int, step: int) -> np.ndarray:
        """As ``scores`` for one sequence of ``n`` blocks, ``step`` at a time;
        ``features(a, b)`` makes the inputs of blocks a to b."""
        p, made = self.parts, {}
        for way in ("f", "b"):
            h = c = np.zeros((1, self.hidden), np.float32)
            made[way] = np.empty((n, self.hidden), np.float32)
            starts = range(0, n, step)
            for a in starts if way == "f" else reversed(starts):
                b = min(n, a + step)
                pre = features(a, b) @ p["w" + way] + p["c" + way]
                out, h, c, _ = _run((pre if way == "f" else pre[::-1])[None], p["u" + way], h, c)
                made[way][a:b] = out[0] if way == "f" else out[0][::-1]
        return _sigmoid(np.concatenate([made["f"], made["b"]], 1) @ p["v"] + p["d"])

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the blocks of a batch, and its gradients."""
        p, zero = self.parts, np.zeros((len(x), self.hidden), x.dtype)
        there = np.arange(x.shape[1])[None, :] < lengths[:, None]
        xb = _reversed(x, lengths)
        hf, _, _, sf = _run(x @ p["wf"] + p["cf"], p["uf"], zero, zero, keep=True)
        hb, _, _, sb = _run(xb @ p["wb"] + p["cb"], p["ub"], zero, zero, keep=True)
        both = np.concatenate([hf, _reversed(hb, lengths)], 2)
        s = _sigmoid(both @ p["v"] + p["d"])
        n = there.sum()
        loss = -np.where(there, y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7), 0).sum() / n
        ds = np.where(there, s - y, 0).astype(x.dtype) / x.dtype.type(n)
        dboth = ds[:, :, None] * p["v"]
        grads = {"v": np.einsum("bt,bth->h", ds, both), "d": ds.sum(keepdims=True).reshape(1)}
        for way, inputs, steps, dh in (("f", x, sf, dboth[:, :, : self.hidden]), ("b", xb, sb, _reversed(dboth[:, :, self.hidden :], lengths))):
            dpre, grads["u" + way] = _back(np.where(there[:, :, None], dh, 0), p["u" + way], steps)
            dpre = np.where(there[:, :, None], dpre, 0)
            grads["w" + way] = np.einsum("btd,bth->dh", inputs, dpre, optimize=True)
            grads["c" + way] = dpre.sum((0, 1))
        return float(loss), grads

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, batch: int = 32, seed: int = 0) -> None:
        """Adam over batches of sequences of like length."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.parts.items()}
        square = {k: np.zeros_like(v) for k, v in self.parts.items()}
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        t = 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, y, lengths = padded([sequences[i] for i in groups[g]])
                _, grads = self.gradients(x, y, lengths)
                t += 1
                size = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
                scale = min(1.0, 5 / (size + 1e-9))
                for k, v in grads.items():
                    v = v * scale
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v**2
                    step = rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
                    self.parts[k] = (self.parts[k] - step).astype(np.float32)


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(y) for _, y in sequences])
    x = np.zeros((len(sequences), lengths.max(), sequences[0][0].shape[1]), np.float32)
    y = np.zeros(x.shape[:2], np.float32)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(b)], y[i, : len(b)] = a, b
    return x, y, lengths
