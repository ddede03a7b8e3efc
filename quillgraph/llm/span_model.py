"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are read as classes (a letter, a digit, a mark). Both directions run as one
stacked recurrence; emissions go into a linear-chain CRF that is trained by its exact
gradient with Adam. All draws come from one seed.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, HIDDEN = 96, 16
PAD, OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3, 4
_MARKS = "@.+-_%()[]/:,\n"
CLASSES = 5 + len(_MARKS) + 26
_TABLE = np.full(128, OTHER, np.uint8)
for _i, _c in enumerate(_MARKS):
    _TABLE[ord(_c)] = 5 + _i
for _i in range(26):
    _TABLE[97 + _i] = _TABLE[65 + _i] = 5 + len(_MARKS) + _i
_TABLE[48:58] = DIGIT
for _c in " \t\r\x0b\x0c":
    _TABLE[ord(_c)] = SPACE


def classes(text: str) -> np.ndarray:
    """Class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], np.uint8(LETTER))


def _tanh_gates(z: np.ndarray, h: int) -> np.ndarray:
    """Sigmoid on input, forget and output gates, tanh on the candidate (last part)."""
    z[..., : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[..., : 3 * h] *= 0.5
    z[..., : 3 * h] += 0.5
    return z


class Model:
    def __init__(self, seed: int = 5) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {
            "x": rng.normal(0, 0.3, (2, CLASSES, 4 * h)).astype(np.float32),
            "u": rng.normal(0, 0.6 / np.sqrt(h), (2, h, 4 * h)).astype(np.float32),
            "o": rng.normal(0, 0.3, (2 * h, TAGS)).astype(np.float32),
            "b": np.zeros(TAGS, np.float32),
            "t": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["x"][:, :, h : 2 * h] += 1.0  # remember at first

    def emissions(self, c: np.ndarray, keep: bool = False):
        """Emissions of windows of classes (n, steps); with ``keep`` also what backward needs."""
        p, h, (n, steps) = self.p, HIDDEN, c.shape
        both = np.stack([c, c[:, ::-1]])
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        kept = []
        for s in range(steps):
            z = np.stack([p["x"][0][both[0, :, s]], p["x"][1][both[1, :, s]]])
            z += hid @ p["u"]
            _tanh_gates(z, h)
            i, f, o, g = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
            before, last = cell, hid
            cell = f * cell + i * g
            tc = np.tanh(cell)
            hid = o * tc
            out[s] = hid
            if keep:
                kept.append((z, before, tc, last))
        top = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)  # steps, n, 2h
        e = top @ p["o"] + p["b"]
        return (e, both, kept, top) if keep else e

    def gradient(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h, (n, steps) = self.p, HIDDEN, c.shape
        e, both, kept, top = self.emissions(c, keep=True)
        e = e.astype(np.float64)
        t = p["t"].astype(np.float64)
        alpha = np.empty_like(e)
        beta = np.zeros_like(e)

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)

        alpha[0] = e[0]
        for s in range(1, steps):
            alpha[s] = e[s] + lse(alpha[s - 1][:, :, None] + t, 1)
        for s in range(steps - 2, -1, -1):
            beta[s] = lse(t[None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = sum(e[s, rows, y[:, s]].sum() for s in range(steps)) + sum(t[y[:, s - 1], y[:, s]].sum() for s in range(1, steps))
        ge = np.exp(alpha + beta - z[None, :, None])
        for s in range(steps):
            ge[s, rows, y[:, s]] -= 1
        gt = np.zeros((TAGS, TAGS))
        for s in range(1, steps):
            gt += np.exp(alpha[s - 1][:, :, None] + t + (e[s] + beta[s] - z[:, None])[:, None, :]).sum(0)
            np.add.at(gt, (y[:, s - 1], y[:, s]), -1)
        ge = (ge / n).astype(np.float32)
        g = {"t": (gt / n).astype(np.float32), "b": ge.sum((0, 1)), "o": np.einsum("snh,snk->hk", top, ge), "x": np.zeros_like(p["x"]), "u": np.zeros_like(p["u"])}
        gtop = ge @ p["o"].T
        ghid = np.stack([gtop[..., :h], gtop[::-1, :, h:]], axis=1)  # steps, 2, n, h
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for s in range(steps - 1, -1, -1):
            zz, before, tc, last = kept[s]
            i, f, o, gg = zz[..., :h], zz[..., h : 2 * h], zz[..., 2 * h : 3 * h], zz[..., 3 * h :]
            dh = dh + ghid[s]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=2)
            for d in (0, 1):
                g["x"][d] += _scatter(both[d, :, s], dz[d])
                g["u"][d] += last[d].T @ dz[d]
            dh = dz @ p["u"].transpose(0, 2, 1)
            dc = dc * f
        return float(z.sum() - gold) / n, g

    def train(self, c: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.06, seed: int = 6) -> float:
        """Adam over random batches; returns the mean loss of the last steps."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for s in range(1, steps + 1):
            rows = rng.integers(0, len(c), batch)
            loss, g = self.gradient(c[rows], y[rows])
            losses.append(loss)
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2.0 * (1 - s / (steps + 1))) * min(1.0, 5.0 / (size + 1e-9))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                self.p[k] -= now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)
        return float(np.mean(losses[-20:]))

    def decode(self, c: np.ndarray) -> np.ndarray:
        """Best tags of windows by Viterbi: (n, steps)."""
        e, t = self.emissions(c), self.p["t"]
        steps, n, _ = e.shape
        back = np.empty((steps, n, TAGS), np.uint8)
        score = e[0]
        for s in range(1, steps):
            a = score[:, :, None] + t
            back[s] = a.argmax(1)
            score = a.max(1) + e[s]
        tags = np.empty((n, steps), np.uint8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for s in range(steps - 1, 0, -1):
            tags[:, s - 1] = back[s, rows, tags[:, s]]
        return tags


def _scatter(index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` by class."""
    return (index[None, :] == np.arange(CLASSES)[:, None]).astype(np.float32) @ values
