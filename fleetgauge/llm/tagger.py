"""A bidirectional LSTM over characters with CRF transitions between tags, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters by class: ASCII each for itself, others by what they are; 0 is padding.
CLASSES = 133


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    classes = np.where(codes < 128, codes + 1, 129)
    for i in np.flatnonzero(codes >= 128):
        c = text[i]
        classes[i] = 130 if c.isalpha() else 131 if c.isspace() else 132 if c.isdigit() else 129
    return classes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    steps, rows, _ = x.shape
    size = wh.shape[0]
    given = x @ wx + b
    h, c = np.zeros((rows, size), x.dtype), np.zeros((rows, size), x.dtype)
    out, cache = np.empty((steps, rows, size), x.dtype), []
    for t in range(steps):
        z = given[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        cache.append((i, f, o, g, tc, before))
    return out, cache


def _lstm_back(grad: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, cache: list) -> tuple:
    size = wh.shape[0]
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    dz_all, dwh = np.empty((*grad.shape[:2], 4 * size), x.dtype), np.zeros_like(wh)
    for t in range(len(grad) - 1, -1, -1):
        i, f, o, g, tc, (c, h) = cache[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwh += h.T @ dz
        dz_all[t] = dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * size)
    return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


class Tagger:
    """Learns tags 0..tags-1 of characters in windows of one length."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 3, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        shape = {
            "embed": (CLASSES, embed), "out": (2 * hidden, tags), "out_b": (tags,), "move": (tags, tags), "start": (tags,),
            **{f"{w}_{d}": s for d in "fb" for w, s in (("wx", (embed, 4 * hidden)), ("wh", (hidden, 4 * hidden)), ("b", (4 * hidden,)))},
        }
        self.p = {k: (rng.normal(0, 0.3 if len(s) > 1 else 0.0, s)).astype(kind) for k, s in shape.items()}
        self.p["move"] *= 0
        for d in "fb":
            self.p[f"b_{d}"][hidden : 2 * hidden] = 1  # remember at first

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores (steps, rows, tags) of characters (rows, steps)."""
        return self._forward(chars)[0]

    def _forward(self, chars: np.ndarray) -> tuple:
        p = self.p
        x = p["embed"][chars.T]
        ahead, cache_f = _lstm(x, p["wx_f"], p["wh_f"], p["b_f"])
        back, cache_b = _lstm(x[::-1], p["wx_b"], p["wh_b"], p["b_b"])
        h = np.concatenate([ahead, back[::-1]], axis=2)
        return h @ p["out"] + p["out_b"], (chars, x, h, cache_f, cache_b)

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        p = self.p
        scores, (chars, x, h, cache_f, cache_b) = self._forward(chars)
        steps, rows, _ = scores.shape
        tags, each = tags.T, np.arange(rows)
        alpha = np.empty_like(scores)
        alpha[0] = p["start"] + scores[0]
        for t in range(1, steps):
            alpha[t] = scores[t] + _lse(alpha[t - 1][:, :, None] + p["move"], 1)
        beta = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(p["move"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1], 1)
        share = np.exp(alpha + beta - total[:, None])
        grad = {"start": share[0].sum(axis=0) - np.bincount(tags[0], minlength=len(p["start"])), "move": np.zeros_like(p["move"])}
        own = p["start"][tags[0]] + scores[0][each, tags[0]]
        for t in range(steps - 1):
            pairs = np.exp(alpha[t][:, :, None] + p["move"] + (scores[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None])
            grad["move"] += pairs.sum(axis=0)
            np.add.at(grad["move"], (tags[t], tags[t + 1]), -1)
            own = own + p["move"][tags[t], tags[t + 1]] + scores[t + 1][each, tags[t + 1]]
        np.put_along_axis(share, tags[:, :, None], np.take_along_axis(share, tags[:, :, None], 2) - 1, 2)
        size = h.shape[2] // 2
        grad["out"] = h.reshape(-1, 2 * size).T @ share.reshape(-1, share.shape[2])
        grad["out_b"] = share.sum(axis=(0, 1))
        dh = share @ p["out"].T
        dx, grad["wx_f"], grad["wh_f"], grad["b_f"] = _lstm_back(dh[:, :, :size], x, p["wx_f"], p["wh_f"], cache_f)
        db, grad["wx_b"], grad["wh_b"], grad["b_b"] = _lstm_back(dh[::-1, :, size:], x[::-1], p["wx_b"], p["wh_b"], cache_b)
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], chars.T, dx + db[::-1])
        return float((total - own).mean()), {k: v / rows for k, v in grad.items()}

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int = 160, rows: int = 48, rate: float = 0.02, seed: int = 5) -> Tagger:
        """Adam over random batches; the rate falls to zero in a straight line."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.integers(0, len(chars), rows)
            _, grad = self.loss(chars[some], tags[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.p[k] = (self.p[k] - rate * (1 - step / (steps + 1)) * move).astype(self.p[k].dtype)
        return self

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence for scores (steps, tags)."""
        best, back = self.p["start"] + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            ways = best[:, None] + self.p["move"]
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[t]
        out = np.empty(len(scores), np.int64)
        out[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
