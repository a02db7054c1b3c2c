"""A byte convolutional network in numpy: embedding, filters of several widths, max pooling, softmax.

Trained on the driver on a bounded sample.  For use, embedding and filters fold into one table row per byte
pair, so a position costs a few table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTHS = (2, 3, 4)
EMBED = 8
FILTERS = 16
#: Positions a filter may look beyond its own; chunks overlap by at least this.
REACH = max(WIDTHS) - 1
#: Positions taken at once, so that the working set stays in a core's cache.
POSITIONS = 8192


@dataclass
class Network:
    """Parameters; ``classes`` are the values that the columns of the output stand for."""

    classes: list
    embed: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per width the rows to add up: by byte pair, and for width 3 by a last single byte."""
        out = []
        for w, kernel in zip(WIDTHS, self.kernels, strict=True):
            byte = [(self.embed @ kernel[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)]
            parts = [(byte[j][:, None, :] + byte[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            out.append((*parts, *([byte[-1]] if w % 2 else [])))
        return out


def logits(net: Network, tables: list[tuple[np.ndarray, ...]], windows: np.ndarray) -> np.ndarray:
    """(rows, classes) for uint8 windows (rows, length); zero bytes pad."""
    out = np.empty((len(windows), len(net.classes)), np.float32)
    length = windows.shape[1]
    step = max(1, POSITIONS // length)
    total, more = np.empty((2, step * length, FILTERS), np.float32)
    for lo in range(0, len(windows), step):
        b = windows[lo : lo + step]
        rows = len(b)
        pair = b[:, :-1].astype(np.intp)
        pair <<= 8
        pair += b[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = length - w + 1
            z = np.take(parts[0], pair[:, :n].ravel(), axis=0, out=total[: rows * n], mode="clip")
            if w == 3:
                z += np.take(parts[1], b[:, 2:].ravel(), axis=0, out=more[: rows * n], mode="clip")
            elif w == 4:
                z += np.take(parts[1], pair[:, 2:].ravel(), axis=0, out=more[: rows * n], mode="clip")
            pooled.append(z.reshape(rows, n, FILTERS).max(axis=1))
        out[lo : lo + step] = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.out_bias
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(raw: np.ndarray, offsets: np.ndarray, length: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every byte of every row, and each window's row; empty rows have none."""
    stride = length - overlap
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - overlap) // stride)), 0)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * stride
    padded = np.concatenate((raw, np.zeros(length, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)[start]
    end = offsets[1:][row] - start
    for i in np.flatnonzero(end < length):
        windows[i, end[i] :] = 0
    return windows, row


def train(texts: list[bytes], labels: list, length: int, seed: int = 11, steps: int = 700, batch: int = 64, rate: float = 4e-3) -> Network:
    """Adam on balanced batches; each example is one window at a random place of a text."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    by_class = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == c and t] for c in classes]
    k, hidden = len(classes), FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(hidden), "d": rng.normal(0, 0.2, (hidden, k)), "o": np.zeros(k)}
    p |= {f"k{w}": rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    first, second = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
    usable = [i for i, x in enumerate(by_class) if x]
    for step in range(1, steps + 1 if len(usable) > 1 else 1):
        y = np.array([usable[i] for i in rng.integers(0, len(usable), batch)])
        x = np.zeros((batch, length), np.uint8)
        for i, c in enumerate(y):
            text = by_class[c][rng.integers(len(by_class[c]))]
            size = length if rng.random() < 0.5 else int(length ** rng.uniform(0.5, 1))
            at = int(rng.integers(0, max(1, len(text) - size + 1)))
            piece = text[at : at + size]
            x[i, : len(piece)] = piece
        embedded = p["e"][x]
        pooled, places = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1)  # batch, places, embed, w
            cols = view.transpose(0, 1, 3, 2).reshape(batch, length - w + 1, w * EMBED)
            z = cols @ p[f"k{w}"]
            at = z.argmax(axis=1)
            places.append((cols, at))
            pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1) + p["b"]
        a = np.maximum(h, 0)
        prob = softmax(a @ p["d"] + p["o"])
        g = prob.copy()
        g[np.arange(batch), y] -= 1
        g /= batch
        grad = {"d": a.T @ g, "o": g.sum(axis=0)}
        gh = (g @ p["d"].T) * (h > 0)
        grad["b"] = gh.sum(axis=0)
        ge = np.zeros_like(p["e"])
        for n, w in enumerate(WIDTHS):
            cols, at = places[n]
            own = gh[:, n * FILTERS : (n + 1) * FILTERS]
            picked = cols[np.arange(batch)[:, None], at]  # batch, filters, w * embed
            grad[f"k{w}"] = np.einsum("bfi,bf->if", picked, own)
            back = (own[:, :, None] * p[f"k{w}"].T[None]).reshape(batch, FILTERS, w, EMBED)
            index = x[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(ge, index.ravel(), back.reshape(-1, EMBED))
        grad["e"] = ge
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for n, v in p.items():
            first[n] = 0.9 * first[n] + 0.1 * grad[n]
            second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
            v -= speed * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Network(classes, p["e"], [p[f"k{w}"] for w in WIDTHS], p["b"], p["d"], p["o"])
