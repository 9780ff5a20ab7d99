"""Main text of pages: a bidirectional LSTM labels every leaf block of a page in its context.

The network is small numpy code, trained here on pages whose labels are known (html_training);
the sample of real pages that lends them words is bounded.  Tasks read the weights only.  Pages
of like length run through the network together; a page runs whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.llm.html_blocks import DIM, Leaf, features, leaves_of
from loadgauge.llm.html_training import Maker

HIDDEN = 20
SAMPLE_PAGES = 60  # real pages that lend words
TRAIN_PAGES = 1200
EPOCHS = 14
BATCH = 16
RATE = 0.012
SEED = 3
CELLS = 40_000  # leaves, with padding, in the network at a time

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int = SEED, hidden: int = HIDDEN, dim: int = DIM) -> Weights:
    r = np.random.default_rng(seed)
    w: Weights = {}
    for side in "fb":
        w[f"x{side}"] = r.normal(0, 0.1, (dim, 4 * hidden))
        w[f"h{side}"] = r.normal(0, 0.15, (hidden, 4 * hidden))
        w[f"c{side}"] = np.zeros(4 * hidden)
        w[f"c{side}"][hidden : 2 * hidden] = 1  # forget gates start open
    w["o"] = r.normal(0, 0.2, (2 * hidden, 1))
    w["d"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: Weights, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states over time of one direction; x is (time, pages, features)."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    n = w[f"h{side}"].shape[0]
    h = np.zeros((x.shape[1], n), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((len(x), x.shape[1], n), np.float32)
    given = x @ w[f"x{side}"] + w[f"c{side}"]
    for t in steps:
        z = given[t] + h @ w[f"h{side}"]
        i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        m = mask[t][:, None]
        c_new = np.where(m, f * c + i * g, c)
        s = np.tanh(c_new)
        h_new = np.where(m, o * s, h)
        if keep is not None:
            keep.append((t, i, f, o, g, c, s, h))
        h, c = h_new, c_new
        out[t] = h
    return out


def chances(w: Weights, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate((_run(w, "f", x, mask), _run(w, "b", x, mask)), axis=2)
    return _sigmoid(both @ w["o"] + w["d"])[:, :, 0]


def gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """(mean loss per leaf, its gradients) by backpropagation through time in both directions."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: _run(w, side, x, mask, kept[side]) for side in "fb"}
    both = np.concatenate((states["f"], states["b"]), axis=2)
    p = _sigmoid(both @ w["o"] + w["d"])[:, :, 0]
    total = max(1, mask.sum())
    loss = -(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / total
    dz = ((p - y) * mask / total)[:, :, None].astype(np.float32)
    g: Weights = {"o": np.einsum("tbn,tbk->nk", both, dz), "d": dz.sum(axis=(0, 1))}
    d_both = dz @ w["o"].T
    n = w["hf"].shape[0]
    for k, side in enumerate("fb"):
        d_out = d_both[:, :, k * n : (k + 1) * n]
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        d_given = np.zeros((*x.shape[:2], 4 * n), np.float32)
        g[f"h{side}"] = np.zeros_like(w[f"h{side}"])
        for t, i, f, o, a, c, s, h in reversed(kept[side]):
            m = mask[t][:, None]
            dh = dh + d_out[t]
            live = np.where(m, dh, 0)
            ds = np.where(m, dc, 0) + live * o * (1 - s * s)
            d = np.concatenate((ds * a * i * (1 - i), ds * c * f * (1 - f), live * s * o * (1 - o), ds * i * (1 - a * a)), axis=1)
            d_given[t] = d
            g[f"h{side}"] += h.T @ d
            dh = np.where(m, d @ w[f"h{side}"].T, dh)
            dc = np.where(m, ds * f, dc)
        g[f"x{side}"] = np.einsum("tbd,tbk->dk", x, d_given, optimize=True)
        g[f"c{side}"] = d_given.sum(axis=(0, 1))
    return float(loss), g


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side: (time, pages, features) and where they have leaves."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for b, rows in enumerate(pages):
        x[: len(rows), b] = rows
        mask[: len(rows), b] = True
    return x, mask


def fit(pages: Sequence[np.ndarray], labels: Sequence[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Adam on batches of pages of like length; the same input gives the same weights."""
    w = new_weights(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    r = np.random.default_rng(seed)
    by_length = np.argsort([len(p) for p in pages], kind="stable")
    batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-3
        for k in r.permutation(len(batches)):
            x, mask = padded([pages[i] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for b, i in enumerate(batches[k]):
                y[: len(labels[i]), b] = labels[i]
            _, g = gradients(w, x, mask, y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for name in w:
                d = g[name] * min(1.0, 2.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def training_set(words: list[str], n: int = TRAIN_PAGES, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of ``n`` made pages."""
    maker = Maker(words, seed)
    pages, labels = [], []
    while len(pages) < n:
        source, main = maker.page()
        leaves = leaves_of(source)
        if leaves and len(leaves) == len(main):
            pages.append(features(leaves))
            labels.append(np.array(main, np.float32))
    return pages, labels


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, n: int = TRAIN_PAGES) -> Weights:
    """Weights learned on made pages with words of at most ``sample_pages`` real ones."""
    # The ids first: else every task would send its own pages to the driver.
    ids = pages.filter("page_id is not null and html is not null").select("page_id").distinct()
    chosen = [r.page_id for r in ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    rows = pages.filter(F.col("page_id").isin(chosen) & F.col("html").isNotNull()).select("html").limit(sample_pages).collect()
    words = sorted({w for r in rows for leaf in leaves_of(r.html) for w in leaf.text.split() if "<" not in w and "&" not in w})
    return fit(*training_set(words or ["word", "text", "page"], n))


def label(w: Weights, pages: Sequence[list[Leaf]]) -> list[np.ndarray]:
    """Whether each leaf of each page is main text; every page is read whole."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, leaves in enumerate(pages) if leaves), key=lambda i: len(pages[i]))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end - begin + 1) * len(pages[order[end]]) <= CELLS:
            end += 1
        group = order[begin:end]
        x, mask = padded([features(pages[i]) for i in group])
        p = chances(w, x, mask)
        for b, i in enumerate(group):
            out[i] = p[: len(pages[i]), b] > 0.5
        begin = end
    return out


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars: a row per row; main blocks in page order, joined by two \\n.

    Null and empty html give an empty text.  Rows that repeat a page give equal results; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                leaves = [leaves_of(x.as_py() or "") for x in part.column(2)]
                texts = [
                    "\n\n".join(leaf.text for leaf, main in zip(page, kept, strict=True) if main)
                    for page, kept in zip(leaves, label(weights, leaves), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
