"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in the tasks on flat byte arrays.  Trees
are grown level by level on binned statistics of a bounded sample of labelled
rows (``max_rows``, chosen by a hash of the id) and flattened into arrays, which
are broadcast; a batch walks all trees at once by array look-ups.

Edge cases: NULL text is the empty text and is scored like one; NULL labels and
labels of unknown documents are not learned from; repeated labels of a document
count as their maximum; with no label, or one class only, every score is the
smoothed share of the class; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.llm.textbatch import pieces, utf8

MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST_ROWS = 64, 4, 60, 0.15, 20.0
FEATURES = (
    "log_bytes log_words word_bytes upper digits stops marks breaks blanks beyond_ascii marks_per_word shouts_per_word "
    "bars_per_word distinct_words repeated_next distinct_triples distinct_lines log_lines line_words capital_words ended_lines"
).split()
ROW_BYTES = 1 << 26


@functools.cache
def _classes() -> np.ndarray:
    """Class of each byte: 0 blank, 1 line break, 2 lower, 3 upper, 4 digit, 5 stop, 6 other mark, 7 beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    out[128:] = 7
    out[[32, 9, 11, 12, 13]] = 0
    out[10] = 1
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[[ord(c) for c in ".,;:?'\"-()"]] = 5
    return out


@functools.cache
def _random() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    odd = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(256), odd(64)


def _hash_runs(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of each run of ``values``; runs begin at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = np.add.reduceat(values * _random()[1][place & 63], starts)
    return h ^ (h >> np.uint64(29))


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys in each row."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of flat texts."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    kind = _classes()[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    by_kind = np.bincount(row * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    shouts = np.bincount(row[data == 33], minlength=n)
    bars = np.bincount(row[data == 124], minlength=n)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    solid = kind > 1
    begins = solid & first[:-1]
    begins[1:] |= solid[1:] & ~solid[:-1]
    starts = np.flatnonzero(begins)
    w_row = row[starts]
    words = np.bincount(w_row, minlength=n).astype(float)
    # bytes of a word are the run from its start on; blanks add nothing
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if len(starts) and starts[0] == 0 else None
    if place is None and len(starts):
        lead = starts[0]
        place = np.concatenate((np.zeros(lead, np.int64), np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))))
    value = np.where(solid, _random()[0][data], np.uint64(0))
    w_hash = _hash_runs(value, starts, place) if len(starts) else np.zeros(0, np.uint64)
    lower = np.bincount(np.cumsum(begins)[solid & (kind == 2)] - 1, minlength=len(starts)) if len(starts) else np.zeros(0)
    upper = np.bincount(np.cumsum(begins)[solid & (kind == 3)] - 1, minlength=len(starts)) if len(starts) else np.zeros(0)
    capital = np.bincount(w_row[(upper > 1) & (lower == 0)], minlength=n)
    nxt = (w_hash[1:] == w_hash[:-1]) & (w_row[1:] == w_row[:-1])
    repeated = np.bincount(w_row[1:][nxt], minlength=n)
    distinct = _distinct(w_hash, w_row, n)
    mix = _random()[1]
    inside = w_row[2:] == w_row[:-2]
    triple = (w_hash[:-2] * mix[1] + w_hash[1:-1] * mix[2] + w_hash[2:] * mix[3])[inside]
    triples = np.bincount(w_row[2:][inside], minlength=n)
    distinct_triples = _distinct(triple, w_row[2:][inside], n)
    # lines: runs of words without a line break between them
    breaks = np.cumsum(kind == 1)
    line_new = np.ones(len(starts), bool)
    if len(starts) > 1:
        line_new[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (w_row[1:] != w_row[:-1])
    l_start = np.flatnonzero(line_new)
    l_row = w_row[l_start]
    lines = np.bincount(l_row, minlength=n).astype(float)
    l_place = np.arange(len(starts)) - np.repeat(l_start, np.diff(np.append(l_start, len(starts)))) if len(starts) else np.zeros(0, np.int64)
    l_hash = _hash_runs(w_hash, l_start, l_place)
    distinct_lines = _distinct(l_hash, l_row, n)
    ends = np.append(starts[l_start[1:]], len(data)) - 1 if len(l_start) else np.zeros(0, np.int64)
    gap = solid.copy()
    last_solid = np.maximum.accumulate(np.where(gap, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
    closing = data[last_solid[ends]] if len(l_start) else np.zeros(0, np.uint8)
    ended = np.bincount(l_row[np.isin(closing, [46, 33, 63, 58])], minlength=n)
    safe, w, ln = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    letters = np.maximum(by_kind[:, 2] + by_kind[:, 3], 1)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), (size - by_kind[:, 0] - by_kind[:, 1]) / w, by_kind[:, 3] / letters, by_kind[:, 4] / safe,
            by_kind[:, 5] / safe, by_kind[:, 6] / safe, by_kind[:, 1] / safe, by_kind[:, 0] / safe, by_kind[:, 7] / safe, by_kind[:, 6] / w,
            shouts / w, bars / w, distinct / w, repeated / w, distinct_triples / np.maximum(triples, 1), distinct_lines / ln, np.log1p(lines),
            words / ln, capital / w, ended / ln,
        ],
        axis=1,
    )


def features(column: pa.Array) -> np.ndarray:
    """Statistics of an Arrow text column, computed over pieces of whole texts."""
    data, offsets = utf8(column)
    out, first, n = np.zeros((len(offsets) - 1, len(FEATURES))), 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 19), side="right")) - 1)
        out[first:last] = statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    return out


@dataclass
class Trees:
    """Complete binary trees in heap order: node i has children 2i+1 and 2i+2; ``leaf`` holds the lowest level."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        margin = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += leaf[node - len(t)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for logistic loss, split on histograms of ``BINS`` quantile bins."""
    positive = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(positive / (1 - positive)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * BINS
    margin = np.full(len(y), base)
    out_f, out_t, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first) * (m * BINS))[:, None] + flat
            shape = (width, m, BINS)
            sum_g, sum_h = (np.bincount(at.ravel(), np.repeat(v, m), minlength=width * m * BINS).reshape(shape) for v in (g, h))
            rows = np.bincount(at.ravel(), minlength=width * m * BINS).reshape(shape)
            left_g, left_h, left_n = (v.cumsum(axis=2) for v in (sum_g, sum_h, rows))
            all_g, all_h, all_n = left_g[..., -1:], left_h[..., -1:], left_n[..., -1:]
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[(left_n < LEAST_ROWS) | (all_n - left_n < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        node -= inner
        leaf = -rate * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + 1)
        margin += leaf[node]
        out_f.append(f), out_t.append(t), out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_l), base)


def sample_labels(labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most about ``max_rows`` (doc_id, y), chosen by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    million = 1_000_000
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("labels")), F.lit(million))
    return known.filter(draw < min(million, million * max_rows // max(1, n) + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Learn ``label`` of ``labels`` (doc_id, label) from the texts of ``docs`` (doc_id, text)."""
    sample = sample_labels(labels, label, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    found = rows.mapInArrow(run, "x array<double>, y int").toArrow()
    if not found.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(found.column("x").to_pylist(), float)
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return grow(x[order], y[order])


def predict(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.predict(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
