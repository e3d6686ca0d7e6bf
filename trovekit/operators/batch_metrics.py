"""In-batch contrastive metrics: accuracy and cross entropy per batch.

Batches of up to ``SMALL_ROWS`` rows are scored whole, many to a task.  A larger batch
is cut into groups of queries and slices of positives; every (group, slice) is a cell
that streams its positives past its queries and emits, per query, the parts of a
log-sum-exp (largest score, scaled sum), the best place and the score of its own
positive.  Parts are merged by an aggregate, so no task holds a whole large batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.functions.vectors import dot, normalize
from trovekit.operators.skew import null_safe_join
from trovekit.session import materialize

SMALL_ROWS = 8192
GROUP_ROWS = 8192
SLICE_ROWS = 16_384
BLOCK_ROWS = 1024

_SCHEMA = "batch long, n long, loss double, accuracy double"


def _unit(m):
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    norm[norm == 0] = 1.0
    return m / norm


def _batch_scores(q: np.ndarray, p: np.ndarray, temperature: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query its cross entropy and whether its own positive wins, ``rows`` x ``rows`` scores at a time."""
    n = len(q)
    loss, wins = np.empty(n), np.empty(n, bool)
    for a in range(0, n, rows):
        mine = q[a : a + rows]
        m = len(mine)
        own = np.einsum("ij,ij->i", mine, p[a : a + rows]) / temperature
        top, total = np.full(m, -np.inf), np.zeros(m)
        best, place = np.full(m, -np.inf), np.zeros(m, int)
        for b in range(0, n, rows):
            logits = mine @ p[b : b + rows].T / temperature
            high = np.maximum(top, logits.max(1))
            total = total * np.exp(top - high) + np.exp(logits - high[:, None]).sum(1)
            top = high
            rounded = np.round(logits, 6)
            first = rounded.argmax(1)
            better = rounded[np.arange(m), first] > best
            best = np.where(better, rounded[np.arange(m), first], best)
            place = np.where(better, b + first, place)
        loss[a : a + m] = top + np.log(total) - own
        wins[a : a + m] = place == np.arange(a, a + m)
    return loss, wins


def inbatch_metrics(
    rows: DataFrame,
    temperature: float = 0.07,
    block_rows: int = 2048,
    small_rows: int = SMALL_ROWS,
    group_rows: int = GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Per batch: the positive of every query against all positives of its batch.

    ``rows`` has ``batch``, ``q`` and ``p`` (vectors) and ``pos``, which is unique in a
    batch.  ``loss`` is the mean softmax cross entropy, ``accuracy`` the share of
    queries whose own positive wins; ties go to the first.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        q, p = _unit(np.stack(pdf["q"]).astype("f8")), _unit(np.stack(pdf["p"]).astype("f8"))
        loss, wins = _batch_scores(q, p, temperature, block_rows)
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "n": [len(pdf)], "loss": [loss.mean()], "accuracy": [wins.mean()]})

    rows = rows.select("batch", "pos", "q", "p")
    # fewer than one row for each small_rows rows of the input
    large = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_rows)
    large = materialize(large, "large-batches")
    if large.isEmpty():
        return rows.groupBy("batch").applyInPandas(score, _SCHEMA)
    small = null_safe_join(rows, F.broadcast(large.select("batch")), "batch", "left_anti")
    parts = _large_parts(null_safe_join(rows, F.broadcast(large), "batch"), temperature, group_rows, slice_rows)
    return small.groupBy("batch").applyInPandas(score, _SCHEMA).unionByName(_merged(parts))


_PARTS = "batch long, pos long, top double, total double, best double, place long, own double"


def _large_parts(rows: DataFrame, temperature: float, group_rows: int, slice_rows: int) -> DataFrame:
    """Per query and slice of positives the parts of its log-sum-exp; ``rows`` carries the batch's size ``n``."""
    cut = lambda size: F.ceil(F.col("n") / size).cast("int")
    groups, slices = cut(group_rows), cut(slice_rows)
    own = lambda seed, of: F.pmod(F.xxhash64("pos", F.lit(seed)), of)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1))
    q = rows.select("batch", "pos", F.lit(0).alias("side"), own(1, groups).alias("grp"), every(slices).alias("slot"), F.col("q").alias("v"))
    p = rows.select("batch", "pos", F.lit(1).alias("side"), every(groups).alias("grp"), own(2, slices).alias("slot"), F.col("p").alias("v"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = q.unionByName(p).repartition(4 * parts, "batch", "grp", "slot").sortWithinPartitions("batch", "grp", "slot", "side", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cell = None, None
        for batch in batches:
            name, pos, side, grp, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            keys = np.stack([np.nan_to_num(name, nan=-1).astype("i8"), batch.column(0).is_null().to_numpy(zero_copy_only=False), grp, slot, side])
            ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(ends, ends[1:]):
                if hi == lo:
                    continue
                key = (batch.column(0)[lo].as_py(), grp[lo], slot[lo])
                if key != current:
                    if cell:
                        yield from cell.parts()
                    current, cell = key, _Cell(key[0], temperature)
                v = batch.column(5).slice(lo, hi - lo)
                mat = _unit(v.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(v), -1))
                (cell.add_positives if side[lo] else cell.add_queries)(pos[lo:hi], mat)
        if cell:
            yield from cell.parts()

    return met.select("batch", "pos", "side", "grp", "slot", "v").mapInArrow(run, _PARTS)


class _Cell:
    """Queries of a group against the positives of a slice, which come in the order of pos."""

    def __init__(self, batch, temperature: float):
        self.batch, self.temperature = batch, temperature
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.q = None

    def add_queries(self, pos, mat):
        self.held.append((pos.copy(), mat))

    def add_positives(self, pos, mat):
        if not self.held:
            return  # no query of this group fell into the cell
        if self.q is None:
            self.pos, self.q = np.concatenate([x for x, _ in self.held]), np.concatenate([m for _, m in self.held])
            n = len(self.pos)
            self.top, self.total, self.own = np.full(n, -np.inf), np.zeros(n), np.full(n, np.nan)
            self.best, self.place = np.full(n, -np.inf), np.zeros(n, np.int64)
        for a in range(0, len(pos), BLOCK_ROWS):
            self._block(pos[a : a + BLOCK_ROWS], mat[a : a + BLOCK_ROWS])

    def _block(self, pos, mat):
        logits = self.q @ mat.T / self.temperature
        every = np.arange(len(self.pos))
        high = np.maximum(self.top, logits.max(1))
        self.total = self.total * np.exp(self.top - high) + np.exp(logits - high[:, None]).sum(1)
        self.top = high
        rounded = np.round(logits, 6)
        first = rounded.argmax(1)
        better = rounded[every, first] > self.best
        self.best = np.where(better, rounded[every, first], self.best)
        self.place = np.where(better, pos[first], self.place)
        at = np.minimum(np.searchsorted(pos, self.pos), len(pos) - 1)  # both rise
        mine = pos[at] == self.pos
        self.own[mine] = logits[every[mine], at[mine]]

    def parts(self):
        if self.q is None:
            return
        own = pa.array(self.own, mask=np.isnan(self.own))
        columns = [pa.array([self.batch] * len(self.pos), pa.int64()), *map(pa.array, (self.pos.astype("i8"), self.top, self.total, self.best, self.place)), own]
        yield pa.RecordBatch.from_arrays(columns, ["batch", "pos", "top", "total", "best", "place", "own"])


def _merged(parts: DataFrame) -> DataFrame:
    """Metrics of the batches from the parts of their queries, a handful per query."""
    one = parts.groupBy("batch", "pos").agg(
        F.max("top").alias("high"),
        F.collect_list(F.struct("top", "total")).alias("sums"),
        F.max(F.struct("best", (-F.col("place")).alias("last"))).alias("winner"),
        F.max("own").alias("own"),
    )
    total = F.aggregate("sums", F.lit(0.0), lambda a, s: a + s["total"] * F.exp(s["top"] - F.col("high")))
    loss = F.col("high") + F.log(total) - F.col("own")
    wins = -F.col("winner.last") == F.col("pos")
    return one.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(wins.cast("int")).alias("accuracy"))


def hard_negative_metrics(rows: DataFrame, temperature: float = 0.07, in_batch: int = 0) -> DataFrame:
    """As above, with each query's own negatives first and then the first
    ``in_batch`` other positives of the batch.

    ``rows`` has ``batch``, ``pos``, ``q``, ``p`` and ``negs`` (array of
    vectors).  The other positives of a batch are its first ``in_batch + 1``
    rows, so one small array per batch is joined, not the batch itself.
    """
    scored = rows.withColumn("q", normalize("q")).withColumn("p", normalize("p"))
    ranked = scored
    if in_batch:
        from pyspark.sql import Window

        w = Window.partitionBy("batch").orderBy("pos")
        heads = (
            scored.select("batch", "pos", "p")
            .withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= in_batch + 1)
            .groupBy("batch")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("__heads"))
        )
        ranked = scored.join(heads, "batch")
        others = F.filter("__heads", lambda h: h["pos"] != F.col("pos"))
        others = F.transform(F.slice(others, 1, in_batch), lambda h: h["p"])
    else:
        others = F.array().cast("array<array<double>>")
    negatives = F.concat(F.transform("negs", lambda v: normalize(v)), others)
    neg_scores = F.transform(negatives, lambda v: dot("q", v) / temperature)
    pos_score = dot("q", "p") / temperature
    lines = ranked.select("batch", pos_score.alias("s"), neg_scores.alias("ns"))
    top = F.greatest("s", F.coalesce(F.array_max("ns"), F.col("s")))
    log_sum = top + F.log(
        F.exp(F.col("s") - top) + F.aggregate("ns", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    )
    wins = F.coalesce(F.round("s", 6) >= F.round(F.array_max("ns"), 6), F.lit(True))
    return lines.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.avg(log_sum - F.col("s")).alias("loss"), F.avg(wins.cast("int")).alias("accuracy")
    )
