"""In-batch metrics of batches cut into cells against the closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovekit.operators.batch_metrics import _large_parts, inbatch_metrics


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def closed_form(q, p, temperature=0.07):
    logits = unit(q) @ unit(p).T / temperature
    high = logits.max(1)
    loss = high + np.log(np.exp(logits - high[:, None]).sum(1)) - np.diag(logits)
    return loss.mean(), (np.round(logits, 6).argmax(1) == np.arange(len(q))).mean()


def batches(sizes, seed=1, dim=6):
    rng = np.random.default_rng(seed)
    out = {}
    for b, n in sizes.items():
        p = rng.normal(size=(n, dim))
        p[n // 2 :] = p[: n - n // 2]  # ties: the first place wins
        out[b] = (p + rng.normal(scale=0.4, size=p.shape), p)
    return out


def frame(spark, held, seed=0):
    rows = [(b, 10 * i + 3, [float(x) for x in q[i]], [float(x) for x in p[i]]) for b, (q, p) in held.items() for i in range(len(q))]
    return spark.createDataFrame(rows, "batch long, pos long, q array<double>, p array<double>").orderBy(F.xxhash64("pos", F.lit(seed)))


@pytest.mark.parametrize("limits", [{}, {"small_rows": 50, "group_rows": 40, "slice_rows": 30}, {"small_rows": 0, "group_rows": 7, "slice_rows": 5}])
def test_equal_to_the_closed_form(spark, limits):
    held = batches({0: 1, 1: 2, 5: 33, 7: 150, None: 61})
    got = {r.batch: r for r in inbatch_metrics(frame(spark, held), **limits).collect()}
    assert set(got) == set(held)
    for b, (q, p) in held.items():
        loss, accuracy = closed_form(q, p)
        assert got[b].n == len(q) and abs(got[b].loss - loss) < 1e-9 and abs(got[b].accuracy - accuracy) < 1e-12


def test_empty(spark):
    assert inbatch_metrics(frame(spark, batches({1: 3})).limit(0)).count() == 0


def test_one_large_batch_spreads(spark):
    """A batch of 30,000 rows: many tasks, none with much more than its share, and the same metrics."""
    n = 30_000
    rng = np.random.default_rng(3)
    p = rng.normal(size=(n, 8))
    q = p + rng.normal(scale=0.5, size=p.shape)
    table = spark.createDataFrame([(i, q[i].tolist(), p[i].tolist()) for i in range(n)], "pos long, q array<double>, p array<double>").withColumn("batch", F.lit(4).cast("long"))
    row = inbatch_metrics(table, group_rows=2048, slice_rows=2048).collect()[0]
    u, v = unit(q), unit(p)
    losses, wins = [], 0
    for a in range(0, n, 2000):
        logits = u[a : a + 2000] @ v.T / 0.07
        high = logits.max(1)
        losses.append(high + np.log(np.exp(logits - high[:, None]).sum(1)) - logits[np.arange(len(logits)), np.arange(a, a + len(logits))])
        wins += (np.round(logits, 6).argmax(1) == np.arange(a, a + len(logits))).sum()
    assert row.n == n and abs(row.loss - np.concatenate(losses).mean()) < 1e-9 and abs(row.accuracy - wins / n) < 1e-12
    sized = table.withColumn("n", F.lit(n))
    per_task = [r["count"] for r in _large_parts(sized, 0.07, 2048, 2048).groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 12 and max(per_task) <= 5 * np.median(per_task)
