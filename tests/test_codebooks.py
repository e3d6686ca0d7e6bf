"""Codebooks beyond the broadcast limit, and their upkeep by running averages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovekit.functions.stable import hash_order
from trovekit.operators import quantize


def books_of(spark, sizes, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(level, 3 * code + 1, rng.normal(size=dim).round(1).tolist()) for level, n in enumerate(sizes) for code in range(n)]
    return rows, spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def vectors_of(spark, n, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i}", rng.normal(size=dim).round(3).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "did string, embedding array<double>")


def rounded(df, column):
    code = lambda r: tuple(r.code) if "code" in df.columns else ()
    return sorted((r.did, code(r), tuple(round(x, 9) for x in r[column])) for r in df.collect())


@pytest.mark.parametrize("group_rows,slice_rows", [(10_000, 1_000), (13, 4), (40, 1)])
def test_streamed_forms_equal_the_sent_ones(spark, group_rows, slice_rows):
    _, books = books_of(spark, [3, 20, 7])
    _, vectors = vectors_of(spark, 90)
    sent = quantize.encode_codes(vectors, books)
    streamed = quantize.encode_codes(vectors, books, limit=0, group_rows=group_rows, slice_rows=slice_rows)
    assert rounded(sent, "quant") == rounded(streamed, "quant") == rounded(quantize._encode_by_search(vectors, books, "did", "embedding"), "quant")
    lost = sent.select("did", F.transform("code", lambda c, i: F.when((i == 1) & (c == 1), 999).otherwise(c)).alias("code"))
    far = quantize.reconstruct(lost, books, limit=0, group_rows=group_rows, slice_rows=slice_rows)
    assert rounded(quantize.reconstruct(lost, books), "quant") == rounded(far, "quant")
    assert quantize.encode_codes(vectors.limit(0), books, limit=0).count() == 0


def test_no_residual_in_a_shuffle(spark):
    """One exchange carries vectors and slices of all levels; nothing is exploded by dimension."""
    _, books = books_of(spark, [3, 20, 7])
    _, vectors = vectors_of(spark, 90)
    plan = quantize.encode_codes(vectors, books, limit=0, group_rows=20)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("grp" in line for line in moved) == 1 and "residual" not in plan


def step(books, vectors, size, decay, least, order):
    """One update in plain numpy."""
    rest = np.array([v for _, v in vectors])
    rest = rest / np.linalg.norm(rest, axis=1, keepdims=True)
    out = {}
    for level in sorted({b[0] for b in books}):
        mine = [(c, np.array(m)) for lv, c, m in books if lv == level]
        book = np.array([m for _, m in mine])
        near = np.round(((rest[:, None] - book[None]) ** 2).sum(2), 12).argmin(1)
        dead = []
        for i, (code, m) in enumerate(mine):
            n = decay * size + (1 - decay) * (near == i).sum()
            out[level, code] = (n, decay * size * m + (1 - decay) * rest[near == i].sum(axis=0))
            if n < least:
                dead.append(code)
        for code, v in zip(dead, order):
            out[level, code] = (least, least * rest[v])
        rest = rest - book[near]
    return out


@pytest.mark.parametrize("least", [0.0, 2.0, 1e9])
def test_one_step_equals_the_plain_form(spark, least):
    held, books = books_of(spark, [2, 12, 4])
    rows, vectors = vectors_of(spark, 60)
    order = [int(r.did[1:]) for r in vectors.select("did").orderBy(hash_order("did"), "did").collect()]
    got = {(r.level, r.code): r for r in quantize.update_codebooks(quantize.codebook_state(books, 3.0), vectors, least=least).collect()}
    want = step(held, rows, 3.0, 0.8, least, order)
    assert set(got) == set(want)
    for k, (size, total) in want.items():
        assert abs(got[k].size - size) < 1e-9 and np.allclose(got[k].total, total, atol=1e-9), k


def test_upkeep_brings_dead_codes_back(spark):
    """Codes far from all vectors are used after some rounds: perplexity does not fall, the error does."""
    rng = np.random.default_rng(5)
    _, vectors = vectors_of(spark, 300)
    near = rng.normal(size=(3, 5)) * 0.3
    books = [(0, i, (near[i] if i < 3 else np.full(5, 40.0 + i)).tolist()) for i in range(10)]
    state = quantize.codebook_state(spark.createDataFrame(books, "level int, code int, centroid array<double>"), 2.0)

    def judged(state):
        codes = quantize.encode_codes(vectors, quantize.state_codebooks(state))
        unit = vectors.join(codes, "did")
        return quantize.perplexity(codes.select("code")).first().perplexity, quantize.quantisation_error(unit).first().mse

    seen = [judged(state)]
    for batch in range(3):
        mine = vectors.where(F.pmod(F.xxhash64("did", F.lit(batch)), F.lit(2)) == 0)
        state = quantize.update_codebooks(state, mine)
        seen.append(judged(state))
    assert all(b[0] >= a[0] - 0.5 for a, b in zip(seen, seen[1:])) and seen[-1][0] > 2 * seen[0][0] and seen[-1][1] < seen[0][1]
