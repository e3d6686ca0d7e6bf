"""Deleted interpolation against counts in plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trovekit.llm import interpolated_lm as lm
from trovekit.llm.common import fold, table
from trovekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</>"]


def grams(texts):
    out = [Counter(), Counter(), Counter()]
    for t in texts:
        words = ["<>", "<>", *tokens_of(t)]
        for i in range(2, len(words)):
            for n in (1, 2, 3):
                out[n - 1][tuple(words[i - n + 1 : i + 1])] += 1
    return out


def positions(text, counts, docs):
    """c(uvw), c(uv), c(vw), c(v), c(w) at each token."""
    one, two, three = counts
    words = ["<>", "<>", *tokens_of(text)]
    for i in range(2, len(words)):
        u, v, w = words[i - 2 : i + 1]
        cv = docs if v == "<>" else one[(v,)]
        cuv = docs if v == "<>" else two[(u, v)]
        yield three[(u, v, w)], cuv, two[(v, w)], cv, one[(w,)]


def bucket(uv, v):
    return lm.POWERS + uv.bit_length() if uv else v.bit_length()


def estimates(c, n, vocabulary):
    uvw, uv, vw, v, w = c
    return [1 / (vocabulary + 1), w / n if n else 0, vw / v if v else 0, uvw / uv if uv else 0]


def brute(rows, rounds=lm.ROUNDS):
    """rows: (text, part). Returns scores and weights, with the same number of rounds as the operator."""
    build, train = grams([t for t, p in rows if p == lm.BUILD]), grams([t for t, p in rows if p != lm.SCORED])
    docs_build, docs = sum(p == lm.BUILD for _, p in rows), sum(p != lm.SCORED for _, p in rows)
    n_build, n = sum(build[0].values()), sum(train[0].values())
    held = [c for t, p in rows if p == lm.TUNE for c in positions(t, build, docs_build)]
    weights = lm.first_weights()
    for _ in range(rounds):
        sums = np.zeros_like(weights)
        for c in held:
            b = bucket(c[1], c[3])
            parts = weights[b] * np.array(estimates(c, n_build, len(build[0])))
            sums[b] += parts / parts.sum()
        before, weights = weights, lm.better_weights(weights, sums)
        if np.abs(weights - before).max() < 1e-4:
            break
    out = []
    for t, _ in rows:
        seen = list(positions(t, train, docs))
        base = sum(math.log10((c[4] + 1) / (n + len(train[0]) + 1)) for c in seen)
        score = sum(math.log10(sum(a * b for a, b in zip(weights[bucket(c[1], c[3])], estimates(c, n, len(train[0]))))) for c in seen)
        out.append((len(seen), sum(c[4] > 0 for c in seen), n, base, score))
    return out, weights


def parted(docs, training, parts=lm.TUNE_PARTS):
    tuned = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("tune")), F.lit(parts)) == 0
    return [r[0] for r in docs.select(F.when(~training, lm.SCORED).when(tuned, lm.TUNE).otherwise(lm.BUILD)).collect()]


def same(got, want):
    assert got[:3] == want[:3]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(got[3:], want[3:])), (got, want)


COLUMNS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_query_equals_plain_counts(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    parts = parted(docs, fold("doc_id", 7) != 2)
    assert {lm.SCORED, lm.BUILD, lm.TUNE} == set(parts)
    want, _ = brute(list(zip([r["text"] for r in rows], parts)))
    want = {r["doc_id"]: w for r, w in zip(rows, want)}
    found = QUERIES["op11_interpolated_lm"](spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        same(tuple(r[c] for c in COLUMNS), want[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_blocks_and_buckets_change_nothing(spark):
    """Texts longer than a block, cut between words, with hard cases and repeated rows."""
    texts = [None, "", "  ", "one", "One\ttwo\nONE", "a b c a b c " * 300, "wortü " * 50, "x" * 5000 + " tail", "lead " + "y" * 5000, "a b c a b c " * 300, "a b c"] * 4
    ids = [None, *range(1, len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, 3, "c") for i, t in zip(ids, texts)], "doc_id long, text string, row long, words string")
    training = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    parts = parted(docs, training, 3)
    want, _ = brute(list(zip(texts, parts)))
    for limit, entries in ((1000, 16), (lm.BLOCK_BYTES, lm.BUCKET_ENTRIES)):
        scores, _ = lm.score(docs, training, 3, limit, entries)
        got = sorted((str(r["doc_id"]), tuple(r[c] for c in COLUMNS)) for r in scores.collect())
        expected = sorted((str(i), w) for i, w in zip(ids, want))
        assert len(got) == len(expected)
        for (a, x), (b, y) in zip(got, expected):
            assert a == b
            same(x, y)


def test_probabilities_of_a_context_add_up_to_one(spark):
    texts = ["a b c a b d", "a b c", "b c a", "c c c d e", "f g a b"] * 3
    rows = [(t, lm.TUNE if k % 4 == 0 else lm.BUILD) for k, t in enumerate(texts)]
    _, weights = brute(rows)
    train = grams([t for t, _ in rows])
    n, words = sum(train[0].values()), [w for (w,) in train[0]]
    for u, v in (("<>", "<>"), ("<>", "a"), ("a", "b"), ("c", "c"), ("g", "zz"), ("zz", "a")):
        total = 0
        for w in [*words, "unknown"]:
            cv = len(rows) if v == "<>" else train[0][(v,)]
            cuv = len(rows) if v == "<>" else train[1][(u, v)]
            c = train[2][(u, v, w)], cuv, train[1][(v, w)], cv, train[0][(w,)]
            total += float(weights[bucket(cuv, cv)] @ np.array(estimates(c, n, len(words))))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_empty_table_and_no_training(spark):
    schema = "doc_id long, text string"
    assert lm.report(spark.createDataFrame([], schema)).count() == 0
    scores, _ = lm.score(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(False))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in scores.collect()) == [(1, 3, 0, 0), (2, 1, 0, 0)]


def test_planes():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64), np.array([255, 256, 1 << 63], np.uint64)):
        assert (lm._from_planes(lm._planes(values)) == values).all()
        assert (lm._from_rising(lm._rising(np.unique(values))) == np.unique(values)).all()
