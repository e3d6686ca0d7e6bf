"""Search, codes and evaluation against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovekit.operators import beam, blocks, code_search, evaluate, prefix, quantize, search
from trovekit.plans.retrieval import code_retrieval


def frame(spark, name, ids, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], f"{name} string, embedding array<double>")


def brute(q, p, pids, k, metric="cosine"):
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
    s = -((q[:, None, :] - p[None]) ** 2).sum(2) if metric == "l2" else q @ p.T
    s = np.round(s, 6) + 0.0
    return [sorted(zip(-row, pids))[:k] for row in s]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    q, p = rng.normal(size=(90, 16)), rng.normal(size=(700, 16))
    p[100:130] = p[0]  # copies of one vector: scores tie
    p[5] = 0.0  # a zero vector
    qids, pids = [f"1:{i}" for i in range(90)], [f"2:{i}" for i in range(700)]
    return q, p, qids, pids, frame(spark, "qid", qids, q).cache(), frame(spark, "did", pids, p).cache()


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_blocked_search_equals_brute_force(spark, data, monkeypatch, metric):
    q, p, qids, pids, qdf, pdf = data
    got = blocks.blocked_top_k(qdf, pdf.repartition(5), 12, metric=metric, slices=3, group_rows=40).collect()
    want = brute(q, p, pids, 12, metric)
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append((r["rank"], r.did, r.score))
    for i, qid in enumerate(qids):
        rows = sorted(by[qid])
        assert [d for _, d, _ in rows] == [d for _, d in want[i]]
        np.testing.assert_allclose([s for _, _, s in rows], [-s for s, _ in want[i]], atol=1.5e-6)


def test_search_with_a_third_of_the_pool_being_copies(spark, data):
    q, p, qids, _, qdf, _ = data
    copies = p.copy()
    copies[::3] = q[0]  # the best answer of one query, and a tie for all others
    pids = [f"2:{i}" for i in range(700)]
    got = {}
    for r in blocks.blocked_top_k(qdf, frame(spark, "did", pids, copies), 12, slices=2).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.did))
    want = brute(q, copies, pids, 12)
    for i, qid in enumerate(qids):
        assert [d for _, d in sorted(got[qid])] == [d for _, d in want[i]]


def test_search_with_fewer_candidates_than_k(spark, data):
    _, _, _, _, qdf, pdf = data
    assert search.top_k(qdf, pdf.limit(4), 10).count() == 90 * 4


def test_index_checks_dimension(spark, data):
    pdf = data[5]
    assert search.build_index(pdf, 16).count() == 700
    with pytest.raises(Exception, match="where 15 is expected"):
        search.build_index(pdf, 15).collect()


def test_buckets_golden(spark):
    codes = spark.createDataFrame([(1, "1", [0]), (2, "2", [0]), (3, "2", [1])], "pos long, did string, code array<int>")
    beams = spark.createDataFrame([("q", 1, [0]), ("q", 2, [1])], "qid string, beam_rank int, code array<int>")
    plain = code_search.retrieve(beams, codes, 3).orderBy("rank").collect()
    assert [r.did for r in plain] == ["1", "2", "2"]
    once = code_search.retrieve(beams, codes, 3, dedupe=True).orderBy("rank").collect()
    assert [r.did for r in once] == ["1", "2"]
    qv = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")
    pv = spark.createDataFrame([("1", [0.0, 1.0]), ("2", [1.0, 0.2])], "did string, embedding array<double>")
    ranked = code_search.rerank(beams, codes, qv, pv, 3).orderBy("rank").collect()
    assert [r.did for r in ranked] == ["2", "1"]


def test_rerank_with_all_codes_equals_exact_search(spark, data):
    q, p, qids, pids, qdf, pdf = data
    # one code holds most of the pool and every query generates it
    codes = pdf.select("did", F.array(F.when(F.xxhash64("did") % 3 == 0, 1).otherwise(0)).alias("code"))
    beams = qdf.select("qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).select(
        "qid", (F.col("c") + 1).alias("beam_rank"), F.array("c").alias("code")
    )
    exact = {(r.qid, r["rank"]): r.did for r in search.top_k(qdf, pdf, 8).collect()}
    for slices in ({}, {"pool_slice": 100, "query_slice": 20}):
        got = {(r.qid, r["rank"]): r.did for r in code_search.rerank(beams, codes, qdf, pdf, 8, **slices).collect()}
        assert got == exact


def books(spark, p, levels=3, size=6):
    rows = [(l, c, [float(x) for x in p[40 + l * size + c] / np.linalg.norm(p[40 + l * size + c])]) for l in range(levels) for c in range(size)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def test_beam_with_room_for_all_returns_every_code(spark, data):
    q, p, qids, pids, qdf, pdf = data
    cb = books(spark, p)
    coded = quantize.encode_codes(pdf, cb).select("did", "code")
    n = coded.select("code").distinct().count()
    rows = beam.beam_search(qdf.limit(5), prefix.prefix_index(coded), cb, 1000, 3)
    per_query = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("d")).collect()
    assert all(r.n == n and r.d == n for r in per_query)
    best = rows.where("beam_rank = 1").collect()
    scores = {(r.qid, tuple(r.code)): r.score for r in rows.collect()}
    for r in best:
        assert r.score == max(s for (qid, _), s in scores.items() if qid == r.qid)
    # and a code retrieval that reaches every code ranks like exact search
    found = code_retrieval(qdf.limit(5), pdf.withColumn("pos", F.split_part("did", F.lit(":"), F.lit(2)).cast("long")), cb, 3, 1000, 5)
    exact = {(r.qid, r["rank"]): r.did for r in search.top_k(qdf.limit(5), pdf, 5).collect()}
    assert {(r.qid, r["rank"]): r.did for r in found.collect()} == exact


def test_codebooks_from_training(spark, data):
    pdf = data[5]
    cb = quantize.train_codebooks(pdf, [3, 5], iterations=3)
    assert {r.level for r in cb.collect()} == {0, 1}
    coded = quantize.encode_codes(pdf, cb)
    assert coded.where(F.size("code") == 2).count() == 700
    errors = quantize.quantisation_error(coded.join(pdf.withColumn("embedding", search.normalize("embedding")), "did")).first()
    assert 0 < errors.mse < 2 / 16


def test_unique_codes_golden(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(i, [1], x) for i, x in enumerate([v, v, w, v])], "pos long, code array<int>, embedding array<double>")
    got = quantize.unique_codes(df).orderBy("pos").collect()
    assert [r.suffix for r in got] == [0, 0, 1, 1]
    assert [r.unique_code for r in got] == [[1, 0], [1, 0], [1, 1], [1, 1]]


def test_prefix_golden(spark):
    codes = spark.createDataFrame([([1, 2],), ([1, 3],), ([4, 2],), ([1, 2],)], "code array<int>")
    index = prefix.prefix_index(codes)
    ask = spark.createDataFrame([([],), ([1],), ([9],), ([1, 2],)], "prefix array<int>")
    got = {tuple(r.prefix): r.nexts for r in prefix.lookup(ask, index).collect()}
    assert got == {(): [1, 4], (1,): [2, 3], (9,): [], (1, 2): []}
    assert sorted(tuple(r.code) for r in prefix.enumerate_codes(index).collect()) == [(1, 2), (1, 3), (4, 2)]
    assert tuple(prefix.code_count(codes).first()) == (4, 3)


def test_index_grows_with_added_codes(spark):
    codes = spark.createDataFrame([([1, 2],), ([4, 2],)], "code array<int>")
    more = spark.createDataFrame([([1, 3],), ([4, 2],)], "code array<int>")
    grown = prefix.extend_index(prefix.prefix_index(codes), more)
    whole = prefix.prefix_index(codes.unionByName(more)).select("prefix", "nexts")
    assert sorted(map(tuple, ((tuple(r.prefix), tuple(r.nexts)) for r in grown.collect()))) == sorted(
        (tuple(r.prefix), tuple(r.nexts)) for r in whole.collect()
    )


def test_beam_with_a_scorer_that_sees_the_prefix(spark):
    codes = spark.createDataFrame([([0, 0],), ([0, 1],), ([1, 0],)], "code array<int>")
    queries = spark.createDataFrame([("q",)], "qid string")

    def scorer(beams, level):
        # token 1 after prefix [0] is best; token scores depend on the beam
        options = beams.select("qid", "prefix", F.explode(F.array(F.lit(0), F.lit(1))).alias("next"))
        best = (F.size("prefix") > 0) & (F.get("prefix", F.lit(0)) == 0) & (F.col("next") == 1)
        return options.withColumn("logp", F.when(best, -0.1).otherwise(-1.0))

    rows = beam.beam_search_scored(queries, prefix.prefix_index(codes), scorer, 2, 2).orderBy("beam_rank").collect()
    assert [(r.code, r.score) for r in rows] == [([0, 1], -1.1), ([0, 0], -2.0)]
    # fewer codes than beams: fewer rows
    assert beam.beam_search_scored(queries, prefix.prefix_index(codes), scorer, 9, 2).count() == 3


def runs(spark, rows):
    return spark.createDataFrame(rows, "qid string, did string, rank int")


def test_hits_golden(spark):
    run = runs(spark, [("0:1", "0:2", 1), ("0:1", "0:1", 2), ("0:2", "0:9", 1), ("0:3", "0:1", 1)])
    qrels = spark.createDataFrame([("0:1", "0:1", 0, 1), ("0:2", "0:5", 0, 2)], "qid string, did string, task_id int, pos long")
    row = evaluate.hit_counts(run, qrels, [1, 2, 5]).first()
    assert (row.n, row.hits_1, row.hits_2, row.hits_5) == (2, 0, 1, 1)
    assert evaluate.unjudged(run, qrels).first().unjudged == 1
    # a judged query that retrieved nothing is a miss once it is known
    asked = spark.createDataFrame([("0:1",), ("0:2",), ("0:4",)], "qid string")
    more = qrels.unionByName(spark.createDataFrame([("0:4", "0:1", 0, 3)], qrels.schema))
    row = evaluate.hit_counts(run, more, [5], asked=asked).first()
    assert (row.n, row.hits_5) == (3, 1)


@pytest.mark.parametrize("h, n, want", [(1, 32, 0.0312), (3, 32, 0.0938), (1, 800, 0.0012), (0, 0, None), (1, 1, 1.0), (2, 3, 0.6667)])
def test_rate(spark, h, n, want):
    assert spark.createDataFrame([(h, n)], "h long, n long").select(evaluate.rate("h", "n").alias("r")).first().r == want


def test_error_types_and_rates(spark):
    # task 1 asks for text; the wrong modality wins over the wrong domain
    run = runs(spark, [("0:1", "1:1", 1), ("0:2", "1:2", 1), ("0:3", "0:3", 1), ("0:4", "0:4", 1)])
    links = spark.createDataFrame([("0:4", "pos", 0, "0:4")], "qid string, label string, ord int, did string")
    qrels = spark.createDataFrame([(f"0:{i}", "0:4", 1, i) for i in range(1, 5)], "qid string, did string, task_id int, pos int")
    pool = spark.createDataFrame([("1:1", "image"), ("1:2", "text"), ("0:3", "text"), ("0:4", "text")], "did string, modality string")
    typed = evaluate.error_types(run, links, qrels, pool)
    assert {r.qid: r.error_type for r in typed.collect()} == {"0:1": 1, "0:2": 2, "0:3": 3, "0:4": 0}
    r = evaluate.error_rates(typed).first()
    assert (r.Type1, r.Type2, r.Type3, r.false_positives) == (0.3333, 0.3333, 0.3333, 3)
    none = evaluate.error_rates(typed.where("error_type = 0")).first()
    assert (none.Type1, none.false_positives) == (None, 0)


def test_hard_negatives_golden(spark):
    run = runs(spark, [("q", "a", 1), ("q", "x", 2), ("q", "y", 3), ("r", "a", 1)])
    links = spark.createDataFrame([("q", "pos", 0, "a"), ("r", "neg", 0, "a")], "qid string, label string, ord int, did string")
    mined = search.hard_negatives(run, links, 5).orderBy("qid", "ord").collect()
    assert [r.did for r in mined] == list("xyxyx")


def test_query_checks(spark):
    rows = [("text", "t", None), ("text", None, None), ("text", "t", "i"), ("image", "t", "i"), ("image", None, None), ("image,text", "t", "i"), ("video", "t", None)]
    df = spark.createDataFrame(rows, "query_modality string, query_txt string, query_img_path string")
    bad = [r.problem is not None for r in search.check_queries(df).collect()]
    assert bad == [False, True, True, True, True, False, True]


def test_long_results(spark):
    df = spark.createDataFrame(
        [(0, "t", "a", "test", "local", 0.5, None), (0, "t", "a", "test", "union", 0.25, None), (1, "u", "b", "test", "local", 0.75, 0.5)],
        "TaskID int, Task string, Dataset string, Split string, CandPool string, `Recall@1` double, `Recall@5` double",
    )
    got = {(r.TaskID, r.Metric): (r.Value, r.UnionPool, r.UnionValue) for r in evaluate.long_results(df).collect()}
    assert got == {(0, "Recall@1"): (0.5, "union", "0.25"), (1, "Recall@1"): (0.75, "", ""), (1, "Recall@5"): (0.5, "", "")}


def test_codebooks_with_gaps_encode_alike_both_ways(spark, data):
    pdf = data[5]
    gaps = books(spark, data[1]).withColumn("code", F.col("code") * 3 + 1).where("code != 4")
    sent = {r.did: (r.code, np.round(r.quant, 9).tolist()) for r in quantize.encode_codes(pdf, gaps).collect()}
    joined = {r.did: (r.code, np.round(r.quant, 9).tolist()) for r in quantize.encode_codes(pdf, gaps, limit=0).collect()}
    assert sent == joined and {c % 3 for code, _ in sent.values() for c in code} == {1}
    codes = quantize.encode_codes(pdf, gaps).select("did", "code")
    back = {r.did: np.round(r.quant, 9).tolist() for r in quantize.reconstruct(codes, gaps).collect()}
    assert back == {d: q for d, (_, q) in sent.items()}
    slow = {r.did: np.round(r.quant, 9).tolist() for r in quantize.reconstruct(codes, gaps, limit=0).collect()}
    assert slow == back


def test_beams_alike_both_ways(spark, data):
    qdf, pdf = data[4], data[5]
    cb = books(spark, data[1]).withColumn("code", F.col("code") * 2)
    index = prefix.prefix_index(quantize.encode_codes(pdf, cb).select("did", "code"))
    sent = {(r.qid, r.beam_rank): (r.code, r.score) for r in beam.beam_search(qdf, index, cb, 4, 3).collect()}
    joined = {(r.qid, r.beam_rank): (r.code, r.score) for r in beam.beam_search(qdf, index, cb, 4, 3, limit=0).collect()}
    assert sent == joined


def test_equal_centroids_go_to_the_smaller_code(spark, data):
    pdf = data[5]
    one = [float(x) for x in np.ones(16) / 4]
    cb = spark.createDataFrame([(0, 5, one), (0, 2, one), (0, 9, one)], "level int, code int, centroid array<double>")
    for limit in (quantize.BROADCAST_BYTES, 0):
        assert {tuple(r.code) for r in quantize.encode_codes(pdf, cb, limit=limit).collect()} == {(2,)}


def test_query_groups_are_bounded(spark):
    ids = spark.range(30_000).select(F.col("id").cast("string").alias("qid"), F.array(F.col("id").cast("double")).alias("embedding"))
    packed = blocks.pack_blocks(ids.repartition(9), "qid", "embedding", "<f8", 256)
    groups, placed = blocks._query_groups(packed.cache(), 1000, packed.count())
    sizes = [r.n for r in placed.groupBy("grp").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 1000 + 256 and len(sizes) == groups


def test_hot_code_with_many_results(spark):
    codes = spark.range(9000).select(F.array(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id").cast("int"))).alias("code"), F.col("id").alias("pos"), F.col("id").cast("string").alias("did"))
    beams = spark.createDataFrame([("q", 1, [3]), ("q", 2, [0])], "qid string, beam_rank int, code array<int>")
    got = code_search.retrieve(beams, codes, 1500).orderBy("rank").collect()
    hot = [str(i) for i in range(9000) if i % 3 > 0 or i == 0]
    assert [r.did for r in got] == ["3"] + hot[:1499]


def test_large_batch_scores(spark):
    from trovekit.operators.batch_metrics import inbatch_metrics

    rng = np.random.default_rng(3)
    q = rng.normal(size=(5000, 8))
    p = q + rng.normal(size=q.shape) * 0.3
    df = spark.createDataFrame([(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(q, p))], "batch long, pos long, q array<double>, p array<double>")
    got = inbatch_metrics(df).first()
    q, p = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, p))
    logits = q @ p.T / 0.07
    top = logits.max(1)
    loss = (top + np.log(np.exp(logits - top[:, None]).sum(1)) - np.diag(logits)).mean()
    assert got.n == 5000 and abs(got.loss - loss) < 1e-9
    assert got.accuracy == (np.round(logits, 6).argmax(1) == np.arange(5000)).mean()


def test_zero_queries_keep_the_smallest_ids_and_score_few_pairs(monkeypatch):
    import numpy as np

    from trovekit.operators import blocks

    rng = np.random.default_rng(3)
    pool = rng.normal(size=(4000, 8))
    pool[::50] = 0
    names = np.array([f"d{i}" for i in rng.permutation(4000)], object)
    queries = rng.normal(size=(40, 8))
    queries[::4] = 0
    merged = []
    real = blocks._Group._merge
    monkeypatch.setattr(blocks._Group, "_merge", lambda self, qi, s, d: (merged.append(len(qi)), real(self, qi, s, d)))
    scored = []
    plain = np.einsum
    monkeypatch.setattr(blocks.np, "einsum", lambda spec, *a: (scored.append(len(a[0])), plain(spec, *a))[1])
    group = blocks._Group(5, "cosine")
    group.add_queries(np.arange(40), queries)
    for a in range(0, 4000, 500):
        group.add_pool(names[a : a + 500], pool[a : a + 500])
    q, d, s = group.result()
    unit = lambda m: m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) == 0, 1, n)
    exact = np.round(unit(queries) @ unit(pool).T, 6) + 0.0
    for i in range(40):
        want = sorted(zip(-exact[i], names))[:5]
        assert [(-x, y) for x, y in zip(s[q == i], d[q == i])] == want
    # the ten zero queries alone would have had 40 000 pairs
    assert sum(scored) < 20_000


def test_products_of_a_group_are_held_in_strips():
    import tracemalloc

    rng = np.random.default_rng(4)
    queries, pool = rng.normal(size=(16_384, 8)), rng.normal(size=(1024, 8))
    group = blocks._Group(3, "cosine")
    group.add_queries(np.arange(16_384), queries)
    names = np.arange(1024).astype(str).astype(object)
    tracemalloc.start()
    group.add_pool(names, pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all products at once are 64 MB in single precision, and were held several times
    assert peak < 64 * 2**20
    _, d, s = group.result()
    exact = np.round(blocks._unit(queries) @ blocks._unit(pool).T, 6) + 0.0
    assert np.allclose(s.reshape(-1, 3), -np.sort(-exact, axis=1)[:, :3])


def test_slices_of_a_pool_do_not_grow_with_the_groups(spark):
    pool, cells = spark.range(400_000), blocks._cells(spark)
    found = [blocks._pool_slices(pool, 200, groups) for groups in (1, 7, 38, 1000)]
    # every slice adds k rows per query; with as many cells as keep the cores busy that sum is bounded
    assert all(groups * n < cells + groups for groups, n in zip((7, 38, 1000), found[1:]))
    assert found[0] == min(cells, 49) and found[-1] == 1


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_single_precision_decides_nothing(monkeypatch, metric):
    rng = np.random.default_rng(5)
    queries, pool = rng.normal(size=(60, 12)) + 300, rng.normal(size=(3000, 12)) * 1e-4 + 300
    pool[100:140] = pool[7]  # ties
    pool[11, 3], pool[12, 0] = np.nan, np.inf
    names = np.array([f"d{i}" for i in rng.permutation(3000)], object)
    kinds = []
    real = blocks._Group._add_strip
    monkeypatch.setattr(blocks._Group, "_add_strip", lambda self, strip, rough, *a: (kinds.append(rough.dtype.char), real(self, strip, rough, *a)))
    group = blocks._Group(9, metric)
    group.add_queries(np.arange(60), queries)
    for a in range(0, 3000, 250):
        group.add_pool(names[a : a + 250], pool[a : a + 250])
    q, d, s = group.result()
    sound = np.isfinite(pool).all(1)
    for i in range(60):
        p = pool[sound]
        exact = np.einsum("j,ij->i", queries[i], p) if metric == "ip" else -((queries[i] - p) ** 2).sum(1)
        want = sorted(zip(-(np.round(exact, 6) + 0.0), names[sound]))[:9]
        if metric == "l2":
            assert [y for _, y in want] == list(d[q == i])
        np.testing.assert_allclose(s[q == i], [-x for x, _ in want], rtol=1e-11, atol=2e-6)
    # the block with components that are no numbers is multiplied in double precision
    assert kinds.count("d") == 1 and kinds.count("f") == 11


def test_zero_queries_are_not_multiplied(monkeypatch):
    rng = np.random.default_rng(6)
    queries, pool = np.zeros((3000, 8)), rng.normal(size=(2048, 8))
    queries[::100] = rng.normal(size=(30, 8))
    pool[5, 2] = np.nan
    names = np.array([f"d{i % 1500}" for i in rng.permutation(2048)], object)  # ids may repeat
    multiplied = []
    real = blocks._Group._add_strip
    monkeypatch.setattr(blocks._Group, "_add_strip", lambda self, strip, rough, *a: (multiplied.append(len(rough)), real(self, strip, rough, *a)))
    group = blocks._Group(4, "ip")
    group.add_queries(np.arange(3000), queries)
    for a in range(0, 2048, 1024):
        group.add_pool(names[a : a + 1024], pool[a : a + 1024])
    q, d, s = group.result()
    assert multiplied == [30, 30]
    sound = np.isfinite(pool).all(1)
    smallest = sorted(names[sound])[:4]
    assert len(q) == 3000 * 4 and (s[np.isin(q, np.arange(0, 3000, 100), invert=True)] == 0).all()
    exact = np.round(queries @ pool[sound].T, 6) + 0.0
    for i in (0, 1, 99, 100, 2999):
        want = sorted(zip(-exact[i], names[sound]))[:4] if i % 100 == 0 else [(0.0, n) for n in smallest]
        assert [(-x, y) for x, y in zip(s[q == i], d[q == i])] == want


def test_interactive_encodes_the_pool_once(spark, monkeypatch):
    from trovekit import encoders
    from trovekit.plans.retrieval import interactive

    monkeypatch.setattr(blocks, "SENT_BYTES", 0)  # the form of many queries
    encoded = spark.sparkContext.accumulator(0)
    plain = encoders.get("hashed_words", dim=16)

    def counted(batches):
        for pdf in plain(batches):
            encoded.add(len(pdf))
            yield pdf

    texts = spark.range(300).select(F.concat(F.lit("3:"), "id").alias("did"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("txt"))
    users = spark.range(40).select(
        F.col("id").alias("pos"), F.lit("text").alias("query_modality"), F.concat(F.lit("w"), F.col("id") % 5).alias("query_txt"),
        F.lit(None).cast("string").alias("query_img_path"), F.lit("text").alias("candidate_modality"),
    )
    pool = texts.select(F.col("did").alias("id"), "txt").mapInPandas(counted, encoders.SCHEMA).withColumnRenamed("id", "did")
    queries = lambda q: search.encode(q.select(F.col("qid").alias("id"), F.col("query_txt").alias("txt")), plain, encoders.SCHEMA).withColumnRenamed("id", "qid")
    found = interactive(users, 4, queries, pool, texts.select("did"), 3).select("pos", "candidates").collect()
    assert encoded.value == 300
    vectors = {r.did: np.array(r.embedding) for r in pool.collect()}
    mine = {r.pos: np.array(r.embedding) for r in users.select(F.col("pos").cast("string").alias("id"), F.col("query_txt").alias("txt")).mapInPandas(plain, encoders.SCHEMA).select(F.col("id").cast("long").alias("pos"), "embedding").collect()}
    for r in found:
        want = sorted((-round(float(mine[r.pos] @ v), 6), did) for did, v in vectors.items())[:3]
        assert [(-c.score, c.did) for c in r.candidates] == want


def test_cells_hold_a_bounded_part_of_the_pool(spark):
    pool = spark.range(10)  # not counted where the caller knows its rows
    assert [blocks._pool_slices(pool, 200, groups, 3_000_000) for groups in (1000, 51, 1)] == [6, 6, blocks._cells(spark)]
    assert blocks._pool_slices(pool, 4, 1000, 3_000_000) == 4 and blocks._pool_slices(pool, 200, 1000, 0) == 1
