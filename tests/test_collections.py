"""Pools, converters, merging and sampling on hand-written rows."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trovekit.operators import convert, links as L, merge, pools, sampling, samples, stats
from trovekit.plans.construction import caption_collection, kb_collection


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([("a.jpg", True), ("b.jpg", True), ("bad.jpg", False)], "img_path string, valid boolean")


def test_text_image_pool_first_seen(spark):
    raw = spark.createDataFrame(
        [(3, "two", "a.jpg"), (1, "one", "a.jpg"), (2, "One.", "b.jpg"), (4, "", "a.jpg")], "pos long, caption string, img_path string"
    )
    got = rows(pools.text_image_pool(raw, 0), "did", "txt", "img_path", "modality")
    assert got == [
        ("0:1", "One.", None, "text"),
        ("0:2", None, "a.jpg", "image"),
        ("0:3", None, "b.jpg", "image"),
        ("0:4", "Two.", None, "text"),
    ]


def test_pair_pool_list_order(spark, manifest):
    first = spark.createDataFrame([(9, "x", "a.jpg", "s1"), (10, "", "a.jpg", "s2")], "pos long, caption string, img_path string, src_content string")
    full = spark.createDataFrame([(1, "x", "a.jpg", "f1"), (2, "y", "a.jpg", "f2"), (3, "z", "bad.jpg", "f3")], first.schema)
    got = rows(pools.pair_pool([first, full], 3, manifest), "did", "txt", "src_content")
    assert got == [("3:1", "X.", "s1"), ("3:2", "Y.", "f2")]


def test_kb_pools(spark, manifest):
    text = " ".join(["w"] * 250)
    articles = spark.createDataFrame(
        [(1, "Q1", "t", text, "a.jpg"), (2, "Q2", "u", "", "bad.jpg"), (3, "Q1", "again", "x", None)],
        "pos long, entity_id string, title string, content string, img_path string",
    )
    kb = pools.kb_pool(articles, manifest, 5)
    assert rows(kb, "did", "modality", "img_path") == [("5:1", "image,text", "a.jpg"), ("5:2", "text", None)]
    assert [len(r.txt.split()) for r in kb.orderBy("did").collect()] == [101, 1]
    chunks = pools.chunked_kb_pool(articles.where("pos < 3"), manifest, 6)
    assert [len(r.txt.split()) - 1 for r in chunks.orderBy("did").collect()] == [100, 100, 50]
    assert all(r.txt.startswith("T. ") for r in chunks.collect())
    skip = spark.createDataFrame([("Q1",)], "entity_id string")
    assert pools.chunked_kb_pool(articles, manifest, 6, skip).count() == 0


def test_override_conflict_and_unique(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "did string, v string")
    b = spark.createDataFrame([("2", "z"), ("3", "w")], "did string, v string")
    assert rows(pools.override_merge(a, b, "did"), "did", "v") == [("1", "x"), ("2", "z"), ("3", "w")]
    assert rows(pools.conflicting_candidates(a.unionByName(b)), "did") == [("2",)]
    with pytest.raises(ValueError, match="duplicate did"):
        pools.ensure_unique(a.unionByName(b), "did")
    with pytest.raises(Exception, match="unknown candidate modality"):
        pools.task_of_candidate(a.withColumn("modality", F.lit("video")), {"text": "t"}).collect()


def test_merge_queries_golden(spark):
    schema = "pos long, qid string, query_txt string, query_img_path string, query_modality string, query_src_content string, pos_cand_list array<string>, neg_cand_list array<string>"
    q = spark.createDataFrame(
        [
            (2, "0:2", "q", None, "text", "second", ["b", "c"], ["n"]),
            (1, "0:1", "q", None, "text", "first", ["a", "b"], []),
            (3, "0:3", None, "i", "image", None, [], []),
            (4, "0:4", "", "i", "image", None, ["z"], []),
        ],
        schema,
    )
    got = {r.qid: (r.query_src_content, r.pos_cand_list, r.neg_cand_list) for r in merge.merge_queries(q).collect()}
    assert got == {"0:1": ("first", ["a", "b", "c"], ["n"]), "0:3": (None, [], []), "0:4": (None, ["z"], [])}


def test_soft_targets_later_value_wins(spark):
    schema = "pos long, reference string, caption string, pairid int, target_hard string, img_set string, target_soft map<string,double>"
    df = spark.createDataFrame([(1, "r", "c", 1, "x", "s", {"x": 1.0}), (2, "r", "c", 2, "y", "s", {"x": 0.5})], schema)
    merged = merge.merge_soft_targets(df)
    row = merged.first()
    assert (row.pairid_list, row.target_hard_list, row.target_soft) == ([1, 2], ["x", "y"], {"x": 0.5})
    images = spark.createDataFrame([("x", "8:1")], "image_id string, did string")
    assert convert.soft_targets(merged.withColumn("qid", F.lit("q")), images).count() == 0


def test_votes_reject_unknown(spark):
    images = spark.createDataFrame([("0/a", "4:1"), ("0/b", "4:2")], "image_id string, did string")
    t = spark.createDataFrame([("q", "x/0/a.png", "x/0/b.png", "1"), ("r", "x/0/a.png", "x/0/c.png", "0")], "qid string, left_path string, right_path string, right_vote string")
    assert rows(convert.votes(t, images), "qid", "pos_did", "neg_did") == [("q", "4:2", "4:1")]
    with pytest.raises(Exception, match="invalid vote"):
        convert.votes(t.withColumn("right_vote", F.lit("2")), images).collect()


def test_composed_queries_both_ways(spark):
    images = spark.createDataFrame([("a", "a.jpg", "7:1"), ("b", "b.jpg", "7:2")], "image_id string, img_path string, did string")
    q = spark.createDataFrame([(1, "a", "b", ["Is red.", "Has sleeves"]), (2, "a", "zz", ["x"])], "pos long, candidate string, target string, captions array<string>")
    assert rows(convert.composed_queries(q, images), "query_txt", "query_img_path", "did") == [("Is red and has sleeves.", "a.jpg", "7:2")]
    assert rows(convert.composed_queries(q, images, concatenate=False), "query_txt") == [("Has sleeves.",), ("Is red.",)]


def test_label_chunks_drops_queries_without_positive(spark):
    q = spark.createDataFrame([("q1", "Q", ["red"], []), ("q2", "Q", ["blue"], [])], "qid string, entity_id string, answer array<string>, answer_eval array<string>")
    chunks = spark.createDataFrame([("Q", 0, "a red one", "6:1"), ("Q", 1, "green", "6:2")], "entity_id string, ord int, txt string, did string")
    lists = L.collect_links(convert.label_chunks(q, chunks)).collect()
    assert [(r.qid, r.pos_cand_list, r.neg_cand_list) for r in lists] == [("q1", ["6:1"], ["6:2"])]


def test_caption_collection(spark, manifest):
    raw = spark.createDataFrame(
        [(1, "one", "a.jpg"), (2, "one", "b.jpg"), (3, "lost", "bad.jpg")], "pos long, caption string, img_path string"
    )
    queries, pool = caption_collection(raw, manifest, 0)
    assert pool.count() == 3
    got = {r.query_txt or r.query_img_path: (r.qid, r.pos_cand_list) for r in queries.collect()}
    assert got == {"a.jpg": ("0:1", ["0:1"]), "One.": ("0:2", ["0:2", "0:3"]), "b.jpg": ("0:3", ["0:1"])}


def test_kb_collection(spark, manifest):
    questions = spark.createDataFrame(
        [(1, "d1", "which?", ["red"], []), (2, "d2", "what?", ["none"], []), (3, "d1", "again?", ["red"], [])],
        "pos long, data_id string, question string, answer array<string>, answer_eval array<string>",
    )
    entity = spark.createDataFrame([("d1", "Q1"), ("d2", "Q1")], "data_id string, entity_id string")
    articles = spark.createDataFrame([(1, "Q1", "t", "a red thing", None), (2, "Q2", "u", "blue", None)], "pos long, entity_id string, title string, content string, img_path string")
    queries, pool = kb_collection(questions, entity, articles, manifest, 6)
    assert rows(pool, "did", "entity_id") == [("6:1", "Q1")]
    assert [(r.qid, r.data_id, r.pos_cand_list) for r in queries.collect()] == [("6:1", "d1", ["6:1"])]


def test_thirds_of_half(spark):
    df = spark.range(12).select(F.col("id").alias("key"), F.col("id").alias("pos"))
    got = sampling.split_thirds_of_half(df, "key").collect()
    assert sorted(r.split for r in got) == ["test", "test", "val", "val"]
    assert all(r.key < 6 for r in got)


def test_thirds_of_half_beyond_one_bucket(spark):
    df = spark.range(240_000).select(F.col("id").alias("key"), F.col("id").alias("pos"))
    got = sampling.split_thirds_of_half(df, "key").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("k")).collect()
    assert {r.split: r.n for r in got} == {"val": 40_000, "test": 40_000}
    assert all(r.k < 120_000 for r in got)


def test_missing_prompt_fails(spark):
    q = spark.createDataFrame([("0:1", "0", "text", "image")], "qid string, dataset_id string, query_modality string, cand_modality string")
    prompts = spark.createDataFrame([("1", "text", "image", ["p"])], "dataset_id string, query_modality string, cand_modality string, prompts array<string>")
    with pytest.raises(Exception, match="no prompt for"):
        sampling.pick_prompt(q, prompts).collect()
    assert sampling.pick_prompt(q, prompts, drop_missing=True).count() == 0


def test_sampling_ignores_partitioning(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"))
    a = rows(sampling.cap_per_group(df, "g", "key", 10), "key")
    b = rows(sampling.cap_per_group(df.repartition(17), "g", "key", 10), "key")
    assert a == b and len(a) == 30


def test_caps_equal_a_window_and_keep_null_groups(spark):
    third = F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2)
    df = spark.range(9000).select(F.col("id").alias("key"), third.alias("g"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.concat(F.lit("2023:"), F.col("key").cast("string"))), "key"))
    for limit in (200, 999, 1001, 2500, 5000):
        want = df.withColumn("rank", place).where(F.col("rank") <= limit).na.fill(-1)
        got = sampling.cap_per_group(df, "g", "key", limit).na.fill(-1)
        assert rows(got, "g", "key", "rank") == rows(want, "g", "key", "rank"), limit
        assert got.where("g = -1").count() == min(limit, 3000)


def test_training_samples_name_what_is_missing(spark):
    pool = spark.createDataFrame([("5:1", "A.", None, "text")], "did string, txt string, img_path string, modality string")
    prompts = spark.createDataFrame([("5", "text", "text", ["Find."])], "dataset_id string, query_modality string, cand_modality string, prompts array<string>")
    schema = "qid string, query_txt string, query_img_path string, query_modality string, pos_cand_list array<string>, neg_cand_list array<string>"

    def run(pos, neg, **how):
        queries = spark.createDataFrame([("5:9", "Q.", None, "text", pos, neg)], schema)
        return samples.training_samples(queries, pool, prompts, **how).collect()

    assert len(run(["5:1"], [])) == 1
    for pos, neg, how, message in [([], [], {}, "without positive"), (None, [], {}, "without positive"), (["5:1"], [], {"negatives": 2}, "without negative"), (["5:7"], [], {}, "not in the pool")]:
        with pytest.raises(Exception, match=message):
            run(pos, neg, **how)


def test_evaluation_samples_keep_own_dataset(spark):
    q = spark.createDataFrame([("5:1", ["6:1", "5:2"]), ("5:2", ["6:1"])], "qid string, pos_cand_list array<string>")
    assert [r.pos_cand_list for r in samples.same_dataset_positives(q).orderBy("qid").collect()] == [["5:2"], []]


def test_caption_counts_and_mixed(spark):
    df = spark.createDataFrame([("train", "i", ["a"]), ("train", "i", ["b"]), ("val", "j", ["a", "b"])], "split string, image string, captions array<string>")
    assert rows(stats.caption_counts(df), "split", "images", "captions") == [("train", 1, 2), ("val", 1, 2)]


def test_extended_lists_equal_the_links(spark):
    import random

    draw = random.Random(5)
    links = [(f"q{q}", "pos", o // (1 + q % 2), f"d{draw.randrange(30)}") for q in range(80) for o in range(draw.randrange(1, 5))]
    links += [("q0", "neg", 0, "d1"), ("q1", "pos", 9, "unknown"), ("alone", "pos", 0, "unknown")]
    links = spark.createDataFrame(links, "qid string, label string, ord long, did string")
    pool = spark.createDataFrame([(f"d{i}", None if i == 7 else f"e{i % 6}") for i in range(30)], "did string, entity_id string")
    # candidates of several entities, twice in one, of an entity without positives; entity e5 has none
    other = [(f"e{draw.randrange(5)}", o, f"o{draw.randrange(40)}") for o in range(90)] + [("e9", 1, "o1"), (None, 2, "o2")]
    other = spark.createDataFrame(other, "entity_id string, ord long, did string")
    joined = L.collect_links(convert.extend_by_entity(links, pool, other).where("label = 'pos'"))
    want = {r.qid: r.pos_cand_list for r in joined.collect()}
    got = convert.extended_lists(links, pool, other)
    assert {r.qid: r.pos_cand_list for r in got.select("qid", "pos_cand_list").collect()} == want
    assert len(want) == 81 and got.count() == 81


def test_answerable_questions_never_broadcast_contents(spark, monkeypatch, tmp_path):
    from trovekit.operators import substrings

    n = 60
    questions = [(i, f"q{i}", "what?", [f"a{i}", "none"] if i % 3 else [None], [""] if i == 5 else []) for i in range(n)]
    questions.append((n, "q1", "again?", ["none"], []))
    questions = spark.createDataFrame(questions, "pos long, data_id string, question string, answer array<string>, answer_eval array<string>")
    entity_of = spark.createDataFrame([(f"q{i}", i % 2) for i in range(n)], "data_id string, entity_id long")
    articles = spark.createDataFrame([(0, "-".join(f"a{i}" for i in range(0, n, 4))), (1, "a1x a55"), (2, None)], "entity_id long, content string")
    articles.write.parquet(str(tmp_path / "articles"))
    articles = spark.read.parquet(str(tmp_path / "articles"))  # small by its files
    text = {0: "-".join(f"a{i}" for i in range(0, n, 4)), 1: "a1x a55"}
    want = sorted(f"q{i}" for i in range(n) if i == 5 or (i % 3 and f"a{i}" in text[i % 2]))
    kept = convert.answerable_questions(questions, entity_of, articles)
    assert sorted(r.data_id for r in kept.collect()) == want
    # entities of more answers than one part
    real = substrings.answer_parts
    monkeypatch.setattr(convert, "answer_parts", lambda answers, key: real(answers, key, 4))
    seen = []
    real_store = convert.materialize
    monkeypatch.setattr(convert, "materialize", lambda df, label: (seen.append(df), real_store(df, label))[1])
    kept = convert.answerable_questions(questions, entity_of, articles)
    assert sorted(r.data_id for r in kept.collect()) == want
    plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin"  # the outermost one meets the contents


def test_numbering_ranges_stay_bounded(spark, monkeypatch):
    from trovekit.operators import numbering

    monkeypatch.setattr(numbering, "BUCKET_ROWS", 50)
    numbered = numbering.number_by_position(spark.range(500).select((F.col("id") * 7).alias("pos")), "pos", width=8 * 10**12)
    assert "Exchange SinglePartition" not in numbered.select("pos", "n")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert [(r.pos, r.n) for r in numbered.orderBy("pos").collect()] == [(7 * i, i + 1) for i in range(500)]


def test_chunks_are_cut_from_text_cleaned_once(spark, manifest):
    articles = spark.createDataFrame([(1, "Q1", "t", "a b", None)], "pos long, entity_id string, title string, content string, img_path string")
    for rows_ in (pools.chunked_kb_rows(articles, manifest), pools.chunked_kb_keys(articles)):
        plan = rows_._jdf.queryExecution().optimizedPlan().toString()
        cut = next(line for line in plan.splitlines() if "Generate" in line)
        # cleaning stands below the generator, whose expressions Spark does not share
        assert "split(content" in cut and "trim" not in cut


def test_augment_makes_texts_of_drawn_entities_only(spark, manifest, monkeypatch):
    from trovekit.operators import sampling
    from trovekit.operators.numbering import number_by_hash

    long = lambda i, n: " ".join(f"w{i}" for _ in range(n))
    data = [(i, None if i == 7 else f"Q{i}", f"t{i}", long(i, (i * 37) % 420), None) for i in range(120)]
    articles = spark.createDataFrame(data, "pos long, entity_id string, title string, content string, img_path string")
    have = spark.createDataFrame([("Q3",), ("Q4",)], "entity_id string")
    made = []
    real = sampling.chunked_kb_rows
    monkeypatch.setattr(sampling, "chunked_kb_rows", lambda a, *more, **k: (made.append(a.count()), real(a, *more, **k))[1])
    got = rows(sampling.augment_pool(have, articles, manifest, 6, 12), "did", "entity_id", "chunk", "txt")
    chunks = real(articles, manifest, skip=have)
    key = F.concat_ws(":", F.col("entity_id").cast("string"), F.col("chunk").cast("string"))
    want = number_by_hash(chunks.withColumn("key", key), "key", out="n", limit=12)
    assert got == rows(want.withColumn("did", F.concat(F.lit("6:"), (F.col("n") + 2).cast("string"))), "did", "entity_id", "chunk", "txt")
    assert len(got) == 12 and made and max(made) < 30
    everything = sampling.augment_pool(have, articles, manifest, 6, 10_000)
    assert everything.count() == chunks.count() and everything.where("entity_id IS NULL").count() == chunks.where("entity_id IS NULL").count() > 0


def test_kb_pool_stores_no_whole_contents(spark, manifest, monkeypatch):
    from trovekit.operators import numbering

    articles = spark.createDataFrame(
        [(i, f"Q{i % 6}", "t", " ".join(f"w{i}" for _ in range(40 * i)), "a.jpg") for i in range(9)],
        "pos long, entity_id string, title string, content string, img_path string",
    )
    longest = []
    real = numbering.materialize

    def spy(df, label="stage"):
        out = real(df, label)
        texts = [F.coalesce(F.max(F.size(F.split(c, " "))), F.lit(0)) for c, kind in out.dtypes if kind == "string"]
        longest.append(max(out.agg(*texts).first(), default=0) if texts else 0)
        return out

    monkeypatch.setattr(numbering, "materialize", spy)
    got = pools.kb_pool(articles, manifest, 5).orderBy("pos").collect()
    assert [(r.entity_id, len(r.txt.split())) for r in got] == [(f"Q{i}", 1 + min(100, 40 * i)) for i in range(6)]
    assert 100 < max(longest) <= 101
