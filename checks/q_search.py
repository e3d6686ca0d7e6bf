"""Embedding retrieval, evaluation and mining."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import domain_sql, query, rate_sql, task_id_sql, task_name_sql, unit, words
from trovekit import encoders
from trovekit.functions.vectors import fuse
from trovekit.operators import batch_metrics, evaluate, search
from trovekit.plans import retrieval

FUSED = f"""
, raw AS (SELECT v.id AS qid, list_transform(list_zip(img::DOUBLE[], txt::DOUBLE[]), lambda x: x[1] * img_mask + x[2] * txt_mask) AS v
          FROM fx_features f JOIN fx_vectors v ON v.vec_id = f.id),
fq AS (SELECT qid, {unit('v')} AS u FROM raw), fp AS (SELECT id AS did, modality, {unit('embedding')} AS u FROM fx_vectors)
"""
SCORED = FUSED + """
, scored AS (SELECT qid, did, modality, round(list_dot_product(fq.u, fp.u), 6) AS score FROM fq, fp)
"""
RUN = SCORED + """
, run AS (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM scored QUALIFY rank <= 10)
"""
NEED = "fx_vectors fx_features"


def query_vectors(t):
    names = t.fx_vectors.select(F.col("vec_id").alias("id"), F.col("id").alias("qid"))
    fused = t.fx_features.select("id", fuse("img", "txt", "img_mask", "txt_mask").alias("embedding"))
    return fused.join(names, "id").select("qid", "embedding")


def pool_vectors(t):
    return t.fx_vectors.select(F.col("id").alias("did"), "embedding", "modality", "pos")


def run10(t):
    return search.top_k(query_vectors(t), pool_vectors(t), 10)


@query(needs=NEED, sql=RUN + "SELECT qid, did, score, rank FROM run")
def topk_search(t):
    return run10(t).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""
WITH u AS (SELECT vec_id, {unit('embedding')} AS u FROM embeddings), p AS (
SELECT a.vec_id AS qid, b.vec_id AS did, round(list_dot_product(a.u, b.u), 6) AS score FROM u a, u b)
SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM p QUALIFY rank <= 10
"""
)
def topk_self(t):
    q = t.embeddings.select(F.col("vec_id").alias("qid"), "embedding")
    p = t.embeddings.select(F.col("vec_id").alias("did"), "embedding")
    return search.top_k(q, p, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    """
WITH p AS (SELECT a.vec_id AS qid, b.vec_id AS did, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS ip,
                  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
i AS (SELECT 'ip' AS metric, qid, did, round(ip, 6) AS score FROM p), l AS (SELECT 'l2', qid, did, round(-d * d, 6) + 0 FROM p),
x AS (SELECT * FROM i UNION ALL SELECT * FROM l)
SELECT metric, qid, did, score, row_number() OVER (PARTITION BY metric, qid ORDER BY score DESC, did) AS rank FROM x QUALIFY rank <= 3
"""
)
def topk_metrics(t):
    q = t.embeddings.select(F.col("vec_id").alias("qid"), "embedding")
    p = t.embeddings.select(F.col("vec_id").alias("did"), "embedding")
    ip = search.top_k(q, p, 3, metric="ip").withColumn("metric", F.lit("ip"))
    l2 = search.top_k(q, p, 3, metric="l2").withColumn("metric", F.lit("l2"))
    return ip.unionByName(l2).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT vec_id, unnest(range(64)) AS i, round(unnest({unit('embedding')}), 6) AS x FROM embeddings")
def build_index(t):
    index = search.build_index(t.embeddings, 64, "vec_id")
    rows = index.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


BAG = f"""
, w AS (SELECT id, unnest({words('txt')}) AS word FROM texts),
s AS (SELECT id, cast('0x' || substr(md5(word), 1, 8) AS bigint) % 64 AS slot, count(*) AS c FROM w GROUP BY ALL),
n AS (SELECT id, sqrt(sum(c * c)) AS n FROM s GROUP BY id), bag AS (SELECT s.id, slot, c / n AS x FROM s JOIN n USING (id))
"""


@query("WITH texts AS (SELECT doc_id::VARCHAR AS id, text AS txt FROM documents)" + BAG + "SELECT id, slot, round(x, 6) AS x FROM bag")
def encode_batch(t):
    records = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("txt"), F.col("doc_id").alias("pos"))
    vectors = search.encode_unique(records, encoders.get("hashed_words", dim=64), encoders.SCHEMA, "id", "pos")
    rows = vectors.select("id", F.posexplode("embedding").alias("slot", "x")).where("x <> 0")
    return rows.select("id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


@query(
    needs="fx_users fx_pool",
    sql=f"""
, good AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM fx_users WHERE query_modality <> 'image' OR query_txt IS NULL),
prep AS (SELECT '4:' || n AS qid, query_modality, query_txt, {task_id_sql('query_modality', "'text'")} AS task_id FROM good),
texts AS (SELECT 'd' || did AS id, txt FROM fx_pool UNION ALL SELECT 'q' || qid, query_txt FROM prep)"""
    + BAG
    + """
, pairs AS (SELECT q.id AS q, d.id AS d, sum(q.x * d.x) AS s FROM bag q JOIN bag d ON q.slot = d.slot WHERE q.id[1] = 'q' AND d.id[1] = 'd' GROUP BY ALL),
allp AS (SELECT prep.qid, prep.task_id, f.did, f.modality, f.img_path, round(coalesce(s, 0), 6) AS score FROM prep CROSS JOIN fx_pool f LEFT JOIN pairs ON pairs.q = 'q' || prep.qid AND pairs.d = 'd' || f.did)
SELECT qid, task_id::BIGINT AS task_id, did, modality, img_path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM allp QUALIFY rank <= 3
""",
)
def interactive(t):
    encoder = encoders.get("hashed_words", dim=64)

    def vectors(df, key, txt):
        records = df.select(F.col(key).alias("id"), F.col(txt).alias("txt"))
        return search.encode(records, encoder, encoders.SCHEMA).withColumnRenamed("id", key)

    queries = t.fx_users.select("pos", "query_modality", "query_txt", "query_img_path").withColumn("candidate_modality", F.lit("text"))
    pool = t.fx_pool.select("did", "modality", "img_path", "txt")
    found = retrieval.interactive(
        queries, 4, lambda q: vectors(q, "qid", "query_txt"), vectors(pool, "did", "txt"), pool.drop("txt"), 3
    )
    rows = found.select("qid", "task_id", F.explode("candidates").alias("c"))
    return rows.select(
        "qid", F.col("task_id").cast("long").alias("task_id"), "c.did", "c.modality", "c.img_path", "c.score", F.col("c.rank").cast("long").alias("rank")
    )


@query(
    needs="fx_users",
    sql="""
SELECT qid, CASE WHEN conv_id % 4 = 0 THEN 'unknown modality' WHEN query_modality = 'image' AND conv_id % 4 = 1 THEN 'image query with text'
                 WHEN query_modality = 'text' AND conv_id % 4 = 2 THEN 'text query with image'
                 WHEN query_modality = 'image,text' AND conv_id % 4 = 3 THEN 'image and text query without image' END AS problem
FROM fx_users
""",
)
def query_consistency(t):
    c = F.col("conv_id") % 4
    broken = t.fx_users.select(
        "qid",
        F.when(c == 0, "video").otherwise(F.col("query_modality")).alias("query_modality"),
        F.when((c == 1) & (F.col("query_modality") == "image"), "words").otherwise(F.col("query_txt")).alias("query_txt"),
        F.when((c == 2) & (F.col("query_modality") == "text"), "a.jpg")
        .when((c == 3) & (F.col("query_modality") == "image,text"), "")
        .otherwise(F.col("query_img_path"))
        .alias("query_img_path"),
    )
    return search.check_queries(broken).select("qid", "problem")


@query(needs=NEED, sql=RUN + "SELECT r.qid, r.rank, r.did, v.modality, v.label::BIGINT AS label FROM run r JOIN fx_vectors v ON r.did = v.id")
def hydrate(t):
    pool = t.fx_vectors.select(F.col("id").alias("did"), "modality", "label")
    lists = search.hydrate_lists(run10(t), pool)
    rows = lists.select("qid", F.posexplode("candidates").alias("p", "c"))
    return rows.select("qid", (F.col("p") + 1).cast("long").alias("rank"), "c.did", "c.modality", F.col("c.label").cast("long").alias("label"))


@query(
    needs=NEED,
    sql=RUN + "SELECT r.qid, r.rank, r.did, r.score FROM run r JOIN fx_vectors v ON r.did = v.id WHERE v.modality = 'image,text'",
)
def retrieved_pairs(t):
    rows = search.retrieved_pairs(run10(t), t.fx_vectors.select(F.col("id").alias("did"), "modality"))
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), "did", "score")


FIRST = """
, tasks AS (SELECT qid, min_by(task_id, pos) AS task_id FROM fx_qrels GROUP BY qid),
first AS (SELECT t.qid, t.task_id, min(r.rank) FILTER (WHERE q.did IS NOT NULL) AS fr
          FROM tasks t JOIN run r ON r.qid = t.qid LEFT JOIN fx_qrels q ON q.qid = r.qid AND q.did = r.did GROUP BY ALL),
hits AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE fr <= 1) AS hits_1, count(*) FILTER (WHERE fr <= 5) AS hits_5,
                count(*) FILTER (WHERE fr <= 10) AS hits_10 FROM first GROUP BY task_id)
"""


@query(
    needs="fx_features fx_qrels",
    sql=RUN
    + FIRST
    + f"""
SELECT task_id::BIGINT AS task_id, n, hits_1, hits_5, hits_10, {rate_sql('hits_1', 'n')} AS r1, {rate_sql('hits_5', 'n')} AS r5, {rate_sql('hits_10', 'n')} AS r10 FROM hits
""",
)
def hit_at_k(t):
    counts = evaluate.hit_counts(run10(t), t.fx_qrels, [1, 5, 10])
    rates = evaluate.hit_rates(counts, [1, 5, 10])
    return rates.select(
        F.col("task_id").cast("long").alias("task_id"),
        "n",
        "hits_1",
        "hits_5",
        "hits_10",
        F.col("Recall@1").alias("r1"),
        F.col("Recall@5").alias("r5"),
        F.col("Recall@10").alias("r10"),
    )


@query(needs="fx_features fx_qrels", sql=RUN + "SELECT count(DISTINCT qid) AS unjudged FROM run WHERE qid NOT IN (SELECT qid FROM fx_qrels)")
def unjudged_queries(t):
    return evaluate.unjudged(run10(t), t.fx_qrels)


RESULTS = (
    SCORED
    + """
, pools AS (SELECT qid, did, score, 'union' AS pool FROM scored UNION ALL SELECT qid, did, score, 'pictures' FROM scored WHERE modality <> 'text'),
run AS (SELECT pool, qid, did, row_number() OVER (PARTITION BY pool, qid ORDER BY score DESC, did) AS rank FROM pools QUALIFY rank <= 10),
tasks AS (SELECT qid, min_by(task_id, pos) AS task_id FROM fx_qrels GROUP BY qid),
first AS (SELECT r.pool, t.qid, t.task_id, min(r.rank) FILTER (WHERE q.did IS NOT NULL) AS fr
          FROM tasks t JOIN run r ON r.qid = t.qid LEFT JOIN fx_qrels q ON q.qid = r.qid AND q.did = r.did GROUP BY ALL),
hits AS (SELECT task_id, pool, count(*) AS n, count(*) FILTER (WHERE fr <= 1) AS h1, count(*) FILTER (WHERE fr <= 10) AS h10 FROM first GROUP BY ALL)
"""
    + f", res AS (SELECT task_id, pool, {rate_sql('h1', 'n')} AS r1, {rate_sql('h10', 'n')} AS r10 FROM hits)"
)


def results(t):
    config = {
        "test": {
            "datasets": ["Vectors", "Vectors"],
            "pools": ["pictures", "UNION"],
            "qrels": ["vectors", "vectors"],
            "metrics": ["Recall@1, Recall@10", "Recall@1, Recall@10"],
        }
    }
    from trovekit.sources.catalog import catalog

    pool = pool_vectors(t)
    runs = retrieval.embedding_runs(
        catalog(t.spark, config),
        {"vectors": query_vectors(t)},
        {"pictures": pool.where("modality <> 'text'"), "union": pool},
    )
    return retrieval.evaluate_runs(runs, t.fx_qrels.withColumn("dataset", F.lit("vectors")), [1, 10])


@query(
    needs="fx_features fx_qrels",
    sql=RESULTS
    + f"""
SELECT task_id::BIGINT AS "TaskID", {task_name_sql('task_id')} AS "Task", 'vectors' AS "Dataset", 'test' AS "Split", pool AS "CandPool", r1, r10,
       row_number() OVER (ORDER BY task_id, CASE pool WHEN 'union' THEN 99 ELSE 0 END) AS place FROM res
""",
)
def result_order(t):
    # a result table has two rows per task: numbering it needs one small partition
    place = F.row_number().over(Window.orderBy(*evaluate.order_columns()))
    rows = results(t).withColumn("place", place.cast("long"))
    return rows.withColumnRenamed("Recall@1", "r1").withColumnRenamed("Recall@10", "r10").withColumn("TaskID", F.col("TaskID").cast("long"))


@query(
    needs="fx_features fx_qrels",
    sql=RESULTS
    + f"""
, long AS (SELECT task_id, pool, 'Recall@1' AS metric, r1 AS value FROM res UNION ALL SELECT task_id, pool, 'Recall@10', r10 FROM res)
SELECT s.task_id::BIGINT AS "TaskID", {task_name_sql('s.task_id')} AS "Task", s.metric AS "Metric", s.pool AS "CandPool", s.value AS "Value", 'union' AS "UnionPool", u.value AS "UnionValue"
FROM long s JOIN long u ON s.task_id = u.task_id AND s.metric = u.metric AND u.pool = 'union' WHERE s.pool <> 'union'
""",
)
def results_long(t):
    rows = retrieval.report(results(t))
    return rows.select(
        F.col("TaskID").cast("long").alias("TaskID"), "Task", "Metric", "CandPool", "Value", "UnionPool", F.col("UnionValue").cast("double").alias("UnionValue")
    )


TYPED = RUN + f"""
, tasks AS (SELECT qid, min_by(task_id, pos) AS task_id FROM fx_qrels GROUP BY qid),
typed AS (SELECT r.qid, r.did, t.task_id, CASE WHEN q.did IS NOT NULL THEN 0 WHEN split_part({task_name_sql('t.task_id')}, ' -> ', 2) <> v.modality THEN 1
                 WHEN {domain_sql("split_part(r.qid, ':', 1)::INT")} <> {domain_sql("split_part(r.did, ':', 1)::INT")} THEN 2 ELSE 3 END AS error_type
          FROM run r JOIN tasks t ON r.qid = t.qid JOIN fx_vectors v ON v.id = r.did
          LEFT JOIN (SELECT DISTINCT qid, did FROM fx_qrels) q ON q.qid = r.qid AND q.did = r.did WHERE r.rank = 1)
"""


def typed(t):
    positives = t.fx_qrels.select("qid", F.lit("pos").alias("label"), F.lit(0).alias("ord"), "did")
    return evaluate.error_types(run10(t), positives, t.fx_qrels, pool_vectors(t))


@query(needs="fx_features fx_qrels", sql=TYPED + "SELECT qid, did, task_id::BIGINT AS task_id, error_type::BIGINT AS error_type FROM typed")
def error_types(t):
    return typed(t).withColumn("task_id", F.col("task_id").cast("long")).withColumn("error_type", F.col("error_type").cast("long"))


@query(
    needs="fx_features fx_qrels",
    sql=TYPED
    + f"""
, tot AS (SELECT count(*) AS f FROM typed WHERE error_type > 0),
c AS (SELECT task_id, count(*) FILTER (WHERE error_type = 1) AS a, count(*) FILTER (WHERE error_type = 2) AS b, count(*) FILTER (WHERE error_type = 3) AS d FROM typed GROUP BY task_id)
SELECT task_id::BIGINT AS task_id, f AS false_positives, {rate_sql('a', 'f')} AS t1, {rate_sql('b', 'f')} AS t2, {rate_sql('d', 'f')} AS t3 FROM c, tot
""",
)
def error_rates(t):
    rows = evaluate.error_rates(typed(t))
    return rows.select(
        F.col("task_id").cast("long").alias("task_id"),
        "false_positives",
        F.col("Type1").alias("t1"),
        F.col("Type2").alias("t2"),
        F.col("Type3").alias("t3"),
    )


@query(
    needs="fx_features fx_qrels",
    sql=RUN
    + """
, fresh AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS slot, count(*) OVER (PARTITION BY qid) AS m FROM run r
            WHERE NOT EXISTS (SELECT 1 FROM fx_qrels q WHERE q.qid = r.qid AND q.did = r.did)),
slots AS (SELECT qid, did, unnest(range(slot, 12, m)) AS ord FROM fresh)
SELECT qid, ord, did FROM slots
""",
)
def hard_negatives(t):
    known = t.fx_qrels.select("qid", F.lit("pos").alias("label"), F.col("pos").alias("ord"), "did")
    mined = search.hard_negatives(run10(t), known, 12)
    return mined.select("qid", F.col("ord").cast("long").alias("ord"), "did")


@query(
    needs="fx_features fx_qrels",
    sql=RUN
    + """
, fresh AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY rank) AS slot FROM run r
            WHERE NOT EXISTS (SELECT 1 FROM fx_qrels q WHERE q.qid = r.qid AND q.did = r.did)),
neg AS (SELECT qid, string_agg(did, '|' ORDER BY slot) AS negs FROM fresh WHERE slot <= 4 GROUP BY qid),
p AS (SELECT qid, string_agg(did, '|' ORDER BY pos) AS poss FROM fx_qrels GROUP BY qid)
SELECT v.id AS qid, coalesce(p.poss, '') AS pos, coalesce(neg.negs, '') AS neg FROM fx_vectors v LEFT JOIN p ON p.qid = v.id LEFT JOIN neg ON neg.qid = v.id
""",
)
def mined_records(t):
    known = t.fx_qrels.select("qid", F.lit("pos").alias("label"), F.col("pos").alias("ord"), "did")
    records = t.fx_vectors.select(F.col("id").alias("qid"))
    rows = retrieval.mine_hard_negatives(records, known, query_vectors(t), pool_vectors(t), 10, 4)
    return rows.select("qid", F.array_join("pos_cand_list", "|").alias("pos"), F.array_join("neg_cand_list", "|").alias("neg"))


BATCH = f"""
, b AS (SELECT id // 32 AS batch, id AS pos, {unit('img')} AS q, {unit('txt')} AS p FROM fx_features)
"""


@query(
    needs="fx_features",
    sql=BATCH
    + """
, s AS (SELECT a.batch, a.pos, c.pos AS other, list_dot_product(a.q, c.p) / 0.07 AS l FROM b a JOIN b c ON a.batch = c.batch),
r AS (SELECT batch, pos, ln(sum(exp(l))) - max(l) FILTER (WHERE pos = other) AS loss, arg_max(other, round(l, 6)) = pos AS hit FROM s GROUP BY batch, pos)
SELECT batch, count(*) AS n, round(avg(loss), 5) AS loss, round(avg(hit::INT), 6) AS accuracy FROM r GROUP BY batch
""",
)
def inbatch_metrics(t):
    rows = t.fx_features.select(F.floor(F.col("id") / 32).alias("batch"), F.col("id").alias("pos"), F.col("img").alias("q"), F.col("txt").alias("p"))
    out = batch_metrics.inbatch_metrics(rows)
    return out.select("batch", "n", F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(
    needs="fx_features",
    sql=BATCH
    + f"""
, negs AS (SELECT f.id AS pos, {unit('e.embedding')} AS v FROM fx_features f JOIN embeddings e ON e.vec_id = (f.id + 7) % (SELECT count(*) FROM embeddings)
           UNION ALL SELECT f.id, {unit('e.embedding')} FROM fx_features f JOIN embeddings e ON e.vec_id = (f.id + 19) % (SELECT count(*) FROM embeddings)),
others AS (SELECT a.pos, c.p AS v FROM b a JOIN b c ON a.batch = c.batch AND a.pos <> c.pos QUALIFY row_number() OVER (PARTITION BY a.pos ORDER BY c.pos) <= 3),
s AS (SELECT b.batch, b.pos, 1 AS own, list_dot_product(b.q, b.p) / 0.07 AS l FROM b UNION ALL
      SELECT b.batch, b.pos, 0, list_dot_product(b.q, n.v) / 0.07 FROM b JOIN (SELECT * FROM negs UNION ALL SELECT * FROM others) n ON n.pos = b.pos),
r AS (SELECT batch, pos, ln(sum(exp(l))) - max(l) FILTER (WHERE own = 1) AS loss, round(max(l) FILTER (WHERE own = 1), 6) >= round(max(l) FILTER (WHERE own = 0), 6) AS hit FROM s GROUP BY batch, pos)
SELECT batch, count(*) AS n, round(avg(loss), 5) AS loss, round(avg(hit::INT), 6) AS accuracy FROM r GROUP BY batch
""",
)
def hardneg_metrics(t):
    e = t.embeddings
    rows = t.fx_features.select(
        F.floor(F.col("id") / 32).alias("batch"), F.col("id").alias("pos"), F.col("img").alias("q"), F.col("txt").alias("p")
    )
    n = e.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    shifts = rows.select("pos", F.lit(1).alias("one")).join(n, "one").select(
        "pos", F.explode(F.array(*[(F.col("pos") + k) % F.col("n") for k in (7, 19)])).alias("vec_id")
    )
    negs = shifts.join(e.select("vec_id", "embedding"), "vec_id").groupBy("pos").agg(F.collect_list("embedding").alias("negs"))
    out = batch_metrics.hard_negative_metrics(rows.join(negs, "pos"), in_batch=3)
    return out.select("batch", "n", F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
