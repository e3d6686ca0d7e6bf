"""Collections built end to end, evaluation from files, and rows without a group or position."""

import os

from pyspark.sql import functions as F

from checks.base import clean, query, rate_sql, task_name_sql
from checks.q_convert import SOFT, UNIQUE_QUESTIONS, soft_rows
from checks.q_search import FIRST, RUN, pool_vectors, query_vectors
from trovekit import schemas
from trovekit.functions.ids import hash_did, hash_qid
from trovekit.operators import numbering, pools, sampling
from trovekit.plans import construction
from trovekit.plans.evaluation import evaluate_from_files
from trovekit.session import scratch_path
from trovekit.sources import records, stores, trec


def joined(c):
    return F.array_join(F.col(c), "|")


GRADED = f"""
, g AS (SELECT d.source AS id, d.doc_id AS ord, {clean('d.text')} AS txt, 'img/' || d.doc_id || '.jpg' AS img_path,
               CASE WHEN l.quality = 1 THEN 3 ELSE 1 + l.toxic END AS score
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN fx_manifest m ON m.img_path = 'img/' || d.doc_id || '.jpg' AND m.valid),
e AS (SELECT d.source AS id, min(d.doc_id) AS pos FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
p AS (SELECT g.*, e.pos, '5:' || row_number() OVER (ORDER BY e.pos, ord) AS did FROM g JOIN e USING (id) WHERE txt <> ''),
q AS (SELECT id, pos, string_agg(did, '|' ORDER BY ord) FILTER (score = 3) AS p, coalesce(string_agg(did, '|' ORDER BY ord) FILTER (score <> 3), '') AS n,
             count(*) FILTER (score = 3) AS np, count(*) FILTER (score <> 3) AS nn FROM p GROUP BY ALL)
SELECT '5:' || row_number() OVER (ORDER BY pos) AS qid, {clean("'about ' || id")} AS query_txt, md5(p) AS pos_list, md5(n) AS neg_list, np AS n_pos, nn AS n_neg, id
FROM q WHERE np > 0
"""


@query(needs="fx_manifest", sql=GRADED)
def collection_graded(t):
    score = F.when(F.col("quality") == 1, 3).otherwise(1 + F.col("toxic"))
    rows = t.documents.join(t.labels, "doc_id")
    graded = rows.select(
        F.col("source").alias("id"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").alias("candidate_id"),
        F.col("text").alias("caption"),
        F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("img_path"),
        score.alias("score"),
    )
    entries = rows.groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("pos")).withColumn("query", F.concat(F.lit("about "), "id"))
    queries, _ = construction.graded_collection(entries, graded, t.fx_manifest, 5)
    kind = "struct<id:string,pos_cand_candidate_id_scores:array<struct<candidate_id:string,score:string>>,neg_cand_candidate_id_scores:array<struct<candidate_id:string,score:string>>>"
    return queries.withColumn("s", F.from_json("query_src_content", kind)).select(
        "qid",
        "query_txt",
        F.md5(joined("pos_cand_list")).alias("pos_list"),
        F.md5(joined("neg_cand_list")).alias("neg_list"),
        F.size("s.pos_cand_candidate_id_scores").cast("long").alias("n_pos"),
        F.size("s.neg_cand_candidate_id_scores").cast("long").alias("n_neg"),
        F.col("s.id").alias("id"),
    )


@query(
    needs="fx_links",
    sql=f"""
, c AS (SELECT did AS old, pos, {clean('txt')} AS txt, img_path, modality FROM fx_pool WHERE modality <> 'image'),
u AS (SELECT txt, img_path, modality, '2:' || row_number() OVER (ORDER BY min(pos)) AS did FROM c WHERE txt <> '' GROUP BY ALL),
k AS (SELECT l.qid, l.label, CASE WHEN c.modality = 'text' THEN 1 ELSE 0 END AS part, l.ord, u.did
      FROM fx_links l JOIN c ON l.did = c.old JOIN u ON u.txt = c.txt AND u.img_path IS NOT DISTINCT FROM c.img_path AND u.modality = c.modality),
q AS (SELECT DISTINCT fx_users.qid, pos, conv_id FROM fx_users JOIN fx_links USING (qid))
SELECT '2:' || row_number() OVER (ORDER BY q.pos) AS new_qid, 'About ' || q.qid || '.' AS query_txt, q.qid AS guid,
       coalesce(p.l, '') AS pos_list, coalesce(n.l, '') AS neg_list
FROM q LEFT JOIN (SELECT qid, string_agg(did, '|' ORDER BY part, ord) AS l FROM k WHERE label = 'pos' GROUP BY qid) p ON p.qid = q.qid
LEFT JOIN (SELECT qid, string_agg(did, '|' ORDER BY part, ord) AS l FROM k WHERE label = 'neg' GROUP BY qid) n ON n.qid = q.qid
""",
)
def collection_facts(t):
    part = t.fx_pool.where("modality <> 'image'").select(
        "pos", F.lit(0).alias("place"), F.col("txt").alias("caption"), "img_path", F.col("lang").alias("src_content")
    )
    linked = t.fx_links.join(t.fx_pool.select("did", "txt", "img_path", "modality"), "did")

    def facts(label, modality):
        entry = F.when((F.col("label") == label) & (F.col("modality") == modality), F.struct("ord", F.struct("txt", "img_path").alias("f")))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["f"])

    lists = linked.groupBy("qid").agg(
        facts("pos", "image,text").alias("img_posFacts"),
        facts("neg", "image,text").alias("img_negFacts"),
        facts("pos", "text").alias("txt_posFacts"),
        facts("neg", "text").alias("txt_negFacts"),
    )
    questions = t.fx_users.select("qid", "pos", "conv_id").join(lists, "qid").withColumn("question", F.concat(F.lit("about "), "qid"))
    questions = questions.withColumnRenamed("qid", "guid").withColumn("category", F.col("conv_id"))
    queries, _ = construction.fact_collection(questions, [part], 2)
    return queries.select(
        F.col("qid").alias("new_qid"),
        "query_txt",
        F.get_json_object("query_src_content", "$.Guid").alias("guid"),
        joined("pos_cand_list").alias("pos_list"),
        joined("neg_cand_list").alias("neg_list"),
    )


@query(
    needs="fx_vectors",
    sql="""
, tr AS (SELECT e.vec_id AS id, (e.vec_id + 1) % n AS a, (e.vec_id + 2) % n AS b, e.label % 2 AS vote FROM embeddings e, (SELECT count(*) AS n FROM embeddings)),
img AS (SELECT vec_id, id AS did FROM fx_vectors WHERE modality <> 'text')
SELECT '4:' || row_number() OVER (ORDER BY tr.id) AS qid, 'ref/' || tr.id || '.png' AS query_img_path, '{"id":"' || tr.id || '"}' AS query_src_content,
       p.did AS pos_list, q.did AS neg_list
FROM tr JOIN img p ON p.vec_id = CASE WHEN vote = 0 THEN a ELSE b END JOIN img q ON q.vec_id = CASE WHEN vote = 0 THEN b ELSE a END
""",
)
def collection_votes(t):
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    rows = t.embeddings.withColumn("one", F.lit(1)).join(n, "one")

    def path(c):
        return F.concat(F.lit("distort/left/"), ((F.col("vec_id") + c) % F.col("n")).cast("string"), F.lit(".png"))

    triplets = rows.select(
        F.col("vec_id").alias("pos"),
        F.col("vec_id").alias("id"),
        F.concat(F.lit("ref/"), "vec_id", F.lit(".png")).alias("ref_path"),
        path(1).alias("left_path"),
        path(2).alias("right_path"),
        (F.col("label") % 2).cast("string").alias("right_vote"),
    )
    images = t.fx_vectors.where("modality <> 'text'").select(F.concat(F.lit("left/"), "vec_id").alias("image_id"), F.col("id").alias("did"))
    queries = construction.vote_collection(triplets, images, 4)
    return queries.select("qid", "query_img_path", "query_src_content", joined("pos_cand_list").alias("pos_list"), joined("neg_cand_list").alias("neg_list"))


@query(
    SOFT
    + f"""
, k AS (SELECT reference, caption, target, score, '8:' || substr(target, 2) AS did FROM latest WHERE target <> 'T7'),
f AS (SELECT reference, caption, min(pos) AS pos FROM r GROUP BY ALL),
q AS (SELECT f.*, string_agg(did, '|' ORDER BY target) FILTER (score = 1.0) AS p, coalesce(string_agg(did, '|' ORDER BY target) FILTER (score <> 1.0), '') AS n
      FROM f JOIN k USING (reference, caption) WHERE f.reference % 5 <> 0 GROUP BY ALL)
SELECT '8:' || row_number() OVER (ORDER BY pos) AS qid, {clean('caption')} AS query_txt, 'img/' || reference || '.png' AS query_img_path,
       reference::VARCHAR AS id, p AS pos_list, n AS neg_list FROM q WHERE p IS NOT NULL
"""
)
def collection_soft(t):
    rows = soft_rows(t).withColumn("reference", F.col("reference").cast("string"))
    targets = rows.select(F.explode(F.map_keys("target_soft")).alias("image_id")).distinct().where("image_id <> 'T7'")
    targets = targets.select("image_id", F.lit(None).cast("string").alias("img_path"), F.concat(F.lit("8:"), F.substring("image_id", 2, 9)).alias("did"))
    refs = rows.where("try_cast(reference AS long) % 5 <> 0").select("reference").distinct()
    refs = refs.select(F.col("reference").alias("image_id"), F.concat(F.lit("img/"), "reference", F.lit(".png")).alias("img_path"), F.lit("9:1").alias("did"))
    queries = construction.soft_collection(rows, targets.unionByName(refs), 8)
    return queries.select(
        "qid",
        "query_txt",
        "query_img_path",
        F.get_json_object("query_src_content", "$.id").alias("id"),
        joined("pos_cand_list").alias("pos_list"),
        joined("neg_cand_list").alias("neg_list"),
    )


@query(
    f"""
WITH x AS (SELECT p_partkey AS pos, p_partkey % 30 + 1 AS candidate, p_size AS target, p_type AS c2 FROM part),
im AS (SELECT p_partkey AS image_id, '7:' || (p_partkey + 1) AS did, 'img/' || p_partkey || '.jpg' AS img_path FROM part),
q AS (SELECT x.pos, {clean("lower(c2[1]) || c2[2:]")} AS query_txt, a.img_path AS query_img_path, b.did, candidate
      FROM x JOIN im a ON x.candidate = a.image_id JOIN im b ON x.target = b.image_id),
s AS (SELECT query_txt, query_img_path, candidate, did, min(pos) AS pos FROM q GROUP BY ALL)
SELECT '7:' || row_number() OVER (ORDER BY min(pos)) AS qid, query_txt, query_img_path, '{{"id":"' || candidate || '"}}' AS query_src_content,
       string_agg(did, '|' ORDER BY pos) AS pos_list FROM s GROUP BY query_txt, query_img_path, candidate
"""
)
def collection_composed(t):
    rows = t.part.select(
        F.col("p_partkey").alias("pos"),
        (F.col("p_partkey") % 30 + 1).alias("candidate"),
        F.col("p_size").cast("long").alias("target"),
        F.array(F.col("p_type")).alias("captions"),
    )
    images = t.part.select(
        F.col("p_partkey").alias("image_id"),
        F.concat(F.lit("7:"), (F.col("p_partkey") + 1).cast("string")).alias("did"),
        F.concat(F.lit("img/"), "p_partkey", F.lit(".jpg")).alias("img_path"),
    )
    queries = construction.composed_collection(rows, images, 7)
    return queries.select("qid", "query_txt", "query_img_path", "query_src_content", joined("pos_cand_list").alias("pos_list"))


@query(
    needs="fx_questions fx_kb fx_kb_manifest",
    sql=UNIQUE_QUESTIONS
    + f"""
, kind AS (SELECT k.entity_id, coalesce(m.valid, false) AS img FROM fx_kb k LEFT JOIN fx_kb_manifest m ON k.img_path = m.img_path),
r AS (SELECT uq.*, img, row_number() OVER (PARTITION BY uq.entity_id ORDER BY md5('2023:' || data_id), data_id) AS rn FROM uq JOIN kind USING (entity_id))
SELECT '5:' || row_number() OVER (ORDER BY pos) AS qid, data_id, entity_id::VARCHAR AS entity_id, {clean('question')} AS query_txt,
       'n:' || (entity_id * 2) || '|n:' || (entity_id * 2 + 1) AS added FROM r WHERE rn <= CASE WHEN img THEN 6 ELSE 3 END
""",
)
def collection_entity(t):
    questions = pools.first_seen(t.fx_questions.select("pos", "data_id", "question", "img_path", "entity_id", "file"), "data_id", "pos")
    chunks = t.fx_kb.select("entity_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    chunks = chunks.withColumn("did", F.concat(F.lit("n:"), (F.col("entity_id") * 2 + F.col("ord")).cast("string")))
    queries, pool = construction.entity_collection(questions, t.fx_kb, t.fx_kb_manifest, chunks, 5, 3, 6, 20)
    first = queries.withColumn("did", F.col("pos_cand_list")[0]).join(pool.select("did", "entity_id"), "did")
    return first.select(
        "qid",
        F.get_json_object("query_src_content", "$.data_id").alias("data_id"),
        F.col("entity_id").cast("string").alias("entity_id"),
        "query_txt",
        F.array_join(F.slice("pos_cand_list", F.lit(2), F.size("pos_cand_list") - 1), "|").alias("added"),
    )


@query(
    needs="fx_raw_pairs",
    sql=f"""
, c AS (SELECT pos, {clean('caption')} AS txt, img_path FROM fx_raw_pairs),
b AS (SELECT 'text' AS modality, txt AS value, pos, 0 AS part FROM c WHERE txt <> '' UNION ALL SELECT 'image', img_path, pos, 1 FROM c),
u AS (SELECT modality, value, min(pos * 2 + part) AS place FROM b GROUP BY ALL)
SELECT '3:' || row_number() OVER (ORDER BY place) AS did, modality, md5(value) AS value FROM u
""",
)
def files_to_pool(t):
    """JSON lines written in order, read with file positions, built into a pool."""
    path = scratch_path(t.spark, "raw")
    raw = t.fx_raw_pairs.select("pos", "caption", "img_path")
    records.write_jsonl(raw.repartitionByRange(5, "pos").sortWithinPartitions("pos").select("caption", "img_path"), path)
    schema = schemas.T.StructType([schemas.T.StructField(c, schemas.T.StringType()) for c in ("caption", "img_path")])
    pool = pools.text_image_pool(records.read_jsonl(t.spark, path, schema, "pos"), 3)
    return pool.select("did", "modality", F.md5(F.coalesce("txt", "img_path")).alias("value"))


SINGLE = """
, kept AS (SELECT qid, did, score FROM scored WHERE modality <> 'text'),
run2 AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM kept QUALIFY rank <= 5),
first2 AS (SELECT t.qid, t.task_id, min(r.rank) FILTER (WHERE q.did IS NOT NULL) AS fr
           FROM tasks t JOIN run2 r ON r.qid = t.qid LEFT JOIN fx_qrels q ON q.qid = r.qid AND q.did = r.did GROUP BY ALL),
hits2 AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE fr <= 1) AS hits_1, count(*) FILTER (WHERE fr <= 5) AS hits_5 FROM first2 GROUP BY task_id)
"""


@query(
    needs="fx_features fx_qrels",
    sql=RUN
    + FIRST
    + SINGLE
    + f"""
SELECT task_id::BIGINT AS "TaskID", {task_name_sql('task_id')} AS "Task", 'mscoco_task0' AS "Dataset", 'union' AS "CandPool",
       {rate_sql('hits_1', 'n')} AS r1, {rate_sql('hits_5', 'n')} AS r5, {rate_sql('hits_10', 'n')} AS r10 FROM hits
UNION ALL SELECT task_id::BIGINT, {task_name_sql('task_id')}, 'mscoco_task0', 'mscoco_task0_test', {rate_sql('hits_1', 'n')}, {rate_sql('hits_5', 'n')}, NULL FROM hits2
""",
)
def eval_from_files(t):
    """Queries, two pools, vectors and judgements written to files, evaluated, and the result table read back."""
    spark, data, store, out = t.spark, scratch_path(t.spark, "eval"), scratch_path(t.spark, "store"), scratch_path(t.spark, "results")
    empty = F.array().cast("array<string>")
    queries = query_vectors(t).select("qid", F.lit("q").alias("query_txt"), *[F.lit(None).cast("string").alias(c) for c in ("query_img_path", "query_modality", "query_src_content")], empty.alias("pos_cand_list"), empty.alias("neg_cand_list"))
    judged = t.fx_qrels.select("qid").distinct()
    records.write_jsonl(queries.join(judged, "qid", "left_semi"), os.path.join(data, "test/mscoco_task0_test.jsonl"))
    cands = pool_vectors(t).select("did", F.lit("c").alias("txt"), F.lit(None).cast("string").alias("img_path"), "modality", F.lit(None).cast("string").alias("src_content"))
    records.write_jsonl(cands, os.path.join(data, "union_pool/union_test_cand_pool.jsonl"))
    records.write_jsonl(cands.where("modality <> 'text'"), os.path.join(data, "local/mscoco_task0_test_cand_pool.jsonl"))
    ordered = t.fx_qrels.repartitionByRange(3, "pos").sortWithinPartitions("pos")
    trec.qrel_lines(ordered).write.text(os.path.join(data, "qrels/test/mscoco_task0_test_qrels.txt"))
    stores.write_embeddings(query_vectors(t).select(hash_qid("qid").alias("id"), "embedding"), store, "mscoco_task0_test")
    for name, keep in (("union", "true"), ("mscoco_task0_test_pool", "modality <> 'text'")):
        stores.write_embeddings(pool_vectors(t).where(keep).select(hash_did("did").alias("id"), "embedding"), store, name)
    config = {"test": {"datasets": ["MSCOCO_TASK0"] * 2, "pools": ["union", "MSCOCO_TASK0"], "qrels": ["MSCOCO_TASK0"] * 2, "metrics": ["Recall@1, Recall@5, Recall@10", "Recall@1, Recall@5"]}}
    evaluate_from_files(spark, data, store, config, out, pool_store=lambda pool: pool if pool == "union" else f"{pool}_pool")
    table = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(out, "results.tsv"))
    number = lambda c: F.col(f"`{c}`").cast("double")
    return table.select(F.col("TaskID").cast("long"), "Task", "Dataset", "CandPool", number("Recall@1").alias("r1"), number("Recall@5").alias("r5"), number("Recall@10").alias("r10"))


NULL_GROUP = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"


@query(
    f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY {NULL_GROUP} ORDER BY md5('2023:' || o_orderkey), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, rn <= 300 AS small FROM r WHERE rn <= 1500
"""
)
def cap_null_groups(t):
    rows = t.orders.select("o_orderkey", F.expr(NULL_GROUP).alias("g"))
    small = sampling.cap_per_group(rows, "g", "o_orderkey", 300).select("o_orderkey", F.lit(True).alias("small"))
    large = sampling.cap_per_group(rows, "g", "o_orderkey", 1500)
    return large.join(small, "o_orderkey", "left").select("o_orderkey", F.coalesce("small", F.lit(False)).alias("small"))


@query(
    """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * o_orderkey END AS p FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY p NULLS FIRST, o_orderkey) AS n FROM r
"""
)
def numbering_nulls(t):
    sparse = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * F.col("o_orderkey"))
    rows = t.orders.select("o_orderkey", sparse.alias("p"))
    return numbering.number_rows(rows, ["p", "o_orderkey"], bucket_rows=1000).select("o_orderkey", "n")
