"""Candidate pools."""

from pyspark.sql import functions as F

from checks.base import chunks, clean, query
from trovekit.operators import links as L
from trovekit.operators import pools
from trovekit.operators.numbering import number_by_hash, number_rows
from trovekit.functions.stable import hash_order
from trovekit.sources.images import demote_invalid_image, with_valid_image

TEXT_IMAGE = f"""
, c AS (SELECT pos, {clean('caption')} AS txt, img_path, src_content, split FROM fx_raw_pairs),
cand AS (SELECT pos, 0 AS part, 'text' AS modality, txt AS value, src_content FROM c
         UNION ALL SELECT pos, 1, 'image', img_path, src_content FROM c),
uniq AS (SELECT * FROM cand WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY modality, value ORDER BY pos, part) = 1),
pool AS (SELECT '3:' || row_number() OVER (ORDER BY pos, part) AS did, * FROM uniq)
"""


def _src():
    return F.col("src_content")


@query(
    needs="fx_raw_pairs",
    sql=TEXT_IMAGE
    + """
SELECT did, CASE WHEN modality = 'text' THEN md5(value) END AS txt, CASE WHEN modality = 'image' THEN value END AS img_path,
       modality, src_content FROM pool
""",
)
def pool_text_image(t):
    pool = pools.text_image_pool(t.fx_raw_pairs, 3, _src())
    return pool.select("did", F.md5("txt").alias("txt"), "img_path", "modality", "src_content")


@query(
    needs="fx_raw_pairs",
    sql=TEXT_IMAGE
    + """
SELECT DISTINCT c.split, pool.modality, pool.did
FROM c JOIN pool ON (pool.modality = 'text' AND pool.value = c.txt) OR (pool.modality = 'image' AND pool.value = c.img_path)
""",
)
def pool_split_subpools(t):
    _, members = pools.split_subpools(t.fx_raw_pairs, 3)
    return members


PAIRS = f"""
, parts AS (
  SELECT 0 AS part, d.doc_id AS pos, {clean('d.text')} AS txt, 'img/' || d.doc_id || '.jpg' AS img_path, NULL AS src_content
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 1, doc_id, {clean('text')}, 'img/' || doc_id || '.jpg', lang FROM documents),
good AS (SELECT p.* FROM parts p JOIN fx_manifest m ON p.img_path = m.img_path AND m.valid WHERE txt <> ''),
uniq AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY txt, img_path ORDER BY part, pos) = 1),
pairs AS (SELECT '5:' || row_number() OVER (ORDER BY part, pos) AS did, txt, img_path, src_content FROM uniq)
"""


def pair_parts(t):
    img = F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("img_path")
    docs = t.documents.select(F.col("doc_id").alias("pos"), F.col("text").alias("caption"), img, F.col("lang").alias("src_content"), "doc_id")
    labelled = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").withColumn("src_content", F.lit(None).cast("string"))
    return [labelled.drop("doc_id"), docs.drop("doc_id")]


def pair_pool(t):
    return pools.pair_pool(pair_parts(t), 5, t.fx_manifest)


@query(needs="fx_manifest", sql=PAIRS + "SELECT did, md5(txt) AS txt, img_path, 'image,text' AS modality, src_content FROM pairs")
def pool_pairs(t):
    return pair_pool(t).withColumn("txt", F.md5("txt"))


@query(
    needs="fx_pool fx_manifest",
    sql=f"""
, f AS (SELECT 0 AS part, pos, 0 AS place, {clean('txt')} AS txt, img_path, lang FROM fx_pool
        UNION ALL SELECT 1, pos, 1, {clean('source')}, NULL, source FROM fx_pool),
good AS (SELECT f.* FROM f LEFT JOIN fx_manifest m ON f.img_path = m.img_path WHERE txt <> '' AND (f.img_path IS NULL OR m.valid)),
uniq AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY txt, img_path ORDER BY part, pos, place) = 1)
SELECT '2:' || row_number() OVER (ORDER BY part, pos, place) AS did, md5(txt) AS txt, img_path,
       CASE WHEN img_path IS NULL THEN 'text' ELSE 'image,text' END AS modality, lang AS src_content FROM uniq
""",
)
def pool_facts(t):
    first = t.fx_pool.select("pos", F.lit(0).alias("place"), F.col("txt").alias("caption"), "img_path", F.col("lang").alias("src_content"))
    second = t.fx_pool.select(
        "pos",
        F.lit(1).alias("place"),
        F.col("source").alias("caption"),
        F.lit(None).cast("string").alias("img_path"),
        F.col("source").alias("src_content"),
    )
    return pools.fact_pool([first, second], 2, t.fx_manifest).withColumn("txt", F.md5("txt"))


@query(
    needs="fx_pool fx_manifest",
    sql="""
SELECT '7:' || row_number() OVER (ORDER BY p.img_path) AS did, p.img_path
FROM (SELECT DISTINCT img_path FROM fx_pool WHERE img_path IS NOT NULL) p JOIN fx_manifest m ON p.img_path = m.img_path AND m.valid
""",
)
def pool_images(t):
    paths = t.fx_pool.where(F.col("img_path").isNotNull()).select("img_path")
    return pools.image_pool(paths, 7, manifest=t.fx_manifest).select("did", "img_path")


KB = f"""
, a AS (SELECT f.pos, f.entity_id, title, content, CASE WHEN m.valid THEN f.img_path END AS img_path,
               CASE WHEN m.valid THEN 'image,text' ELSE 'text' END AS modality
        FROM fx_kb f LEFT JOIN fx_kb_manifest m ON f.img_path = m.img_path)
"""
CHUNKS = (
    KB
    + f"""
, pieces AS (SELECT pos, entity_id, title, img_path, modality, {chunks(clean('content'))} AS l FROM a),
flat AS (SELECT pos, entity_id, title, img_path, modality, unnest(range(len(l))) AS chunk, unnest(l) AS piece FROM pieces),
texts AS (SELECT pos, chunk, entity_id, img_path, modality, {clean("title || '. ' || piece")} AS txt FROM flat)
"""
)


@query(
    needs="fx_kb fx_kb_manifest",
    sql=KB
    + f"""
, x AS (SELECT *, {clean("title || '. ' || array_to_string(([w FOR w IN regexp_split_to_array(content, chr(92) || 's+') IF w <> ''])[1:100], ' ')")} AS txt FROM a)
SELECT '5:' || row_number() OVER (ORDER BY pos) AS did, entity_id, md5(txt) AS txt, img_path, modality FROM x WHERE txt <> ''
""",
)
def pool_kb(t):
    pool = pools.kb_pool(t.fx_kb, t.fx_kb_manifest, 5)
    return pool.select("did", "entity_id", F.md5("txt").alias("txt"), "img_path", "modality")


@query(
    needs="fx_kb fx_kb_manifest",
    sql=CHUNKS
    + """
SELECT '6:' || row_number() OVER (ORDER BY pos, chunk) AS did, entity_id, chunk, md5(txt) AS txt, img_path, modality
FROM texts WHERE entity_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)
""",
)
def pool_chunked(t):
    skip = t.part.where("p_size > 40").select(F.col("p_partkey").alias("entity_id"))
    pool = pools.chunked_kb_pool(t.fx_kb, t.fx_kb_manifest, 6, skip)
    return pool.select("did", "entity_id", F.col("chunk").cast("long").alias("chunk"), F.md5("txt").alias("txt"), "img_path", "modality")


@query(
    needs="fx_links",
    sql="""
, renum AS (SELECT did AS old_did, '1:' || row_number() OVER (ORDER BY md5('2023:' || did), did) AS did FROM fx_pool)
SELECT l.qid, l.label, l.ord::BIGINT AS ord, r.did FROM fx_links l JOIN renum r ON l.did = r.old_did
""",
)
def pool_renumber(t):
    renumbered = pools.renumber_pool(t.fx_pool, 1, [hash_order("old_did"), "old_did"])
    return pools.rewrite_links(t.fx_links, renumbered).withColumn("ord", F.col("ord").cast("long"))


@query(
    """
SELECT doc_id, lang, source, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
"""
)
def first_seen_dedup(t):
    docs = t.documents.select("doc_id", "lang", "source", "text")
    return pools.first_seen(docs, "text", "doc_id").select("doc_id", "lang", "source", F.md5("text").alias("h"))


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def dense_numbering(t):
    return number_rows(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], bucket_rows=2000)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY md5('2023:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS n FROM lineitem")
def hash_numbering(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    keyed = t.lineitem.select(*cols, F.concat_ws("-", *cols).alias("key"))
    return number_by_hash(keyed, "key").drop("key")


@query(
    needs="fx_pool",
    sql="SELECT did, CASE modality WHEN 'text' THEN 'task1' WHEN 'image' THEN 'task0' ELSE 'task2' END AS task FROM fx_pool",
)
def task_pool_split(t):
    return pools.task_of_candidate(t.fx_pool, {"text": "task1", "image": "task0", "image,text": "task2"}).select("did", "task")


@query(
    needs="fx_users",
    sql="SELECT query_modality, count(*) AS n, sum(pos)::BIGINT AS positions FROM fx_users GROUP BY 1",
)
def query_split_by_modality(t):
    return t.fx_users.groupBy("query_modality").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))


@query(
    needs="fx_links",
    sql="""
SELECT l.qid, CASE p.modality WHEN 'text' THEN 'task1' WHEN 'image' THEN 'task0' ELSE 'task2' END AS task
FROM fx_links l JOIN fx_pool p ON l.did = p.did WHERE l.label = 'pos' AND l.ord = 0
""",
)
def query_split_by_positive(t):
    pool = pools.task_of_candidate(t.fx_pool, {"text": "task1", "image": "task0", "image,text": "task2"})
    return L.first_positive(t.fx_links).join(pool.select("did", "task"), "did").select("qid", "task")


@query(
    needs="fx_pool fx_manifest",
    sql="""
SELECT p.did, count(*) OVER () AS kept FROM fx_pool p JOIN fx_manifest m ON p.img_path = m.img_path AND m.valid
""",
)
def valid_image_filter(t):
    kept = with_valid_image(t.fx_pool.select("did", "img_path"), t.fx_manifest)
    n = kept.agg(F.count(F.lit(1))).scalar()
    return kept.select("did", n.alias("kept"))


@query(
    needs="fx_pool fx_manifest",
    sql="""
SELECT p.did, CASE WHEN m.valid THEN p.img_path END AS img_path, CASE WHEN m.valid THEN 'image,text' ELSE 'text' END AS modality
FROM fx_pool p LEFT JOIN fx_manifest m ON p.img_path = m.img_path
""",
)
def invalid_image_demotion(t):
    return demote_invalid_image(t.fx_pool.select("did", "img_path", "modality"), t.fx_manifest)


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(text) <> '') AS kept FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def empty_text_filter(t):
    listed = t.documents.where(F.col("lang").isin("en", "fr"))
    return listed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.trim("text") != "").cast("long")).alias("kept")
    )


@query(
    needs="fx_links",
    sql="""
SELECT p.did, p.modality, md5(coalesce(p.txt, '')) AS txt FROM fx_pool p WHERE did IN (SELECT did FROM fx_links)
""",
)
def train_pool(t):
    kept = pools.train_pool(t.fx_pool, t.fx_links)
    return pools.in_id_order(kept).select("did", "modality", F.md5(F.coalesce("txt", F.lit(""))).alias("txt"))


@query(
    needs="fx_links",
    sql="""
SELECT 'used' AS part, did FROM fx_pool WHERE did IN (SELECT did FROM fx_links)
UNION ALL SELECT 'rest', did FROM fx_pool WHERE did NOT IN (SELECT did FROM fx_links)
""",
)
def skip_set(t):
    used = pools.referenced_ids(t.fx_links)
    pool = t.fx_pool.select("did")
    rest = pool.join(used, "did", "left_anti").select(F.lit("rest").alias("part"), "did")
    return pool.join(used, "did", "left_semi").select(F.lit("used").alias("part"), "did").unionByName(rest)


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def merge_override(t):
    base = t.documents.select("doc_id", F.lit(-1).alias("quality"))
    merged = pools.override_merge(base, t.labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    return merged.withColumn("quality", F.col("quality").cast("long"))


@query(
    """
SELECT 'd:' || (doc_id // 2) AS did, count(DISTINCT lang || '/' || text) AS n_contents FROM documents GROUP BY 1 HAVING count(DISTINCT lang || '/' || text) > 1
"""
)
def conflict_report(t):
    rows = t.documents.select(F.concat(F.lit("d:"), F.floor(F.col("doc_id") / 2).cast("string")).alias("did"), "lang", "text")
    return pools.conflicting_candidates(rows)


@query(
    needs="fx_pool",
    sql="""
SELECT 'did' AS key, count(*) AS n_rows, count(DISTINCT did) AS n_keys, count(*) = count(DISTINCT did) AS is_unique FROM fx_pool
UNION ALL SELECT 'source', count(*), count(DISTINCT source), count(*) = count(DISTINCT source) FROM fx_pool
""",
)
def uniqueness(t):
    a = pools.uniqueness(t.fx_pool, "did").select(F.lit("did").alias("key"), "*")
    return a.unionByName(pools.uniqueness(t.fx_pool, "source").select(F.lit("source").alias("key"), "*"))


@query(
    needs="fx_links",
    sql="""
SELECT qid, count(DISTINCT did) FILTER (WHERE label = 'pos') AS n_pos,
       count(DISTINCT did) FILTER (WHERE label = 'neg' AND did NOT IN (SELECT did FROM fx_links p WHERE p.qid = l.qid AND p.label = 'pos')) AS n_only_neg,
       bool_or(label = 'neg' AND did IN (SELECT did FROM fx_links p WHERE p.qid = l.qid AND p.label = 'pos')) AS overlap
FROM fx_links l GROUP BY qid
""",
)
def set_operations(t):
    q = t.fx_queries
    return q.select(
        "qid",
        F.size(F.array_distinct("pos_cand_list")).cast("long").alias("n_pos"),
        F.size(F.array_except("neg_cand_list", "pos_cand_list")).cast("long").alias("n_only_neg"),
        F.arrays_overlap("neg_cand_list", "pos_cand_list").alias("overlap"),
    )


@query(
    needs="fx_pool",
    sql="""
SELECT did, pool, modality FROM (SELECT did, 'pool' || (ds % 3) AS pool, modality FROM fx_pool UNION ALL SELECT did, 'union', modality FROM fx_pool)
""",
)
def union_pool(t):
    from trovekit.session import scratch_path

    path = scratch_path(t.spark, "pools")
    rows = t.fx_pool.select("did", F.concat(F.lit("pool"), (F.col("ds") % 3).cast("string")).alias("pool"), "modality")
    parts = [rows.where(F.col("pool") == f"pool{i}") for i in range(3)]
    union = pools.union_pools(parts)
    pools.write_pools(pools.union_pools([union, union.withColumn("pool", F.lit("union"))]), path)
    return t.spark.read.schema("did string, pool string, modality string").parquet(path)
