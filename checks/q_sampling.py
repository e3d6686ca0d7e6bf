"""Splits, caps, trims and choices."""

from pyspark.sql import functions as F

from checks.base import clean, query
from checks.q_convert import CLEAN_PROMPTS, pick_sql, prompt_table
from checks.q_pools import CHUNKS

from trovekit.functions.ids import id_dataset
from trovekit.functions.vectors import mix_up
from trovekit.operators import samples, sampling

@query(
    needs="fx_raw_pairs",
    sql="""
, r AS (SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY md5('2023:' || pos), pos) AS rn FROM fx_raw_pairs)
SELECT pos, source, CASE WHEN rn <= 20 THEN 'train' WHEN rn <= 30 THEN 'val' ELSE 'test' END AS split FROM r WHERE rn <= 40
""",
)
def split_stratified(t):
    return sampling.split_per_group(t.fx_raw_pairs.select("pos", "source"), "source", "pos", 20, 10, 10)


@query(
    """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('2023:' || o_orderkey), o_orderkey) AS n, count(*) OVER () AS c FROM orders)
SELECT o_orderkey, CASE WHEN n <= 3500 THEN 'val' ELSE 'train' END AS split, CASE WHEN n <= c // 2 THEN 'val' ELSE 'test' END AS half FROM r
"""
)
def holdout(t):
    orders = t.orders.select("o_orderkey")
    held = sampling.hold_out(orders, "o_orderkey", 3500)
    half = sampling.hold_out_half(orders, "o_orderkey").withColumnRenamed("split", "half")
    return held.join(half, "o_orderkey")


@query(
    """
WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () // 2 AS half FROM orders),
r AS (SELECT o_orderkey, half, row_number() OVER (ORDER BY md5('2023:' || o_orderkey), o_orderkey) AS n FROM h WHERE rn <= half)
SELECT o_orderkey, CASE WHEN n <= half // 3 THEN 'val' ELSE 'test' END AS split FROM r WHERE n <= half // 3 OR n > half // 3 * 2
"""
)
def split_fractions(t):
    orders = t.orders.select("o_orderkey", F.col("o_orderkey").alias("pos"))
    return sampling.split_thirds_of_half(orders, "o_orderkey").select("o_orderkey", "split")


@query(
    needs="fx_questions fx_kb",
    sql="""
, r AS (SELECT q.row_id, q.file, k.img_path IS NOT NULL AS img, row_number() OVER (PARTITION BY q.entity_id ORDER BY md5('2023:' || row_id), row_id) AS rn
        FROM fx_questions q JOIN fx_kb k ON q.entity_id = k.entity_id)
SELECT row_id, file FROM r WHERE rn <= CASE WHEN img THEN 25 ELSE 12 END
""",
)
def cap_per_entity(t):
    kind = t.fx_kb.select("entity_id", F.when(F.col("img_path").isNotNull(), "image,text").otherwise("text").alias("modality"))
    rows = t.fx_questions.select("row_id", "file", "entity_id").join(kind, "entity_id")
    return sampling.cap_per_entity(rows, "entity_id", "row_id", 12, 25).select("row_id", "file")


@query(
    needs="fx_links",
    sql="""
, used AS (SELECT DISTINCT did FROM fx_links), rest AS (SELECT did, row_number() OVER (ORDER BY md5('2023:' || did), did) AS n FROM fx_pool WHERE did NOT IN (SELECT did FROM used)),
allr AS (SELECT did, 0 AS part, pos AS n FROM fx_pool WHERE did IN (SELECT did FROM used) UNION ALL SELECT did, 1, n FROM rest WHERE n <= 150)
SELECT did, row_number() OVER (ORDER BY part, n) AS rank FROM allr
""",
)
def trim_pool(t):
    return sampling.trim_pool(t.fx_pool, t.fx_links, 150).select("did", "rank")


@query(
    needs="fx_kb fx_kb_manifest",
    sql=CHUNKS
    + """
, have AS (SELECT p_partkey AS entity_id FROM part WHERE p_size <= 25),
r AS (SELECT *, row_number() OVER (ORDER BY md5('2023:' || entity_id || ':' || chunk), entity_id || ':' || chunk) AS n FROM texts WHERE entity_id NOT IN (SELECT entity_id FROM have))
SELECT '6:' || (n + (SELECT count(*) FROM have)) AS did, entity_id, chunk, md5(txt) AS txt FROM r WHERE n <= 1000
""",
)
def augment_pool(t):
    have = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("entity_id"))
    added = sampling.augment_pool(have, t.fx_kb, t.fx_kb_manifest, 6, 1000)
    return added.select("did", "entity_id", F.col("chunk").cast("long").alias("chunk"), F.md5("txt").alias("txt"))


@query(
    needs="fx_users",
    sql="""
, r AS (SELECT qid, query_modality, row_number() OVER (PARTITION BY query_modality ORDER BY md5('2023:' || qid), qid) AS rn FROM fx_users),
k AS (SELECT qid, query_modality FROM r WHERE rn <= CASE query_modality WHEN 'text' THEN 60 WHEN 'image' THEN 40 ELSE 30 END)
SELECT qid, query_modality, '1:' || row_number() OVER (ORDER BY md5('2023/order:' || qid), qid) AS new_qid FROM k
""",
)
def cap_per_modality(t):
    rows = t.fx_users.select("qid", "query_modality")
    return sampling.cap_per_modality(rows, {"text": 60, "image": 40, "image,text": 30}, 1)


@query(
    needs="fx_queries fx_prompts",
    sql=CLEAN_PROMPTS
    + f"""
SELECT q.qid, c.m AS cand_modality, md5({clean(pick_sql('r.prompts', 'q.qid'))}) AS prompt
FROM fx_queries q JOIN (SELECT 'text' AS m UNION ALL SELECT 'image' UNION ALL SELECT 'image,text') c ON true
JOIN prompts r ON r.dataset_id = split_part(q.qid, ':', 1) AND r.query_modality = q.query_modality AND r.cand_modality = c.m
""",
)
def pick_prompt(t):
    kinds = F.explode(F.array(F.lit("text"), F.lit("image"), F.lit("image,text"))).alias("cand_modality")
    rows = t.fx_queries.select("qid", id_dataset("qid").alias("dataset_id"), "query_modality", kinds)
    picked = sampling.pick_prompt(rows, prompt_table(t))
    return picked.select("qid", "cand_modality", F.md5("prompt").alias("prompt"))


@query(
    needs="fx_queries",
    sql=f"SELECT qid, {pick_sql('pos_cand_list', 'qid')} AS picked, pos_cand_list[1] AS first FROM fx_queries",
)
def pick_positive(t):
    return t.fx_queries.select(
        "qid", sampling.pick_positive().alias("picked"), sampling.pick_positive(random=False).alias("first")
    )


@query(
    needs="fx_queries",
    sql="""
, sh AS (SELECT qid, list(did ORDER BY md5('2023:' || qid || ':' || i)) AS l, list(did ORDER BY i) AS o FROM (
           SELECT qid, unnest(range(len(neg_cand_list))) AS i, unnest(neg_cand_list) AS did FROM fx_queries) GROUP BY qid)
SELECT q.qid, coalesce(array_to_string([l[i % len(l) + 1] FOR i IN range(5)], '|'), '') AS shuffled,
       coalesce(array_to_string([o[i % len(o) + 1] FOR i IN range(5)], '|'), '') AS in_order
FROM fx_queries q LEFT JOIN sh ON q.qid = sh.qid
""",
)
def pick_negatives(t):
    return t.fx_queries.select(
        "qid",
        F.array_join(sampling.pick_negatives(5), "|").alias("shuffled"),
        F.array_join(sampling.pick_negatives(5, shuffle=False), "|").alias("in_order"),
    )


@query(
    needs="fx_queries",
    sql=f"""
, e AS (SELECT qid, unnest(range(len(pos_cand_list))) AS i, unnest(pos_cand_list) AS did, len(pos_cand_list) AS n, pos_cand_list AS l FROM fx_queries),
f AS (SELECT qid, did, min(i) AS i FROM e GROUP BY ALL), o AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS place FROM f),
big AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY md5('2023:' || qid || ':' || i)) - 1 AS slot FROM e WHERE n >= 2 QUALIFY slot < 2),
small AS (SELECT qid, did, i AS slot FROM e WHERE n < 2 UNION ALL
          SELECT qid, {pick_sql('pos_cand_list', "(qid || ':2')")}, 1 FROM fx_queries WHERE len(pos_cand_list) = 1),
allr AS (SELECT * FROM big UNION ALL SELECT * FROM small)
SELECT a.qid, a.slot, a.did, o.place FROM allr a JOIN o ON a.qid = o.qid AND a.did = o.did
""",
)
def n_positives(t):
    pairs = samples.positive_pairs(t.fx_queries, 2)
    return pairs.select("qid", F.col("slot").cast("long").alias("slot"), "did", F.col("place").cast("long").alias("place"))


def _uniform(salt):
    return f"cast('0x' || substr(md5('2023:' || id || ':' || i || ':{salt}'), 1, 8) AS bigint) / 4294967296.0::DOUBLE"


@query(
    needs="fx_features",
    sql=f"""
, e AS (SELECT id, unnest(range(len(img))) AS i, unnest(img::DOUBLE[]) AS q, unnest(txt::DOUBLE[]) AS p FROM fx_features),
u AS (SELECT id, i, q, p, {_uniform('a')} AS a, {_uniform('b')} AS b, {_uniform('c')} AS c FROM e),
s AS (SELECT id, i, q, p, a + b + c - greatest(a, b, c) - least(a, b, c) AS s0, greatest(least(a, b), least(greatest(a, b), c)) AS s FROM u),
m AS (SELECT id, i, sqrt(s) * q + sqrt(1 - s) * p AS x FROM s), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY id)
SELECT m.id, m.i, round(m.x / n.n, 6) AS x FROM m JOIN n ON m.id = n.id
""",
)
def mixup(t):
    rows = t.fx_features.select("id", F.posexplode(mix_up("img", "txt", "id")).alias("i", "x"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
