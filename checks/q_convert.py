"""Source rows to queries and links."""

from pyspark.sql import functions as F

from checks.base import clean, query
from checks.q_pools import CHUNKS, PAIRS, TEXT_IMAGE, pair_pool
from trovekit.operators import convert, links as L, merge, pools, samples
from trovekit.functions import ids
from trovekit.session import materialize

@query(
    needs="fx_raw_pairs",
    sql=TEXT_IMAGE
    + """
, q AS (SELECT pos, 0 AS part, NULL AS query_txt, img_path AS query_img_path, 'image' AS query_modality, 'text' AS want, txt AS value FROM c WHERE txt <> ''
        UNION ALL SELECT pos, 1, txt, NULL, 'text', 'image', img_path FROM c WHERE txt <> '')
SELECT q.pos, q.part::BIGINT AS part, md5(coalesce(q.query_txt, '')) AS txt, q.query_img_path, q.query_modality, p.did
FROM q JOIN pool p ON p.modality = q.want AND p.value = q.value
""",
)
def convert_pairs(t):
    pool = pools.text_image_pool(t.fx_raw_pairs, 3)
    pairs = convert.caption_pairs(t.fx_raw_pairs, pool)
    return pairs.select(
        "pos",
        F.col("part").cast("long").alias("part"),
        F.md5(F.coalesce("query_txt", F.lit(""))).alias("txt"),
        "query_img_path",
        "query_modality",
        "did",
    )


@query(
    needs="fx_manifest",
    sql=PAIRS
    + f"""
, g AS (SELECT d.source AS qid, d.doc_id AS ord, {clean('d.text')} AS txt, 'img/' || d.doc_id || '.jpg' AS img_path,
               CASE WHEN l.quality = 1 THEN 3 ELSE 1 + l.toxic END AS score
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT g.qid, CASE WHEN score = 3 THEN 'pos' ELSE 'neg' END AS label, g.ord, p.did FROM g JOIN pairs p USING (txt, img_path))
SELECT * FROM k WHERE qid IN (SELECT qid FROM k WHERE label = 'pos')
""",
)
def convert_graded(t):
    score = F.when(F.col("quality") == 1, 3).otherwise(1 + F.col("toxic"))
    graded = t.documents.join(t.labels, "doc_id").select(
        F.col("source").alias("qid"),
        F.col("doc_id").alias("ord"),
        _clean("text").alias("txt"),
        F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("img_path"),
        F.lit("image,text").alias("modality"),
        score.alias("score"),
    )
    return convert.graded_candidates(graded, pair_pool(t), manifest=t.fx_manifest)


def _clean(c):
    from trovekit.functions.text import clean_text

    return clean_text(c)


@query(
    needs="fx_links",
    sql="""
, f AS (SELECT l.qid, l.label, l.ord, p.did, p.modality FROM fx_links l JOIN fx_pool p ON l.did = p.did),
k AS (SELECT qid, label, CASE WHEN modality = 'text' THEN 1 ELSE 0 END AS part, ord, did FROM f WHERE modality IN ('text', 'image,text')),
keyed AS (SELECT k.*, md5(concat_ws('-', p.ctxt, p.img_path, p.modality)) AS key FROM k JOIN (SELECT did, CTXT AS ctxt, img_path, modality FROM fx_pool) p ON k.did = p.did),
first AS (SELECT key, min(split_part(did, ':', 2)::BIGINT) AS n, min_by(did, split_part(did, ':', 2)::BIGINT) AS did FROM (
  SELECT did, md5(concat_ws('-', CTXT, img_path, modality)) AS key FROM fx_pool WHERE modality <> 'image') GROUP BY key)
SELECT keyed.qid, keyed.label, row_number() OVER (PARTITION BY keyed.qid, keyed.label ORDER BY part, ord) AS place, first.did
FROM keyed JOIN first USING (key)
""".replace("CTXT", f"({clean('txt')})"),
)
def convert_facts(t):
    pool = pools.first_seen(
        t.fx_pool.where("modality <> 'image'").withColumn("txt", _clean("txt")), ["txt", "modality", "img_path"], "pos"
    )
    linked = t.fx_links.join(t.fx_pool.select("did", "txt", "img_path", "modality"), "did")

    def facts(label, modality):
        entry = F.when(
            (F.col("label") == label) & (F.col("modality") == modality), F.struct("ord", F.struct("txt", "img_path").alias("f"))
        )
        return F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["f"])

    rows = linked.groupBy("qid").agg(
        facts("pos", "image,text").alias("img_posFacts"),
        facts("neg", "image,text").alias("img_negFacts"),
        facts("pos", "text").alias("txt_posFacts"),
        facts("neg", "text").alias("txt_negFacts"),
    )
    links = convert.fact_lists(rows, pool)
    joined = L.collect_links(links)
    return joined.select(
        "qid", F.explode(F.array(F.struct(F.lit("pos").alias("label"), F.col("pos_cand_list").alias("l")),
                                 F.struct(F.lit("neg").alias("label"), F.col("neg_cand_list").alias("l")))).alias("s")
    ).select("qid", "s.label", F.posexplode("s.l").alias("p", "did")).select(
        "qid", "label", (F.col("p") + 1).cast("long").alias("place"), "did"
    )


SOFT = """
WITH r AS (SELECT o_orderkey AS pos, o_custkey AS reference, o_orderpriority AS caption,
             'T' || (o_orderkey % 4) AS t1, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.5 END AS s1,
             'T' || (o_orderkey % 6 + 2) AS t2, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE -1.0 END AS s2 FROM orders),
e AS (SELECT pos, reference, caption, t1 AS target, s1 AS score FROM r WHERE t1 <> t2 UNION ALL SELECT pos, reference, caption, t2, s2 FROM r),
latest AS (SELECT reference, caption, target, max_by(score, pos) AS score FROM e GROUP BY ALL)
"""


def soft_rows(t):
    o = t.orders
    t1 = F.concat(F.lit("T"), (F.col("o_orderkey") % 4).cast("string"))
    t2 = F.concat(F.lit("T"), (F.col("o_orderkey") % 6 + 2).cast("string"))
    s1 = F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.5)
    s2 = F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(-1.0)
    pairs = F.when(t1 == t2, F.create_map(t2, s2)).otherwise(F.create_map(t1, s1, t2, s2))
    return o.select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("reference"),
        F.col("o_orderpriority").alias("caption"),
        F.col("o_orderkey").alias("pairid"),
        t1.alias("target_hard"),
        F.col("o_orderstatus").alias("img_set"),
        pairs.alias("target_soft"),
    )


@query(
    SOFT
    + """
, lists AS (SELECT reference, caption, array_to_string(list(pos ORDER BY pos), '|') AS pairids, array_to_string(list(t1 ORDER BY pos), '|') AS hards FROM r GROUP BY ALL)
SELECT lists.reference, lists.caption, pairids, hards, string_agg(target || '=' || score::DOUBLE, ',' ORDER BY target) AS soft
FROM lists JOIN latest ON latest.reference = lists.reference AND latest.caption = lists.caption GROUP BY ALL
"""
)
def merge_soft_targets(t):
    merged = merge.merge_soft_targets(soft_rows(t))
    entries = F.transform(F.array_sort(F.map_entries("target_soft")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return merged.select(
        "reference",
        "caption",
        F.array_join(F.col("pairid_list").cast("array<string>"), "|").alias("pairids"),
        F.array_join("target_hard_list", "|").alias("hards"),
        F.array_join(entries, ",").alias("soft"),
    )


@query(
    SOFT
    + """
, k AS (SELECT reference || '/' || caption AS qid, CASE WHEN score = 1.0 THEN 'pos' ELSE 'neg' END AS label, '8:' || substr(target, 2) AS did
        FROM latest WHERE target <> 'T7')
SELECT * FROM k WHERE qid IN (SELECT qid FROM k WHERE label = 'pos')
"""
)
def convert_soft(t):
    merged = merge.merge_soft_targets(soft_rows(t)).withColumn("qid", F.concat_ws("/", "reference", "caption"))
    # images that the pool knows: every target but T7
    images = soft_rows(t).select(F.explode(F.map_keys("target_soft")).alias("image_id")).distinct().where("image_id <> 'T7'")
    images = images.withColumn("did", F.concat(F.lit("8:"), F.substring("image_id", 2, 9)))
    return convert.soft_targets(merged, images).select("qid", "label", "did")


@query(
    needs="fx_vectors",
    sql="""
, tr AS (SELECT e.vec_id AS qid, (e.vec_id + 1) % n AS a, (e.vec_id + 2) % n AS b, e.label % 2 AS vote FROM embeddings e, (SELECT count(*) AS n FROM embeddings)),
img AS (SELECT vec_id, id AS did FROM fx_vectors WHERE modality <> 'text')
SELECT qid, p.did AS pos_did, q.did AS neg_did
FROM tr JOIN img p ON p.vec_id = CASE WHEN vote = 0 THEN a ELSE b END JOIN img q ON q.vec_id = CASE WHEN vote = 0 THEN b ELSE a END
""",
)
def convert_vote(t):
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    rows = t.embeddings.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one")

    def path(c):
        return F.concat(F.lit("distort/left/"), ((F.col("vec_id") + c) % F.col("n")).cast("string"), F.lit(".png"))

    triplets = rows.select(
        F.col("vec_id").alias("qid"),
        path(1).alias("left_path"),
        path(2).alias("right_path"),
        (F.col("label") % 2).cast("string").alias("right_vote"),
    )
    images = t.fx_vectors.where("modality <> 'text'").select(
        F.concat(F.lit("left/"), "vec_id").alias("image_id"), F.col("id").alias("did")
    )
    return convert.votes(triplets, images)


@query(
    f"""
WITH x AS (SELECT p_partkey AS pos, p_partkey AS candidate, p_size * 40 AS target, 'Is ' || p_name || '.' AS c1, p_type AS c2 FROM part),
im AS (SELECT p_partkey AS image_id, '7:' || (p_partkey + 1) AS did, 'img/' || p_partkey || '.jpg' AS img_path FROM part)
SELECT pos, {clean("'is ' || substr(c1, 4, len(c1) - 4) || ' and ' || lower(c2[1]) || c2[2:]")} AS query_txt, a.img_path AS query_img_path, b.did
FROM x JOIN im a ON x.candidate = a.image_id JOIN im b ON x.target = b.image_id
"""
)
def convert_composed(t):
    rows = t.part.select(
        F.col("p_partkey").alias("pos"),
        F.col("p_partkey").alias("candidate"),
        (F.col("p_size") * 40).cast("long").alias("target"),
        F.array(F.concat(F.lit("Is "), "p_name", F.lit(".")), F.lit(""), F.col("p_type")).alias("captions"),
    )
    images = t.part.select(
        F.col("p_partkey").alias("image_id"),
        F.concat(F.lit("7:"), (F.col("p_partkey") + 1).cast("string")).alias("did"),
        F.concat(F.lit("img/"), "p_partkey", F.lit(".jpg")).alias("img_path"),
    )
    return convert.composed_queries(rows, images).select("pos", "query_txt", "query_img_path", "did")


UNIQUE_QUESTIONS = """
, uq AS (SELECT * FROM fx_questions QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY pos) = 1)
"""


@query(
    needs="fx_questions fx_kb",
    sql=UNIQUE_QUESTIONS
    + f"""
SELECT uq.row_id, {clean('question')} AS query_txt, '5:' || (k.entity_id + 1) AS did FROM uq JOIN fx_kb k ON uq.entity_id = k.entity_id
""",
)
def convert_entity(t):
    entities = t.fx_kb.select("entity_id", F.concat(F.lit("5:"), (F.col("entity_id") + 1).cast("string")).alias("did"))
    return convert.entity_questions(t.fx_questions, entities).select("row_id", "query_txt", "did")


ANSWER = "list_bool_or([contains({c}, x) FOR x IN list_concat(answer, answer_eval)])"


@query(
    needs="fx_questions fx_kb",
    sql=UNIQUE_QUESTIONS
    + f"""
SELECT uq.row_id, uq.question_type, '6:' || row_number() OVER (ORDER BY uq.pos) AS qid, count(*) OVER () AS n_kept
FROM uq JOIN fx_kb k ON uq.entity_id = k.entity_id WHERE {ANSWER.format(c='k.content')}
""",
)
def convert_kb_answer(t):
    q = t.fx_questions
    first = pools.first_seen(q.select("data_id", "entity_id", "question_type", "pos"), "data_id", "pos", stored=False)
    kept = convert.answerable_questions(
        q.select("pos", "row_id", "data_id", "question", "answer", "answer_eval"),
        first.select("data_id", "entity_id"),
        t.fx_kb,
        first.select("data_id", "question_type"),
    )
    kept = materialize(kept.select("pos", "row_id", "question_type"), "kept")  # numbered and counted
    numbered = convert.number_queries(kept, 6, width=8 * 10**12)
    n = kept.agg(F.count(F.lit(1)).alias("n_kept"), F.lit(1).alias("one"))
    return numbered.withColumn("one", F.lit(1)).join(n, "one").select("row_id", "question_type", "qid", "n_kept")


@query(
    needs="fx_questions fx_kb",
    sql=UNIQUE_QUESTIONS
    + f"""
SELECT entity_id, title FROM fx_kb WHERE entity_id IN (SELECT uq.entity_id FROM uq JOIN fx_kb k ON uq.entity_id = k.entity_id WHERE {ANSWER.format(c='k.content')})
""",
)
def matched_articles(t):
    q = t.fx_questions
    entity = pools.first_seen(q.select("data_id", "entity_id", "pos"), "data_id", "pos", stored=False).select("data_id", "entity_id")
    kept = convert.answerable_questions(q.select("pos", "data_id", "question", "answer", "answer_eval"), entity, t.fx_kb)
    return convert.matched_articles(kept, t.fx_kb).select("entity_id", "title")


@query(
    needs="fx_questions fx_kb fx_kb_manifest",
    sql=CHUNKS
    + f"""
, pool AS (SELECT entity_id, chunk, txt, '6:' || row_number() OVER (ORDER BY pos, chunk) AS did FROM texts),
k AS (SELECT q.row_id AS qid, CASE WHEN {ANSWER.format(c='p.txt')} THEN 'pos' ELSE 'neg' END AS label, p.chunk AS ord, p.did
      FROM fx_questions q JOIN pool p ON q.entity_id = p.entity_id)
SELECT qid, label, count(*) AS n, string_agg(did, '|' ORDER BY ord) AS dids FROM k
WHERE qid IN (SELECT qid FROM k WHERE label = 'pos') GROUP BY qid, label
""",
)
def label_chunks(t):
    pool = pools.chunked_kb_pool(t.fx_kb, t.fx_kb_manifest, 6)
    chunks = pool.select("entity_id", F.col("chunk").alias("ord"), "txt", "did")
    questions = t.fx_questions.select(F.col("row_id").alias("qid"), "entity_id", "answer", "answer_eval")
    lists = convert.label_lists(questions, chunks)
    side = lambda label, c: F.struct(F.lit(label).alias("label"), F.size(c).cast("long").alias("n"), F.array_join(c, "|").alias("dids"))
    sides = F.array(side("pos", "pos_cand_list"), side("neg", "neg_cand_list"))
    return lists.select("qid", F.inline(F.filter(sides, lambda x: x["n"] > 0)))


@query(
    needs="fx_links",
    sql="""
, other AS (SELECT source AS entity, pos AS ord, '9:' || (pos + 1) AS did FROM fx_pool WHERE modality = 'text'),
p AS (SELECT l.qid, l.ord, l.did, x.source AS entity FROM fx_links l JOIN fx_pool x ON l.did = x.did WHERE l.label = 'pos'),
new AS (SELECT p.qid, o.did, min(struct_pack(a := p.ord, b := o.ord)) AS ap FROM p JOIN other o USING (entity) GROUP BY ALL),
allp AS (SELECT qid, 0 AS src, ord::BIGINT AS a, 0::BIGINT AS b, did FROM fx_links WHERE label = 'pos' UNION ALL SELECT qid, 1, ap.a, ap.b, did FROM new)
SELECT qid, count(*) AS n, md5(string_agg(did, '|' ORDER BY src, a, b)) AS dids FROM allp GROUP BY qid
""",
)
def extend_by_key(t):
    pool = t.fx_pool.select("did", F.col("source").alias("entity_id"))
    other = t.fx_pool.where("modality = 'text'").select(
        F.col("source").alias("entity_id"),
        F.col("pos").alias("ord"),
        F.concat(F.lit("9:"), (F.col("pos") + 1).cast("string")).alias("did"),
    )
    lists = convert.extended_lists(t.fx_links, pool, other)
    return lists.select(
        "qid", F.size("pos_cand_list").cast("long").alias("n"), F.md5(F.array_join("pos_cand_list", "|")).alias("dids")
    )


@query(
    needs="fx_links",
    sql="""
, other AS (SELECT min(pos) AS pos, txt FROM fx_pool WHERE modality = 'text' GROUP BY txt),
p AS (SELECT l.qid, l.ord, x.txt FROM fx_links l JOIN fx_pool x ON l.did = x.did WHERE l.label = 'pos' AND x.modality = 'text'),
allp AS (SELECT qid, 0 AS src, ord, did FROM fx_links WHERE label = 'pos' UNION ALL SELECT p.qid, 1, p.ord, '9:' || (o.pos + 1) FROM p JOIN other o ON p.txt = o.txt)
SELECT qid, string_agg(did, '|' ORDER BY src, ord) AS dids FROM allp GROUP BY qid
""",
)
def extend_by_content(t):
    other = pools.first_seen(t.fx_pool.where("modality = 'text'"), "txt", "pos")
    other = other.withColumn("did", F.concat(F.lit("9:"), (F.col("pos") + 1).cast("string")))
    links = convert.extend_by_content(t.fx_links, t.fx_pool, other)
    return L.collect_links(links.where("label = 'pos'")).select("qid", F.array_join("pos_cand_list", "|").alias("dids"))


@query(
    needs="fx_merge_queries",
    sql="""
, k AS (SELECT *, concat_ws('-', coalesce(query_txt, 'None'), query_img_path, query_modality) AS key FROM fx_merge_queries),
f AS (SELECT key, min(pos) AS pos FROM k GROUP BY key),
e AS (SELECT key, 'pos' AS label, pos, unnest(range(len(pos_cand_list))) AS ord, unnest(pos_cand_list) AS did FROM k
      UNION ALL SELECT key, 'neg', pos, unnest(range(len(neg_cand_list))), unnest(neg_cand_list) FROM k),
u AS (SELECT key, label, did, min(struct_pack(p := pos, o := ord)) AS ap FROM e GROUP BY ALL),
l AS (SELECT key, label, string_agg(did, '|' ORDER BY ap) AS dids FROM u GROUP BY ALL)
SELECT '0:' || f.pos AS qid, f.key, '{"order":' || f.pos || '}' AS src, lp.dids AS pos, ln.dids AS neg
FROM f JOIN l lp ON lp.key = f.key AND lp.label = 'pos' JOIN l ln ON ln.key = f.key AND ln.label = 'neg'
""",
)
def merge_queries(t):
    merged = merge.merge_queries(t.fx_merge_queries)
    return merged.select(
        "qid",
        merge.query_key().alias("key"),
        F.col("query_src_content").alias("src"),
        F.array_join("pos_cand_list", "|").alias("pos"),
        F.array_join("neg_cand_list", "|").alias("neg"),
    )


CLEAN_PROMPTS = """
, prompts AS (SELECT dataset_id, query_modality, cand_modality, [p FOR p IN raw_prompts IF p <> ''] AS prompts FROM fx_prompts)
"""


def prompt_table(t):
    return t.fx_prompts.select(
        "dataset_id", "query_modality", "cand_modality", F.filter("raw_prompts", lambda p: p != "").alias("prompts")
    )


def pick_sql(values, key):
    return f"({values})[cast('0x' || substr(md5('2023:' || {key}), 1, 8) AS bigint) % len({values}) + 1]"


ASSEMBLED = (
    CLEAN_PROMPTS
    + f"""
, chosen AS (SELECT q.*, {pick_sql('q.pos_cand_list', 'q.qid')} AS did FROM fx_queries q),
s AS (SELECT c.*, p.txt AS pos_txt, p.img_path AS pos_img, p.modality AS cand_modality FROM chosen c JOIN fx_pool p ON c.did = p.did),
j AS (SELECT s.*, {clean(pick_sql('r.prompts', 's.qid'))} AS prompt FROM s JOIN prompts r
      ON r.dataset_id = split_part(s.qid, ':', 1) AND r.query_modality = s.query_modality AND r.cand_modality = s.cand_modality)
"""
)


@query(
    needs="fx_queries fx_prompts",
    sql=ASSEMBLED
    + f"""
SELECT qid, split_part(qid, ':', 1)::BIGINT * 500000 + split_part(qid, ':', 2)::BIGINT AS hashed_qid,
       split_part(did, ':', 1)::BIGINT * 10000000 + split_part(did, ':', 2)::BIGINT AS hashed_did, md5(prompt) AS prompt,
       md5({clean("prompt || ' ' || coalesce(query_txt, '')")}) AS with_prompt, md5({clean('pos_txt')}) AS pos_txt, pos_img
FROM j
""",
)
def assemble_samples(t):
    s = samples.training_samples(t.fx_queries, t.fx_pool, prompt_table(t))
    return s.select(
        "qid",
        "hashed_qid",
        "hashed_did",
        F.md5("prompt").alias("prompt"),
        F.md5("query_txt_with_prompt").alias("with_prompt"),
        F.md5("pos_txt").alias("pos_txt"),
        F.col("pos_img_path").alias("pos_img"),
    )


@query(
    needs="fx_queries fx_prompts",
    sql=f"""
, sh AS (SELECT qid, list(did ORDER BY md5('2023:' || qid || ':' || i)) AS l FROM (
           SELECT qid, unnest(range(len(neg_cand_list))) AS i, unnest(neg_cand_list) AS did FROM fx_queries) GROUP BY qid),
pl AS (SELECT qid, unnest(range(3)) AS place, unnest([l[i % len(l) + 1] FOR i IN range(3)]) AS did FROM sh)
SELECT pl.qid, pl.place, pl.did, md5({clean('p.txt')}) AS txt, p.img_path FROM pl JOIN fx_pool p ON pl.did = p.did
""",
)
def sample_negatives(t):
    # a query without negatives would fail the job
    some = t.fx_queries.where(F.size("neg_cand_list") > 0)
    s = samples.training_samples(some, t.fx_pool, prompt_table(t), negatives=3)
    rows = samples.sample_negatives(s, t.fx_pool)
    return rows.select("qid", F.col("place").cast("long").alias("place"), "did", F.md5("txt").alias("txt"), "img_path")


@query(
    needs="fx_queries fx_pool",
    sql=f"""
SELECT 'q' AS kind, split_part(qid, ':', 1)::BIGINT * 500000 + split_part(qid, ':', 2)::BIGINT AS id, md5({clean('query_txt')}) AS txt,
       query_img_path AS img_path, query_modality AS modality, query_src_content AS src FROM fx_users
UNION ALL SELECT 'd', split_part(did, ':', 1)::BIGINT * 10000000 + split_part(did, ':', 2)::BIGINT, md5({clean('txt')}), img_path, modality, src_content FROM fx_pool
""",
)
def record_projection(t):
    q = samples.query_records(t.fx_users, with_source=True).withColumnRenamed("qid", "id")
    d = samples.candidate_records(t.fx_pool, with_source=True).withColumnRenamed("did", "id")
    both = q.withColumn("kind", F.lit("q")).unionByName(d.withColumn("kind", F.lit("d")))
    return both.select("kind", "id", F.md5("txt").alias("txt"), "img_path", "modality", F.col("src_content").alias("src"))


@query(
    needs="fx_queries",
    sql="""
SELECT qid, array_to_string([d FOR d IN pos_cand_list IF split_part(d, ':', 1) = split_part(qid, ':', 1)], '|') AS kept FROM fx_queries
""",
)
def same_dataset_positives(t):
    return samples.same_dataset_positives(t.fx_queries).select("qid", F.array_join("pos_cand_list", "|").alias("kept"))


@query(
    needs="fx_queries",
    sql="""
, e AS (SELECT qid, unnest(range(len(pos_cand_list))) AS i, unnest(pos_cand_list) AS did FROM fx_queries),
f AS (SELECT qid, did, min(i) AS i FROM e GROUP BY ALL), o AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS place FROM f)
SELECT qid, did, place FROM o
""",
)
def positive_order(t):
    distinct = t.fx_queries.withColumn("pos_cand_list", F.array_distinct("pos_cand_list"))
    return distinct.select("qid", F.posexplode("pos_cand_list").alias("place", "did")).withColumn(
        "place", F.col("place").cast("long")
    )


@query(
    needs="fx_qrels fx_features",
    sql="""
SELECT q.qid, q.did, round(list_dot_product(a.img::DOUBLE[], b.img::DOUBLE[]), 6) AS ip, (a.txt_mask + b.img_mask)::BIGINT AS m
FROM fx_qrels q JOIN fx_features a ON a.id = split_part(q.qid, ':', 2)::BIGINT - 1 JOIN fx_features b ON b.id = split_part(q.did, ':', 2)::BIGINT - 1
""",
)
def features_by_id(t):
    from trovekit.functions.vectors import dot

    features = t.fx_features.join(t.fx_vectors.select(F.col("vec_id").alias("id"), F.col("id").alias("name")), "id")
    q = features.withColumn("id", ids.hash_qid("name")).drop("name", "next_id")
    p = features.withColumn("id", ids.hash_did("name")).drop("name", "next_id")
    rows = samples.pair_features(t.fx_qrels.select("qid", "did"), q, p)
    return rows.select(
        "qid",
        "did",
        F.round(dot("q_img", "p_img"), 6).alias("ip"),
        (F.col("q_txt_mask") + F.col("p_img_mask")).cast("long").alias("m"),
    )
