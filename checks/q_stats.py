"""Statistics."""

from pyspark.sql import functions as F

from checks.base import query, words
from trovekit.operators import pools, stats


@query(needs="fx_pool", sql="SELECT modality, count(*) AS n FROM fx_pool GROUP BY modality")
def pool_stats(t):
    return stats.pool_counts(t.fx_pool)


@query(
    needs="fx_links",
    sql="""
, x AS (SELECT l.label, u.query_modality || '-' || p.modality AS pair, l.qid, l.did, l.ord FROM fx_links l JOIN fx_users u ON l.qid = u.qid JOIN fx_pool p ON l.did = p.did)
SELECT label, pair, count(*) AS examples, count(*) FILTER (WHERE ord = 0) AS queries, count(DISTINCT qid) AS unique_queries, count(DISTINCT did) AS unique_docs
FROM x GROUP BY label, pair
""",
)
def dataset_stats(t):
    return stats.modality_stats(t.fx_queries, t.fx_pool)


@query(
    needs="fx_links",
    sql=f"""
, q AS (SELECT count(*) AS n, sum(len({words('query_txt')})) AS qw FROM fx_users),
c AS (SELECT count(*) FILTER (WHERE label = 'pos') AS np, count(*) FILTER (WHERE label = 'neg') AS nn,
             sum(len({words('txt')})) FILTER (WHERE label = 'pos') AS pw, sum(len({words('txt')})) FILTER (WHERE label = 'neg') AS nw
      FROM fx_links l JOIN fx_pool p ON l.did = p.did)
SELECT round(np / n, 6) AS avg_pos_cand_count, round(nn / n, 6) AS avg_neg_cand_count, round(qw / n, 6) AS avg_query_txt_words,
       round(pw / np, 6) AS avg_pos_txt_words, round(nw / nn, 6) AS avg_neg_txt_words
FROM q, c
""",
)
def dataset_averages(t):
    row = stats.dataset_averages(t.fx_queries, t.fx_pool)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    needs="fx_links",
    sql="""
SELECT l.qid, count(DISTINCT p.modality) AS n_modalities FROM (SELECT qid, 'pos' AS label, did FROM fx_links) l JOIN fx_pool p ON l.did = p.did
GROUP BY l.qid HAVING count(DISTINCT p.modality) > 1
""",
)
def modality_consistency(t):
    # both lists taken as positives, so that mixed queries exist
    q = t.fx_queries.withColumn("pos_cand_list", F.concat("pos_cand_list", "neg_cand_list"))
    return stats.mixed_positives(q, t.fx_pool)


@query(
    needs="fx_users",
    sql="SELECT query_src_content->>'$.question_type' AS question_type, count(*) AS n FROM fx_users WHERE query_src_content IS NOT NULL GROUP BY 1",
)
def question_types(t):
    return stats.question_types(t.fx_users)


@query(
    f"""
WITH c AS (SELECT len({words('text')}) AS a, len({words("source || ' ' || lang")}) AS b FROM documents)
SELECT 'text' AS field, round(avg(a), 6) AS avg_words, min(a)::BIGINT AS min_words, max(a)::BIGINT AS max_words FROM c
UNION ALL SELECT 'title', round(avg(b), 6), min(b)::BIGINT, max(b)::BIGINT FROM c
"""
)
def length_stats(t):
    docs = t.documents.select("text", F.concat_ws(" ", "source", "lang").alias("title"))
    return stats.length_stats(docs, ["text", "title"]).withColumn("avg_words", F.round("avg_words", 6))


@query(
    needs="fx_questions fx_kb",
    sql="""
, x AS (SELECT q.entity_id, CASE WHEN k.img_path IS NULL THEN 'text' ELSE 'image,text' END AS modality FROM fx_questions q JOIN fx_kb k ON q.entity_id = k.entity_id),
c AS (SELECT entity_id, modality, count(*) AS c FROM x GROUP BY ALL), b AS (SELECT entity_id, modality, c FROM c UNION ALL SELECT entity_id, 'all', c FROM c)
SELECT modality, sum(c)::BIGINT AS total, round(avg(c), 6) AS avg_rows, max(c) AS max_rows, min(c) AS min_rows, count(*) AS entities FROM b GROUP BY modality
""",
)
def entity_stats(t):
    kind = t.fx_kb.select("entity_id", F.when(F.col("img_path").isNotNull(), "image,text").otherwise("text").alias("modality"))
    rows = t.fx_questions.select("entity_id").join(kind, "entity_id")
    return stats.entity_stats(rows).withColumn("avg_rows", F.round("avg_rows", 6))


@query(
    """
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1
"""
)
def duplicate_report(t):
    rows = t.documents.select(
        F.col("doc_id").alias("pos"), F.col("text").alias("txt"), F.lit(None).cast("string").alias("img_path"), F.col("lang").alias("modality")
    )
    return pools.duplicate_candidates(rows).select(F.col("pos").alias("doc_id"), F.col("modality").alias("lang"))


@query("SELECT event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY event_type || user_id ORDER BY event_id) > 1")
def attr_duplicates(t):
    # views carry no value, and empty values are not compared
    value = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.concat("event_type", F.col("user_id").cast("string")))
    return pools.later_duplicates(t.events.select("event_id", "event_type", "user_id"), value, "event_id").select("event_id")


@query(
    needs="fx_qrels",
    sql="SELECT count(DISTINCT qid) AS queries, count(*) AS relevant, round(count(*) / count(DISTINCT qid), 6) AS avg_relevant FROM fx_qrels",
)
def qrel_stats(t):
    return stats.qrel_stats(t.fx_qrels).withColumn("avg_relevant", F.round("avg_relevant", 6))


@query(
    needs="fx_qrels",
    sql="SELECT qid, min_by(task_id, pos)::BIGINT AS task_id FROM fx_qrels GROUP BY qid",
)
def qrel_tasks(t):
    from trovekit.sources.trec import task_of_query

    return task_of_query(t.fx_qrels).withColumn("task_id", F.col("task_id").cast("long"))


@query(
    """
SELECT CASE WHEN role = 'user' THEN 'train' ELSE 'test' END AS split, count(DISTINCT conv_id) AS images, count(*) AS captions
FROM conversations GROUP BY 1
"""
)
def caption_counts(t):
    split = F.when(F.col("role") == "user", "train").otherwise("test")
    lists = t.conversations.groupBy(split.alias("split"), "conv_id", (F.col("turn") % 2).alias("half")).agg(
        F.collect_list("text").alias("captions")
    )
    return stats.caption_counts(lists.withColumnRenamed("conv_id", "image"))


@query(
    needs="fx_meter",
    sql="""
, m AS (SELECT meter, event_id, value, row_number() OVER w AS n, list(value) OVER f AS l, avg(value) OVER f AS a, max(value) OVER f AS mx
        FROM fx_meter WINDOW w AS (PARTITION BY meter ORDER BY ts, event_id), f AS (PARTITION BY meter ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT meter, event_id, n, value AS last, list_sort(l)[(len(l) + 1) // 2] AS median, round(a, 6) AS avg, mx AS max FROM m
""",
)
def rolling_meter(t):
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    numbered = stats.number_within(t.fx_meter, "meter", hours, ["ts", "event_id"])
    rows = stats.rolling_meter(numbered, "meter", ["event_id"], "value", width=500)
    return rows.withColumn("avg", F.round("avg", 6))


@query(
    "SELECT event_type AS meter, sum(user_id % 5 + 1)::BIGINT AS count, round(sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1), 6) AS global_avg FROM events GROUP BY 1"
)
def global_average(t):
    rows = t.events.select(F.col("event_type").alias("meter"), "value", (F.col("user_id") % 5 + 1).alias("w"))
    return stats.global_averages(rows, "meter", "value", "w").withColumn("global_avg", F.round("global_avg", 6))


@query(
    """
SELECT count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS accuracy
FROM (SELECT (list_position(embedding, list_max(embedding)) - 1 = label * 6)::INT AS hit FROM embeddings)
"""
)
def argmax_accuracy(t):
    rows = t.embeddings.select(F.col("embedding").alias("logits"), (F.col("label") * 6).alias("label"))
    return stats.argmax_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))
