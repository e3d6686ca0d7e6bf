"""Sources and sinks: every query writes whole tables and reads them back."""

from pyspark.sql import functions as F

from checks.base import query
from trovekit import schemas
from trovekit.operators import pools
from trovekit.operators.pools import ensure_unique
from trovekit.session import scratch_path
from trovekit.sources import catalog, images, records, stores, tables, trec


@query(
    needs="fx_pool",
    sql="SELECT did, md5(coalesce(txt, '')) AS txt, img_path, modality, src_content FROM fx_pool",
)
def io_roundtrip_jsonl(t):
    path = scratch_path(t.spark, "pool")
    columns = [f.name for f in schemas.CANDIDATE.fields]
    half = t.fx_pool.select(*columns)
    records.write_jsonl(half.where("modality = 'image'"), path)
    records.write_jsonl(half.where("modality <> 'image'"), path, mode="append")
    back = records.read_jsonl(t.spark, path, schemas.CANDIDATE, position="pos")
    return back.select("did", F.md5(F.coalesce("txt", F.lit(""))).alias("txt"), "img_path", "modality", "src_content")


@query(
    needs="fx_queries",
    sql="""
SELECT qid, md5(coalesce(query_txt, '')) AS txt, query_img_path AS img, query_modality AS modality, query_src_content AS src,
       array_to_string(pos_cand_list, '|') AS pos, array_to_string(neg_cand_list, '|') AS neg
FROM fx_queries
""",
)
def io_roundtrip_queries(t):
    path = scratch_path(t.spark, "queries")
    records.write_jsonl(t.fx_queries.select(*[f.name for f in schemas.QUERY.fields]), path)
    back = records.keyed_queries(records.read_jsonl(t.spark, path, schemas.QUERY), "qid")
    return back.select(
        F.col("key").alias("qid"),
        F.md5(F.coalesce("query_txt", F.lit(""))).alias("txt"),
        F.col("query_img_path").alias("img"),
        F.col("query_modality").alias("modality"),
        F.col("query_src_content").alias("src"),
        F.array_join("pos_cand_list", "|").alias("pos"),
        F.array_join("neg_cand_list", "|").alias("neg"),
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_roundtrip_csv(t):
    path = scratch_path(t.spark, "csv")
    source = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    source.write.option("header", True).csv(path)
    return tables.read_csv(t.spark, path, source.schema)


@query("SELECT 'img/' || l_partkey || '.jpg' AS img_path, l_returnflag || ' ' || l_orderkey AS description FROM lineitem")
def io_roundtrip_labels(t):
    path = scratch_path(t.spark, "labels")
    source = t.lineitem.select(
        F.concat(F.lit("img/"), "l_partkey", F.lit(".jpg")).alias("img_path"),
        F.col("l_discount").alias("score"),
        F.concat_ws(" ", "l_returnflag", "l_orderkey").alias("description"),
    )
    source.write.option("sep", "\t").csv(path)
    return tables.read_labels(t.spark, path)


@query(
    """
SELECT '0:' || l_orderkey AS qid, '1:' || l_partkey AS did, l_linenumber::BIGINT AS rank, l_quantity AS score,
       'lines_single_pool_test_k7' AS run_id, (l_suppkey % 9)::BIGINT AS task_id
FROM lineitem
"""
)
def io_roundtrip_run(t):
    path = scratch_path(t.spark, "run")
    run = t.lineitem.select(
        F.concat(F.lit("0:"), "l_orderkey").alias("qid"),
        F.concat(F.lit("1:"), "l_partkey").alias("did"),
        F.col("l_linenumber").alias("rank"),
        F.col("l_quantity").alias("score"),
        F.lit(trec.run_name("lines", "own", "test", 7)).alias("run_id"),
        (F.col("l_suppkey") % 9).alias("task_id"),
    )
    trec.write_run(run, path)
    back = trec.read_run(t.spark, path)
    return back.withColumn("rank", F.col("rank").cast("long")).withColumn("task_id", F.col("task_id").cast("long"))


@query(
    """
SELECT '0:' || l_orderkey AS qid, '1:' || l_partkey AS did, (l_linenumber - 3)::BIGINT AS relevance, (l_suppkey % 9)::BIGINT AS task_id
FROM lineitem WHERE l_linenumber > 3
"""
)
def io_roundtrip_qrels(t):
    path = scratch_path(t.spark, "qrels")
    qrels = t.lineitem.select(
        F.concat(F.lit("0:"), "l_orderkey").alias("qid"),
        F.concat(F.lit("1:"), "l_partkey").alias("did"),
        (F.col("l_linenumber") - 3).alias("relevance"),
        (F.col("l_suppkey") % 9).alias("task_id"),
    )
    trec.qrel_lines(qrels).write.text(path)
    back = trec.read_qrels(t.spark, path).drop("pos")
    return back.withColumn("relevance", F.col("relevance").cast("long")).withColumn(
        "task_id", F.col("task_id").cast("long")
    )


@query(
    needs="fx_features",
    sql="""
SELECT id, round(list_sum(img::DOUBLE[]), 5) AS img, round(list_sum(txt::DOUBLE[]), 5) AS txt, len(img)::BIGINT AS dim,
       img_mask::BIGINT AS img_mask, txt_mask::BIGINT AS txt_mask
FROM fx_features
""",
)
def io_roundtrip_features(t):
    path = scratch_path(t.spark, "features")
    stores.write_features(t.fx_features.drop("next_id"), path)
    total = lambda c: F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5)
    return stores.read_features(t.spark, path).select(
        "id",
        total("img").alias("img"),
        total("txt").alias("txt"),
        F.size("img").cast("long").alias("dim"),
        F.col("img_mask").cast("long").alias("img_mask"),
        F.col("txt_mask").cast("long").alias("txt_mask"),
    )


@query(
    """
SELECT 'label' || label AS pool, count(*) AS n, sum(vec_id)::BIGINT AS ids, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total
FROM embeddings GROUP BY label
UNION ALL SELECT 'union', count(*), sum(vec_id)::BIGINT, round(sum(list_sum(embedding::DOUBLE[])), 4) FROM embeddings
"""
)
def io_roundtrip_embeddings(t):
    path = scratch_path(t.spark, "embeddings")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    labels = [r[0] for r in rows.select("label").distinct().collect()]
    for label in [*labels, *labels]:  # a job that runs again leaves the same rows
        stores.write_embeddings(rows.where(F.col("label") == label), path, f"label{label}")
    stored = ensure_unique(stores.read_embeddings(t.spark, path), "id")
    both = stored.unionByName(stored.withColumn("pool", F.lit("union")))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return both.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.round(F.sum(total), 4).alias("total")
    )


@query(
    needs="fx_prompts",
    sql="""
SELECT dataset_id, query_modality, cand_modality, array_to_string([md5(p) FOR p IN raw_prompts IF p <> ''], '|') AS prompts
FROM fx_prompts
""",
)
def io_roundtrip_prompts(t):
    path = scratch_path(t.spark, "prompts") + ".tsv"
    flat = F.transform("raw_prompts", lambda p: p)
    lines = t.fx_prompts.select(
        F.concat_ws("\t", "query_modality", "cand_modality", F.lit("unused"), "dataset_id", F.array_join(flat, "\t")).alias(
            "query_modality\tcand_modality\tname\tdataset_id\tprompts"
        )
    )
    lines.write.option("header", True).option("quote", "").option("sep", "\x01").option("escapeQuotes", False).csv(path)
    back = tables.read_prompts(t.spark, path)
    return back.withColumn("prompts", F.array_join(F.transform("prompts", lambda p: F.md5(p)), "|"))


@query("SELECT doc_id::VARCHAR AS key, md5(text) AS caption, lang FROM documents")
def json_map_rows(t):
    path = scratch_path(t.spark, "objects")
    value = F.struct(F.col("text").alias("caption"), "lang")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), value)))
    objects = t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.to_json(entries).alias("value"))
    objects.repartition("part").write.partitionBy("part").text(path)
    rows = tables.read_object_rows(t.spark, path, "struct<caption:string,lang:string>")
    return rows.select("key", F.md5("value.caption").alias("caption"), "value.lang")


@query("SELECT 'p' || p_partkey AS image_id, 'images/set' || (p_size % 5) || '/' || p_partkey || '.png' AS img_path FROM part")
def split_map_rows(t):
    path = scratch_path(t.spark, "splits")
    entry = F.struct(
        F.concat(F.lit("p"), "p_partkey"),
        F.concat(F.lit("./set"), (F.col("p_size") % 5).cast("string"), F.lit("/"), "p_partkey", F.lit(".png")),
    )
    objects = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    objects.repartition("part").write.partitionBy("part").text(path)
    return tables.read_split_map(t.spark, path, "images")


@query(
    """
SELECT doc_id::VARCHAR AS image_id, md5(text) AS payload, (source = 'src1' OR source = 'src2') AS jpeg FROM documents
"""
)
def base64_rows(t):
    path = scratch_path(t.spark, "base64")
    head = F.when(F.col("source").isin("src1", "src2"), F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("89504E")))
    payload = F.base64(F.concat(head, F.encode("text", "UTF-8")))
    # one line per image: the encoder's line breaks go
    t.documents.select(F.col("doc_id").cast("string"), F.regexp_replace(payload, r"\s", "")).write.option("sep", "\t").csv(path)
    rows = tables.read_base64_images(t.spark, path)
    body = F.decode(F.substring("content", 4, 2_000_000_000), "UTF-8")
    return rows.select("image_id", F.md5(body).alias("payload"), images.is_jpeg("content").alias("jpeg"))


@query("SELECT 'source=' || source || '/lang=' || lang AS folder, count(DISTINCT doc_id % 3) AS files, true AS once FROM documents GROUP BY source, lang")
def image_listing(t):
    # a folder tree written from the documents, up to three files to a folder, listed by extension
    path = scratch_path(t.spark, "images")
    rows = t.documents.select("source", "lang", "text", (F.col("doc_id") % 3).cast("int").alias("part"))
    # a task writes a folder's files of one part, and folders are dealt over many tasks
    spread = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    target = (F.pmod(F.xxhash64("source", "lang"), F.lit(spread)) * 3 + F.col("part")).cast("int")
    rows.repartitionById(3 * spread, target).drop("part").write.partitionBy("source", "lang").text(path, lineSep="\0")
    found = images.list_images(t.spark, path, extensions=("txt",))
    assert images.list_images(t.spark, path, extensions=("jpg",)).isEmpty()
    folder = F.array_join(F.slice(F.split("path", "/"), -3, 2), "/").alias("folder")
    return found.groupBy(folder).agg(F.count_distinct("path").alias("files"), (F.count(F.lit(1)) == F.count_distinct("path")).alias("once"))


@query(
    """
SELECT DISTINCT lower(event_type) AS dataset, 'test' AS split,
       lower(event_type) || CASE WHEN lower(event_type) IN ('mscoco_task0', 'mscoco_task3', 'flickr30k_task0', 'flickr30k_task3') THEN '_test' ELSE '' END AS pool,
       '1|5|10' AS depths, 10::BIGINT AS k, 'test/' || lower(event_type) || '_test.jsonl' AS query_file,
       'local/' || lower(event_type) || '_cand_pool.jsonl' AS pool_file, 'qrels/test/' || lower(event_type) || '_test_qrels.txt' AS qrel_file
FROM events
"""
)
def catalog_join(t):
    names = t.events.select(F.upper("event_type").alias("dataset")).distinct()
    rows = names.select(
        "dataset",
        F.lit("test").alias("split"),
        F.col("dataset").alias("pool"),
        F.col("dataset").alias("qrel"),
        F.lit("Recall@1, Recall@5, Recall@10").alias("metrics"),
    )
    return catalog.resolve(rows).select(
        "dataset",
        "split",
        "pool",
        F.array_join(F.col("depths").cast("array<string>"), "|").alias("depths"),
        F.col("k").cast("long").alias("k"),
        "query_file",
        "pool_file",
        "qrel_file",
    )


@query(
    needs="fx_pool",
    sql="""
SELECT source AS key, max(pos)::BIGINT AS last_pos, count(*) AS n FROM fx_pool GROUP BY source
""",
)
def source_field_key(t):
    last = records.by_source_field(t.fx_pool, "source", "pos").select("key", F.col("pos").alias("last_pos"))
    every = records.by_source_field(t.fx_pool, "source", "pos", keep="all")
    return last.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")


@query(
    needs="fx_pool",
    sql="SELECT did AS key, md5(concat_ws('-', nullif(txt, ''), img_path, modality)) AS content FROM fx_pool",
)
def keyed_pool(t):
    by_id = records.keyed_pool(t.fx_pool.select("did", "txt", "img_path", "modality"), "did").select("key", "did")
    unique = t.fx_pool.select("did", "txt", "img_path", "modality")
    by_content = records.keyed_pool(unique, "content", check=False).select("did", F.md5("key").alias("content"))
    return by_id.join(by_content, "did").select("key", "content")


@query(
    needs="fx_pool",
    sql="""
, c AS (SELECT did, pos, concat_ws('-', nullif(txt, ''), img_path, modality) AS content FROM fx_pool)
SELECT md5(content) AS key, min_by(did, pos) AS did FROM c GROUP BY content
""",
)
def keyed_pool_unique(t):
    first = pools.first_seen(t.fx_pool.select("did", "txt", "img_path", "modality", "pos"), ["txt", "img_path", "modality"], "pos")
    return records.keyed_pool(first, "content").select(F.md5("key").alias("key"), "did")


@query(
    """
WITH e AS (SELECT 'p_' || vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings
           UNION ALL SELECT 'q_' || vec_id, list_reverse(embedding::DOUBLE[]) FROM embeddings)
SELECT key, unnest(range(64)) AS i, round(unnest(v), 6) AS x FROM e
"""
)
def keyed_vectors(t):
    p = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = p.withColumn("embedding", F.reverse("embedding"))
    rows = stores.keyed_vectors(q, p).select("key", F.posexplode("embedding").alias("i", "x"))
    return rows.select("key", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    needs="fx_features",
    sql="""
SELECT a.vec_id AS pos, a.vec_id AS q_id, (a.vec_id + 1) % (SELECT count(*) FROM embeddings) AS p_id,
       round(list_dot_product(a.embedding::DOUBLE[], b.txt::DOUBLE[]), 6) AS ip
FROM embeddings a JOIN fx_features b ON a.vec_id = b.id
""",
)
def aligned_pairs(t):
    from trovekit.functions.vectors import dot

    q = t.embeddings.select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("id"), "embedding")
    p = t.fx_features.select(F.col("id").alias("pos"), F.col("next_id").alias("id"), F.col("txt").alias("embedding"))
    pairs = stores.aligned_pairs(q, p)
    return pairs.select("pos", "q_id", "p_id", F.round(dot("q_embedding", "p_embedding"), 6).alias("ip"))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def io_roundtrip_results_tsv(t):
    path = scratch_path(t.spark, "results")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    tables.write_tsv(rows, path)
    back = t.spark.read.schema(rows.schema).option("sep", "\t").option("header", True).csv(path)
    return back.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) OVER () AS n FROM labels")
def json_entries(t):
    # JSON arrays of 100 entries per file, counted and read back
    path = scratch_path(t.spark, "arrays") + ".json"
    arrays = t.labels.groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("value")
    )
    arrays.repartition("part").write.partitionBy("part").text(path)
    back = records.read_entries(t.spark, path, "doc_id long, quality long, toxic long").drop("part")
    return back.withColumn("n", F.lit(back.count()).cast("long"))


@query(
    needs="fx_raw_pairs",
    sql="SELECT pos, img_path, split, 'held out' AS part FROM fx_raw_pairs WHERE split <> 'train' UNION ALL SELECT pos, img_path, split, 'all' FROM fx_raw_pairs",
)
def rows_by_split(t):
    # splits are partition folders, so the held-out part reads no training file
    path = scratch_path(t.spark, "splits")
    t.fx_raw_pairs.select("pos", "img_path", "split").write.partitionBy("split").parquet(path)
    stored = t.spark.read.schema("pos long, img_path string, split string").parquet(path)
    held_out = stored.where(F.col("split") != "train").withColumn("part", F.lit("held out"))
    return held_out.unionByName(stored.withColumn("part", F.lit("all")))
