"""Fixture views over the driver tables."""

from checks.base import fixture


@fixture()
def fx_pool(d):
    return """
SELECT doc_id AS pos,
       concat(ds, ':', doc_id + 1) AS did,
       CASE WHEN m = 1 THEN NULL ELSE text END AS txt,
       CASE WHEN m = 0 THEN NULL ELSE concat('img/', doc_id, '.jpg') END AS img_path,
       CASE m WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'image,text' END AS modality,
       concat('{"id":', doc_id, ',"lang":"', lang, '","source":"', source, '"}') AS src_content,
       lang, source, ds
FROM (SELECT *, cast(substr(source, 4) AS int) % 11 AS ds, doc_id % 3 AS m FROM documents)
"""


@fixture()
def fx_manifest(d):
    return """
SELECT concat('img/', documents.doc_id, '.jpg') AS img_path, coalesce(toxic, 0) = 0 AS valid
FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id
"""


@fixture()
def fx_raw_pairs(d):
    return f"""
SELECT doc_id AS pos, text AS caption, concat(source, '/', doc_id % 300, '.png') AS img_path, source,
       CASE WHEN {d.hash32('doc_id')} % 10 < 7 THEN 'train' WHEN {d.hash32('doc_id')} % 10 < 9 THEN 'val' ELSE 'test' END AS split,
       concat('{{"id":"', doc_id, '"}}') AS src_content
FROM documents
"""


@fixture()
def fx_users(d):
    return f"""
SELECT conv_id * 100 + turn AS pos, conv_id, turn, conv_id % 11 AS ds,
       concat(conv_id % 11, ':', conv_id * 100 + turn + 1) AS qid,
       CASE WHEN m = 1 THEN NULL ELSE text END AS query_txt,
       CASE WHEN m = 0 THEN NULL ELSE concat('img/q', (conv_id * 7 + turn) % 97, '.jpg') END AS query_img_path,
       CASE m WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'image,text' END AS query_modality,
       CASE WHEN turn % 4 = 2 THEN NULL
            ELSE concat('{{"question_type":"', CASE conv_id % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'Numerical' ELSE 'Time' END, '"}}')
       END AS query_src_content
FROM (SELECT *, (conv_id + turn) % 3 AS m FROM conversations WHERE role = 'user')
"""


@fixture("fx_users", "fx_pool")
def fx_links(d):
    third = d.div("(SELECT count(*) FROM documents)", 3)
    n = "(SELECT count(*) FROM documents)"
    pos = [
        f"SELECT qid, 'pos' AS label, {j} AS ord, ((conv_id * 7 + turn * 3 + {j * 11}) % {third}) * 3 + conv_id % 3 AS doc "
        f"FROM fx_users WHERE conv_id % 3 >= {j}"
        for j in range(3)
    ]
    neg = [
        f"SELECT qid, 'neg' AS label, {j} AS ord, (conv_id * 13 + turn * 5 + {j * 17 + 1}) % {n} AS doc "
        f"FROM fx_users WHERE conv_id % 5 > {j}"
        for j in range(4)
    ]
    return f"""
SELECT l.qid, l.label, l.ord, p.did FROM ({' UNION ALL '.join(pos + neg)}) l JOIN fx_pool p ON l.doc = p.pos
"""


@fixture("fx_users", "fx_links")
def fx_queries(d):
    return f"""
SELECT u.*, p.l AS pos_cand_list, coalesce(n.l, {d.no_list()}) AS neg_cand_list
FROM fx_users u
JOIN (SELECT qid, {d.ordered_list('did', 'ord')} AS l FROM fx_links WHERE label = 'pos' GROUP BY qid) p ON u.qid = p.qid
LEFT JOIN (SELECT qid, {d.ordered_list('did', 'ord')} AS l FROM fx_links WHERE label = 'neg' GROUP BY qid) n ON u.qid = n.qid
""".replace("u.*", "u.pos, u.conv_id, u.turn, u.ds, u.qid, u.query_txt, u.query_img_path, u.query_modality, u.query_src_content")


@fixture()
def fx_merge_queries(d):
    return f"""
SELECT o_orderkey AS pos, concat('0:', o_orderkey) AS qid,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS query_txt,
       concat('img/c', o_custkey, '.jpg') AS query_img_path, 'image,text' AS query_modality,
       concat('{{"order":', o_orderkey, '}}') AS query_src_content,
       {d.array("concat('1:', o_orderkey % 7)", "concat('1:', o_orderkey % 5)")} AS pos_cand_list,
       {d.array("concat('2:', o_orderkey % 3)")} AS neg_cand_list
FROM orders
"""


@fixture(spread={"part": "p_partkey"})
def fx_kb(d):
    # a row of a hundred bytes becomes an article of up to ten thousand
    return f"""
SELECT p_partkey AS pos, p_partkey AS entity_id, p_name AS title,
       CASE WHEN p_size % 7 = 0 THEN '' ELSE concat({d.repeat("concat(p_type, ' ', p_brand, ' ')", 'p_size * 5')}, p_name) END AS content,
       CASE WHEN p_size % 2 = 0 THEN concat('img/', p_partkey, '.jpg') END AS img_path
FROM part
"""


@fixture()
def fx_kb_manifest(d):
    return "SELECT concat('img/', p_partkey, '.jpg') AS img_path, p_retailprice < 1800 AS valid FROM part"


@fixture()
def fx_questions(d):
    return f"""
SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos,
       concat(l_orderkey, '-', l_linenumber) AS data_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS row_id,
       concat('which brand has part ', l_partkey) AS question,
       l_partkey AS entity_id,
       concat('img/', l_suppkey, '.jpg') AS img_path,
       {d.array("concat('Brand#', l_suppkey % 25 + 1)", "concat('flag ', l_returnflag)")} AS answer,
       {d.array("concat('TYPE ', l_linestatus)")} AS answer_eval,
       CASE l_returnflag WHEN 'A' THEN 'String' WHEN 'N' THEN 'Numerical' ELSE 'Time' END AS question_type,
       CASE WHEN l_linenumber <= 4 THEN 'entity' ELSE 'query' END AS file
FROM lineitem
"""


@fixture()
def fx_prompts(d):
    # 11 datasets x 3 query x 3 candidate modalities, prompts from the benchmark texts, one of them blank
    def one(x):
        return f"replace({x}, chr(10), ' ')"

    def place(m):
        return f"CASE {m} WHEN 'text' THEN 0 WHEN 'image' THEN 1 ELSE 2 END"

    modalities = d.unnest("'text'", "'image'", "'image,text'")
    return f"""
SELECT cast(n.ds AS {'string' if d.spark else 'varchar'}) AS dataset_id, n.query_modality, n.cand_modality,
       {d.array(one('b1.text'), "''", one('b2.text'), one('b3.text'))} AS raw_prompts
FROM (SELECT ds, query_modality, {modalities} AS cand_modality FROM (
        SELECT ds, {modalities} AS query_modality FROM (SELECT DISTINCT item_id % 11 AS ds FROM benchmark))) n
JOIN benchmark b1 ON b1.item_id = n.ds
JOIN benchmark b2 ON b2.item_id = n.ds + 11 + {place('n.query_modality')}
JOIN benchmark b3 ON b3.item_id = n.ds + 14 + {place('n.cand_modality')}
"""


@fixture()
def fx_vectors(d):
    return """
SELECT vec_id AS pos, vec_id, concat(label, ':', vec_id + 1) AS id, embedding, label,
       CASE vec_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'image,text' END AS modality
FROM embeddings
"""


@fixture()
def fx_features(d):
    # image vector of the row, text vector of the next row, masks by modality
    return """
SELECT e.vec_id AS id, n.vec_id AS next_id, e.embedding AS img, n.embedding AS txt,
       CASE WHEN e.vec_id % 3 = 1 THEN 0 ELSE 1 END AS img_mask, CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE 1 END AS txt_mask
FROM (SELECT vec_id, embedding, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS nxt FROM embeddings) e
JOIN embeddings n ON n.vec_id = e.nxt
"""


@fixture("fx_vectors")
def fx_qrels(d):
    # up to three following vectors of the same label within blocks of 64 ids
    near = d.div("pos", 64)
    w = f"OVER (PARTITION BY label, {near} ORDER BY pos)"
    parts = [f"SELECT id AS qid, lead(id, {j}) {w} AS did, pos * 3 + {j} AS pos, label FROM fx_vectors" for j in (1, 2, 3)]
    return f"""
SELECT qid, did, 1 AS relevance, CASE WHEN label % 9 = 5 THEN 4 ELSE label % 9 END AS task_id, pos
FROM ({' UNION ALL '.join(parts)}) WHERE did IS NOT NULL
"""


@fixture()
def fx_codebooks(d):
    # three levels of eight centroids: means over all vectors, grouped three ways
    eighth = d.div("vec_id", 8)
    if d.spark:
        entries = "SELECT level, code, posexplode(v) AS (i, x) FROM grouped"
    else:
        entries = "SELECT level, code, unnest(range(len(v))) AS i, unnest(v) AS x FROM grouped"
    vector = "cast(embedding AS array<double>)" if d.spark else "embedding::DOUBLE[]"
    return f"""
SELECT cast(level AS int) AS level, cast(code AS int) AS code, {d.ordered_list('x', 'i')} AS centroid
FROM (SELECT level, code, i, round(avg(x), 6) AS x FROM ({entries.replace('grouped', f"""(
        SELECT 0 AS level, label % 8 AS code, {vector} AS v FROM embeddings
        UNION ALL SELECT 1, vec_id % 8, {vector} FROM embeddings
        UNION ALL SELECT 2, {eighth} % 8, {vector} FROM embeddings) grouped""")}) entries GROUP BY level, code, i) means
GROUP BY level, code
"""


@fixture()
def fx_meter(d):
    return "SELECT event_id, event_type AS meter, ts, value FROM events"
