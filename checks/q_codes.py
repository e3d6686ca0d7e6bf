"""Discrete codes: quantisation, prefix index, beam search, look-up, re-ranking."""

from pyspark.sql import functions as F

from checks.base import query, rate_sql, unit
from checks.q_search import FUSED, query_vectors
from trovekit.functions import codes as C
from trovekit.functions.vectors import normalize
from trovekit.operators import beam, code_search, evaluate, prefix, quantize
from trovekit.plans import retrieval
from trovekit.session import materialize, scratch_path
from trovekit.sources import stores

LEVELS, BEAMS = 3, 5


def _minus(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda x: x[1] - x[2])"


def _plus(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda x: x[1] + x[2])"


def code_steps(source: str, name: str = "codes") -> str:
    """CTEs that encode ``source`` (key, u) level by level into ``name``."""
    parts = [f"e0 AS (SELECT key, u AS r, [x * 0 FOR x IN u] AS total, []::BIGINT[] AS code FROM {source})"]
    for level in range(LEVELS):
        parts.append(
            f"e{level + 1} AS (SELECT e.key, {_minus('e.r', 'b.centroid')} AS r, {_plus('e.total', 'b.centroid')} AS total, "
            f"list_append(e.code, b.code::BIGINT) AS code FROM e{level} e JOIN fx_codebooks b ON b.level = {level} "
            "QUALIFY row_number() OVER (PARTITION BY e.key ORDER BY list_distance(e.r, b.centroid), b.code) = 1)"
        )
    parts.append(f"{name} AS (SELECT key AS did, code, total FROM e{LEVELS})")
    return ", " + ",\n".join(parts)


POOL_CODES = f"""
, units AS (SELECT id AS key, {unit('embedding')} AS u FROM fx_vectors)
""" + code_steps("units")


def beam_steps(beams: int = BEAMS) -> str:
    """CTEs of the beam search of ``fq`` (qid, u) over the codes of the pool."""
    parts = ["b0 AS (SELECT qid, []::BIGINT[] AS prefix, 0.0::DOUBLE AS score, u AS r FROM fq)"]
    for level in range(LEVELS):
        parts.append(
            f"b{level + 1} AS (SELECT b.qid, p.code AS prefix, b.score - list_distance(b.r, c.centroid) ** 2 AS score, {_minus('b.r', 'c.centroid')} AS r "
            f"FROM b{level} b JOIN (SELECT DISTINCT code[1:{level + 1}] AS code FROM codes) p ON p.code[1:{level}] = b.prefix "
            f"JOIN fx_codebooks c ON c.level = {level} AND c.code = p.code[{level + 1}] "
            f"QUALIFY row_number() OVER (PARTITION BY b.qid ORDER BY round(b.score - list_distance(b.r, c.centroid) ** 2, 6) DESC, p.code) <= {beams})"
        )
    parts.append(
        "beams AS (SELECT qid, prefix AS code, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, prefix) AS beam_rank "
        f"FROM b{LEVELS})"
    )
    return ", " + ",\n".join(parts)


NEED = "fx_features fx_qrels fx_codebooks"
DECODED = FUSED + POOL_CODES + beam_steps()


def joined(c):
    return F.array_join(F.col(c).cast("array<string>"), "-")


def pool_codes(t):
    v = t.fx_vectors.select(F.col("id").alias("did"), "embedding", "pos")
    coded = quantize.encode_codes(v.select("did", "embedding"), t.fx_codebooks)
    return coded.join(v, "did")


def decoded(t, codes):
    return beam.beam_search(query_vectors(t), prefix.prefix_index(codes), t.fx_codebooks, BEAMS, LEVELS)


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES + f", x AS (SELECT did, code, {unit('total')} AS q FROM codes) SELECT did, array_to_string(code, '-') AS code, unnest(range(64)) AS i, round(unnest(q), 6) AS x FROM x",
)
def encode_codes(t):
    rows = pool_codes(t).select("did", joined("code").alias("code"), F.posexplode("quant").alias("i", "x"))
    return rows.select("did", "code", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES + f", x AS (SELECT did, code, {unit('total')} AS q FROM codes) SELECT did, array_to_string(code, '-') AS code, unnest(range(64)) AS i, round(unnest(q), 6) AS x FROM x",
)
def encode_codes_joined(t):
    # the way for codebooks beyond the broadcast limit
    v = t.fx_vectors.select(F.col("id").alias("did"), "embedding")
    coded = quantize.encode_codes(v, t.fx_codebooks, limit=0)
    rows = coded.select("did", joined("code").alias("code"), F.posexplode("quant").alias("i", "x"))
    return rows.select("did", "code", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + f"""
, x AS (SELECT did, {unit('total')} AS q FROM codes) SELECT did, unnest(range(64)) AS i, round(unnest(q), 6) AS x FROM x
""",
)
def reconstruct(t):
    quant = quantize.reconstruct(pool_codes(t).select("did", "code"), t.fx_codebooks)
    rows = quant.select("did", F.posexplode("quant").alias("i", "x"))
    return rows.select("did", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT unnest([0, 1, 2]) AS level, unnest([3, 8, 8]) AS codes, 64 AS dim, true AS closer")
def train_codebooks(t):
    """Sizes of the trained levels, and whether each level brings all vectors nearer to their sums of centroids."""
    vectors = t.embeddings.select(F.col("vec_id").alias("did"), "embedding")
    books = materialize(quantize.train_codebooks(vectors, [3, 8, 8], iterations=5), "books")
    errors = [1e9]
    for level in range(3):
        codes = quantize.encode_codes(vectors, books.where(F.col("level") <= level)).select("did", "code")
        chosen = codes.select("did", F.posexplode("code").alias("level", "code")).join(books, ["level", "code"])
        entries = chosen.select("did", F.posexplode("centroid").alias("i", "x")).groupBy("did", "i").agg(F.sum("x").alias("x"))
        units = vectors.select("did", F.posexplode(normalize("embedding")).alias("i", "u"))
        errors.append(entries.join(units, ["did", "i"]).agg(F.sum((F.col("x") - F.col("u")) ** 2)).first()[0])
    falls = F.array(*[F.lit(b < a) for a, b in zip(errors, errors[1:])])
    return books.groupBy("level").agg(F.count(F.lit(1)).alias("codes"), F.max(F.size("centroid")).alias("dim")).select(
        F.col("level").cast("int"), F.col("codes").cast("int"), "dim", F.get(falls, F.col("level")).alias("closer")
    )


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, rest AS (SELECT key, 0 AS level, r FROM e0 UNION ALL SELECT key, 1, r FROM e1 UNION ALL SELECT key, 2, r FROM e2),
went AS (SELECT key, level, c.code[level + 1] AS code, r FROM rest JOIN codes c ON c.did = key),
n AS (SELECT level, code, count(*) AS n FROM went GROUP BY ALL),
x AS (SELECT level, code, i, sum(x) AS x FROM (SELECT level, code, unnest(range(64)) AS i, unnest(r) AS x FROM went) GROUP BY ALL),
moved AS (SELECT b.level, b.code, (0.8 * 30 + 0.2 * coalesce(n.n, 0))::DOUBLE AS size FROM fx_codebooks b LEFT JOIN n ON n.level = b.level AND n.code = b.code),
dead AS (SELECT level, code, row_number() OVER (PARTITION BY level ORDER BY code) AS place FROM moved WHERE size < 34),
first AS (SELECT key, row_number() OVER (ORDER BY md5('2023:' || key), key) AS place FROM e0),
fresh AS (SELECT d.level, d.code, r.r FROM dead d JOIN first f USING (place) JOIN rest r ON r.key = f.key AND r.level = d.level),
i AS (SELECT b.level, b.code, unnest(range(64)) AS i, unnest(b.centroid) AS c FROM fx_codebooks b)
SELECT i.level::BIGINT AS level, i.code::BIGINT AS code, i.i, f.r IS NOT NULL AS begun, round(CASE WHEN f.r IS NULL THEN m.size ELSE 34.0::DOUBLE END, 6) AS size,
  round(CASE WHEN f.r IS NULL THEN 0.8 * 30 * i.c + 0.2 * coalesce(x.x, 0) ELSE 34 * f.r[i.i + 1] END, 5) AS total
FROM i JOIN moved m ON m.level = i.level AND m.code = i.code LEFT JOIN x ON x.level = i.level AND x.code = i.code AND x.i = i.i
LEFT JOIN fresh f ON f.level = i.level AND f.code = i.code
""",
)
def codebook_update(t):
    """One mini-batch of upkeep on given centroids, with the codes that begin anew."""
    vectors = t.fx_vectors.select(F.col("id").alias("did"), "embedding")
    state = quantize.update_codebooks(quantize.codebook_state(t.fx_codebooks, 30.0), vectors, least=34.0)
    rows = state.select("level", "code", "size", F.posexplode("total").alias("i", "x"))
    return rows.select(
        F.col("level").cast("long").alias("level"), F.col("code").cast("long").alias("code"), F.col("i").cast("long").alias("i"),
        (F.col("size") == 34).alias("begun"), F.round("size", 6).alias("size"), F.round("x", 5).alias("total"),
    )


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, d AS (SELECT DISTINCT code FROM codes), s AS (SELECT code, unnest(range(3)) AS l FROM d),
e AS (SELECT code[1:l] AS prefix, code[l + 1] AS nxt, count(*) AS n FROM s GROUP BY ALL),
ways AS (SELECT prefix, count(*) AS ways FROM e GROUP BY prefix),
stops AS (SELECT s.code, l FROM s JOIN ways w ON w.prefix = s.code[1:l] WHERE l = 0 OR ways > 1 UNION ALL SELECT code, 3 FROM d),
edges AS (SELECT code, l AS b, lag(l) OVER (PARTITION BY code ORDER BY l) AS a FROM stops)
SELECT array_to_string(code[1:a], '-') AS prefix, array_to_string(code[a + 1:b], '-') AS label, count(*) AS n_codes, b = 3 AS leaf FROM edges WHERE a IS NOT NULL GROUP BY ALL
""",
)
def prefix_compact(t):
    index = prefix.compact_index(pool_codes(t))
    return index.select(joined("prefix").alias("prefix"), joined("label").alias("label"), "n_codes", "leaf")


TWICE = """
, twice AS (SELECT c.did, c.code[1:2] AS code, v.vec_id AS pos, v.embedding FROM codes c JOIN fx_vectors v ON c.did = v.id
            UNION ALL SELECT c.did, c.code[1:2], v.vec_id + (SELECT count(*) FROM fx_vectors), v.embedding FROM codes c JOIN fx_vectors v ON c.did = v.id)
"""


def twice(t):
    one = pool_codes(t).select("did", F.slice("code", 1, 2).alias("code"), "pos", "embedding")
    n = t.fx_vectors.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    again = one.withColumn("one", F.lit(1)).join(n, "one").withColumn("pos", F.col("pos") + F.col("n")).select(one.columns)
    return one.unionByName(again)


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + TWICE
    + """
, f AS (SELECT code, min_by(embedding, pos) AS fv FROM twice GROUP BY code),
d AS (SELECT t.pos, t.code, len([i FOR i IN range(1, 65) IF abs(f.fv[i]::DOUBLE - t.embedding[i]::DOUBLE) > 1e-5 + 1e-5 * abs(t.embedding[i]::DOUBLE)]) > 0 AS apart FROM twice t JOIN f USING (code))
SELECT pos, array_to_string(code, '-') AS code, sum(apart::INT) OVER (PARTITION BY code ORDER BY pos)::BIGINT AS suffix FROM d
""",
)
def unique_codes(t):
    rows = quantize.unique_codes(twice(t))
    return rows.select("pos", joined("code").alias("code"), "suffix")


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + TWICE
    + """
, l AS (SELECT code, split_part(did, ':', 1) AS id, lag(split_part(did, ':', 1)) OVER (PARTITION BY code ORDER BY pos) AS prev FROM twice)
SELECT array_to_string(code, '-') AS code, count(*) FILTER (WHERE prev <> id) AS changes, count(DISTINCT id) - 1 AS extra_ids FROM l GROUP BY code
""",
)
def collisions(t):
    rows = twice(t).withColumn("did", F.split_part("did", F.lit(":"), F.lit(1)))
    return quantize.collisions(rows).withColumn("code", joined("code"))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + TWICE
    + """
, l AS (SELECT code, split_part(did, ':', 1) AS id, lag(split_part(did, ':', 1)) OVER (PARTITION BY code ORDER BY pos) AS prev FROM twice),
c AS (SELECT code, count(*) FILTER (WHERE prev <> id) AS changes, count(DISTINCT id) - 1 AS extra_ids FROM l GROUP BY code)
SELECT sum(changes)::BIGINT AS collisions, sum(extra_ids)::BIGINT AS extra_ids FROM c
""",
)
def collision_totals(t):
    rows = twice(t).withColumn("did", F.split_part("did", F.lit(":"), F.lit(1)))
    return quantize.collision_totals(quantize.collisions(rows))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, e AS (SELECT unnest(range(3)) AS level, unnest(code) AS c FROM codes), n AS (SELECT level, c, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT level, n / (SELECT count(*) FROM codes) AS p FROM n), x AS (SELECT exp(-sum(p * ln(p + 1e-6))) AS perplexity FROM p GROUP BY level)
SELECT round(avg(perplexity), 6) AS perplexity FROM x
""",
)
def mean_perplexity(t):
    per_level = quantize.perplexity(materialize(pool_codes(t).select("code"), "codes"))
    return quantize.mean_perplexity(per_level).select(F.round("perplexity", 6).alias("perplexity"))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, e AS (SELECT unnest(range(3)) AS level, unnest(code) AS c FROM codes), n AS (SELECT level, c, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT level, n / (SELECT count(*) FROM codes) AS p FROM n)
SELECT level, round(exp(-sum(p * ln(p + 1e-6))), 6) AS perplexity, count(*) AS used FROM p GROUP BY level
""",
)
def perplexity(t):
    rows = quantize.perplexity(materialize(pool_codes(t).select("code"), "codes"))
    return rows.select(F.col("level").cast("long").alias("level"), F.round("perplexity", 6).alias("perplexity"), "used")


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES + ", s AS (SELECT code, count(*) AS size FROM codes GROUP BY code) SELECT size, count(*) AS codes FROM s GROUP BY size",
)
def bucket_hist(t):
    return quantize.bucket_sizes(pool_codes(t))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
SELECT array_to_string(c.code, '-') AS code, c.did, row_number() OVER (PARTITION BY c.code ORDER BY v.pos) - 1 AS place FROM codes c JOIN fx_vectors v ON c.did = v.id
""",
)
def code_buckets(t):
    rows = code_search.code_buckets(pool_codes(t))
    return rows.select(joined("code").alias("code"), "did", F.col("at").cast("long").alias("place"))


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, d AS (SELECT DISTINCT code FROM codes), s AS (SELECT code, unnest(range(3)) AS l FROM d),
e AS (SELECT code[1:l] AS prefix, code[l + 1] AS nxt, count(*) AS n FROM s GROUP BY ALL)
SELECT array_to_string(prefix, '-') AS prefix, string_agg(nxt, '|' ORDER BY nxt) AS nexts, sum(n)::BIGINT AS n_codes FROM e GROUP BY prefix
""",
)
def prefix_index(t):
    index = prefix.prefix_index(pool_codes(t))
    return index.select(joined("prefix").alias("prefix"), F.array_join(F.col("nexts").cast("array<string>"), "|").alias("nexts"), "n_codes")


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES + "SELECT array_to_string(code, '-') AS code, count(*) OVER () AS n_codes FROM (SELECT DISTINCT code FROM codes)",
)
def prefix_enumerate(t):
    codes = materialize(pool_codes(t).select("code"), "codes")
    count = prefix.code_count(codes).select("n_codes", F.lit(1).alias("one"))
    rows = prefix.enumerate_codes(prefix.prefix_index(codes))
    return rows.select(joined("code").alias("code"), F.lit(1).alias("one")).join(count, "one").drop("one")


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + """
, a AS (SELECT DISTINCT code[1:2] AS code FROM codes), b AS (SELECT DISTINCT [code[3] + 8, code[1]] AS code FROM codes),
ask AS (SELECT []::BIGINT[] AS prefix UNION ALL SELECT DISTINCT code[1:1] FROM a UNION ALL SELECT DISTINCT code[1:1] FROM b UNION ALL SELECT code FROM a UNION ALL SELECT code FROM b),
r AS (SELECT ask.prefix, list_distinct(CASE WHEN len(ask.prefix) = 0 THEN (SELECT list(code[1]) FROM a WHERE code[1] <> 0) || (SELECT list(code[1]) FROM b)
        WHEN ask.prefix IN (SELECT code[1:1] FROM a) OR ask.prefix IN (SELECT code FROM a) THEN coalesce((SELECT list(code[2]) FROM a WHERE len(ask.prefix) = 1 AND code[1:1] = ask.prefix), [])
        ELSE coalesce((SELECT list(code[2]) FROM b WHERE len(ask.prefix) = 1 AND code[1:1] = ask.prefix), []) END) AS nexts FROM ask)
SELECT array_to_string(prefix, '-') AS prefix, array_to_string(list_sort(nexts), '|') AS nexts FROM r
""",
)
def prefix_chained(t):
    codes = materialize(pool_codes(t).select("code"), "codes")
    a = codes.select(F.slice("code", 1, 2).alias("code"))
    b = codes.select(F.array(F.col("code")[2] + 8, F.col("code")[0]).alias("code"))
    heads = lambda df: df.select(F.slice("code", 1, 1).alias("prefix")).distinct()
    root = a.select(F.slice("code", 1, 0).alias("prefix")).distinct()
    ask = root.unionByName(heads(a)).unionByName(heads(b)).unionByName(a.distinct().toDF("prefix")).unionByName(b.distinct().toDF("prefix"))
    found = prefix.chained_lookup(ask, prefix.prefix_index(a), prefix.prefix_index(b), 0)
    return found.select(joined("prefix").alias("prefix"), F.array_join(F.sort_array("nexts").cast("array<string>"), "|").alias("nexts"))


@query(needs=NEED, sql=DECODED + "SELECT qid, beam_rank, array_to_string(code, '-') AS code, score FROM beams")
def beam_search(t):
    rows = decoded(t, materialize(pool_codes(t), "codes"))
    return rows.select("qid", F.col("beam_rank").cast("long").alias("beam_rank"), joined("code").alias("code"), "score")


@query(needs=NEED, sql=DECODED + "SELECT qid, beam_rank, array_to_string(code, '-') AS code, score FROM beams")
def beam_search_joined(t):
    # the way for a level of the codebook beyond the broadcast limit
    codes = materialize(pool_codes(t), "codes")
    rows = beam.beam_search(query_vectors(t), prefix.prefix_index(codes), t.fx_codebooks, BEAMS, LEVELS, limit=0, checkpoint_levels=1)
    return rows.select("qid", F.col("beam_rank").cast("long").alias("beam_rank"), joined("code").alias("code"), "score")


@query(
    needs=NEED,
    sql=FUSED
    + POOL_CODES
    + """
, s AS (SELECT qid, c.level, c.code::BIGINT AS nxt, round(list_dot_product(fq.u, c.centroid), 6) AS logp FROM fq, fx_codebooks c),
p1 AS (SELECT s.qid, [nxt] AS prefix, logp AS score FROM s WHERE level = 0 AND nxt IN (SELECT code[1] FROM codes) QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY round(logp, 6) DESC, [nxt]) <= 4),
p2 AS (SELECT p1.qid, list_append(prefix, nxt) AS prefix, score + logp AS score FROM p1 JOIN s ON s.qid = p1.qid AND s.level = 1
       WHERE list_append(prefix, nxt) IN (SELECT code[1:2] FROM codes) QUALIFY row_number() OVER (PARTITION BY p1.qid ORDER BY round(score + logp, 6) DESC, list_append(prefix, nxt)) <= 4),
p3 AS (SELECT p2.qid, list_append(prefix, nxt) AS prefix, score + logp AS score FROM p2 JOIN s ON s.qid = p2.qid AND s.level = 2
       WHERE list_append(prefix, nxt) IN (SELECT code FROM codes) QUALIFY row_number() OVER (PARTITION BY p2.qid ORDER BY round(score + logp, 6) DESC, list_append(prefix, nxt)) <= 4)
SELECT qid, array_to_string(prefix, '-') AS code, round(score, 6) AS score FROM p3
""",
)
def beam_search_scored(t):
    from trovekit.functions.vectors import dot, normalize

    codes = materialize(pool_codes(t), "codes")
    q = query_vectors(t).select("qid", normalize("embedding").alias("u"))
    # eight centroids per level: a table of 24 rows, one score per query and token
    books = t.fx_codebooks.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("level", "code", "centroid")).alias("book"))
    scores = q.withColumn("one", F.lit(1)).join(books, "one").select("qid", "u", F.inline("book")).select(
        "qid", "level", F.col("code").alias("next"), F.round(dot("u", "centroid"), 6).alias("logp")
    )
    rows = beam.beam_search_scored(q.select("qid"), prefix.prefix_index(codes), scores, 4, LEVELS)
    return rows.select("qid", joined("code").alias("code"), "score")


RETRIEVED = DECODED + """
, members AS (SELECT c.code, c.did, v.pos FROM codes c JOIN fx_vectors v ON c.did = v.id),
plain AS (SELECT b.qid, m.did, row_number() OVER (PARTITION BY b.qid ORDER BY b.beam_rank, m.pos) AS rank FROM beams b JOIN members m ON b.code = m.code QUALIFY rank <= 10),
cand AS (SELECT DISTINCT b.qid, m.did FROM beams b JOIN members m ON b.code = m.code),
cosined AS (SELECT c.qid, c.did, round(list_dot_product(fq.u, fp.u), 6) AS score FROM cand c JOIN fq ON fq.qid = c.qid JOIN fp ON fp.did = c.did),
reranked AS (SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM cosined QUALIFY rank <= 10)
"""


def _stages(t):
    codes = materialize(pool_codes(t).select("did", "code", "pos", "embedding"), "codes")
    beams = materialize(decoded(t, codes), "beams")
    return codes, beams


@query(needs=NEED, sql=RETRIEVED + "SELECT qid, did, rank, 1.0 / rank AS score FROM plain")
def code_retrieve(t):
    codes, beams = _stages(t)
    return code_search.retrieve(beams, codes, 10).withColumn("rank", F.col("rank").cast("long"))


@query(needs=NEED, sql=RETRIEVED + "SELECT qid, did, rank, score FROM reranked")
def code_rerank(t):
    codes, beams = _stages(t)
    rows = code_search.rerank(beams, codes, query_vectors(t), codes.select("did", "embedding"), 10)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(needs=NEED, sql=RETRIEVED + "SELECT qid, did, rank, score FROM reranked")
def code_rerank_stored(t):
    # over vectors that lie by their codes, frequent codes in several slices
    codes, beams = _stages(t)
    path = scratch_path(t.spark, "by-code")
    stores.write_vectors_by_code(codes.select("code", "did"), codes.select("did", "embedding"), path, slice_rows=3)
    rows = code_search.rerank_stored(beams, stores.read_vectors_by_code(t.spark, path), query_vectors(t), 10)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(
    needs=NEED,
    sql=RETRIEVED
    + """
, tasks AS (SELECT qid, min_by(task_id, pos) AS task_id FROM fx_qrels GROUP BY qid),
staged AS (SELECT 'c' AS stage, qid, did, rank FROM plain UNION ALL SELECT 'r', qid, did, rank FROM reranked),
first AS (SELECT b.stage, t.qid, t.task_id, min(b.rank) FILTER (WHERE q.did IS NOT NULL) AS fr FROM tasks t JOIN staged b ON b.qid = t.qid
          LEFT JOIN fx_qrels q ON q.qid = b.qid AND q.did = b.did GROUP BY ALL),
k AS (SELECT 1 AS k UNION ALL SELECT 5 UNION ALL SELECT 10)
SELECT task_id::BIGINT AS task_id, k::BIGINT AS k, count(*) FILTER (WHERE stage = 'c' AND fr <= k) AS hits_codes, count(*) FILTER (WHERE stage = 'r' AND fr <= k) AS hits_rerank
FROM first, k GROUP BY task_id, k
""",
)
def rerank_gain(t):
    codes, beams = _stages(t)
    before = code_search.retrieve(beams, codes, 10)
    after = code_search.rerank(beams, codes, query_vectors(t), codes.select("did", "embedding"), 10)
    gain = evaluate.rerank_gain(before, after, t.fx_qrels, [1, 5, 10])
    return gain.withColumn("task_id", F.col("task_id").cast("long")).withColumn("k", F.col("k").cast("long"))


@query(
    needs=NEED,
    sql=DECODED
    + """
, best AS (SELECT b.qid, b.code AS predicted, c.code AS target FROM beams b JOIN codes c ON c.did = b.qid WHERE beam_rank = 1)
SELECT count(*) AS n, round(avg((predicted = target)::INT), 6) AS all_levels, round(avg((predicted[2] = target[2])::INT), 6) AS level_1,
       round(avg((predicted[2:3] = target[2:3])::INT), 6) AS level_12, round(avg((predicted[2:4] = target[2:4])::INT), 6) AS level_123 FROM best
""",
)
def prefix_accuracy(t):
    codes, beams = _stages(t)
    best = beams.where("beam_rank = 1").select("qid", F.col("code").alias("predicted"))
    pairs = best.join(codes.select(F.col("did").alias("qid"), F.col("code").alias("target")), "qid")
    out = quantize.prefix_accuracy(pairs)
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(
    needs="fx_vectors fx_codebooks",
    sql=POOL_CODES
    + f"""
, x AS (SELECT v.embedding::DOUBLE[] AS e, {unit('c.total')} AS q FROM codes c JOIN fx_vectors v ON c.did = v.id)
SELECT round(avg(list_distance(e, q) ** 2 / 64), 8) AS mse, count(*) AS n FROM x
""",
)
def quant_error(t):
    return quantize.quantisation_error(pool_codes(t)).withColumn("mse", F.round("mse", 8))


@query(
    needs="fx_vectors",
    sql="SELECT id, CASE modality WHEN 'image' THEN 0 WHEN 'text' THEN 1 ELSE 2 END::BIGINT AS code FROM fx_vectors",
)
def modality_code(t):
    return t.fx_vectors.select("id", C.modality_code("modality").cast("long").alias("code"))


@query(
    needs=NEED,
    sql=RETRIEVED
    + f"""
, tasks AS (SELECT qid, min_by(task_id, pos) AS task_id FROM fx_qrels GROUP BY qid),
first AS (SELECT t.qid, t.task_id, min(r.rank) FILTER (WHERE q.did IS NOT NULL) AS fr FROM tasks t JOIN reranked r ON r.qid = t.qid
          LEFT JOIN fx_qrels q ON q.qid = r.qid AND q.did = r.did GROUP BY ALL),
hits AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE fr <= 1) AS h1, count(*) FILTER (WHERE fr <= 10) AS h10 FROM first GROUP BY task_id)
SELECT task_id::BIGINT AS task_id, n, {rate_sql('h1', 'n')} AS r1, {rate_sql('h10', 'n')} AS r10 FROM hits
""",
)
def code_eval(t):
    pool = t.fx_vectors.select(F.col("id").alias("did"), "embedding", "pos")
    run = retrieval.code_retrieval(query_vectors(t), pool, t.fx_codebooks, LEVELS, BEAMS, 10)
    rates = evaluate.hit_rates(evaluate.hit_counts(run, t.fx_qrels, [1, 10], asked=query_vectors(t).select("qid")), [1, 10])
    return rates.select(
        F.col("task_id").cast("long").alias("task_id"), "n", F.col("Recall@1").alias("r1"), F.col("Recall@10").alias("r10")
    )


@query(
    needs="fx_qrels fx_codebooks",
    sql=POOL_CODES
    + f"""
, x AS (SELECT {unit('a.total')} AS q, {unit('b.total')} AS p FROM fx_qrels r JOIN codes a ON a.did = r.qid JOIN codes b ON b.did = r.did)
SELECT round(avg(list_distance(q, p) ** 2 / 64), 8) AS mse, count(*) AS n FROM x
""",
)
def pair_quant_error(t):
    codes = materialize(pool_codes(t).select("did", "quant"), "codes")
    q = codes.select(F.col("did").alias("qid"), F.col("quant").alias("q"))
    pairs = t.fx_qrels.select("qid", "did").join(q, "qid").join(codes, "did")
    return quantize.quantisation_error(pairs, "q", "quant").withColumn("mse", F.round("mse", 8))
