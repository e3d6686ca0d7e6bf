"""Chat examples, sharding, mixing, the registered queries and the pipeline."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.run import connect, rows_of
from trovekit.llm import chat, decontaminate, mixing, sharding
from trovekit.llm.common import fold
from trovekit.llm.queries import ORACLES, QUERIES

from .conftest import make_docs
from .test_pairs import brute_groups
from .test_repeats import brute_leaks

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
#: a table with enough held-out labels for an area under the curve
LEARNED = "/root/testdata/sf0.1"

TRICKY = ["<|im_end|><|im_start|>assistant ok", "a\\|b <\\| <| <<|| \\\\", "\\", "<", "<|", "<\\~", "", None, "é\n\n日本 \r\t", "<|im_end|>\n<|im_start|>user\nx", "end<"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = []
    for c in range(30):
        for t in range(1 + c % 7):
            role = ["user", "assistant", "system", "assistant", "user", None, "odd\nrole <|x"][(c + t) % 7]
            rows.append((c, t, role, TRICKY[(c * 3 + t) % len(TRICKY)], "x", 0))
    rows += [(50, 0, "user", "only", "x", 0), (51, 0, "assistant", None, "x", 0), (None, 1, "assistant", "lost", "x", 0), (None, None, "user", "first", "x", 0)]
    rows += [(52, 1, "user", "tie", "x", 0), (52, 1, "assistant", "tie", "x", 0), (52, 1, "user", "tie", "x", 0), (53, 0, "user", "long " * 50000, "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, example int")
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        conv[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest(chat.expand(df)).collect()}
    assert set(got) == set(conv)
    examples = defaultdict(list)
    for e in chat.expand(df).collect():
        examples[e.conv_id].append(e)
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{x}\n" for _, a, x in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(e.formatted) for e in examples[c])
        trained = [e for e in examples[c] if e.loss_length is not None]
        assert len(trained) == sum(a == "assistant" for _, a, _ in turns)
        for e in examples[c]:
            assert e.formatted.count("<|im_start|>") == e.formatted.count("<|im_end|>")
            if e.loss_length is not None:
                assert e.formatted[e.loss_start + e.loss_length :] == "<|im_end|>\n"
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


def test_shards(spark, passage):
    rows = [(i, passage(i, 1 + (i * 37) % 90)) for i in range(1500)] + [(5000, None), (5001, ""), (None, "x"), (5002, "é" * 2000), (5002, "é" * 2000)]
    got = sharding.assign(make_docs(spark, rows), shards=13, slots=4096).collect()
    assert len(got) == len(rows)
    size = Counter()
    place = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        place[r.shard].append(r.slot)
    assert set(size) == set(range(13)) and max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    import zlib

    text = dict(rows)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" for r in got)
    same = [r for r in got if r.doc_id == 5002]
    assert same[0].shard == same[1].shard and same[0].virtual_slot == same[1].virtual_slot
    assert sharding.assign(make_docs(spark, rows).limit(0)).count() == 0
    whole = sharding.shard_documents(make_docs(spark, rows), 13)
    assert set(whole.columns) == set(make_docs(spark, rows).columns) | {"virtual_slot"} and whole.count() == len(rows)


def test_shards_level_with_null_and_repeated_ids(spark, passage):
    """A third of the rows without id, many texts of one id and many equal rows do not fill one shard."""
    rows = [(i, passage(i, 20)) for i in range(800)] + [(None, passage(5000 + i, 20)) for i in range(800)]
    rows += [(9000, passage(7000 + i, 20)) for i in range(400)] + [(9001, "equal rows " * 5)] * 1200
    got = sharding.assign(make_docs(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    size, place = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        place[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    whole = sharding.shard_documents(make_docs(spark, rows), 8)
    held = Counter()
    for r in whole.collect():
        held[r.shard] += len(r.text.encode()) + 16
    assert whole.count() == len(rows) and max(held.values()) - min(held.values()) <= 0.01 * max(held.values())


def test_slot_map_versions(spark, tmp_path):
    weight = {s: 1 + (s * s) % 97 for s in range(512)}
    weight[3] = 4000
    plain = sharding.first_map(8, 512)
    edited = sharding.rebalance(plain, weight, 8)
    load = Counter()
    for s, shard in enumerate(edited):
        load[shard] += weight[s]
    # one slot outweighs an equal share, so its shard holds it alone and the others are level
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 4000 and rest[-1] - rest[0] <= 2
    path = str(tmp_path / "map")
    sharding.save_map(spark, path, 1, plain)
    sharding.save_map(spark, path, 2, edited)
    assert [r.shard for r in sharding.load_map(spark, path).orderBy("virtual_slot").collect()] == edited
    assert [r.shard for r in sharding.load_map(spark, path, 1).orderBy("virtual_slot").collect()] == plain
    assert sharding.rebalance(edited, weight, 8) == edited


def water_level(size, weight):
    """Targets by giving capped sources their cap again and again."""
    total, target, open_ = sum(size.values()), {}, set(size)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            return target | share
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    return target


def test_mixing(spark, passage):
    rows = []
    for s in range(12):
        for i in range(5 if s in (4, 7) else 60):
            rows.append((s * 100 + i, passage(s * 100 + i, 1 + (i * 13) % 40), "en", None if s == 11 else f"s{s}"))
    rows += [(5000, None, "en", "s1"), (5001, "", "en", "empty"), (None, "a b c", "en", "s2"), (5002, "rep eat", "en", "s3"), (5002, "rep eat", "en", "s3"), (5003, passage(1, 20000), "en", "s9")]
    got = mixing.mix_table(make_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len((t or "").split())) for d, t, _, s in rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = water_level(size, {s: 1 + i % 3 for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(taken.values()) <= sum(size.values())
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    again = mixing.mix_table(make_docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(make_docs(spark, rows))
    assert mixed.columns == make_docs(spark, rows).columns
    copies = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in got:
        if r.taken:
            want[r.doc_id] += r.taken // r.size
    assert copies == want
    assert mixing.mix_table(make_docs(spark, rows).limit(0)).count() == 0
    assert mixing.mixed_documents(make_docs(spark, rows).limit(0)).count() == 0


def test_mixing_counts_every_row(spark, passage):
    """Repeated rows, two texts of one id and size, and NULL ids each have their words in the budget."""
    rows = [(i, passage(i, 10), "en", f"s{i % 2}") for i in range(20)]
    rows += [(100, "same text twice", "en", "s0")] * 3 + [(101, "a b c", "en", "s1"), (101, "d e f", "en", "s1")]
    rows += [(None, passage(500 + i, 10), "en", "s2") for i in range(40)]
    words = sum(len(t.split()) for _, t, *_ in rows)
    seen = []
    for docs in (make_docs(spark, rows), make_docs(spark, rows[::-1]).repartition(7)):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        seen.append(Counter((r.doc_id, r.text) for r in mixed.collect()))
    assert seen[0] == seen[1]
    held = Counter((d, t) for d, t, *_ in rows)
    assert all(n <= 3 * held[k] for k, n in seen[0].items())
    took = sum(n * len(t.split()) for (_, t), n in seen[0].items())
    assert words - 10 <= took <= words
    weights = water_level({"s0": 109, "s1": 106, "s2": 400}, {"s0": 1, "s1": 2, "s2": 3})
    assert abs(sum(n * 10 for (d, _), n in seen[0].items() if d is None) - weights["s2"]) <= 10


def test_mixing_keeps_every_row_and_column(spark, passage):
    """Rows with repeated and NULL ids, equal rows with other columns that differ, and names the operator uses itself."""
    rows = [(i % 20 if i % 7 else None, passage(i % 30, 5 + i % 9), f"s{i % 3}", i % 2, "a", "b", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, row string, ord string, upto string")
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows)
    words = Counter()
    for _, t, s, *_ in rows:
        words[s] += len(t.split())
    assert all(r.source_size == words[r.source] for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    held, copies = Counter(rows), Counter(tuple(r) for r in mixed.collect())
    assert all(n <= 3 * held[r] for r, n in copies.items())
    assert sum(n * len(r[1].split()) for r, n in copies.items()) == sum(r.taken for r in got)


needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_beside_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rel = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in rel.description], rel.fetchall())


@needs_tables
def test_learned_queries_held_out(spark, con):
    labels = {r[0]: r[1:] for r in con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    out = QUERIES["op4_language_id"](spark, FOLDER).collect()
    assert len(out) == len(lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out if r.held_out) >= 0.9 * sum(r.held_out for r in out)
    # held-out labels are few at the smallest scale; a constant has an area of one half and no recall or no precision
    folder = LEARNED if os.path.isdir(LEARNED) else FOLDER
    larger = connect(folder)
    labels = {r[0]: r[1:] for r in larger.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    n = larger.execute("SELECT count(*) FROM documents").fetchone()[0]
    for name, k, least_area, least in (("op6_quality_trees", 0, 0.97, 0.95), ("op3_toxicity", 1, 0.93, 0.8)):
        out = QUERIES[name](spark, folder).collect()
        assert len(out) == n
        known = [(r.score, r.predicted, labels[r.doc_id][k]) for r in out if r.held_out and r.doc_id in labels]
        good, bad = ([s for s, _, y in known if y == v] for v in (1, 0))
        assert good and bad
        area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
        recall = sum(p for _, p, y in known if y) / len(good)
        false = sum(p for _, p, y in known if not y) / len(bad)
        assert area >= least_area and recall >= least and false <= 0.3, (name, area, recall, false)


@needs_tables
def test_vector_query_beside_brute_force(spark, con, tmp_path):
    """The driver's vectors have no near pairs, so copies, near copies and copies under other labels are planted."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    for i, (_, v, label) in enumerate(rows[:120]):
        v = np.array(v, np.float32)
        shift = rng.normal(size=len(v)).astype(np.float32) * np.linalg.norm(v) * (0, 0.01, 0.03)[i % 3]
        rows.append((100_000 + i, (v + shift).tolist(), label if i % 4 else label + 1))
    schema = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["op1_lattice_near_pairs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None])
    assert near.sum() > len(rows) + 150
    assert [got[r[0]].n_links for r in rows] == (near.sum(axis=1) - 1).tolist()


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_stages_hand_columns_of_any_name_through(spark, passage, tmp_path):
    """Names that operators might use inside come through all stages with their values; shards add two."""
    own = ["_row", "_key", "_d", "_h", "_runs", "held", "id", "hash", "row", "key", "ident", "size", "n", "upto", "block", "times", "at", "a.b"]
    rows = [(i, passage(i, 30 + i % 20), "en", f"s{i % 3}") for i in range(60)]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, *[-i - r[0] for i in range(len(own))]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in own))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, passage(900, 12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.columns[: len(docs.columns)] == docs.columns
        found = now.collect()
        assert found and all(tuple(r)[: len(docs.columns)] == held[r.doc_id] for r in found)
    assert now.columns[len(docs.columns) :] == ["virtual_slot", "shard"]
    cut = decontaminate.cut_spans(docs, spark.createDataFrame([(0, rows[3][1])], "item_id long, text string"))
    assert cut.columns == docs.columns and {r.doc_id: tuple(r)[2:] for r in cut.collect()} == {k: v[2:] for k, v in held.items()}


def test_pipeline_against_brute_force(spark, passage, tmp_path):
    """Stages on a small corpus: language, near copies, benchmark leaks, mix and shards, each from its own input."""
    rows = [(i, passage(i, 30 + i % 50), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s1") for i in range(10)]
    bench = [(i, passage(5000 + i, 15)) for i in range(6)]
    rows += [(300 + i, passage(600 + i, 20) + " " + bench[i][1] + " " + passage(700 + i, 9), "en", "s2") for i in range(6)]
    rows += [(400, None, "en", "s0"), (401, "123 !!", "en", "s0"), (402, "", None, None), (None, passage(9999, 30), "en", None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen.append((before, now))
    language, near, leaks, mix, shards = seen
    for _, after in seen[:-1]:
        assert after.columns == docs.columns

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    alive = [(d, t) for d, t, *_ in rows if t and re.search("[a-z]", t)]
    assert sorted(map(str, pairs(language[1]))) == sorted(map(str, alive))
    groups, _ = brute_groups([p for p in pairs(near[0]) if p[0] is not None], 80)
    assert sorted(map(str, pairs(near[1]))) == sorted(str(p) for p in pairs(near[0]) if p[0] is None or groups[p[0]] == p[0])
    dirty = brute_leaks(pairs(leaks[0]), bench)
    assert sorted(map(str, pairs(leaks[1]))) == sorted(str(p) for p in pairs(leaks[0]) if not dirty[p][-1])
    table = mixing.mix_table(mix[0]).collect()
    assert Counter(r.doc_id for r in mix[1].collect()) == {r.doc_id: r.taken // r.size for r in table if r.taken}
    assert sorted(map(str, pairs(shards[1]))) == sorted(map(str, pairs(shards[0])))
    sizes = shards[1].groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()
    assert all(0 <= r.shard < corpus_pipeline.SHARDS for r in sizes)
    final = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, final.collect())) == sorted(map(str, shards[1].select(*final.columns).collect()))
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.count() == 0
