"""Files: images, records, run files, tables."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from trovekit import encoders, schemas
from trovekit.operators import search
from trovekit.session import materialize, scratch_path, shared_dir
from trovekit.sources import catalog, images, records, stores, tables, trec


@pytest.fixture()
def image_dir(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.jpg").write_bytes(b"\xff\xd8\xff" + b"0" * 20)
    (tmp_path / "a" / "bad.jpg").write_bytes(b"GIF8")
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_image_listing_and_manifest(spark, image_dir):
    names = sorted(os.path.basename(r.path) for r in images.list_images(spark, image_dir).collect())
    assert names == ["bad.jpg", "good.jpg"]
    manifest = images.image_manifest(spark, image_dir)
    assert {r.img_path: r.valid for r in manifest.collect()} == {"a/good.jpg": True, "a/bad.jpg": False, "note.txt": False}
    df = spark.createDataFrame([("1", "a/good.jpg"), ("2", "a/bad.jpg"), ("3", None)], "did string, img_path string")
    assert [r.did for r in images.with_valid_image(df, manifest).collect()] == ["1"]
    demoted = images.demote_invalid_image(df.withColumn("modality", F.lit("?")), manifest)
    assert {r.did: (r.modality, r.img_path) for r in demoted.collect()} == {
        "1": ("image,text", "a/good.jpg"),
        "2": ("text", None),
        "3": ("text", None),
    }


def test_jsonl_keeps_line_order(spark, tmp_path):
    for name in ("b", "a"):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            for i in range(500):
                f.write(json.dumps({"did": f"{name}:{i}", "txt": None, "modality": "text"}) + "\n")
    df = records.read_jsonl(spark, str(tmp_path), schemas.CANDIDATE, position="pos")
    got = [r.did for r in df.repartition(7).orderBy("pos").collect()]
    assert got == [f"{n}:{i}" for n in ("a", "b") for i in range(500)]


def test_entries_by_extension(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"did": "1"}, {"did": "2"}]))
    (tmp_path / "x.jsonl").write_text('{"did": "1"}\n')
    assert records.read_entries(spark, str(tmp_path / "x.json"), schemas.CANDIDATE).count() == 2
    assert records.read_entries(spark, str(tmp_path / "x.jsonl"), schemas.CANDIDATE).count() == 1
    with pytest.raises(ValueError):
        records.read_entries(spark, "x.csv", schemas.CANDIDATE)


def test_duplicate_keys_fail(spark):
    pool = spark.createDataFrame([("1", "t", None, "text"), ("2", "t", None, "text")], "did string, txt string, img_path string, modality string")
    assert records.keyed_pool(pool, "did").count() == 2
    with pytest.raises(ValueError, match="duplicate key"):
        records.keyed_pool(pool, "content")


def test_run_and_qrels(spark, tmp_path):
    run = spark.createDataFrame([("0:2", "0:1", 2, 0.5, "r"), ("0:2", "0:9", 1, 0.75, "r"), ("0:1", "0:1", 1, 1.0, "r")], "qid string, did string, rank int, score double, run_id string")
    path = str(tmp_path / "run")
    trec.write_run(run, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == ["0:1 Q0 0:1 1 1.0 r", "0:2 Q0 0:1 2 0.5 r", "0:2 Q0 0:9 1 0.75 r"]
    assert trec.read_run(spark, path).where("task_id IS NULL").count() == 3
    (tmp_path / "qrels.txt").write_text("0:1 0 0:5 1 3\n0:1 0 0:6 0 4\n0:1 0 0:7 2 4\n")
    qrels = trec.read_qrels(spark, str(tmp_path / "qrels.txt"))
    assert sorted(r.did for r in qrels.collect()) == ["0:5", "0:7"]
    assert trec.task_of_query(qrels).first().task_id == 3
    assert trec.run_name("a", "union", "test", 10) == "a_union_pool_test_k10"


def test_prompts_are_ragged(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("q\tc\tname\tid\tp1\tp2\ntext\timage\tx\t0\tfirst\t\tthird\nimage\ttext\ty\t1\tonly\n")
    got = {r.dataset_id: r.prompts for r in tables.read_prompts(spark, str(path)).collect()}
    assert got == {"0": ["first", "third"], "1": ["only"]}
    with pytest.raises(ValueError):
        tables.read_prompts(spark, "p.csv")


def test_base64_and_labels(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("7\t" + base64.b64encode(b"\xff\xd8\xffabc").decode() + "\n")
    row = tables.read_base64_images(spark, str(tmp_path / "i.tsv")).first()
    assert (row.image_id, bytes(row.content)) == ("7", b"\xff\xd8\xffabc")
    (tmp_path / "l.txt").write_text('a/b.jpg\t0.5\tred "dress"\n')
    assert tuple(tables.read_labels(spark, str(tmp_path / "l.txt")).first()) == ("a/b.jpg", 'red "dress"')


def test_guid_objects(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"g1": {"Q": "a", "split": "train"}, "g2": {"Q": "b", "split": "val"}}, indent=1))
    rows = tables.read_object_rows(spark, str(tmp_path / "o.json"), "struct<Q:string,split:string>")
    assert sorted((r.key, r.value.Q) for r in rows.collect()) == [("g1", "a"), ("g2", "b")]


def test_catalog_checks_lengths(spark):
    config = {"test": {"datasets": ["A"], "pools": ["union"], "qrels": ["A"], "metrics": ["Recall@1, Recall@5"]}}
    row = catalog.catalog(spark, config).first()
    assert (row.dataset, row.pool, row.k, row.pool_file) == ("a", "union", 5, "union_pool/union_test_cand_pool.jsonl")
    config["test"]["pools"] = []
    with pytest.raises(ValueError, match="differ in length"):
        catalog.catalog(spark, config)


def test_embedding_store_by_pool(spark, tmp_path):
    path = str(tmp_path / "vectors")
    for pool, ids in (("a", [1, 2]), ("b", [3])):
        df = spark.createDataFrame([(i, [float(i)]) for i in ids], "id long, embedding array<double>")
        stores.write_embeddings(df, path, pool)
    assert sorted(r.id for r in stores.read_embeddings(spark, path, "a").collect()) == [1, 2]
    assert stores.read_embeddings(spark, path).count() == 3
    plan = stores.read_embeddings(spark, path, "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pool" in plan


def test_encoder_registry(spark):
    assert "hashed_words" in encoders.names()
    with pytest.raises(KeyError):
        encoders.get("nothing")
    df = spark.createDataFrame([("1", "a b a"), ("2", None)], "id string, txt string")
    got = {r.id: r.embedding for r in search.encode(df, encoders.get("hashed_words", dim=8), encoders.SCHEMA).collect()}
    assert abs(sum(x * x for x in got["1"]) - 1) < 1e-9 and sum(got["2"]) == 0


class _Session:
    """Stands in for a session with other settings; files stay on the real one."""

    def __init__(self, spark, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, master, "test-app"

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    assert shared_dir(_Session(spark, str(tmp_path), "yarn")) == str(tmp_path)
    assert scratch_path(_Session(spark, str(tmp_path), "yarn"), "x").startswith(str(tmp_path))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session(spark, None, "yarn"))
    assert shared_dir(_Session(spark, None, "local[2]")) == shared_dir(_Session(spark, None, "local[2]"))


def test_materialize_reads_back_what_it_wrote(spark):
    df = spark.range(5).select("id", F.array("id").alias("a"))
    assert sorted(map(tuple, materialize(df).collect())) == sorted(map(tuple, df.collect()))
