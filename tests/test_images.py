"""The image manifest from three bytes a file."""

import os

import pytest

from trovekit.sources.images import image_manifest


def files(folder):
    os.makedirs(folder / "a b" / "deep")
    jpeg, png = b"\xff\xd8\xff\xe0 rest", b"\x89PNG rest"
    held = {"one.jpg": jpeg, "a b/two+2.jpg": png, "a b/deep/three.jpg": jpeg, "empty.jpg": b"", "short.jpg": b"\xff\xd8", "four%20.jpg": jpeg}
    for name, data in held.items():
        (folder / name).write_bytes(data)
    # Spark lists no files without bytes
    return {name: data.startswith(b"\xff\xd8\xff") for name, data in held.items() if data}


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_manifest_both_ways(spark, tmp_path, prefix):
    want = files(tmp_path)
    root = f"{prefix}{tmp_path}"
    for opened in (None, {}):
        assert {r.img_path: r.valid for r in image_manifest(spark, root, opened).collect()} == want


def test_large_files_are_not_read(spark, tmp_path):
    """Sparse files of three gigabytes, more than Spark reads whole: their heads are enough."""
    for name, head in (("big.jpg", b"\xff\xd8\xff"), ("other.jpg", b"GIF")):
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            f.truncate(3 << 30)
    assert {r.img_path: r.valid for r in image_manifest(spark, str(tmp_path)).collect()} == {"big.jpg": True, "other.jpg": False}
    with pytest.raises(Exception, match="2147483647"):
        image_manifest(spark, str(tmp_path), {}).collect()


def test_listed_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    import checks.all_queries  # noqa: F401
    from checks import q_sources
    from checks.base import Tables

    docs = spark.range(900).selectExpr("id AS doc_id", "concat('src', id % 30) AS source", "concat('l', id % 2) AS lang", "'t' AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    path = str(tmp_path / "images")
    monkeypatch.setattr(q_sources, "scratch_path", lambda s, label: path)
    found = q_sources.image_listing(Tables(spark, str(tmp_path))).collect()
    assert sorted((r.files, r.once) for r in found) == sorted(
        (len({d % 3 for d in range(900) if d % 30 == s and d % 2 == l}), True) for s in range(30) for l in range(2) if any(d % 30 == s and d % 2 == l for d in range(900))
    )
    tasks = {name.split("-")[1] for _, _, files in os.walk(path) for name in files if name.startswith("part-")}
    assert len(tasks) > 3
