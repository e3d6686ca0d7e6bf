"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from trovekit.functions import codes, ids, stable, text, vectors
from trovekit.sources.catalog import max_depth, metric_depths, pool_file_stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        (None, ""),
        ("", ""),
        ("\r\n", ""),
        (' "hello World" ', "Hello World."),
        ("what?", "What?"),
        ("ok.", "Ok."),
        ("wow!", "Wow!"),
        ('"" ', ""),
        ("  été\x1f", "Été."),
        ("a\nb", "A\nb."),
        ('say "hi"', 'Say "hi.'),
        ("ßachzu", "ẞachzu."),
        ("ŉ ᾳ", "ŉ ᾳ."),
        ("ᾳ", "ᾼ."),
    ],
)
def test_clean_text(spark, raw, cleaned):
    assert one(spark, text.clean_text(F.lit(raw).cast("string"))) == cleaned


def test_ids(spark):
    assert one(spark, ids.hash_qid(F.lit("5:42"))) == 2500042
    assert one(spark, ids.hash_did(F.lit("5:42"))) == 50000042
    assert one(spark, ids.unhash_qid(F.lit(2500042))) == "5:42"
    assert one(spark, ids.unhash_did(F.lit(50000042))) == "5:42"
    assert one(spark, ids.unhash_qid(ids.hash_qid(F.lit("9:510201")), F.lit("9"))) == "9:510201"
    assert one(spark, ids.unhash_did(ids.hash_did(F.lit("9:10000001")), F.lit("9"))) == "9:10000001"
    assert one(spark, ids.unhash_qid(ids.hash_qid(F.lit("9:42")), F.lit("9"))) == "9:42"
    assert one(spark, ids.qid_overflows(F.lit("1:500000"))) is True
    assert one(spark, ids.did_overflows(F.lit("1:9999999"))) is False
    assert one(spark, ids.dataset_name(F.lit("9:1"))) == "MSCOCO"
    assert one(spark, ids.dataset_name(F.lit("99:1"))) is None
    assert one(spark, ids.task_id(F.lit("image,text"), F.lit("text"))) == 6
    assert one(spark, ids.task_id(F.lit("video"), F.lit("text"))) is None
    assert one(spark, ids.task_modalities(F.lit(7))) == ["image,text", "image"]


def test_doc_key(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.doc_key(F.lit("A."), null, F.lit("text"))) == "A.-text"
    assert one(spark, text.doc_key(F.lit(""), F.lit("a.jpg"), null)) == "a.jpg"
    with pytest.raises(Exception, match="neither text nor image"):
        one(spark, text.doc_key(F.lit(""), null, F.lit("text")))


def test_chunks_and_words(spark):
    words = " ".join(f"w{i}" for i in range(250))
    pieces = one(spark, text.chunk_words(F.lit(words)))
    assert [len(p.split()) for p in pieces] == [100, 100, 50]
    assert " ".join(pieces) == words
    assert one(spark, text.chunk_words(F.lit(" \n "))) == []
    assert one(spark, text.word_count(F.lit(" a b\tc "))) == 3
    assert one(spark, text.truncate_words(F.lit("a  b c"), 2)) == "a b"
    assert one(spark, text.title_body(F.lit("t"), F.lit("b"))) == "T. b."


def test_captions(spark):
    assert one(spark, text.merge_captions(F.array(F.lit("Is red."), F.lit(""), F.lit("Has sleeves")))) == "Is red and has sleeves."
    assert one(spark, text.first_captions(F.lit('["a","b","c","d","e","f"]'))) == list("abcde")
    assert one(spark, text.first_captions(F.lit('"only"'))) == ["only"]


def test_answers(spark):
    entries = text.string_entries(F.lit('["x", {"range": [1, 2]}, 5, null]'))
    assert one(spark, entries) == ["x"]
    arr = F.array(F.lit("Abc"))
    assert one(spark, text.contains_answer(F.lit("xx Abc"), arr)) is True
    assert one(spark, text.contains_answer(F.lit("xx abc"), arr)) is False


def test_paths(spark):
    assert one(spark, text.to_jpg(F.lit("a/b.c.png"))) == "a/b.c.jpg"
    assert one(spark, text.to_jpg(F.lit("a.d/b"))) == "a.d/b.jpg"
    assert one(spark, text.drop_dot_dir(F.lit("./x/y"))) == "x/y"
    for value in ("oven_00123456", "12345678", "1234567", "123456", "12"):
        assert one(spark, text.shard_by_tail(F.lit(value))) == value[-8:-6], value
        assert one(spark, text.shard_by_head(F.lit(value))) == value[:4]
    assert one(spark, text.folder_key(F.lit("distort/left/000/abc.png"))) == "000/abc"


def test_codes(spark):
    code = F.array(F.lit(1), F.lit(402), F.lit(7))
    assert one(spark, codes.code_to_tokens(code)) == "<a1><b402><c7>"
    assert one(spark, codes.tokens_to_code(codes.code_to_tokens(code))) == [1, 402, 7]
    assert one(spark, codes.modality_code(F.lit("image,text"))) == 2


def test_cycles(spark):
    two = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, stable.cycled(two, 5)) == list("xyxyx")
    assert one(spark, stable.cycled(two, 3)) == list("xyx")
    assert one(spark, stable.cycled(F.array().cast("array<string>"), 5)) == []


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalize(zero)) == [0.0, 0.0]
    assert one(spark, vectors.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vectors.argmax(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == 1
    mixed = one(spark, vectors.mix_up(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.lit("k")))
    assert abs(sum(x * x for x in mixed) - 1) < 1e-9


def test_metric_spec(spark):
    spec = F.lit("Recall@1, Recall@5, MAP@30")
    assert one(spark, metric_depths(spec)) == [1, 5]
    assert one(spark, max_depth(spec)) == 5
    assert one(spark, pool_file_stem(F.lit("MSCOCO_task0"))) == "mscoco_task0_test"


def test_lower_by_character(spark):
    assert one(spark, text.lower(F.lit("ΟΔΟΣ İX"))) == "οδοσ ix"


def test_hashed_words_hold_few_texts_at_once(monkeypatch):
    import numpy as np
    import pandas as pd

    from trovekit import encoders

    texts = [f"w{i} w{i % 3} {'long ' * (i % 40)}" for i in range(200)] + [None, "", "x" * 5000]
    batch = pd.DataFrame({"id": [str(i) for i in range(len(texts))], "txt": texts})
    encode = encoders.get("hashed_words", dim=16)
    whole = pd.concat(encode(iter([batch])))
    monkeypatch.setattr(encoders, "SLICE_CHARS", 500)
    monkeypatch.setattr(encoders, "KNOWN_WORDS", 20)
    parts = list(encode(iter([batch, batch.iloc[:0]])))
    assert len(parts) > 20 and max(len(p) for p in parts) < 100
    again = pd.concat(parts)
    assert list(again["id"]) == list(batch["id"]) == list(whole["id"])
    assert np.array_equal(np.stack(again["embedding"]), np.stack(whole["embedding"]))
