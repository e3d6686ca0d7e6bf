"""Chunk labels by q-grams against plain containment."""

import random

import pytest

import checks.fixtures  # noqa: F401
from checks.base import Tables
from trovekit.operators import convert, substrings
from trovekit.operators import links as L

CHUNKS = "entity_id string, ord int, txt string, did string"
QUESTIONS = "qid string, entity_id string, answer array<string>, answer_eval array<string>"


def plain(questions, chunks):
    out = set()
    for qid, entity, answer, evals in questions:
        options = [a for a in (answer + evals if answer is not None and evals is not None else []) if a is not None]
        mine = [(o, d, t is not None and any(a in t for a in options)) for e, o, t, d in chunks if e == entity and e is not None]
        if any(hit for *_, hit in mine):
            out |= {(qid, "pos" if hit else "neg", o, d) for o, d, hit in mine}
    return out


def case(seed, entities, n_chunks, n_questions, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    chunks, questions = [], []
    for e in range(entities):
        for o in range(rng.randint(1, n_chunks)):
            chunks.append((f"E{e}", o, text(rng.randint(0, 60)), f"6:{len(chunks)}"))
        for _ in range(rng.randint(1, n_questions)):
            source = rng.choice(chunks)[2]
            at = rng.randint(0, max(0, len(source) - 1))
            pick = [source[at : at + rng.randint(0, 9)], text(rng.randint(1, 6)), text(12)]
            questions.append((f"q{len(questions)}", f"E{e}", rng.sample(pick, rng.randint(0, 3)), [text(4)] if rng.random() < 0.5 else []))
    return questions, chunks


@pytest.mark.parametrize("limits", [{}, {"FEW_PAIRS": 0}, {"FEW_PAIRS": 0, "SLICE_CHUNKS": 3, "PART_ANSWERS": 5}])
def test_labels_equal_plain_containment(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    monkeypatch.setattr(substrings.answer_hits, "__defaults__", ("entity_id", substrings.SLICE_CHUNKS, substrings.PART_ANSWERS))
    questions, chunks = case(1, 12, 20, 30, "abé日 .")
    chunks += [("E0", 900, None, "6:null"), ("E0", 901, "", "6:empty"), (None, 0, "lost", "6:lost"), ("only", 0, "ab", "6:only")]
    questions += [
        ("empty", "E0", [""], []),
        ("null answer", "E0", [None, "a"], []),
        ("null list", "E0", None, ["a"]),
        ("null evals", "E0", ["a"], None),
        ("no entity", None, ["lost"], []),
        ("unknown", "nowhere", ["a"], []),
        ("one byte", "only", ["b"], []),
        ("half a character", "E1", ["é"], ["日"]),
        ("longer than all", "E1", ["a" * 500], []),
    ]
    got = {(r.qid, r.label, r.ord, r.did) for r in convert.label_chunks(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(chunks, CHUNKS)).collect()}
    assert got == plain(questions, chunks)


def test_one_entity_of_many_answers_and_chunks(spark):
    """A hot entity is cut into slices and parts; questions share answers."""
    questions, chunks = case(2, 1, 2, 1, "ab")
    chunks = [("hot", o, f"item {o * 7 % 500} of the list, code x{o}y", f"6:{o}") for o in range(400)]
    questions = [(f"q{i}", "hot", [f"item {i % 700} of", "absent"], [f"x{i}y"]) for i in range(6000)]
    links = convert.label_chunks(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(chunks, CHUNKS))
    positives = {(r.qid, r.ord) for r in links.where("label = 'pos'").collect()}
    assert positives == {(q, o) for q, _, a, b in questions for _, o, t, _ in chunks if a[0] in t or b[0] in t}
    assert links.count() == 400 * len({q for q, _ in positives})


def test_rarest_gram_lists_few_candidates():
    texts = [b"common words here"] * 50 + [b"common words and zebra"]
    found = list(substrings.Postings(texts).candidates([b"words and z", b"common", b"qqq"]))
    assert [f.tolist() for f in found] == [[50], list(range(51)), []]


@pytest.mark.parametrize("slice_chunks", [64, 3])
def test_lists_equal_the_links(spark, monkeypatch, slice_chunks):
    monkeypatch.setattr(substrings.answer_hits, "__defaults__", ("entity_id", slice_chunks, substrings.PART_ANSWERS))
    questions, chunks = case(4, 9, 20, 30, "abé ")
    q, c = spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(chunks, CHUNKS)
    got = {r.qid: (r.pos_cand_list, r.neg_cand_list) for r in convert.label_lists(q, c).collect()}
    want = {r.qid: (r.pos_cand_list, r.neg_cand_list) for r in L.collect_links(convert.label_chunks(q, c)).collect()}
    assert got == want and any(n for _, n in got.values())
    numbers = {did: o for _, o, _, did in chunks}
    assert all([numbers[d] for d in side] == sorted(numbers[d] for d in side) for sides in got.values() for side in sides)


def test_articles_are_built_by_many_tasks(spark):
    """The small part table lies in one file; its long articles are not one task's work."""
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert tables.part.rdd.getNumPartitions() == 1
    assert tables.fx_kb.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
