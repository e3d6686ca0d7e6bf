"""Language ID, quality, toxicity: learned operators on small corpora, and their edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trovekit.llm import langid, quality, textbatch, toxicity

from .conftest import make_docs


def test_pieces_cover_whole_texts():
    texts = ["abc def", None, "", "é" * 50, "word " * 40, "x" * 33]
    data, offsets = textbatch.utf8(pa.array(texts).slice(0))
    got = {}
    for rows, part, at in textbatch.pieces(data, offsets, limit=17):
        part.tobytes().decode()  # never cut inside a character
        for r, a, b in zip(rows, at[:-1], at[1:]):
            got[int(r)] = got.get(int(r), b"") + part[a:b].tobytes()
    assert [got.get(i, b"").decode() for i in range(len(texts))] == [t or "" for t in texts]


def language_rows():
    rng = random.Random(1)
    sounds = {"aa": "ka la ma ta ra".split(), "bb": "sch ung ber ein ich".split(), "cc": "ço éa ñu îl ôr".split()}
    rows = []
    for i in range(240):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_language_id(spark):
    rows = language_rows()
    odd = [(500, None, "aa"), (501, "", "aa"), (502, "123 456 !!", "aa"), (503, "KALA " * 20000, None), (503, "KALA " * 20000, None), (None, "schung berich", "bb"), (504, "日本", None)]
    model = langid.fit(make_docs(spark, rows[:150] + odd[:3]))
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.predict(make_docs(spark, rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert np.mean([found[i][0] == lang for i, _, lang in rows[150:]]) == 1.0
    assert found[500] == found[501] == found[502] == ("und", 0.0)
    assert found[503][0] == "aa" and found[None][0] == "bb" and found[504][0] in model.languages
    assert all(0 <= s <= 1 for _, s in found.values())
    kept = langid.keep_identified(make_docs(spark, rows + odd), model)
    assert kept.columns == make_docs(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {500, 501, 502} & set(ids) and ids.count(503) == 2 and {i for i, _, _ in rows} <= set(ids)
    rng = random.Random(8)
    junk = [(600 + i, " ".join("".join(rng.choice("qxzwjyvp") for _ in range(6)) for _ in range(n)), None) for i, n in enumerate((20, 200, 2000))]
    junk += [(610, "слово за слово " * 300, None)]
    sure = {r.doc_id: r.score for r in langid.predict(make_docs(spark, junk), model).collect()}
    assert min(sure.values()) > 0.5  # the posterior tells nothing here
    assert langid.keep_identified(make_docs(spark, junk), model).count() == 0
    empty = langid.fit(make_docs(spark, rows).limit(0))
    assert {r.lang_pred for r in langid.predict(make_docs(spark, rows), empty).collect()} == {"und"}
    assert langid.predict(make_docs(spark, rows).limit(0), model).count() == 0


def test_language_pieces_add_up(monkeypatch, spark):
    rows = language_rows()
    model = langid.fit(make_docs(spark, rows))
    column = pa.array([" ".join(t for _, t, lang in rows if lang == "bb"), rows[0][1]])
    whole = langid.score_texts(column, model)
    monkeypatch.setattr(langid, "PIECE_BYTES", 64)
    parts = langid.score_texts(column, model)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_boosted_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 0] > 0.5)).astype(float)
    model = quality.grow(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    one = quality.grow(x[:50], np.ones(50))
    assert (one.predict(x[:5]) > 0.9).all()
    none = quality.grow(np.zeros((0, 5)), np.zeros(0))
    assert np.allclose(none.predict(x[:5]), 0.5)


def test_statistics_by_hand():
    text = "The cat sat.\nThe cat sat.\nBIG!! | end"
    f = dict(zip(quality.FEATURES, quality.features(pa.array([text]))[0]))
    words, lines = text.split(), text.split("\n")
    assert np.isclose(f["log_bytes"], np.log1p(len(text))) and np.isclose(f["log_words"], np.log1p(len(words)))
    assert np.isclose(f["distinct_words"], len(set(words)) / len(words))
    assert np.isclose(f["distinct_lines"], len(set(lines)) / len(lines)) and np.isclose(f["log_lines"], np.log1p(3))
    assert np.isclose(f["shouts_per_word"], 2 / len(words)) and np.isclose(f["bars_per_word"], 1 / len(words))
    assert np.isclose(f["capital_words"], 1 / len(words)) and np.isclose(f["ended_lines"], 2 / 3)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert np.isclose(f["distinct_triples"], len(set(triples)) / len(triples))
    many = quality.features(pa.array(["", None, " \n", text, "a", text]))
    assert np.isfinite(many).all() and np.allclose(many[3], many[5]) and np.allclose(many[3], list(f.values()))


def test_quality(spark, passage):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = ". ".join(passage(i * 7 + j, 12).capitalize() for j in range(rng.randint(2, 12))) + "."
        rows.append((i, text if good else " ".join(w + "$$#" for w in text.split())))
        labels.append((i, int(good) if i % 11 else None, "x"))
    labels += [(1, 0, "x"), (9999, 0, "x"), (None, 1, "x")]
    odd = [(500, None), (501, ""), (501, ""), (None, "x"), (502, "long word. " * 30000)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality.fit(make_docs(spark, rows[:300] + odd), known)
    got = quality.predict(make_docs(spark, rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd)
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values()) and score[500] == score[501]
    assert np.mean([(score[i] >= 0.5) == (i % 3 > 0) for i in range(300, 400)]) > 0.97
    flat = quality.fit(make_docs(spark, rows), known.limit(0))
    assert {r.score for r in quality.predict(make_docs(spark, rows), flat).collect()} == {0.5}
    assert quality.predict(make_docs(spark, rows).limit(0), model).count() == 0


BAD = ["idiot", "scum", "pathetic", "worthless"]
HIDDEN = ["1d10t", "i d i o t", "sccccum", "p4th3t1c", "w.o.r.t.h.l.e.s.s", "$cum", "id!ot", "p-a-t-h-e-t-i-c", "IDIOOOOT", "w0rthl3ss"]


@pytest.fixture
def toxic_corpus(passage):
    rows, labels = [], []
    for i in range(500):
        words = passage(i, 40).split()
        bad = i % 5 == 0
        if bad:
            for j in range(3):
                words.insert((i * 3 + j * 11) % 40, BAD[(i + j) % 4])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_toxicity(spark, toxic_corpus, passage):
    rows, labels = toxic_corpus
    hidden = [(1000 + k, passage(k + 900, 20) + f" {w} " + passage(k + 950, 20)) for k, w in enumerate(HIDDEN)]
    odd = [(2000, None), (2001, ""), (2001, ""), (None, "idiot"), (2002, "nice 10 words 4 you on 12.03.2020 at 10.20.30.40 call 555-1234 " * 3000)]
    docs = make_docs(spark, rows + hidden + odd)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text long").filter("doc_id % 7 > 0")
    model = toxicity.fit(docs, known)
    restore = toxicity.Restorer(model.characters)
    for text, plain in [("you 1d10t", "you idiot"), ("you i d i o t", "you idiot"), ("sccccum", "scum"), ("$cum of", "scum of"), ("a p4th3t1c one", "a pathetic one")]:
        assert restore(text) == plain
    assert restore("plain words stay, even 12 of 2020-01-02.") == "plain words stay, even 12 of 2020-01-02."
    got = toxicity.predict(docs, model).collect()
    assert len(got) == len(rows) + len(hidden) + len(odd)
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i, _ in rows)
    assert all(score[i] >= 0.5 for i, _ in hidden), [w for k, w in enumerate(HIDDEN) if score[1000 + k] < 0.5]
    assert score[2000] == score[2001] < 0.5 and score[2002] < 0.5 and score[None] >= 0.5
    one_class = toxicity.fit(docs, known.filter("toxic = 0"))
    assert len({r.score for r in toxicity.predict(docs, one_class).collect()}) == 1
    assert toxicity.predict(docs.limit(0), model).count() == 0
    shown = {r.doc_id: r.restored for r in toxicity.restore_texts(docs, model.characters).collect()}
    assert "idiot" in shown[1000] and shown[2000] == ""
    plain = [(i, t) for i, t in rows if not re.search(r"(.)\1\1", t)]
    assert len(plain) > 200 and all(shown[i] == t for i, t in plain)


def test_toxicity_reads_disguises_at_any_place(spark, toxic_corpus, passage):
    """Look-alikes up to the word's end, long gaps, line breaks and accented letters."""
    rows, labels = toxic_corpus
    rows = [(i, t.replace("worthless", "crétin")) for i, t in rows]
    said = {
        "id10+": "idiot", "idi07": "idiot", "i   d   i   o   t": "idiot", "i\nd\ni\no\nt": "idiot", "p\n\na\n\nt\n\nh\n\ne\n\nt\n\ni\n\nc": "pathetic",
        "c r é t i n": "crétin", "crééétin": "crétin", "CRÉÉÉTIN": "crétin", "cré7in": "crétin", "i" + " " * 300 + "d" + " " * 300 + "i" + " " * 300 + "o" + " " * 300 + "t": "idiot", "(idiot)": "idiot", "idiot!": "idiot",
    }
    hidden = [(1000 + k, passage(k + 900, 20) + f" of {w} and " + passage(k + 950, 20)) for k, w in enumerate(said)]
    docs = make_docs(spark, rows + hidden)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text long"))
    shown = {r.doc_id: r.restored for r in toxicity.restore_texts(docs, model.characters).collect()}
    missed = {w: shown[1000 + k][100:220] for k, (w, plain) in enumerate(said.items()) if plain not in re.split(r"\W+", shown[1000 + k])}
    assert not missed, missed
    score = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    assert all(score[i] >= 0.5 for i, _ in hidden), [w for k, w in enumerate(said) if score[1000 + k] < 0.5]
    # a long word without blanks is read in linear time
    assert len(toxicity.decode("ab1" * 100_000, model.characters)) >= 200_000


def test_decode_is_the_best_path():
    """The Viterbi reading has the largest total of all readings of the lattice."""
    import itertools

    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), size=(toxicity.SYMBOLS, toxicity.SYMBOLS)))
    symbol = lambda c: 0 if c == " " else ord(c) - 96
    for token in ("a1b", "1d10t", "b.a.d", "s$$5oo"):
        best = None
        for path in itertools.product(*toxicity._lattice(token)):
            text = "".join(x for x, _ in path)
            total, a, b = sum(w for _, w in path), 0, 0
            for c in text + " ":
                if not (b == symbol(c) == 0):
                    total += model[a, b, symbol(c)]
                    a, b = b, symbol(c)
            best = max(best or (total, text), (total, text))
        assert toxicity.decode(token, model) == best[1].strip()
