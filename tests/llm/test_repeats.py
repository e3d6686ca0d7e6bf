"""Repeated passages and benchmark windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from trovekit.llm import bwt_dedup, decontaminate

from .conftest import make_docs


def brute_repeats(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(passage):
    rng = random.Random(4)
    rows, n = [], 0
    shared = [passage(100 + i, rng.randint(50, 160)) for i in range(6)]
    for seed in range(40):
        parts = [passage(seed, rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a : len(s) - rng.randint(0, 60)], passage(1000 + n, rng.randint(0, 60))]
            n += 1
        rows.append((seed, " ".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[4][1] + " tail"), (53, None), (54, ""), (55, "short"), (56, "short")]
    rows += [(60, "word " * 300), (61, "ab" * 500), (62, "a" * 399), (63, "a" * 400), (64, "a" * 401), (65, "b" * 400)]
    rows += [(70, "été " * 150 + passage(7, 100)), (71, passage(8, 90) + "été " * 120)]
    same = "".join(chr(33 + (i * i) % 90) for i in range(700))
    rows += [(80, same[:400] + "x"), (81, "y" + same[:400]), (82, same[1:400]), (83, same[300:] + same[300:])]
    return rows


def check(spark, rows):
    got = {}
    for r in bwt_dedup.remove_repeats(make_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = {}
    for (doc_id, _), w in zip(rows, brute_repeats(rows)):
        want.setdefault(doc_id, []).append(w)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, w in want.items():
        assert sorted(got[doc_id]) == sorted(w), doc_id


def test_repeats_against_brute_force(spark, passage):
    check(spark, repeat_rows(passage))


def test_repeats_in_several_shards(spark, passage, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 4000)
    check(spark, repeat_rows(passage))


def test_planted_passages_of_fifty_to_eighty_words(spark, passage):
    """Passages shared by two documents: all of 400 bytes or more go, shorter ones stay, as brute force has it."""
    rng = random.Random(12)
    short = [" ".join(w[:6] for w in passage(3000 + i, rng.randint(50, 80)).split()) for i in range(40)]
    planted = short + [passage(3100 + i, rng.randint(50, 80)) for i in range(40)]
    rows = []
    for i, p in enumerate(planted):
        for copy in range(2):
            rows.append((2 * i + copy, f"{passage(4000 + 2 * i + copy, 30)} {p} {passage(5000 + 2 * i + copy, 30)}"))
    # with the blanks around it a passage is two bytes longer
    sizes = [len(p.encode()) + 2 for p in planted]
    assert min(sizes) < 390 and max(sizes) > 410
    got = {r.doc_id: r.n_removed for r in bwt_dedup.remove_repeats(make_docs(spark, rows)).collect()}
    for i, n in enumerate(sizes):
        if abs(n - 400) > 3:  # a letter beside the passage may be shared by chance
            assert all((got[2 * i + copy] >= n) == (n >= 400) for copy in range(2)), n
    check(spark, rows)


def test_repeats_odd_tables(spark, passage):
    text = passage(1, 120)
    check(spark, [(1, text), (1, text), (None, text + "!"), (None, None), (2, passage(2, 100)), (2, passage(3, 100) + text)])
    assert bwt_dedup.remove_repeats(make_docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_long_text_pieces(monkeypatch, passage):
    """Anchors of a text cut into pieces are those of the whole text."""
    raw = np.frombuffer((passage(1, 9000) + "a" * 3000).encode(), np.uint8)
    whole = bwt_dedup.anchors(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(bwt_dedup, "PIECE", 5000)
    for a, b in zip(whole, bwt_dedup.anchors(raw, np.array([0, len(raw)]))):
        assert (a == b).all()


def test_merge_finds_the_repeated_phrases(spark, passage):
    """Intervals of the merged transform are the phrase runs that occur twice."""
    rows = repeat_rows(passage)
    named = [(i, -i, t) for i, (_, t) in enumerate(rows) if t and len(t.encode()) >= 400]
    df = spark.createDataFrame(named, "h1 long, h2 long, text string")
    phrases = df.mapInArrow(bwt_dedup._phrase_rows, "h1 long, h2 long, pos array<int>, sym array<long>").collect()
    runs = Counter()
    where = {}
    for r in phrases:
        # a run ends once it has the guaranteed bytes, or after one symbol and all rounds
        for i in range(len(r.sym)):
            sizes = [m for m in range(1, bwt_dedup.MAX_ROUNDS + 2) if i + m < len(r.pos) and r.pos[i + m] - r.pos[i] >= bwt_dedup.CORE]
            m = sizes[0] if sizes else bwt_dedup.MAX_ROUNDS + 1
            if i + m <= len(r.sym):
                key = tuple(r.sym[i : i + m])
                runs[key] += 1
                where[r.h1, r.pos[i]] = key
    want = {k for k, v in where.items() if runs[v] > 1}
    got = {(r.h1, p) for r in bwt_dedup.repeated_anchors(spark.createDataFrame(phrases, "h1 long, h2 long, pos array<int>, sym array<long>"), 5).collect() for p in r.pos}
    assert want == got


WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_leaks(docs, items):
    out = {}
    for doc_id, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for item_id, t in items:
            iw = words_of(t)
            m = min(10, len(iw))
            windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
            for i in range(len(ws) - m + 1):
                if tuple(ws[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= {str(item_id)} if item_id is not None else set()
        out[doc_id, text] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_against_brute_force(spark, passage, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", limit)
    items = [(i, passage(50 + i, 12 + 3 * i)) for i in range(8)] + [(20, "Short item!"), (21, None), (22, "..."), (23, passage(50, 12)), (None, passage(60, 11))]
    docs = [(i, passage(i, 60)) for i in range(10)]
    docs += [(30 + i, passage(300 + i, 30) + ", " + items[i][1].upper().replace(" ", " -- ") + " " + passage(400 + i, 9)) for i in range(8)]
    docs += [(40, "a short item here"), (41, None), (42, ""), (43, "\n\t"), (44, items[3][1][: len(items[3][1]) // 2]), (45, "shortÉ item"), (46, items[2][1] + " x " + items[2][1])]
    docs += [(47, passage(60, 11)), (48, passage(9, 20000) + " " + items[1][1])]
    repeated = docs + [docs[3], (30, "other text of the same id, short item"), (None, "short item")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    df = make_docs(spark, repeated)
    want = brute_leaks(repeated, items)
    got = decontaminate.report(df, bench).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((d[0], *want[d])) for d in repeated)
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(d) for d in repeated if not want[d][-1])
    cut = {(r.doc_id, len(words_of(r.text))) for r in decontaminate.cut_spans(df, bench).collect()}
    assert cut == {(d[0], want[d][0] - want[d][1]) for d in repeated}
    nothing = decontaminate.report(df, bench.limit(0)).collect()
    assert len(nothing) == len(repeated) and not any(r.contaminated for r in nothing)
    assert decontaminate.report(df.limit(0), bench).count() == 0
