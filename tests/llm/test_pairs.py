"""Lattice and MinHash near-duplicates against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from trovekit.llm import lattice_dedup, minhash
from trovekit.llm.components import components

from .conftest import make_docs


def group_of(edges, nodes):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(500, 560)]
    links = spark.createDataFrame([*edges, (3, 3), (None, 4)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = group_of(edges, {x for e in edges for x in e})
    assert got == {n: want[n] for n in linked}
    assert components(links.limit(0)).count() == 0


def test_e8_decode_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 3
    point = lattice_dedup.decode(x)
    near = lattice_dedup.neighbours()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2)
    best = ((x[:, None] - point[:, None] - near[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - point) ** 2).sum(axis=1) <= best + 1e-9).all()


def vectors(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_lattice_pairs(spark):
    rng = np.random.default_rng(5)
    base = vectors(rng, 60, 24)
    near = base[:40] + rng.normal(size=(40, 24)) * 0.05
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(near)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)]  # copies
    rows += [(300, rows[0][1], 1), (301, rows[0][1], None)]  # other label, no label
    good = list(rows)
    odd = [(400, None, 0), (401, [0.0] * 24, 0), (402, [None] * 24, 0), (403, [float("nan")] + [1.0] * 23, 0), (404, [], 0), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [float("inf")] * 24, 0)]
    schema = "vec_id long, embedding array<float>, label int, node string, dim string"
    df = spark.createDataFrame([(*r, "x", "y") for r in good + odd + [rows[1], (None, rows[1][1], 1)]], schema)
    usable = [r for r in good if r[2] is not None] + [odd[5], odd[6]]
    edges = []
    for a, b in itertools.combinations(usable, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                edges.append((a[0], b[0]))
    assert len(edges) > 30
    want = group_of(edges, [r[0] for r in good + odd])
    links = {n: sum(n in e for e in edges) for n in want}
    got = lattice_dedup.classify(df).collect()
    assert len(got) == len(good) + len(odd) + 1
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.kept and r.component_id is None
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert lattice_dedup.classify(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [3, 20])
def test_crowded_cells_change_nothing(spark, crowded):
    """Clusters, their neighbours, copies and single vectors: with crowded cells as without."""
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = vectors(rng, 1, 16)[0]
        spread = rng.choice([0.02, 0.06, 0.1])
        for v in centre + rng.normal(size=(int(rng.integers(1, 60)), 16)) * spread:
            rows.append((len(rows), v.astype(np.float32).tolist(), int(c % 3)))
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[::9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (m @ m.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in lattice_dedup.classify(df, crowded=crowded, rows=16).collect()}
    plain = {r.vec_id: r for r in lattice_dedup.classify(df).collect()}
    for (vec_id, _, _), n in zip(rows, near.sum(axis=1).tolist()):
        # blocks find every link that cells find, and none that is not there
        assert plain[vec_id].n_links <= got[vec_id].n_links <= n and got[vec_id].component_id <= plain[vec_id].component_id
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * near.sum()
    # where all links of a group are found it is one component
    want = group_of([(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near)))], [r[0] for r in rows])
    whole = {want[r[0]] for r in rows} - {want[r[0]] for r, n in zip(rows, near.sum(axis=1)) if got[r[0]].n_links < n}
    assert len(whole) > 5 and all(got[k].component_id == c for k, c in want.items() if c in whole)


def test_many_unequal_near_copies_of_one_label(spark):
    """20,000 near copies: right counts, and rows that do not grow with the square."""
    n, rng = 20_000, np.random.default_rng(9)
    v = vectors(rng, 1, 16) + rng.normal(size=(n, 16)) * 0.03
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>, label int")
    _, edges, counts, _ = lattice_dedup.near_links(df)
    assert edges.count() <= 40 * n
    m = v.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = np.concatenate([(m[a : a + 2000] @ m.T >= 0.93).sum(axis=1) - 1 for a in range(0, n, 2000)])
    found = {r.node: r.linked for r in counts.collect()}
    linked = np.array([found.get(i, 0) for i in range(n)])
    assert (linked <= want).all() and linked.sum() >= 0.999 * want.sum()


def test_lattice_recall():
    """Pairs at exactly the threshold share a cell of some table."""
    rng = np.random.default_rng(8)
    u = vectors(rng, 600, 64)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    a, b = lattice_dedup.cells(u), lattice_dedup.cells(v)
    hit = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert hit.mean() > 0.98


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(rows, percent):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingles(text))
    edges = []
    for (a, xs), (b, ys) in itertools.combinations(sets.items(), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in xs for y in ys):
            edges.append((a, b))
    return group_of(edges, sets), edges


def near_copies(passage, rng):
    rows, n = [], 0
    for seed in range(25):
        words = passage(seed, rng.randint(1, 400)).split()
        for copy in range(rng.randint(1, 5)):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                changed[rng.randrange(len(changed))] = f"new{n}"
            rows.append((n, " ".join(changed)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_minhash_against_brute_force(spark, passage, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    rows = near_copies(passage, rng)
    shared = passage(999, 60)
    rows += [(500 + i, shared + " " + passage(2000 + i, 80)) for i in range(40)]  # one passage in many documents
    rows += [(600 + i, shared + f" end{i}") for i in range(40)]  # a large group of near copies
    graded = passage(998, 120).split()
    for i in range(60):  # copies with up to 14 changes: few are near each other
        changed = list(graded)
        for j in rng.sample(range(120), i % 15):
            changed[j] = f"w{i}x{j}"
        rows.append((800 + i, " ".join(changed)))
    rows += [(700, None), (701, ""), (702, " \t\n "), (703, "One  two"), (704, "one two"), (705, "ONE two\x0bthree"), (706, "É two"), (707, "é two")]
    rows += [(710, passage(5, 30000)), (711, passage(5, 30000).upper())]
    for percent in (85, 80) if block > 7 else (85,):
        want, edges = brute_groups(rows, percent)
        assert len(edges) > 800
        got = {r.doc_id: r for r in minhash.classify(make_docs(spark, rows), percent).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            r = got[doc_id]
            assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(text)), want[doc_id], want[doc_id] == doc_id), doc_id


def test_minhash_repeated_rows_and_null_ids(spark, passage):
    rows = [(1, passage(1, 50)), (1, passage(1, 50)), (1, passage(2, 50)), (2, passage(2, 50)), (None, passage(2, 50)), (None, None)]
    got = minhash.classify(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (None, None, True)}
    assert minhash.classify(make_docs(spark, rows).limit(0)).count() == 0


def test_minhash_one_row_per_group(spark, passage):
    """Copies under NULL and repeated ids go as well; rows without words and other texts of an id stay."""
    near = passage(3, 60)
    rows = [(1, passage(1, 50)), (1, passage(1, 50)), (1, passage(2, 50)), (2, passage(2, 50)), (None, passage(2, 50)), (None, None), (None, "")]
    rows += [(None, near), (None, near + " x"), (7, near + " y"), (9, near), (None, passage(4, 40)), (None, passage(4, 40))]
    for docs in (make_docs(spark, rows), make_docs(spark, rows[::-1]).repartition(5)):
        kept = minhash.one_row_per_group(docs)
        assert kept.columns == docs.columns
        want = [(1, passage(1, 50)), (1, passage(2, 50)), (None, None), (None, ""), (7, near + " y"), (None, passage(4, 40))]
        assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, want))
    assert minhash.one_row_per_group(make_docs(spark, rows).limit(0)).count() == 0
