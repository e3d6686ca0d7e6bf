"""Token alignment against a direct computation over all byte offsets."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trovekit.llm import token_alignment as ta
from trovekit.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_a string, links long"


@pytest.fixture(scope="module")
def coder():
    return ta.encoder(ta.FOLDER, ta.BYTE_MODEL, ta.PIECE_MODEL)


def plain_groups(coder, text):
    """Groups by offset look-up, no walk along the arrays."""
    if not text:
        return []
    a = coder.a.encode(" " + text, add_special_tokens=False).ids
    b = coder.b.encode(text)
    want = (" " + text).encode()
    if b"".join(coder.a_bytes[i] for i in a) != want or b"".join(coder.b_bytes[i] for i in b) != want:
        return []
    sides = []
    for ids, spelled in ((a, coder.a_bytes), (b, coder.b_bytes)):
        at, ends = 0, []
        for i in ids:
            at += len(spelled[i])
            ends.append((at, i))
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    out = [[[], []] for _ in cuts]
    for k, side in enumerate(sides):
        for e, i in side:
            out[bisect.bisect_left(cuts, e)][k].append(i)
    return out


def brute(coder, texts):
    groups = [plain_groups(coder, t) for t in texts]
    counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for g in groups:
        linked = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append(
            (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(linked))
            + (sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked))
            + (hashlib.sha256(text.encode()).hexdigest() if text else "",)
        )
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    None,
    "",
    " ",
    "x",
    "a▁b",
    "<s> </s> <|endoftext|>",
    "  two  blanks and\ttabs\r\n",
    "café ﬁne 日本語 \U0001f600 ́",
    "nul \x00 byte",
    "same text",
    "same text",
    "word " * 3000,
    "unbrokenletters" * 4000,
]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_hard_texts_and_both_ways_of_look_up(spark, coder):
    ids = [None, 1, 2, 2, *range(4, len(HARD) + 0)]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in zip(ids, HARD)], SCHEMA)
    want = Counter(zip(ids, brute(coder, HARD)))
    for most in (ta.MAX_BROADCAST_PAIRS, 0):
        got = ta.report(docs, max_pairs=most)
        assert Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in got.collect()) == want
    marked = {r["doc_id"]: r["n_a"] for r in ta.report(docs).collect()}
    assert marked[4] == 0  # a text that holds the blank mark of the pieces is not spelled by them


def test_empty_table(spark):
    assert ta.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_read_back(spark, coder):
    texts = ["The quick brown fox, unfortunately, jumps over 1234567 lazy dogs.", "la langue de l'été"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ta.aligned(docs, groups=True).collect():
        a, b = b"", b""
        for g in r["groups"].split(";"):
            x, y = g.split("|")
            x, y = (b"".join(spelled[int(i)] for i in s.split(",")) for s, spelled in ((x, coder.a_bytes), (y, coder.b_bytes)))
            assert x == y
            a, b = a + x, b + y
        assert a == b == (" " + texts[r["doc_id"]]).encode()


def test_quick_library_encodes_like_the_file(coder):
    """Random Latin-1 texts, rich in blanks of all kinds, digits and apostrophes."""
    assert coder.ranked is not None
    rng = np.random.default_rng(11)
    common = np.array([32, 32, 9, 10, 13, 11, 12, 28, 31, 133, 160, 39, 115, 116, 108, 49, 178, 188, 46, 223, 233, 173, 170, 181])
    texts = []
    for k in range(3000):
        n = int(rng.integers(1, 60))
        codes = np.where(rng.random(n) < 0.7, rng.choice(common, n), rng.integers(0, 256, n))
        texts.append("".join(map(chr, codes)))
    texts += [chr(a) + chr(b) for a in range(256) for b in (32, 39, 48, 97, 10, 160)]
    want = [e.ids for e in coder.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode_a(texts)] == want


def test_stretches_of_random_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        a = sorted({size, *rng.integers(1, size + 1, rng.integers(0, size + 1)).tolist()})
        b = sorted({size, *rng.integers(1, size + 1, rng.integers(0, size + 1)).tolist()})
        i, j = ta.links(np.array(a), np.array(b))
        assert [a[x] for x in i] == [b[x] for x in j] == sorted(set(a) & set(b))


def test_query_equals_brute_force(spark, coder):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute(coder, [r["text"] for r in docs])))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, sf_dir).collect()}
    assert got == want
