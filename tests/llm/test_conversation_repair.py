"""Repair against an exhaustive search over edit scripts and a plain reading of the rules."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from trovekit.llm import conversation_repair as cr
from trovekit.llm.queries import ORACLES, QUERIES

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, idx long, key string"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Dijkstra over (cost, audit, rows read, state) of ``rows`` (initial, fault); returns (cost, audit, roles)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        if (at, state) in seen:
            continue
        seen.add((at, state))
        moves = [(5, "I", 0, r) for r in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            moves.append((2, "D", 1, ""))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                moves.append((more, "K", 1, initial))
                moves += [(1 + more, "R", 1, r) for r in "ua"]
        for price, edit, read, role in moves:
            if edit == "D":
                heapq.heappush(heap, (cost + price, audit + edit, at + read, state, out))
            elif role in GRAMMAR[state]:
                heapq.heappush(heap, (cost + price, audit + edit, at + read, GRAMMAR[state][role], (*out, (role, edit, at))))


def brute(rows, conv_ids, harm=True):
    by = {c: [] for c in conv_ids}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(name.encode()) % 20 if harm else 9
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            plain = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, edits = cheapest(list(zip(initials, faults)))
        lines = []
        for role, edit, at in edits:
            had, text = (mine[at][1], mine[at][2]) if edit != "I" else ("", "")
            lines.append(f"{had if edit == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_chart_equals_exhaustive_search():
    rng = random.Random(5)
    patterns = ["".join(p) for n in range(1, 5) for p in itertools.product("suxAd", repeat=n)]
    patterns += ["".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(5, 11))) for _ in range(300)]
    for codes in patterns:
        rows = [(c.lower() if c != "d" else "u", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in codes]
        assert cr.best(cr.parse(codes))[:2] == cheapest(rows)[:2], codes


def test_cells_of_parts_make_the_cell_of_the_whole():
    rng = random.Random(6)
    for _ in range(100):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 14)))
        cut = rng.randint(1, len(codes) - 1)
        assert cr.joined(cr.parse(codes[:cut]), cr.parse(codes[cut:])) == cr.parse(codes)


def hard_rows():
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "assistant", ""), (1, None, "tool", "a b"), (1, 5, "", "x."), (1, 9, "user", "\t \n")]
    rows += [(2, t, "user", "same.") for t in range(40)]
    rows += [(3, 0, "assistant", "long " * 50_000), (4, 7, "system", "Only a system row."), (5, -3, "user", "é?"), (5, 3, "assistant", "ß! \x0b")]
    for conv in range(6, 60):
        for t in range(rng.randint(1, 12)):
            rows.append((conv, t + rng.randint(0, 1), rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", "", "A long text! ", "q?", None, f"{t}."])))
    rows += [(99, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"t{t}{'.' if t % 5 else ''}") for t in range(700)]
    return rows


@pytest.mark.parametrize("chunk", [3, cr.CHUNK])
def test_hard_conversations(spark, chunk):
    rows = hard_rows()
    turns = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)
    want = brute(rows, {r[0] for r in rows})
    assert got(cr.report(cr.damaged(turns), turns, chunk)) == want


def test_repaired_rows_are_well_formed(spark):
    rows = hard_rows()
    turns = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)
    found = cr.faulted(turns)
    by = {}
    for r in cr.repaired(found, cr.parsed(found)).collect():
        by.setdefault(r["key"], []).append((r["place"], r["role"]))
    for lines in by.values():
        assert [p for p, _ in sorted(lines)] == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, role in sorted(lines)))


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert cr.report(cr.damaged(turns), turns).count() == 0


def test_query_equals_plain_reading_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(QUERIES["op13_conversation_repair"](spark, folder))
    assert found == brute(rows, {r[0] for r in rows})
    assert len({f[6] for f in found.values()}) > 10
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    answer = db.execute(ORACLES["op13_conversation_repair"])
    names = [d[0] for d in answer.description]
    assert {r[0]: tuple(r[names.index(c)] for c in COLUMNS) for r in answer.fetchall()} == found
