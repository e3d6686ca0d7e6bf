"""Conversation structure repair by weighted CYK interval parsing.

A conversation is well formed when its role initials spell ``(s?(ua)+)?``.  Rows may be
kept, given the role user or assistant, or deleted, and rows without text inserted; a
repair grammar in Chomsky normal form derives spans of rows, and each cell of the chart
holds the least (cost, audit) of a symbol.  Symbols: D, all deleted; XY, rows that
alternate from role X to role Y; S, a kept system row; SX, a system row and rows that
alternate from user to X.  Insertions are derivations of nothing, so they are closed
over in each cell.  Cells are combined bottom-up by span length.

Rows of at most ``CHUNK`` places in a conversation are parsed by one chart; spans beyond
that are combined in rounds from the cells of chunks, eight at a time, by the same
rules.  Since cells of a span only depend on the cells of its two parts, wherever it is
cut, the result does not depend on the chunks; no task ever holds a whole conversation's
texts.

Faults are found by joins, not in the parser: a row without text is blank, a row whose
role and text came before in the conversation is a duplicate, one that does not end in
``.``, ``!`` or ``?`` is truncated; the first that applies counts.

Edge cases: a NULL role or text is one blank; NULL turns come first; rows that tie on
turn are ordered by role and text; rows with NULL conv_id are one conversation; roles
that begin with another letter can only be changed or deleted; a conversation without
rows has cost 0 and an empty audit; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovekit.operators.numbering import number_rows
from trovekit.session import materialize, release

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: rows of a chart, and chunks that a round combines
CHUNK, FAN = 16, 8
SPACE = r"\x20\x09-\x0D"

SYMBOLS = ("D", "UU", "UA", "AU", "AA", "S", "SU", "SA")
_AT = {s: i for i, s in enumerate(SYMBOLS)}
_OTHER = {"U": "A", "A": "U"}


def _binary_rules() -> list[tuple[int, int, int]]:
    """(left, right, whole) of the grammar."""
    rules = [("D", "D", "D")]
    for s in SYMBOLS[1:]:
        rules += [("D", s, s), (s, "D", s)]
    for first in "UA":
        for middle in "UA":
            for last in "UA":
                rules.append((first + middle, _OTHER[middle] + last, first + last))
    for last in "UA":
        rules.append(("S", "U" + last, "S" + last))
        rules += [("S" + middle, _OTHER[middle] + last, "S" + last) for middle in "UA"]
    return [(_AT[a], _AT[b], _AT[c]) for a, b, c in rules]


def _insertions() -> list[tuple[int, int, bool]]:
    """(before, after, in front): what one inserted row makes of a symbol."""
    rules = []
    for role in "UA":
        rules += [("D", role * 2, False), ("D", role * 2, True)]
        for far in "UA":
            rules.append((far + _OTHER[role], far + role, False))
            rules.append((_OTHER[role] + far, role + far, True))
        rules.append(("S" + _OTHER[role], "S" + role, False))
    rules.append(("S", "SU", False))
    return [(_AT[a], _AT[b], front) for a, b, front in rules]


RULES, INSERTIONS = _binary_rules(), _insertions()
#: (cost, audit) by symbol, None where nothing is derived
Cell = list


def _closed(cell: Cell) -> Cell:
    """``cell`` with all insertions at its ends."""
    changed = True
    while changed:
        changed = False
        for before, after, front in INSERTIONS:
            if (x := cell[before]) is not None:
                found = (x[0] + INSERT, "I" + x[1] if front else x[1] + "I")
                if cell[after] is None or found < cell[after]:
                    cell[after] = found
                    changed = True
    return cell


def _least(cell: Cell, left: Cell, right: Cell) -> None:
    """Enter what ``left`` and ``right`` make together."""
    for a, b, c in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            cost = x[0] + y[0]
            best = cell[c]
            if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                cell[c] = (cost, x[1] + y[1])


def joined(left: Cell, right: Cell) -> Cell:
    cell = [None] * len(SYMBOLS)
    _least(cell, left, right)
    return _closed(cell)


def leaf(code: str) -> Cell:
    """Cell of one row: s, u, a or x (another role), a capital when truncated, d when it must go."""
    cell = [None] * len(SYMBOLS)
    cell[_AT["D"]] = (DELETE, "D")
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        role = code.lower()
        for symbol, own in (("S", "s"), ("UU", "u"), ("AA", "a")):
            if role == own:
                cell[_AT[symbol]] = (KEEP + more, "K")
            elif symbol != "S":
                cell[_AT[symbol]] = (REROLE + more, "R")
    return _closed(cell)


def parse(codes: str, known: dict[str, Cell] | None = None) -> Cell:
    """Cell of the whole of ``codes`` (not empty) from a chart over all its spans; ``known`` keeps spans by their codes."""
    known = {} if known is None else known
    for size in range(1, len(codes) + 1):
        for at in range(len(codes) - size + 1):
            span = codes[at : at + size]
            if span in known:
                continue
            if size == 1:
                known[span] = leaf(span)
                continue
            cell = [None] * len(SYMBOLS)
            for cut in range(1, size):
                _least(cell, known[span[:cut]], known[span[cut:]])
            known[span] = _closed(cell)
    return known[codes]


def best(cell: Cell) -> tuple[int, str, bool]:
    """(cost, audit, whether a system row opens it) of a whole conversation."""
    found = [(*cell[_AT[s]], s == "SA") for s in ("D", "UA", "SA") if cell[_AT[s]] is not None]
    return min(found)


# ---- rows -------------------------------------------------------------------


def _key(c: str = "conv_id") -> Column:
    return F.concat(F.when(F.col(c).isNull(), "1").otherwise("0"), F.coalesce(F.col(c).cast("string"), F.lit("")))


def faulted(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` (conv_id, turn, role, text) in order, a written table.

    Columns: key, idx (0, 1, ... in the conversation), turn, role, text, fault (blank,
    duplicate, truncated or NULL) and initial.
    """
    blank = F.lit(" ")
    rows = turns.select(_key().alias("key"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = materialize(number_rows(rows, ["key", "turn", "role", "text"], "n"), "turns")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    marked = rows.withColumn("same", same)
    starts = rows.groupBy("key").agg(F.min("n").alias("start"))
    often = marked.groupBy("key", "same").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank")
        .when(F.col("n") > F.col("first"), "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
    )
    out = marked.join(often, ["key", "same"], "left").join(starts, "key")
    out = out.select("key", (F.col("n") - F.col("start")).alias("idx"), "turn", "role", "text", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))
    out = materialize(out, "turn-faults")
    release(rows)
    return out


_CELLS = "array<struct<cost: long, audit: string>>"
_PARSED = f"key string, chunk long, cells {_CELLS}, illegal long, first string, last string"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cells = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [pa.string(), pa.int64(), cells, pa.int64(), pa.string(), pa.string()]
    names = ["key", "chunk", "cells", "illegal", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], names)


def _stored(cell: Cell) -> list:
    return [None if x is None else {"cost": x[0], "audit": x[1]} for x in cell]


def _chunk_cells(rows: DataFrame, chunk: int) -> DataFrame:
    """One chart for each run of ``chunk`` places."""
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault") == "truncated", F.upper(role)).when(F.col("fault").isNull(), role).otherwise("d")
    listed = rows.select("key", F.floor(F.col("idx") / chunk).cast("long").alias("chunk"), F.struct("idx", code.alias("code"), "initial").alias("r"))
    listed = listed.groupBy("key", "chunk").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("rs")), lambda i: F.concat(F.element_at("rs", i - 1)["initial"], F.element_at("rs", i)["initial"]))
    wrong = F.when(F.size("rs") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    listed = listed.select(
        "key",
        "chunk",
        F.array_join(F.transform("rs", lambda r: r["code"]), "").alias("codes"),
        wrong.cast("long").alias("illegal"),
        F.element_at("rs", 1)["initial"].alias("first"),
        F.element_at("rs", -1)["initial"].alias("last"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Cell] = {}
        for batch in batches:
            out = []
            for key, at, codes, illegal, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if len(known) > 100_000:
                    known = {}
                out.append((key, at, _stored(parse(codes, known)), illegal, first, last))
            if out:
                yield _table(out)

    return listed.mapInArrow(run, _PARSED)


def _combined(parts: DataFrame) -> DataFrame:
    """Cells of FAN neighbouring spans each."""
    whole = parts.select("key", F.floor(F.col("chunk") / FAN).cast("long").alias("up"), F.struct("chunk", "cells", "illegal", "first", "last").alias("p"))
    whole = whole.groupBy("key", "up").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, up, spans in zip(*(c.to_pylist() for c in batch.columns)):
                cells = [[None if x is None else (x["cost"], x["audit"]) for x in s["cells"]] for s in spans]
                wrong = sum(s["illegal"] for s in spans)
                wrong += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(spans, spans[1:]))
                while len(cells) > 1:  # by span length, two by two
                    cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
                yield _table([(key, up, _stored(cells[0]), wrong, spans[0]["first"], spans[-1]["last"])])

    return whole.mapInArrow(run, _PARSED)


def parsed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation of ``rows`` (made by ``faulted``): key, cost, audit, system (a system row opens it), illegal."""
    most = rows.agg(F.max("idx")).first()[0]
    cells = _chunk_cells(rows, chunk)
    spans = 0 if most is None else most // chunk
    for _ in range(math.ceil(math.log(spans + 1, FAN) - 1e-9) if spans else 0):
        below, cells = cells, materialize(_combined(cells), "spans")
        release(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best([None if x is None else (x["cost"], x["audit"]) for x in cell]) for cell in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.string(), pa.bool_()))), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cost", "audit", "system", "illegal"])

    return cells.select("key", "cells", "illegal").mapInArrow(run, "key string, cost long, audit string, system boolean, illegal long")


def scripted(found: DataFrame, piece: int = 65_536) -> DataFrame:
    """The rows that remain: key, place, idx (NULL for an inserted row), edit, role (NULL where a row keeps its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out), kinds)], ["key", "place", "idx", "edit", "role"])
            out.clear()
            return batch

        for batch in batches:
            for key, audit, system in zip(*(c.to_pylist() for c in batch.columns)):
                idx, place = 0, 0
                for edit in audit:
                    if edit != "D":
                        role = None if edit == "K" else ("user", "assistant")[(place - system) % 2]
                        out.append((key, place, None if edit == "I" else idx, edit, role))
                        place += 1
                        if len(out) >= piece:
                            yield flushed()
                    idx += edit != "I"
        if out:
            yield flushed()

    return found.select("key", "audit", "system").mapInArrow(run, "key string, place long, idx long, edit string, role string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: key, place, role, text, edit."""
    own = rows.select("key", "idx", F.col("role").alias("had"), "text")
    lines = scripted(found).join(own, ["key", "idx"], "left")
    return lines.select("key", "place", F.coalesce("role", "had").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of the lines ``role:text`` of each conversation; a conversation streams through its task in order."""
    line = F.concat(F.col("role"), F.lit(":"), F.col("text")).alias("line")
    ordered = lines.select("key", "place", line).repartition("key").sortWithinPartitions("key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                    sha.update(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done])
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (now, sha.hexdigest())))])

    names = ("key", "repaired_sha256")
    return ordered.mapInArrow(run, "key string, repaired_sha256 string")


def report(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conv_id of ``conversations``: gaps, faults, illegal neighbours, cost, audit and the digest of the repair of ``turns``."""
    rows = faulted(turns)
    found = materialize(parsed(rows, chunk), "repairs")
    shas = digests(repaired(rows, found))
    kinds = ("blank", "duplicate", "truncated")
    # the turns of a conversation are told apart before they are counted, so equal ones meet early
    turn = rows.groupBy("key", "turn").agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds])
    counts = turn.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds]
    )
    out = conversations.select("conv_id").distinct().withColumn("key", _key())
    for part in (counts, found.drop("system"), shas):
        out = out.join(part, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the faults that crc32 of ``conv_id:turn`` modulo 20 names: 0 dropped, 1 emptied, 2 without ``.!?``, 3 repeated, 4 said by the user."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("harm != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
