"""Repeated passages by merging Burrows-Wheeler transforms of shards.

Bytes covered by a string of ``length`` bytes that also starts somewhere else are
found and removed.

1. Phrases.  Each text is cut at content-defined anchors: the rightmost smallest
   hash of a 16-byte gram in every window of ``window`` grams.  Two occurrences of a
   string of ``length`` bytes share all anchors of the windows inside it, so they
   share a run of whole phrases of at least ``length - 2 window - 14`` bytes (130 by
   default).  Phrases are the symbols of the transform; text shrinks some
   sixtyfold.
2. Shards.  Texts go to shards of a bounded number of bytes.  A shard sorts its own
   suffixes and keeps, in that order, the symbol before each suffix (its transform)
   and the row that suffix leads to (the LF mapping).
3. Merge.  The shards' transforms are interleaved by refinement.  At depth h every
   row knows its interval, the suffixes of all shards that share their first h
   symbols.  A shard sends, for every (symbol before, interval), one run length; equal
   ones of all shards are the intervals of depth h + 1, and the LF mapping says which
   rows they hold.  That is the interleave in run-length form: no suffix is compared or
   sorted again, and common prefixes follow from the depth at which rows part.
   Intervals of one suffix are dropped at once, intervals whose common prefix has
   the guaranteed bytes are finished, so the rounds are few and shrink.  After
   ``MAX_ROUNDS`` what is left (low-entropy text) counts as repeated; that only adds
   work to the next step.
4. Exact check.  The repeated intervals name the anchors near which a repeat can
   start.  128-bit digests of the bytes common to all starts of an anchor (nothing
   there repeats if they do not), of all bytes of these starts (all repeat if they do)
   and, between the two, of ever smaller parts down to single starts decide each
   start exactly.
5. Removal.  Runs are merged per text and cut out.

Equal texts go through the steps once; as each of them starts elsewhere too, all
their bytes go when there are ``length`` or more.

Edge cases: NULL is the empty text; texts below ``length`` bytes keep everything;
rows that repeat a doc_id are texts of their own, and equal rows repeat each other;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovekit.llm.common import drop, written
from trovekit.llm.textbatch import byte_numbers, utf8

LENGTH, WINDOW, GRAM = 400, 128, 16
SHARD_BYTES = 16_000_000
MAX_ROUNDS = 8
PIECE = 1 << 19
#: sizes of the ranges of starts that are decided together, from a whole anchor down to one
RANGES = (WINDOW, 16, 1)


# -- phrases -------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = byte_numbers()[data]
    width = 1
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts data[starts:ends] shorter than 2**20 bytes together: (row, anchor, first start, gram hash) of each anchor, in order."""
    none = np.zeros(0, np.int64)
    span = WINDOW + GRAM - 1
    if len(data) < span:
        return none, none, none, none.view(np.uint64)
    h = _gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width = 1
    while width < WINDOW:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    counts = np.maximum(ends - starts - span + 1, 0)
    row = np.repeat(np.arange(len(starts)), counts)
    if not len(row):
        return none, none, none, none.view(np.uint64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]
    anchor = (low - (least[at] & low)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    return row[new], anchor[new], at[new], h[anchor[new]]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first, hash) of a batch of texts, positions counted from the start of each text.

    ``first`` is the first start whose window selects the anchor; its starts end
    where those of the next anchor of the text begin.
    """
    parts = []
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1
        if hi > lo:
            base = offsets[lo]
            row, anchor, first, h = _window_anchors(data[base : offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base)
            shift = offsets[lo:hi][row] - base if len(row) else 0
            parts.append((row + lo, anchor - shift, first - shift, h))
            lo = hi
            continue
        begin, end = int(offsets[lo]), int(offsets[lo + 1])
        long = []
        for at in range(begin, end, PIECE):
            stop = min(end, at + PIECE + WINDOW + GRAM - 2)
            _, anchor, first, h = _window_anchors(data[at:stop], np.array([0]), np.array([stop - at]))
            long.append((anchor + at - begin, first + at - begin, h))
        anchor, first, h = (np.concatenate(x) for x in zip(*long))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        parts.append((np.full(new.sum(), lo), anchor[new], first[new], h[new]))
        lo += 1
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    counts = np.bincount(row, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _phrase_rows(batches):
    """One row per text that is new in this partition: its anchors and phrase symbols."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for i, key in enumerate(zip(h1.tolist(), h2.tolist())):
            if key not in seen:
                seen.add(key)
                keep[i] = True
        batch = batch.filter(pa.array(keep))
        row, anchor, _, h = anchors(*utf8(batch.column("text")))
        n = batch.num_rows
        gap, after = np.zeros(len(row), np.int64), np.zeros(len(row), np.uint64)
        inner = np.flatnonzero(row[1:] == row[:-1])
        gap[inner], after[inner] = anchor[inner + 1] - anchor[inner], h[inner + 1]
        sym = h * np.uint64(0x94D049BB133111EB) + gap.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + after * np.uint64(0x9E3779B97F4A7C15)
        sym ^= sym >> np.uint64(32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), _lists(anchor.astype(np.int32), row, n), _lists(sym.view(np.int64), row, n)], names=["h1", "h2", "pos", "sym"]
        )


# -- shards and their transforms -----------------------------------------------


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _texts_once(table: pa.Table) -> pa.Table:
    """Equal texts that came from several partitions, once."""
    h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return table.take(pa.array(np.sort(order[new])))


def _first_runs(table: pa.Table) -> pa.Table:
    """Depth 1: the run length of each symbol in a shard."""
    shard = table.column("shard")[0].as_py()
    sym, n = np.unique(_flat(_texts_once(table), "sym"), return_counts=True)
    return pa.table({"shard": pa.array(np.full(len(sym), shard, np.int32)), "sym": sym, "block": np.zeros(len(sym), np.int64), "n": n})


def _sorted_suffixes(sym: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a shard by their first ``MAX_ROUNDS`` symbols, by prefix doubling."""
    rank = np.unique(sym, return_inverse=True)[1]
    step, jump = 1, nxt
    while step < MAX_ROUNDS and len(sym):
        second = np.where(jump >= 0, rank[jump], -1)
        order = np.lexsort((second, rank))
        new = np.ones(len(order), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        jump = np.where(jump >= 0, jump[jump], -1)
        step *= 2
    return np.argsort(rank, kind="stable")


CORE = LENGTH - 2 * WINDOW - GRAM + 2
LISTS = {"h1": "long", "h2": "long", "pos": "int", "before": "long", "lf": "int", "size": "int", "block": "long", "depth": "int"}
DONE = {"done_h1": "long", "done_h2": "long", "done_pos": "int"}
BWT = "shard int, " + ", ".join(f"{k} array<{t}>" for k, t in (LISTS | DONE).items()) + ", open long"


def _state(shard: int, c: dict[str, np.ndarray]) -> pa.Table:
    """One row: the part of a shard's transform that refinement still needs.

    Those are the open rows (in an interval of less than ``CORE`` bytes) and the
    ones that lead to an open row.  Others leave; the ones that are in an interval
    of ``CORE`` bytes are listed as done.
    """
    live, lf = c["block"] != 0, c["lf"]
    still = live & (c["depth"] < CORE)
    need = still | (live & (lf >= 0) & still[np.maximum(lf, 0)]) if len(lf) else still
    done = live & ~need
    place = np.cumsum(need) - 1
    kept = {k: v[need] for k, v in c.items()}
    target = np.maximum(kept["lf"], 0)
    kept["lf"] = np.where((kept["lf"] >= 0) & need[target], place[target], -1) if len(target) else target
    kept |= {f"done_{k}": c[k][done] for k in ("h1", "h2", "pos")}
    types = {"int": pa.int32(), "long": pa.int64()}
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(kept[k])], pa.int32()), pa.array(kept[k], types[t])) for k, t in (LISTS | DONE).items()}
    return pa.table({"shard": pa.array([shard], pa.int32()), **lists, "open": pa.array([int(still.sum())], pa.int64())})


def _empty_state() -> pa.Table:
    return _state(0, {k: np.zeros(0, np.int64) for k in LISTS}).slice(0, 0)


def _transform(table: pa.Table, back: pa.Table) -> pa.Table:
    """The shard's transform over phrases that occur anywhere else; all others end a suffix."""
    if not table.num_rows or not back.num_rows:
        return _empty_state()
    shard = table.column("shard")[0].as_py()
    table = _texts_once(table)
    sizes = np.diff(table.column("sym").combine_chunks().offsets.to_numpy())
    sym, pos = _flat(table, "sym"), _flat(table, "pos")
    text = np.repeat(np.arange(len(sizes)), sizes)
    known = back.column("sym").to_numpy()
    order = np.argsort(known)
    known, ids = known[order], back.column("id").to_numpy()[order]
    at = np.minimum(np.searchsorted(known, sym), len(known) - 1)
    kept = np.flatnonzero(known[at] == sym)
    size = np.zeros(len(sym), np.int64)
    same = np.flatnonzero(text[1:] == text[:-1])
    size[same] = pos[same + 1] - pos[same]
    joined = (np.diff(kept, append=-1) == 1) & (text[kept] == np.append(text[kept][1:], -1)) if len(kept) else np.zeros(0, bool)
    nxt = np.where(joined, np.arange(len(kept)) + 1, -1)
    rows = _sorted_suffixes(sym[kept], nxt)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    preceded = np.zeros(len(rows), bool)
    preceded[nxt[nxt >= 0]] = True
    has = preceded[rows]
    prev = np.maximum(rows - 1, 0)
    h1, h2 = table.column("h1").to_numpy()[text[kept]], table.column("h2").to_numpy()[text[kept]]
    return _state(
        shard,
        {
            "h1": h1[rows],
            "h2": h2[rows],
            "pos": pos[kept][rows],
            "before": np.where(has, sym[kept][prev], 0),
            "lf": np.where(has, place[prev], -1),
            "size": np.where(has, size[kept][prev], 0),
            "block": ids[at[kept]][rows],
            "depth": size[kept][rows],
        },
    )


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {k: _flat(table, k) for k in LISTS}


def _sending(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows in an interval whose preceding suffix is still refined."""
    rows = np.flatnonzero((c["block"] != 0) & (c["lf"] >= 0))
    target = c["lf"][rows]
    return rows[(c["block"][target] != 0) & (c["depth"][target] < CORE)]


def _runs(batches):
    """Run lengths of (symbol before, interval) of each shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            table = pa.Table.from_batches([batch.slice(i, 1)])
            c = _columns(table)
            rows = _sending(c)
            sym, block = c["before"][rows], c["block"][rows]
            order = np.lexsort((block, sym))
            sym, block = sym[order], block[order]
            new = np.ones(len(sym), bool)
            new[1:] = (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            shard = np.full(len(at), table.column("shard")[0].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(sym[at]), pa.array(block[at]), pa.array(np.diff(np.append(at, len(sym))))], names=["shard", "sym", "block", "n"])


def _refine(table: pa.Table, back: pa.Table) -> pa.Table:
    """Rows of a shard in their intervals one symbol deeper; suffixes that are alone leave."""
    if not table.num_rows:
        return _empty_state()
    c = _columns(table)
    rows = _sending(c)
    target = c["lf"][rows]
    block, depth = c["block"].copy(), c["depth"].copy()
    refined = (block != 0) & (depth < CORE)
    block[refined] = 0
    if back.num_rows and len(rows):
        sym, old, ids = (back.column(k).to_numpy() for k in ("sym", "block", "id"))
        order = np.lexsort((np.append(old, c["block"][rows]), np.append(sym, c["before"][rows])))
        all_sym, all_old = np.append(sym, c["before"][rows])[order], np.append(old, c["block"][rows])[order]
        all_id = np.append(ids, np.zeros(len(rows), np.int64))[order]
        new = np.ones(len(order), bool)
        new[1:] = (all_sym[1:] != all_sym[:-1]) | (all_old[1:] != all_old[:-1])
        group = np.cumsum(new) - 1
        # a group has one answer at most; 0 where it has none
        answer = np.zeros(group[-1] + 1, np.int64)
        answered = order < len(sym)
        answer[group[answered]] = all_id[answered]
        found = np.empty(len(order), np.int64)
        found[order] = answer[group]
        block[target] = found[len(sym) :]
    depth[target] = c["size"][rows] + c["depth"][rows]
    c["block"], c["depth"] = block, depth
    return _state(table.column("shard")[0].as_py(), c)


def _merged(runs: DataFrame) -> DataFrame:
    """Intervals that hold several suffixes: (shard, sym, block, id) to every shard that has a part in them."""
    whole = Window.partitionBy("sym", "block")
    ids = F.xxhash64("sym", "block")
    some = runs.withColumn("total", F.sum("n").over(whole)).filter("total > 1")
    return some.select("shard", "sym", "block", F.when(ids == 0, F.lit(1)).otherwise(ids).alias("id"))


def repeated_anchors(phrases: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, pos array): anchors whose following phrases, ``CORE`` bytes or more, occur elsewhere too."""
    dealt = phrases.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    runs = dealt.groupBy("shard").applyInArrow(_first_runs, "shard int, sym long, block long, n long")
    state = written(dealt.groupBy("shard").cogroup(_merged(runs).groupBy("shard")).applyInArrow(_transform, BWT), "bwt")
    done = [state.select(F.arrays_zip(*DONE).alias("x"))]
    for _ in range(MAX_ROUNDS):
        if not (state.agg(F.sum("open")).first()[0] or 0):
            break
        state = state.drop(*DONE)
        back = _merged(state.mapInArrow(_runs, "shard int, sym long, block long, n long"))
        state = written(state.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_refine, BWT), "bwt")
        done.append(state.select(F.arrays_zip(*DONE).alias("x")))
    left = state.select(F.arrays_zip("h1", "h2", "pos").alias("x")).toDF("x")
    parts = [d.select(F.explode("x").alias("x")).select("x.done_h1", "x.done_h2", "x.done_pos").toDF("h1", "h2", "pos") for d in done]
    parts.append(left.select(F.explode("x").alias("x")).select("x.h1", "x.h2", "x.pos"))
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("h1", "h2").agg(F.collect_list("pos").alias("pos"))


# -- exact check ---------------------------------------------------------------


def _digest(data: bytes, a: int, b: int) -> bytes:
    return hashlib.blake2b(data[a:b], digest_size=16).digest()


def _ranges(level: int):
    """Digests of ranges of starts: (h1, h2, anchor, from, to, shared, whole).

    Starts are counted back from the anchor, so equal surroundings give equal ranges.
    ``from`` and ``to`` bound the starts that belong to the anchor.  Of single
    starts ``shared`` and ``whole`` are the same.
    """
    width = RANGES[level]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            if level == 0:
                wanted = [sorted(x) for x in batch.column("pos").to_pylist()]
                all_rows = anchors(data, offsets)
                edge = np.searchsorted(all_rows[0], np.arange(batch.num_rows + 1))
            else:
                wanted = batch.column("part").to_pylist()
            out: list[tuple] = []
            h1s, h2s = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            raw = data.tobytes()
            for i in range(batch.num_rows):
                base, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                last = size - LENGTH
                if level == 0:
                    own = all_rows[1][edge[i] : edge[i + 1]]
                    first = all_rows[2][edge[i] : edge[i + 1]]
                    final = np.append(first[1:] - 1, last)
                    spots = np.searchsorted(own, np.array(wanted[i], np.int64))
                    parts = [(int(own[s]), int(own[s]) - width + 1, int(first[s]), min(int(final[s]), last)) for s in spots]
                else:
                    parts = []
                    for p in wanted[i]:
                        for start in range(p["a"], p["a"] + RANGES[level - 1], width):
                            lo, hi = max(p["lo"], start), min(p["hi"], start + width - 1)
                            if lo <= hi:
                                parts.append((p["anchor"], start, lo, hi))
                for anchor, a, lo, hi in parts:
                    if lo > hi:
                        continue
                    shared = _digest(raw, base + a + width - 1, base + a + LENGTH)
                    whole = shared if width == 1 else _digest(raw, base + a, base + a + width - 1 + LENGTH) if a >= 0 and a + width - 1 <= last else None
                    out.append((h1s[i], h2s[i], anchor, a, lo, hi, shared, whole))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h1", "h2", "anchor", "a", "lo", "hi", "shared", "whole"])

    return run


RANGE = "h1 long, h2 long, anchor int, a int, lo int, hi int, shared binary, whole binary"


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(h1, h2, first, last): byte ranges covered by repeated strings, of ``texts`` (h1, h2, text, pos).

    Each level is written, used and removed before the next but one begins.
    """
    source, spans = texts, None
    for level in range(len(RANGES)):
        ranges = written(source.mapInArrow(_ranges(level), RANGE), "ranges")
        if source is not texts:
            drop(source)
        alone = F.concat_ws(":", "h1", "h2", "anchor", "a").cast("binary")
        kinds = ranges.select("shared", F.coalesce("whole", alone).alias("whole"), "whole", F.struct("h1", "h2", "anchor", "a", "lo", "hi").alias("at")).toDF("shared", "kind", "whole", "at")
        kinds = kinds.groupBy("shared", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.count("whole").alias("known"))
        kinds = written(kinds, "range-kinds")
        twice = kinds.filter("n > 1 and known > 0").select(F.col("kind").alias("whole"))
        sure = ranges.join(twice, "whole").select("h1", "h2", F.greatest("a", F.lit(0)).alias("first"), (F.col("a") + RANGES[level] - 1 + LENGTH).alias("last"))
        sure = written(sure, "spans")
        drop(ranges)
        spans = sure if spans is None else spans.unionByName(sure)
        if level + 1 == len(RANGES):
            drop(kinds)
            break
        several = kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("shared")
        parts = kinds.join(several, "shared", "left_semi").groupBy("at.h1", "at.h2").agg(F.collect_list("at").alias("part"))
        source = written(texts.select("h1", "h2", "text").join(parts, ["h1", "h2"]), "range-texts")
        drop(kinds)
    return spans


def _merge_spans(spans: DataFrame) -> DataFrame:
    """Per text its maximal runs: (h1, h2, runs)."""
    text = Window.partitionBy("h1", "h2").orderBy("first", "last")
    reach = F.max("last").over(text.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("new", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(text)).groupBy("h1", "h2", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _cut(batches):
    """Texts without their runs: (h1, h2, n_removed, n_spans, kept)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        removed, spans, kept = [], [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            text, at, left = raw[offsets[i] : offsets[i + 1]], 0, []
            for r in runs:
                left.append(text[at : r["first"]])
                at = r["last"]
            left.append(text[at:])
            whole = b"".join(left)
            removed.append(len(text) - len(whole)), spans.append(len(runs)), kept.append(whole)
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["h1", "h2", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the
    remaining bytes where some went (NULL: the text is as it was)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), F.octet_length(text).cast("long").alias("n"))
    ident = written(named.select("doc_id", "h1", "h2", "n", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "text-names")
    key = ["h1", "h2"]
    long = ident.filter(F.col("n") >= LENGTH)
    total = long.agg(F.sum("n")).first()[0] or 0
    phrases = written(named.filter(F.col("n") >= LENGTH).select(*key, "text").mapInArrow(_phrase_rows, "h1 long, h2 long, pos array<int>, sym array<long>"), "phrases")
    wanted = written(repeated_anchors(phrases, max(1, -(-total // SHARD_BYTES))), "anchors")
    drop(phrases)
    # of equal texts the one of the smallest row is taken
    classes = written(long.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "text-classes")
    chosen = classes.join(wanted, key)
    one = named.filter(F.col("n") >= LENGTH).select("doc_id", *key, "text").alias("x")
    c = chosen.alias("c")
    match = (F.col("x.h1") == F.col("c.h1")) & (F.col("x.h2") == F.col("c.h2")) & F.col("x.doc_id").eqNullSafe(F.col("c.doc_id"))
    texts = one.join(c, match).select("x.h1", "x.h2", "x.text", "c.pos", "c.copies")
    texts = written(texts, "repeat-texts")
    runs = written(_merge_spans(repeated_spans(texts)), "runs")
    cut = texts.filter("copies = 1").select(*key, "text").join(runs, key).mapInArrow(_cut, "h1 long, h2 long, n_removed long, n_spans long, kept binary")
    cut = written(cut, "cut")
    copies = classes.filter("copies > 1").select(*key, F.lit(True).alias("again"))
    out = ident.join(cut, key, "left").join(copies, key, "left")
    again = F.coalesce("again", F.lit(False))
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(again, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, F.sha2(F.lit("").cast("binary"), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(again, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )
