"""Beam search over the codes that exist in a pool."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovekit import constants as K
from trovekit.functions.vectors import normalize
from trovekit.operators.blocks import _matrix
from trovekit.operators.quantize import BROADCAST_BYTES, codebook_levels, met_by_group, slices_of, stream_slices
from trovekit.operators.skew import lookup_join, skew_join
from trovekit.session import materialize

DIGITS = 6
CHECKPOINT_LEVELS = 3
#: queries whose beams lie together where centroids are streamed
GROUP_QUERIES = 2_048


def _cut(candidates: DataFrame, beams: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", DIGITS)), "prefix")
    return candidates.withColumn("beam_rank", F.row_number().over(best)).where(F.col("beam_rank") <= beams)


def _prefix_matrix(column: pa.Array) -> np.ndarray:
    """Prefixes of one level, all equally long, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("i8")
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _residuals(unit: np.ndarray, prefix: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the centroids of a prefix leave of the query vector."""
    rest = unit.copy()
    for level in range(prefix.shape[1]):
        names, book = books[level]
        rest -= book[np.searchsorted(names, prefix[:, level])]
    return rest


def _score_children(expanded: DataFrame, books: list[tuple[np.ndarray, np.ndarray]], level: int, beams: int) -> DataFrame:
    """Score all allowed next tokens of each beam, keep those that can be among the best.

    The centroids of all levels travel with the tasks, so a beam's residual is
    computed from the query vector where it is needed and never shuffled.  A
    beam keeps its ``beams`` best children and all within rounding of the last of
    them; the rounded order, decided in one place, is that of ``_cut``.
    """
    shared = expanded.sparkSession.sparkContext.broadcast(books)
    schema = "qid string, prefix array<int>, score double"

    def run(batches):
        names, book = shared.value[level]
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = _prefix_matrix(batch.column("prefix"))
            rest = _residuals(_matrix(batch.column("unit"), "<f8"), prefix, shared.value)
            scores = batch.column("score").to_numpy()
            lists = batch.column("nexts")
            ends = lists.offsets.to_numpy()
            tokens = lists.values.to_numpy()
            # beams with one prefix share their options: one matrix product each
            order = np.lexsort(prefix.T[::-1]) if level else np.arange(len(prefix))
            changed = np.flatnonzero((prefix[order][1:] != prefix[order][:-1]).any(axis=1)) + 1 if level else []
            take, kids, total = [], [], []
            for members in np.split(order, changed):
                first = members[0]
                options = tokens[ends[first] : ends[first + 1]]
                row = np.minimum(np.searchsorted(names, options), len(names) - 1)
                known = names[row] == options  # a token without a centroid cannot be chosen
                options, centroids = options[known], book[row[known]]
                n = len(options)
                if not n:
                    continue
                r = rest[members]
                rough = (r * r).sum(1)[:, None] - 2 * (r @ centroids.T) + (centroids * centroids).sum(1)[None, :]
                cut = np.partition(rough, beams - 1, axis=1)[:, beams - 1 : beams] if n > beams else rough.max(1, keepdims=True)
                i, j = np.nonzero(rough <= cut + 2 * 10.0**-DIGITS)
                exact = np.concatenate([((r[i[x : x + 65_536]] - centroids[j[x : x + 65_536]]) ** 2).sum(1) for x in range(0, len(i), 65_536)])
                take.append(members[i])
                kids.append(options[j])
                total.append(scores[members[i]] - exact)
            if not take:
                continue
            take, kids, total = np.concatenate(take), np.concatenate(kids), np.concatenate(total)
            codes = np.column_stack([prefix[take], kids]).astype("i4")
            offsets = pa.array(np.arange(0, codes.size + 1, level + 1, dtype="i4"))
            yield pa.record_batch(
                [batch.column("qid").take(pa.array(take)), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(total)],
                names=["qid", "prefix", "score"],
            )

    return expanded.select("qid", "prefix", "score", "unit", "nexts").mapInArrow(run, schema)


class _Beams:
    """Queries of a group with their open beams; centroids pass by level after level.

    Slices of the levels before take away what a beam's prefix has explained; those of
    ``level`` score the allowed next tokens.
    """

    def __init__(self, level: int, beams: int):
        self.level, self.beams = level, beams
        self.units: dict[str, np.ndarray] = {}
        self.rows: list[tuple[str, tuple[int, ...], float, list[int]]] = []
        self.rest, self.found = None, []

    def add(self, batch):
        for qid, unit, prefix, score, nexts in zip(*(batch.column(c).to_pylist() for c in ("qid", "unit", "prefix", "score", "nexts"))):
            if unit is not None:
                self.units[qid] = np.array(unit)
            else:
                self.rows.append((qid, tuple(prefix), score, nexts))

    def slice(self, level, codes, centroids):
        if not self.rows or level > self.level:
            return
        if self.rest is None:
            self.rest = np.stack([self.units[r[0]] for r in self.rows])
            self.beam = np.repeat(np.arange(len(self.rows)), [len(r[3]) for r in self.rows])
            self.token = np.array([t for r in self.rows for t in r[3]], np.int64)
        wanted = self.token if level == self.level else np.array([r[1][level] for r in self.rows])
        row = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        here = np.flatnonzero(codes[row] == wanted)
        if level < self.level:
            self.rest[here] -= centroids[row[here]]
            return
        score = np.array([r[2] for r in self.rows])
        for a in range(0, len(here), 65_536):
            part = here[a : a + 65_536]
            away = ((self.rest[self.beam[part]] - centroids[row[part]]) ** 2).sum(1)
            self.found.append((self.beam[part], self.token[part], score[self.beam[part]] - away))

    def end(self):
        if not self.found:
            return
        beam, token, score = (np.concatenate(x) for x in zip(*self.found))
        names = sorted({r[0] for r in self.rows})
        query = np.searchsorted(names, [r[0] for r in self.rows])[beam]
        _, place = np.unique([r[1] for r in self.rows], axis=0, return_inverse=True) if self.level else (None, np.zeros(len(self.rows), int))
        order = np.lexsort((token, np.ravel(place)[beam], -np.round(score, DIGITS), query))
        q = query[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < self.beams]
        qids = [self.rows[i][0] for i in beam[order]]
        prefixes = [[*self.rows[i][1], int(t)] for i, t in zip(beam[order], token[order])]
        yield pa.record_batch(
            [pa.array(qids, pa.string()), pa.array(prefixes, pa.list_(pa.int32())), pa.array(score[order])], names=["qid", "prefix", "score"]
        )


def _score_streamed(expanded: DataFrame, units: DataFrame, codebooks: DataFrame, level: int, beams: int, group_rows: int) -> DataFrame:
    """The best ``beams`` extensions per query, for codebooks too large to send.

    A query's vector and its beams lie in one group; what a prefix leaves of the vector
    is computed there from the slices that pass, and never shuffled.
    """
    groups = max(1, -(-units.count() // group_rows))
    grp = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("grp")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = units.select(grp, "qid", "unit", null("array<int>", "prefix"), null("double", "score"), null("array<int>", "nexts"))
    rows = rows.unionByName(expanded.select(grp, "qid", null("array<double>", "unit"), "prefix", "score", "nexts"))
    slices = stream_slices(codebooks.where(F.col("level") <= level), groups)
    met = met_by_group(rows, slices, groups, ["qid", "unit", "prefix", "score", "nexts"])
    return met.mapInArrow(lambda batches: slices_of(batches, lambda: _Beams(level, beams)), "qid string, prefix array<int>, score double")


class _Tree:
    """Prefix index as arrays: per level the children of its prefixes, in the order of the prefixes."""

    def __init__(self, rows: list[tuple[tuple[int, ...], list[int]]], levels: int):
        #: per level: first child of each open prefix (and the end), the children's tokens, their place among the open prefixes of the next level or -1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_level: list[dict[tuple[int, ...], list[int]]] = [{} for _ in range(levels + 1)]
        for prefix, nexts in rows:
            if len(prefix) < levels:
                by_level[len(prefix)][prefix] = nexts
        for level in range(levels):
            open_, below = sorted(by_level[level]), {p: i for i, p in enumerate(sorted(by_level[level + 1]))}
            sizes = [len(by_level[level][p]) for p in open_]
            tokens = [t for p in open_ for t in by_level[level][p]]
            place = [below.get((*p, t), -1) for p in open_ for t in by_level[level][p]]
            self.levels.append((np.cumsum([0, *sizes]), np.array(tokens, np.int64), np.array(place, np.int64)))


#: scores of one block of a search in the tasks
BLOCK_SCORES = 1 << 22


def _search_block(unit: np.ndarray, tree: _Tree, books: list[tuple[np.ndarray, np.ndarray]], beams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, score) of the best ``beams`` codes of each query, best first."""
    query, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    score, rest, codes = np.zeros(len(unit)), unit.copy(), np.zeros((len(unit), 0), np.int64)
    for level, (first, tokens, place) in enumerate(tree.levels):
        names, book = books[level]
        live = node >= 0
        query, node, score, rest, codes = query[live], node[live], score[live], rest[live], codes[live]
        if not len(first) - 1:
            query, node, score, rest, codes = (x[:0] for x in (query, node, score, rest, codes))
        row = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        known = names[row] == tokens  # a token without a centroid cannot be chosen
        take, kid, total, distance = [], [], [], []
        sizes = first[node + 1] - first[node] if len(node) else np.zeros(0, np.int64)
        # beams are worked on in runs that have a bounded number of options
        run = np.cumsum(sizes) // max(1, BLOCK_SCORES // max(1, unit.shape[1]))
        for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(run)) + 1) if len(node) else []:
            beam = np.repeat(part, sizes[part])
            child = np.arange(len(beam)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]) + np.repeat(first[node[part]], sizes[part])
            keep = known[child]
            beam, child = beam[keep], child[keep]
            if len(book) * len(part) < len(beam) * 8:  # many options each: one product for all
                options = book[row[child]]
                r = rest[part]
                rough = (r * r).sum(1)[:, None] - 2 * (r @ book.T) + (book * book).sum(1)[None, :]
                near = score[beam] - rough[np.searchsorted(part, beam), row[child]]
                keep = _among_best(query[beam], near, beams, 10.0**-DIGITS)
                beam, child = beam[keep], child[keep]
            options = book[row[child]]
            take.append(beam)
            kid.append(child)
            total.append(score[beam] - ((rest[beam] - options) ** 2).sum(1))
        if not take or not sum(map(len, take)):
            return np.zeros(0, np.int64), np.zeros((0, len(tree.levels)), np.int64), np.zeros(0)
        take, kid, total = np.concatenate(take), np.concatenate(kid), np.concatenate(total)
        # children are numbered in the order of their prefixes
        order = np.lexsort((kid, -np.round(total, DIGITS), query[take]))
        q = query[take][order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < beams]
        take, kid, score = take[order], kid[order], total[order]
        query, node = query[take], place[kid] if level + 1 < len(tree.levels) else kid
        codes = np.column_stack([codes[take], tokens[kid]])
        rest = rest[take] - book[row[kid]]
    return query, codes, score


def _among_best(query: np.ndarray, score: np.ndarray, beams: int, margin: float) -> np.ndarray:
    """Rows that can be among the best ``beams`` of their query, scores being off by less than ``margin``."""
    order = np.lexsort((-score, query))
    q = query[order]
    start = np.searchsorted(q, q, side="left")
    last = np.minimum(start + beams - 1, np.searchsorted(q, q, side="right") - 1)
    out = np.empty(len(score), bool)
    out[order] = score[order] >= score[order][last] - 2 * margin
    return out


def _search_in_tasks(queries: DataFrame, vector: str, tree: _Tree, books: list[tuple[np.ndarray, np.ndarray]], beams: int, levels: int) -> DataFrame:
    """The whole search of a query in one task, with the index and the codebooks sent to it."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, books))
    rows = queries.select(F.col("qid").cast("string").alias("qid"), normalize(vector).alias("unit"))

    def run(batches):
        tree, books = shared.value
        for batch in batches:
            step = max(1, BLOCK_SCORES // max(1, beams * len(books[0][1][0]) if len(books[0][1]) else 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                query, codes, score = _search_block(_matrix(part.column("unit"), "<f8"), tree, books, beams)
                if not len(query):
                    continue
                rank = np.arange(len(query)) - np.searchsorted(query, query, side="left") + 1
                offsets = pa.array(np.arange(0, codes.size + 1, levels, dtype="i4"))
                code = pa.ListArray.from_arrays(offsets, pa.array(codes.astype("i4").ravel()))
                columns = [part.column("qid").take(pa.array(query)), pa.array(rank.astype("i4")), code, pa.array(np.round(score, DIGITS) + 0.0)]
                yield pa.record_batch(columns, names=["qid", "beam_rank", "code", "score"])

    return rows.mapInArrow(run, "qid string, beam_rank int, code array<int>, score double")


def index_bytes(index: DataFrame) -> int:
    """Size of a prefix index as the arrays a search in the tasks needs."""
    row = index.agg(F.sum(F.size("nexts").cast("long") * 16 + 8)).first()
    return int(row[0] or 0)


def beam_search(
    queries: DataFrame,
    index: DataFrame,
    codebooks: DataFrame,
    beams: int = K.BEAMS,
    levels: int = K.CODE_LEVELS + 1,
    vector: str = "embedding",
    limit: int = BROADCAST_BYTES,
    checkpoint_levels: int = CHECKPOINT_LEVELS,
    group_rows: int = GROUP_QUERIES,
) -> DataFrame:
    """(qid, beam_rank, code, score): best ``beams`` existing codes per query.

    A step scores the next token by the negative squared distance between the
    residual and its centroid.  Only prefixes of the index are followed; a
    query gets fewer codes when fewer exist.  Scores tie on six digits and go
    to the smaller prefix.  Where the index and the codebooks are each within
    ``limit`` bytes they travel with the tasks and nothing is shuffled.  Beyond that
    the index is written once and each level reads its own part of it.
    """
    if 0 < levels and index_bytes(index) <= limit and (sent := codebook_levels(codebooks, limit)):
        found = index.where(F.size("prefix") < levels).select("prefix", "nexts").toArrow()
        rows = [(tuple(p), n) for p, n in zip(found.column("prefix").to_pylist(), found.column("nexts").to_pylist())]
        return _search_in_tasks(queries, vector, _Tree(rows, levels), sent, beams, levels)
    units = materialize(queries.select(F.col("qid").cast("string").alias("qid"), normalize(vector).alias("unit")), "units")
    books = codebook_levels(codebooks, limit)
    by_level = materialize(index.select("prefix", "nexts", F.size("prefix").alias("__level")), "index")
    state = units.select("qid", F.array().cast("array<int>").alias("prefix"), F.lit(0.0).alias("score"))
    for level in range(levels):
        children = by_level.where(F.col("__level") == level).select("prefix", "nexts")
        # One row per prefix on the right, its children in an array.  The first
        # levels have few prefixes, so their side is measured small and sent to
        # the beams; later levels have many prefixes with few beams each.
        expanded = lookup_join(state, children, "prefix")
        if books is not None:
            state = _cut(_score_children(lookup_join(expanded, units, "qid"), books, level, beams), beams).drop("beam_rank")
        else:
            state = _score_streamed(expanded, units, codebooks, level, beams, group_rows)
        if level + 1 < levels and (level + 1) % checkpoint_levels == 0:
            state = materialize(state, "beams")
    ranked = _cut(state, beams)
    return ranked.select("qid", "beam_rank", F.col("prefix").alias("code"), F.round("score", DIGITS).alias("score"))


def beam_search_scored(
    queries: DataFrame,
    index: DataFrame,
    scorer: DataFrame | Callable[[DataFrame, int], DataFrame],
    beams: int,
    levels: int,
    checkpoint_levels: int = CHECKPOINT_LEVELS,
) -> DataFrame:
    """Beam search with a user's token scores.

    ``scorer`` is a table (qid, level, next, logp), optionally with ``prefix``,
    or a callable ``(beams, level) -> table`` that scores the open beams.
    Tokens without a score cannot be chosen.
    """
    state = queries.select("qid", F.array().cast("array<int>").alias("prefix"), F.lit(0.0).alias("score"))
    for level in range(levels):
        children = index.where(F.size("prefix") == level).select("prefix", F.explode("nexts").alias("next"))
        table = scorer(state, level) if callable(scorer) else scorer.where(F.col("level") == level).drop("level")
        on = ["qid", "next"] + (["prefix"] if "prefix" in table.columns else [])
        options = skew_join(state, children, "prefix", spread_by=["qid"]).join(table, on)
        state = _cut(
            options.select(
                "qid", F.concat("prefix", F.array("next")).alias("prefix"), (F.col("score") + F.col("logp")).alias("score")
            ),
            beams,
        )
        if level + 1 < levels:
            state = state.drop("beam_rank")
            if (level + 1) % checkpoint_levels == 0:
                state = materialize(state, "beams")
    return state.select("qid", "beam_rank", F.col("prefix").alias("code"), F.round("score", DIGITS).alias("score"))
