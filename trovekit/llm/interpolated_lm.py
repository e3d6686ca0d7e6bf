"""Language-model scores by deleted interpolation.

Trigram, bigram and unigram maximum-likelihood estimates and a uniform share over the
vocabulary and one unknown word are mixed with weights that depend on how often the
context was seen (one bucket for each power of two).  The weights are learned by
expectation-maximisation: part of the training documents is set aside, estimates come
from the others, and the n-gram counts of the part set aside are explained by the
mixture.  Scores then use the counts of all training documents.

How it runs: documents are cut into blocks of about ``BLOCK_BYTES``, stored as token
numbers.  A block asks for each of its different n-grams once: hashes, cut to a width
that follows the number of tokens (about one n-gram in a million shares a hash with
another), go in rising order to the buckets of the hash space, and each bucket answers
with the counts over all blocks in the same order.  So a frequent n-gram is one entry
per block, and neither the vocabulary nor a table of n-grams is ever in one place.
Only totals and the sums per context bucket reach the driver.

Edge cases: a NULL or empty text is the end token alone; a NULL id counts as the empty
text for the folds; rows that repeat stay separate; a text longer than a block goes on in the next
one with its context, cut between words; without training documents every token has
the uniform share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovekit.llm import textbatch
from trovekit.llm.common import fold
from trovekit.session import materialize, materialize_bucketed, release

ORDER = 3
BLOCK_BYTES = 8 << 20
#: bytes of a segment; longer texts have several
SEGMENT_BYTES = 1 << 20
#: entries of a hash bucket, about
BUCKET_ENTRIES = 1 << 19
#: one training document in so many is set aside for the weights
TUNE_PARTS = 20
ROUNDS = 25
#: responsibilities are added up as integers, so their sum does not depend on its order
UNIT = 1 << 20
POWERS = 40
CONTEXTS = 2 * POWERS + 1
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: numbers of a block that are added up
TOTALS = ("tokens", "n_build", "n_tune", "docs_build", "docs_tune", "asked1", "asked2", "asked3")
#: what a document is used for
SCORED, BUILD, TUNE = 0, 1, 2


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of its beginning and its last word."""
    x = (h + BEGIN) * np.uint64(0xBF58476D1CE4E5B9) + w
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _planes(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def _rising(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


# ---- blocks -----------------------------------------------------------------


def _segments(data: np.ndarray, offsets: np.ndarray, block_bytes: int, limit: int) -> Iterator[list[tuple[int, int, int, bool, bool]]]:
    """Blocks of (row, from, to, first of its row, last of its row); rows over ``limit`` are cut after a separator."""
    block, held = [], 0
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = lo
        while True:
            to = hi
            if hi - at > limit:
                gaps = np.flatnonzero(_separators(data[at : at + limit]))
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one very long word: up to its end
                    for far in range(at + limit, hi, limit):
                        gaps = np.flatnonzero(_separators(data[far : min(hi, far + limit)]))
                        if len(gaps):
                            to = far + int(gaps[0]) + 1
                            break
            if block and held + to - at > block_bytes:
                yield block
                block, held = [], 0
            block.append((row, at, to, at == lo, to == hi))
            held += to - at
            at = to
            if at >= hi:
                break
    if block:
        yield block


def _separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words in order, number of words in each segment); bounds cut the bytes into segments."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~_separators(data)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    upto = np.searchsorted(starts, bounds)
    return textbatch.run_hash(data, solid, starts, place), np.diff(upto)


def _words_of(data: np.ndarray, segments: list[tuple[int, int, int, bool, bool]]) -> Iterator[np.ndarray]:
    """The words of each segment; about ``SEGMENT_BYTES`` are worked on at once."""
    first = 0
    while first < len(segments):
        last, lo = first + 1, segments[first][1]
        while last < len(segments) and segments[last][2] - lo <= SEGMENT_BYTES:
            last += 1
        bounds = np.array([s[1] for s in segments[first:last]] + [segments[last - 1][2]]) - lo
        words, sizes = _words(data[lo : lo + int(bounds[-1])], bounds)
        yield from np.split(words, np.cumsum(sizes)[:-1])
        first = last


def _stored(sequences: list[np.ndarray]) -> tuple[bytes, bytes, list[int]]:
    """(different words rising, word numbers, lengths) of some token sequences with two words of context each."""
    lengths = [len(s) for s in sequences]
    tokens = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
    words, numbers = np.unique(tokens, return_inverse=True)
    return zlib.compress(_rising(words), 1), zlib.compress(_planes(numbers), 1), lengths




def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, part: SCORED, BUILD or TUNE).

    A row holds the segments' ids, rows, parts and lengths, the block's different
    words and its word numbers, and the same of its tuning segments alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    code = "words binary, numbers binary, lengths array<long>"
    schema = f"block long, ids array<{kind}>, rows array<long>, parts array<int>, {code}, tune struct<{code}>"
    schema += "".join(f", {c} long" for c in TOTALS)
    plain = pa.struct([("words", pa.binary()), ("numbers", pa.binary()), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        block = row = 0
        for batch in batches:
            ids, parts = batch.column(0), batch.column(2).to_numpy()
            data, offsets = textbatch.utf8(batch.column(1))
            before = np.array([BEGIN, BEGIN])
            for segments in _segments(data, offsets, block_bytes, min(block_bytes, SEGMENT_BYTES)):
                sequences = []
                for words, (_, _, _, first, last) in zip(_words_of(data, segments), segments):
                    if first:
                        before = np.array([BEGIN, BEGIN])
                    mine = np.concatenate((before, words, np.array([END] if last else [], np.uint64)))
                    before = mine[-2:]
                    sequences.append(mine)
                part = parts[[s[0] for s in segments]]
                stored = _stored(sequences)
                tuned = _stored([s for s, p in zip(sequences, part) if p == TUNE])
                entries = len(np.unique(np.concatenate(sequences))), sum(stored[2]), sum(stored[2])
                length = np.array(stored[2], np.int64) - 2
                opens = np.array([s[3] for s in segments])
                count = lambda kind, values: int(values[part == kind].sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at + block]),
                        pa.array([ids.take(pa.array([s[0] for s in segments]))], pa.list_(ids.type)),
                        pa.array([[at + row + s[0] for s in segments]]),
                        pa.array([part.tolist()], pa.list_(pa.int32())),
                        pa.array([stored[0]], pa.binary()),
                        pa.array([stored[1]], pa.binary()),
                        pa.array([stored[2]], pa.list_(pa.int64())),
                        pa.array([dict(zip(("words", "numbers", "lengths"), tuned))], plain),
                        *[pa.array([int(x)]) for x in (length.sum(), count(BUILD, length), count(TUNE, length), count(BUILD, opens), count(TUNE, opens))],
                        *[pa.array([x]) for x in entries],
                    ],
                    names,
                )
                block += 1
            row += batch.num_rows

    names = ["block", "ids", "rows", "parts", "words", "numbers", "lengths", "tune", *TOTALS]
    return docs.select("doc_id", "text", "part").mapInArrow(run, schema)


# ---- n-grams of a block ----------------------------------------------------


class Grams:
    """The n-grams that end at each token of a block, and the hashes asked for, rising.

    The two tokens before a sequence are its context: they are asked for, but not counted.
    """

    def __init__(self, words: bytes, numbers: bytes, lengths: list[int], bits: int):
        known, tokens = _from_rising(zlib.decompress(words)), _from_planes(zlib.decompress(numbers)).astype(np.int64)
        sizes = np.array(lengths, np.int64)
        firsts = np.cumsum(sizes) - sizes
        counted = np.ones(len(tokens), bool)
        counted[firsts] = counted[firsts + 1] = False
        #: places of the tokens that count
        self.real = np.flatnonzero(counted)
        hashes = known[tokens]
        #: whether the word before a counted token is the beginning
        self.opens = hashes[self.real - 1] == BEGIN
        two = np.zeros(len(tokens), np.uint64)
        two[1:] = _mixed(hashes[:-1], hashes[1:])
        two[firsts] = 0
        self.hashes, self.two, self.bits = hashes, two, bits

    def entries(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes asked for, entry of each token's n-gram); of each counted token's for trigrams."""
        grams = (self.hashes, self.two)[order - 1] if order < 3 else _mixed(self.two[self.real - 1], self.hashes[self.real])
        keys, at = np.unique(grams >> np.uint64(64 - self.bits), return_inverse=True)
        return keys, at.astype(np.int32)

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes asked for, entry of the n-gram that ends at each counted token)"""
        keys, at = self.entries(order)
        return keys, at if order == 3 else at[self.real]

    def counts(self, answers: list[np.ndarray], docs: int) -> list[np.ndarray]:
        """Per counted token: c(uvw), c(uv), c(vw), c(v), c(w); the beginning counts as often as there are documents."""
        lower = []
        for order in (1, 2):
            counts = answers[order - 1][self.entries(order)[1]]
            lower += [np.where(self.opens, docs, counts[self.real - 1]), counts[self.real]]
        v, w, uv, vw = lower
        return [answers[2][self.entries(3)[1]], uv, vw, v, w]


def _asks(stored: DataFrame, bits: int, shift: list[int]) -> DataFrame:
    """(ord, bucket, block, hashes, total, tune): what each block asks of each bucket, with its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                grams = Grams(r["words"], r["numbers"], r["lengths"], bits)
                tuned = Grams(**r["tune"], bits=bits)
                part = np.repeat(np.array(r["parts"]), np.array(r["lengths"]) - 2)
                for order in (1, 2, 3):
                    keys, at = grams.asked(order)
                    total = np.bincount(at[part != SCORED], minlength=len(keys))
                    # twice the tuning count, and one where the tuning documents ask
                    tune = 2 * np.bincount(at[part == TUNE], minlength=len(keys))
                    tune[np.searchsorted(keys, tuned.asked(order)[0])] += 1
                    bucket = keys >> np.uint64(shift[order - 1])
                    edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64((1 << 64) - 1)))
                    rows = {c: [] for c in ("ord", "bucket", "block", "hashes", "total", "tune")}
                    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
                        for c, x in zip(rows, (order, int(bucket[lo]), r["block"], _rising(keys[lo:hi]), _planes(total[lo:hi]), _planes(tune[lo:hi]))):
                            rows[c].append(x)
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    columns = stored.select("block", "words", "numbers", "lengths", "parts", "tune")
    return columns.mapInArrow(run, "ord int, bucket long, block long, hashes binary, total binary, tune binary")


def _answers(asks: DataFrame) -> DataFrame:
    """(block, ord, bucket, total, build, v_total, v_build): counts over all blocks in the order asked.

    ``total`` covers all training documents; ``build`` leaves the tuning ones out and
    has only the entries that the block's tuning documents ask for.  A row without a
    block has the number of different words of its bucket.
    """
    schema = "block long, ord int, bucket long, total binary, build binary, v_total long, v_build long"

    def run(table: pa.Table) -> pa.Table:
        asked = [_from_rising(x) for x in table.column("hashes").to_pylist()]
        total = np.concatenate([_from_planes(x) for x in table.column("total").to_pylist()])
        tunes = [_from_planes(x) for x in table.column("tune").to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        everything = np.bincount(at, total, len(keys)).astype(np.int64)
        build = everything - np.bincount(at, np.concatenate(tunes) >> np.uint64(1), len(keys)).astype(np.int64)
        order, bucket = table.column("ord")[0].as_py(), table.column("bucket")[0].as_py()
        rows, first = [], 0
        for block, mine, tune in zip(table.column("block").to_pylist(), asked, tunes):
            own = at[first : first + len(mine)]
            first += len(mine)
            rows.append((block, order, bucket, _planes(everything[own]), _planes(build[own[tune % np.uint64(2) == 1]]), None, None))
        if order == 1:
            rows.append((None, order, bucket, None, None, int((everything > 0).sum()), int((build > 0).sum())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["block", "ord", "bucket", "total", "build", "v_total", "v_build"])

    return asks.groupBy("ord", "bucket").applyInArrow(run, schema)


def _by_order(answers: pa.Table, column: str) -> list[np.ndarray]:
    """The answers of a block, one array for each order."""
    held: dict[int, list[tuple[int, bytes]]] = {1: [], 2: [], 3: []}
    for order, bucket, data in zip(answers.column("ord").to_pylist(), answers.column("bucket").to_pylist(), answers.column(column).to_pylist()):
        held[order].append((bucket, data))
    join = lambda parts: np.concatenate([_from_planes(d) for _, d in sorted(parts)]).astype(np.int64) if parts else np.zeros(0, np.int64)
    return [join(held[o]) for o in (1, 2, 3)]


# ---- mixture ----------------------------------------------------------------


def context_bucket(uv: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Power of two of the context's count: the two words' where they were seen, else the last word's, else 0."""
    power = lambda c: np.minimum(np.frexp(c.astype(np.float64))[1], POWERS)
    return np.where(uv > 0, POWERS + power(uv), power(v))


def estimates(counts: list[np.ndarray], tokens: int, vocabulary: int) -> np.ndarray:
    """Uniform, unigram, bigram and trigram estimates per token."""
    uvw, uv, vw, v, w = (c.astype(np.float64) for c in counts)
    return np.stack([np.full(len(w), 1 / (vocabulary + 1)), w / max(tokens, 1), vw / np.maximum(v, 1), uvw / np.maximum(uv, 1)], axis=1)


def first_weights() -> np.ndarray:
    """Equal shares of the estimates that a context bucket has."""
    has = np.ones((CONTEXTS, ORDER + 1))
    has[: POWERS + 1, 3] = 0
    has[0, 2] = 0
    return has / has.sum(axis=1, keepdims=True)


def better_weights(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights from added-up responsibilities, with one more token shared equally."""
    start = first_weights()
    return (sums + start) / (sums.sum(axis=1, keepdims=True) + 1)


def responsibilities(weights: np.ndarray, f: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the shares that each estimate has in the held-out tokens, by context bucket."""
    parts = weights[bucket] * f
    parts *= (times / parts.sum(axis=1))[:, None]
    return np.stack([np.bincount(bucket, parts[:, k], CONTEXTS) for k in range(parts.shape[1])], axis=1)


def _held_out(stored: DataFrame, answers: DataFrame, bits: int, docs_build: int) -> DataFrame:
    """Per block the counts of its tuning n-grams: times, c(uvw), c(uv), c(vw), c(v), c(w) in the other training documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            counts = np.stack(Grams(**r["tune"], bits=bits).counts(_by_order(right, "build"), docs_build))
            different, times = np.unique(counts, axis=1, return_counts=True)
            out.append(zlib.compress(b"".join(_sized(_planes(c)) for c in (times, *different)), 1))
        return pa.Table.from_arrays([pa.array(out, pa.binary())], ["data"])

    left = stored.filter("n_tune > 0").select("block", "tune")
    right = answers.filter("block IS NOT NULL").select("block", "ord", "bucket", "build")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, "data binary")


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + data


def _unsized(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        yield data[at + 8 : at + 8 + size]
        at += 8 + size


def learn_weights(held: DataFrame, tokens: int, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by context bucket; each round is one pass over the held-out counts."""
    weights = first_weights()
    for _ in range(rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    times, *counts = (_from_planes(x).astype(np.int64) for x in _unsized(zlib.decompress(data)))
                    bucket = context_bucket(counts[1], counts[3])
                    sums = np.rint(responsibilities(now, estimates(counts, tokens, vocabulary), bucket, times) * UNIT).astype(np.int64)
                    b, k = np.nonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(k), pa.array(sums[b, k])], ["b", "k", "units"])

        sums = np.zeros_like(weights)
        # at most CONTEXTS x (ORDER + 1) numbers
        for b, k, units in held.mapInArrow(run, "b long, k long, units long").groupBy("b", "k").agg(F.sum("units")).collect():
            sums[b, k] = units / UNIT
        weights = better_weights(now, sums)
        if np.abs(weights - now).max() < 1e-4:
            break
    return weights


# ---- scores -----------------------------------------------------------------


def _scored(stored: DataFrame, answers: DataFrame, bits: int, totals: dict, weights: np.ndarray) -> DataFrame:
    kind = stored.schema["ids"].dataType.elementType.simpleString()
    tokens, vocabulary, docs = totals["tokens"], totals["vocabulary"], totals["docs"]
    base = math.log10(tokens + vocabulary + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            sizes = np.array(r["lengths"], np.int64) - 2
            counts = Grams(r["words"], r["numbers"], r["lengths"], bits).counts(_by_order(right, "total"), docs)
            p = (weights[context_bucket(counts[1], counts[3])] * estimates(counts, tokens, vocabulary)).sum(axis=1)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            columns = [sizes]
            columns.append(textbatch.row_sums((counts[4] > 0).astype(np.float64), ends).astype(np.int64))
            for values in (np.log10(counts[4] + 1.0) - base, np.log10(p)):
                # each segment on its own, so equal texts have equal sums
                columns.append(np.array([math.fsum(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]))
            out.append(pa.Table.from_arrays([pa.array(r["rows"], pa.int64()), pa.array(r["ids"], left.schema.field("ids").type.value_type), *map(pa.array, columns)], names))
        return pa.concat_tables(out)

    names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"]
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    left = stored.select("block", "rows", "ids", "words", "numbers", "lengths")
    right = answers.filter("block IS NOT NULL").select("block", "ord", "bucket", "total")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, training: Column, tune_parts: int = TUNE_PARTS, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Scores of all ``docs`` (doc_id, text) under a model of those where ``training`` holds, and the weights.

    Per row: doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram) and
    score, both log10 probabilities of the text with its end.
    """
    tuned = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("tune")), F.lit(tune_parts)) == 0
    part = F.when(~F.coalesce(training, F.lit(False)), SCORED).when(tuned, TUNE).otherwise(BUILD).cast("int")
    # the blocks are read where they lie; only questions and answers move
    stored = materialize_bucketed(blocks(docs.select("doc_id", "text", part.alias("part")), block_bytes), "block", "lm-blocks")
    sums = {c: x or 0 for c, x in zip(TOTALS, stored.agg(*[F.sum(c) for c in TOTALS]).first())}
    bits = min(64, 8 * math.ceil((max(1, sums["tokens"]).bit_length() + 20) / 8))
    shift = [bits - max(0, math.ceil(sums[f"asked{o}"] / bucket_entries) - 1).bit_length() for o in (1, 2, 3)]
    answers = materialize(_answers(_asks(stored, bits, shift)), "lm-answers")
    seen = answers.filter("block IS NULL").agg(F.sum("v_total"), F.sum("v_build")).first()
    v_total, v_build = (x or 0 for x in seen)
    held = materialize(_held_out(stored, answers, bits, sums["docs_build"]), "lm-held")
    weights = learn_weights(held, sums["n_build"], v_build, rounds)
    release(held)
    n = sums["n_build"] + sums["n_tune"]
    totals = {"tokens": n, "vocabulary": v_total, "docs": sums["docs_build"] + sums["docs_tune"]}
    pieces = _scored(stored, answers, bits, totals, weights)
    out = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"), weights


def report(docs: DataFrame, parts: int = 7, left_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    training = fold("doc_id", parts) != left_out
    scores, _ = score(docs, training)
    return scores.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
