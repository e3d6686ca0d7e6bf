"""Alignment of two tokenizers by diagonal run skipping.

A text is cut into tokens by a byte-level BPE (A) and by a piece model (B).  Both
give rising arrays of byte ends.  Along one index shift the arrays are compared in
windows of doubling size, so a stretch of one-to-one tokens costs a few slice
comparisons; where the ends differ, the side that is behind advances until both end
together, and the walk goes on at the new shift.  Byte offsets where both end cut
the tokens into groups; the two tokens that end there are linked.

Links are counted over the whole corpus by pair of ids; a pair is best when no other
pair of its B id has a higher count.  The table of pairs is bounded by the two
vocabularies, not by the corpus; up to ``MAX_BROADCAST_PAIRS`` it is broadcast as
sorted arrays, beyond it is joined by a shuffle, with the same result.

Tokenizer files lie on every machine below ``folder``; they are only read.

Edge cases: NULL and empty texts, and texts whose tokens do not spell blank + text
(pieces that change characters), have no tokens: all numbers 0, the digest empty;
rows that repeat are separate documents; ids may be NULL; long texts are encoded
whole, a batch holds about ``BATCH_BYTES`` of text or one longer text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovekit.session import materialize

FOLDER = "/opt/tokenizers"
# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
MAX_BROADCAST_PAIRS = 4_000_000
BATCH_BYTES = 1 << 19
#: pairs a task holds before it adds equal ones up
HELD_PAIRS = 4_000_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Both tokenizers with the bytes of every token."""

    def __init__(self, folder: str, byte_model: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        path = os.path.join(folder, byte_model)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        vocab = read["model"]["vocab"]
        letter = byte_letters()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.ranked = self._ranked(read)
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, piece_model))
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_spelled, self.b_spelled = np.array(self.a_bytes, object), np.array(self.b_bytes, object)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        most = max(len(self.a_bytes), len(self.b_bytes))
        #: every id before each separator
        self.written = np.array([f"{i}{sep}" for sep in ",|;" for i in range(most)], object)
        self.most = most

    def _ranked(self, read: dict):
        """The same vocabulary for the quicker library, where merges are ranked as their ids and words are cut by ``WORDS``."""
        import tiktoken

        pre, model = read.get("pre_tokenizer") or {}, read["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = [model["vocab"].get(x + y) for x, y in pairs]
        plain = read.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or None in ranks or ranks != list(range(256, 256 + len(ranks))):
            return None
        table = {self.a_bytes[i]: i for i in range(256 + len(ranks))}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=table, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of blank + text.  Texts beyond Latin-1 go to the file's own library, whose tables of letters may be of another year."""
        out: list = [None] * len(texts)
        rest = list(range(len(texts)))
        if self.ranked is not None:
            rest = []
            for k, text in enumerate(texts):
                try:
                    text.encode("latin-1")
                    out[k] = self.ranked.encode_to_numpy(" " + text, disallowed_special=())
                except UnicodeEncodeError:
                    rest.append(k)
        for k, found in zip(rest, self.a.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(found.ids, np.uint32)
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text; none where the joined bytes differ from blank + text."""
        a = self.encode_a(texts)
        b = [np.array(x, np.uint32) for x in self.b.encode(texts, num_threads=1)]
        nothing = np.zeros(0, np.uint32)
        for k, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or any(b"".join(spelled[x].tolist()) != want for spelled, x in zip((self.a_spelled, self.b_spelled), (a[k], b[k]))):
                a[k], b[k] = nothing, nothing
        return a, b


@functools.lru_cache(maxsize=2)
def encoder(folder: str, byte_model: str, piece_model: str) -> Encoder:
    return Encoder(folder, byte_model, piece_model)


def equal_stretches(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, length) of the stretches with a[i + k] = b[j + k]; both lists rise and end with the same value."""
    out = []
    i = j = 0
    a, b = [*a, -1], [*b, -2]  # no window is equal beyond the ends
    n = len(a) - 1
    while i < n:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: the side that is behind goes on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i0, shift = i, j - i
        i += 1
        window = 2
        # windows double while they are equal at this shift ...
        while a[i : i + window] == b[i + shift : i + shift + window]:
            i += window
            window *= 2
        # ... and halve to the first difference
        while window > 2:
            window //= 2
            if a[i : i + window] == b[i + shift : i + shift + window]:
                i += window
        j = i + shift
        if a[i] == b[j]:
            i += 1
            j += 1
        out.append((i0, i0 + shift, i - i0))
    return out


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A and of B that end together."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.array(equal_stretches(a_ends.tolist(), b_ends.tolist()), np.int64)
    length = found[:, 2]
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(found[:, 0], length) + step, np.repeat(found[:, 1], length) + step


def written_groups(coder: Encoder, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """The ids of all groups in order, as text pieces: a1,a2|b1;a3|b2,b3;"""
    size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    out = np.empty(len(a) + len(b), np.int64)
    sep_a, sep_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sep_a[at_a], sep_b[at_b] = 1, 2
    out[np.arange(len(a)) + np.repeat(at_b + 1 - size_b, size_a)] = a + sep_a * coder.most
    out[np.arange(len(b)) + np.repeat(at_a + 1, size_b)] = b + sep_b * coder.most
    return coder.written[out]


def pack(pairs: np.ndarray) -> bytes:
    """The different pairs, rising, and their counts, as compressed byte planes."""
    keys, n = np.unique(pairs, return_counts=True)
    return zlib.compress(np.concatenate((keys, n)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(different pairs, counts)"""
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return both[: len(both) // 2], both[len(both) // 2 :]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, t in enumerate(texts):
        size = len(t or "")
        if k > first and held + size > BATCH_BYTES:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def _align(coder: Encoder, texts: list[str], keep_groups: bool) -> dict[str, list]:
    ids_a, ids_b = coder.encode(texts)
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = (np.concatenate(x).astype(np.int64) for x in (ids_a, ids_b))
    # texts follow each other: every text's last ends are common
    at_a, at_b = links(np.cumsum(coder.a_size[a]), np.cumsum(coder.b_size[b]))
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    upto = np.searchsorted(at_a, last_a, side="left")
    n_links = np.diff(upto, prepend=0)
    pairs = (a[at_a] << 32) | b[at_b]
    text = written_groups(coder, a, b, at_a, at_b)
    out: dict[str, list] = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_links.tolist(), "n_links": n_links.tolist()}
    shas, packed, groups = [], [], []
    ends = last_a + last_b
    for k in range(len(texts)):
        lo, hi = (ends[k - 1] if k else 0), ends[k]
        joined = "".join(text[lo:hi].tolist())[:-1]
        shas.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        packed.append(pack(pairs[upto[k] - n_links[k] : upto[k]]))
        groups.append(joined)
    out |= {"groups_sha256": shas, "links": packed}
    return out | ({"groups": groups} if keep_groups else {})


def aligned(docs: DataFrame, folder: str = FOLDER, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, groups: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (packed id pairs with counts).

    With ``groups`` also the groups themselves, as written for the digest.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string, links binary" + ", groups string" * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(folder, byte_model, piece_model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in _batches(texts):
                out = _align(coder, [t or "" for t in texts[first:last]], groups)
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(out[c]) if c != "links" else pa.array(out[c], pa.binary()) for c in out]], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _add_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])
    keys, where = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(where, n, len(keys)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all links of ``rows``: n links hold the pair, best where n is the highest of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(unpack(data))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [_add_up(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _add_up(held)], ["pair", "n"])

    parts = rows.select("links").mapInArrow(run, "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    # one B id meets at most the vocabulary of A
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum, from the whole pair table as sorted arrays."""
    found = counts.toArrow()
    pairs, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    known = rows.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order].astype(np.int64)))
    kept = [c for c in rows.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            n_best, total = [], []
            for data in batch.column("links").to_pylist():
                mine, k = unpack(data)
                at = np.searchsorted(pairs, mine)
                n_best.append(int((k * best[at]).sum()))
                total.append(int((k * n[at]).sum()))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "links")
    return rows.mapInArrow(run, kinds + ", n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffle: one row per document and different pair meets the table."""
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "align-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, k = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), at)), pa.array(pairs), pa.array(k)], ["_at", "pair", "k"])

    held = rows.select("_at", "links").mapInArrow(run, "_at long, pair long, k long").join(counts, "pair")
    sums = held.groupBy("_at").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = rows.drop("links").join(sums, "_at", "left").drop("_at")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def score_links(rows: DataFrame, max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """``rows`` of ``aligned`` (a written table) with n_best and count_sum instead of links."""
    counts = materialize(pair_counts(rows), "align-pairs")
    return _looked_up(rows, counts) if counts.count() <= max_pairs else _joined(rows, counts)


def report(docs: DataFrame, folder: str = FOLDER, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = materialize(aligned(docs, folder, byte_model, piece_model), "align")
    return score_links(rows, max_pairs).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
