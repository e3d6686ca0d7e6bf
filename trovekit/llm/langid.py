"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters; everything else is a blank.  N-grams of one to
three characters that hold no inner blank are hashed into buckets.  Training adds
up a (language, bucket) table in the tasks; the log-probability matrix, whose size
is languages x buckets, is broadcast, and a batch is scored as the sparse product
of its bucket counts with that matrix: rows of the matrix are gathered for the
n-grams that occur and added up per text.

Training reads at most ``per_language`` rows of each language, chosen by a hash of
the id; all other work covers every row and whole texts.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0; NULL
languages are not learned from; without any labelled row everything is ``und``;
equal scores go to the language that sorts first; very long texts are scored in
pieces whose sums are added; more than ``MAX_LANGUAGES`` labels fail the job, as they
are no languages; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.llm.textbatch import PIECE_BYTES, codepoints, pieces, utf8

BUCKETS = 1 << 16
MAX_LANGUAGES = 1024
#: how far a text's mean log-probability per n-gram may lie under what its language
#: makes one expect, and how much further a text of one n-gram may; the latter falls
#: with the root of the number of n-grams
MARGIN, SHORT_MARGIN = 3.0, 8.0
PER_LANGUAGE = 5000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: (buckets + 1, languages); the last row, for positions without an n-gram, is zero
    log_prob: np.ndarray
    prior: np.ndarray
    #: expected log-probability of an n-gram of each language
    expected: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case form of each character of the basic plane, a blank where it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _fold(chars: np.ndarray) -> np.ndarray:
    high = chars >> 16 != 0
    out = _letters()[np.where(high, 32, chars)]
    if high.any():
        known = {int(c): int(c) if chr(int(c)).isalpha() else 32 for c in np.unique(chars[high])}
        out[high] = [known[int(c)] for c in chars[high]]
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each position for n = 1, 2, 3; offsets of the rows; rows that hold a letter.

    A blank stands before each row and after the last, so no n-gram joins two rows.
    """
    chars, at = codepoints(data, offsets)
    n = len(at) - 1
    c = np.full(len(chars) + n + 3, 32, np.uint32)
    rows = at + np.arange(n + 1)
    spots = np.ones(len(chars) + n, bool)
    spots[rows[:-1]] = False
    c[: len(chars) + n][spots] = _fold(chars)
    m = len(chars) + n
    a, b, d = c[:m], c[1 : m + 1], c[2 : m + 2]
    letter_a, letter_b = a != 32, b != 32
    shift = np.uint32(16)
    h1 = a * np.uint32(0x9E3779B1)
    h2 = (h1 ^ (h1 >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35)
    h3 = (h2 ^ (h2 >> np.uint32(13))) * np.uint32(0x27D4EB2F) + d * np.uint32(0x165667B1)
    none = np.uint32(BUCKETS)
    grams = [
        np.where(letter_a, (h1 ^ (h1 >> np.uint32(7))) >> shift, none),
        np.where(letter_a | letter_b, (h2 ^ (h2 >> np.uint32(7))) >> shift, none),
        np.where(letter_b, (h3 ^ (h3 >> np.uint32(7))) >> shift, none),
    ]
    total = np.concatenate(([0], np.cumsum(letter_a)))
    return grams, rows, total[rows[1:]] > total[rows[:-1]]


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS + 1), np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for rows, data, offsets in pieces(*utf8(batch.column("text"))):
                grams, at, _ = _grams(data, offsets)
                of = np.repeat(lang[rows] * (BUCKETS + 1), np.diff(at))
                for g in grams:
                    counts += np.bincount(of + g, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"]
        )

    return run


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang)."""
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), np.zeros(0))
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(million, million * per_language // n + 1))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language")), F.lit(million))
    sample = rows.filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    sums = sample.mapInArrow(_count(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    smooth = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    log_prob = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    log_prob[:BUCKETS] = smooth.T
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, log_prob, np.log(prior / prior.sum()), (np.exp(smooth) * smooth).sum(axis=1))


def score_texts(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and likeness of each text of an Arrow column.

    The posterior of a long text is near one whatever it holds.  The likeness does not
    grow with the length: the mean log-probability per n-gram less what the language
    makes one expect, with the allowance of a text of its length.
    """
    n, k = len(column), len(model.languages)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), np.full(n, -np.inf)
    total, seen, held = np.zeros((n, k)), np.zeros(n, bool), np.zeros(n)
    for rows, data, offsets in pieces(*utf8(column), limit=max(4096, PIECE_BYTES * 4 // max(4, k))):
        grams, at, letters = _grams(data, offsets)
        values = model.log_prob[grams[0]]
        for g in grams[1:]:
            values += model.log_prob[g]
        total[rows] += np.add.reduceat(values, at[:-1], axis=0, dtype=np.float64)
        seen[rows] |= letters
        for g in grams:
            held[rows] += np.add.reduceat(g != BUCKETS, at[:-1], dtype=np.int64)
    fit = total / np.maximum(held, 1)[:, None] - model.expected
    total += model.prior
    best = total.argmax(axis=1)
    share = 1.0 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
    names = np.array(model.languages, object)[best]
    likeness = np.where(seen, fit[np.arange(n), best] + SHORT_MARGIN / np.sqrt(np.maximum(held, 1)), -np.inf)
    return [x if s else UNKNOWN for x, s in zip(names, seen)], np.where(seen, np.clip(share, 0, 1), 0.0), likeness


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score, _ = score_texts(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` in a learned language; all columns stay.

    The posterior must be ``least`` or more and the text as likely as texts of that
    language are, so letter junk and other scripts go however long they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names, score, likeness = score_texts(batch.column(at), shared.value)
            ok = [x != UNKNOWN and s >= least and f >= -MARGIN for x, s, f in zip(names, score, likeness)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    # columns go by their place: names with dots are none inside
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
