"""Toxicity scores of texts restored by a noisy-channel decoder.

1. Character language model: trigram counts over the words of all documents,
   added up in the tasks.
2. Deobfuscation: stretches that look disguised (words that hold letters and
   look-alike digits or marks at any place, letters repeated three times or more,
   letters set apart by any number of blanks, line breaks or marks; letters of any
   script) become a lattice: each character gives the letters it may stand
   for, a run of one letter may be one or two of it, a mark between letters may
   be nothing or a gap.  A Viterbi search over trigram states takes the likeliest
   reading.  Plain stretches have one reading and are left as they are.
3. Lexicon: for hashed words and word beginnings (4, 5 and 6 bytes) of the restored
   texts of labelled documents, the lower confidence bound (three standard errors)
   of the log-odds of being in a toxic one.
4. Score: logistic function, fitted on the same labels, of the largest weight and
   the logarithm of the sum of weights of a text's different features.

Labels are learned from at most ``max_rows`` rows, chosen by a hash of the id; the
language model and the scores cover all documents and whole texts.

Edge cases: NULL text is the empty text and is scored like one; NULL labels are
not learned from; with one class or none the score is that class's smoothed share;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.llm.quality import MAX_ROWS, sample_labels
from trovekit.llm.textbatch import pieces, row_max, row_sums, run_hash, utf8

BUCKETS = 1 << 18
#: symbols of the language model: 0 gap, 1 to 26 letters, 27 any other letter
SYMBOLS = 28
CACHE = 200_000

# Letters that a character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a",
}
APART = " .-_*~'`/\\,:\t\n\r"
# letters and digits of any script, look-alikes, marks inside a word
SOLID, ALIKE, INNER = r"[^\W_]", r"0-9@$!|+(*#%&", r".\-_"
WORD = rf"(?:{SOLID}|[{ALIKE}{INNER}])"
#: a whole word that holds a letter and a look-alike, at any place
MIXED = re.compile(rf"(?<![{ALIKE}{INNER}])(?<!{SOLID})(?=[{ALIKE}{INNER}]*[^\W\d_])(?=(?:[^\W\d_]|[{INNER}])*[{ALIKE}]){WORD}+")
REPEATED = re.compile(r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*", re.I)
ALONE = rf"(?:{SOLID}|[@$!|+(#%&])"
SPACED = re.compile(rf"(?<!{SOLID})(?<![@$]){ALONE}(?:[ .\-_*~'`/\\,:\t\n\r]+{ALONE}){{2,}}(?!{SOLID}|[@$])")


@functools.cache
def _symbols() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[128:] = 27
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    return out


def _count(batches):
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, data, offsets in pieces(*utf8(batch.column("text"))):
            # a gap before each text and two at the end, so no trigram joins two texts
            s = np.insert(_symbols()[data], offsets, 0)
            s = np.concatenate((s, [0]))
            code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            counts += np.bincount(code[s[1:-1] + s[2:] > 0], minlength=len(counts))
    code = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(counts[code])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first, second) of the symbols of all texts."""
    sums = docs.select("text").mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    # after a gap at a text's beginning a word begins as after any gap
    counts[0, 0] = counts[:, 0].sum(axis=0)
    two = counts.sum(axis=0) + 0.1
    two /= two.sum(axis=1, keepdims=True)
    # counts backed by ten observations of the bigram estimate
    return np.log((counts + 10 * two[None]) / (counts.sum(axis=2, keepdims=True) + 10))


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each stretch of equal characters, with the logarithm of their weight."""
    out: list[list[tuple[str, float]]] = []
    i, n = 0, len(token)
    while i < n:
        c, j = token[i], i
        while j < n and token[j] == c:
            j += 1
        run, inner, leads = j - i, 0 < i and j < n, i == 0 and j < n
        choices: list[tuple[str, float]] = []
        if c.isalpha():
            choices = [(c, 0.0 if run == 1 else -1.0 if run == 2 else -0.2)]
            if run > 1:
                choices.append((c * 2, 0.0 if run == 2 else -1.2))
        else:
            for k, letter in enumerate(LOOK_ALIKES.get(c, "")):
                choices.append((letter, -1.0 - 0.3 * k - (0.0 if inner or leads else 0.7)))
                if run > 1:
                    choices.append((letter * 2, -1.6 - 0.3 * k))
            if c in APART:
                choices.append(("", -0.7 if inner else -2.0))
            # a bracket or a sign before a word is one as often as it is a letter
            lead = -2.0 if c in "(*#%&" else -8.0
            # at a word's end only punctuation is as good as nothing; a digit or a sign is there for a letter
            last = -1.0 if c in "!|(*" else -3.0
            choices.append((" ", -1.0 if c not in LOOK_ALIKES else lead if leads else -3.0 if inner else last))
        out.append(choices)
        i = j
    return out


def decode(token: str, model: np.ndarray) -> str:
    """Likeliest reading of a lower-case token: Viterbi over the states of the two last symbols."""
    # any other letter counts once for each of its bytes, as in the language model
    symbols = lambda c: (0,) if c == " " else (ord(c) - 96,) if "a" <= c <= "z" else (27,) * len(c.encode())
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*_lattice(token), [(" ", 0.0)]]:
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        read = [(letters, weight, [z for c in letters for z in symbols(c)]) for letters, weight in choices]
        for (a, b), (score, text) in best.items():
            for letters, weight, states in read:
                x, y, total = a, b, score + weight
                for z in states:
                    if not (y == z == 0):
                        total += model[x, y, z]
                        x, y = y, z
                have = step.get((x, y))
                if have is None or total > have[0]:
                    step[x, y] = (total, (text, letters))
        best = step
    return max((score, _joined(text)) for score, text in best.values())[1].strip()


def _joined(text: tuple | None) -> str:
    out = []
    while text is not None:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


class Restorer:
    """Replaces disguised stretches; readings are kept for tokens seen before."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def _read(self, found: re.Match) -> str:
        token = found.group().lower()
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            out = self.known[token] = decode(token, self.model)
        return out

    def __call__(self, text: str) -> str:
        text = SPACED.sub(self._read, text)
        text = MIXED.sub(self._read, text)
        return REPEATED.sub(self._read, text)


BEFORE, AFTER = 48, 96


LETTER, ALIKE_BIT, APART_BIT, INNER_BIT = 1, 2, 4, 8


@functools.cache
def _marks() -> np.ndarray:
    """Kinds of bytes: letters, look-alikes, characters that set letters apart, marks inside a word."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] |= LETTER
    kind[97:123] |= LETTER
    kind[0xC0:] |= LETTER
    for marks, bit in (("".join(LOOK_ALIKES), ALIKE_BIT), (APART, APART_BIT), (".-_", INNER_BIT)):
        kind[[ord(c) for c in marks]] |= bit
    return kind


def _characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for the bytes of each character that begins at ``at``."""
    code, more = data[at].astype(np.int64), np.ones(len(at), bool)
    for j in range(1, 4):
        spot = np.minimum(at + j, len(data) - 1)
        more &= (at + j < len(data)) & ((data[spot] & 0xC0) == 0x80)
        code = np.where(more, code << 8 | data[spot], code)
    return code


def _suspects(data: np.ndarray) -> np.ndarray:
    """Positions where a stretch may be disguised; everything else reads as it is."""
    solid = (data & 0xC0) != 0x80
    at = np.flatnonzero(solid)
    if len(at) < 3:
        return at
    plain = len(at) == len(data)
    head = data if plain else data[at]
    kind = _marks()[head]
    letter = (kind & LETTER) > 0
    hit = np.zeros(len(at), bool)
    # a letter beside a look-alike, marks inside the word aside
    some = np.flatnonzero((kind & INNER_BIT) == 0)
    part = kind[some] & (LETTER | ALIKE_BIT)
    near = np.flatnonzero((part[:-1] | part[1:]) == (LETTER | ALIKE_BIT))
    near = near[(part[near] > 0) & (part[near + 1] > 0)]
    hit[some[near]] = hit[some[near + 1]] = True
    # one letter three times, in upper or lower case; whole characters where lead bytes agree
    low = np.where(letter, head | 32, head)
    same = np.flatnonzero(letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]))
    wide = same[head[same] >= 0xC0]
    if len(wide):
        one, two, three = (_characters(data, at[wide + j]) for j in range(3))
        # Latin letters with accents differ from their capitals in one bit
        one, two, three = (np.where((c >= 0xC380) & (c <= 0xC39E), c | 32, c) for c in (one, two, three))
        hit[wide[(one == two) & (two == three)]] = True
    hit[same[head[same] < 0x80]] = True
    # three characters in a row that stand alone, any marks between them: the whole stretch
    some = np.flatnonzero((kind & APART_BIT) == 0)
    single = (kind[some] & (LETTER | ALIKE_BIT)) > 0
    joined = (np.diff(some) == 1) & single[:-1] & single[1:]
    alone = single & ~np.append(False, joined) & ~np.append(joined, False)
    for i in np.flatnonzero(alone[:-2] & alone[1:-1] & alone[2:]).tolist():
        hit[some[i] : some[i + 2] + 1] = True
    return at[hit]


def restored(data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Flat texts with disguised stretches read; stretches are looked at in whole words around each suspect position."""
    at = _suspects(data)
    if not len(at):
        return data, offsets
    row = np.searchsorted(offsets, at, side="right") - 1
    blank = np.flatnonzero((data == 32) | (data == 10))
    edges = np.concatenate(([-1], blank, [len(data)]))
    lo = np.maximum(edges[np.searchsorted(edges, at - BEFORE, side="right") - 1] + 1, offsets[row]) if len(at) else at
    lo = np.where(at - BEFORE <= 0, offsets[row], lo)
    hi = np.minimum(edges[np.minimum(np.searchsorted(edges, at + AFTER), len(edges) - 1)], offsets[row + 1])
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
    starts = np.flatnonzero(new)
    out, done, grown = [], 0, np.zeros(len(offsets) - 1, np.int64)
    ends = np.append(starts[1:], len(at)) - 1
    for first, last in zip(starts.tolist(), ends.tolist()):
        a, b = int(lo[first]), int(hi[first : last + 1].max())
        text = restore(data[a:b].tobytes().decode("utf-8", "replace")).encode()
        out += [data[done:a], np.frombuffer(text, np.uint8)]
        done = b
        grown[row[first]] += len(text) - (b - a)
    out.append(data[done:])
    return np.concatenate(out), np.concatenate(([0], np.cumsum(np.diff(offsets) + grown)))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words and word beginnings of each row, repeats included; a word is a run of letters."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    solid = ((low >= 97) & (low <= 122)) | (low >= 128)
    first = np.zeros(len(low) + 1, bool)
    first[offsets[:-1]] = True
    begins = solid & first[:-1]
    begins[1:] |= solid[1:] & ~solid[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts
    place = np.arange(len(low)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(low)]))))
    row = np.searchsorted(offsets, starts, side="right") - 1
    found = [run_hash(low, solid, starts, place) >> np.uint64(46)]
    size = np.append(starts[1:], len(low)) - starts
    h, alive = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for j in range(6):
        spot = np.minimum(starts + j, len(low) - 1)
        alive &= solid[spot] & (j < size)
        h = np.where(alive, (h ^ low[spot]) * np.uint64(0x9E3779B97F4A7C15), h * np.uint64(0xD6E8FEB86659FD93))
        h ^= h >> np.uint64(31)
        if j >= 3:
            found.append(h >> np.uint64(46))
    return np.tile(row, len(found)), np.concatenate(found).astype(np.int64)


def _different(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    characters: np.ndarray
    weight: np.ndarray
    logistic: np.ndarray


def measures(column: pa.Array, model: Model, restore: Restorer) -> np.ndarray:
    """(rows, 2): the largest weight and log(1 + sum of weights) of the different features of each restored text."""
    n = len(column)
    most, total = np.zeros(n), np.zeros(n)
    for rows, data, offsets in pieces(*utf8(column)):
        row, bucket = _features(*restored(data, offsets, restore))
        some = model.weight[bucket] > 0
        row, bucket = _different(row[some], bucket[some])
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        w = model.weight[bucket]
        total[rows] += row_sums(w, at)
        most[rows] = np.maximum(most[rows], row_max(w, at))
    return np.stack([most, np.log1p(total)], axis=1)


def _lexicon_counts(shared):
    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        restore = Restorer(shared.value)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for rows, data, offsets in pieces(*utf8(batch.column("text"))):
                row, bucket = _different(*_features(*restored(data, offsets, restore)))
                counts += np.bincount(y[rows][row] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        y, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[y, bucket])], names=["y", "bucket", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) of a lightly regularised logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, label) and all texts of ``docs`` (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    characters = language_model(docs)
    shared = context.broadcast(characters)
    sample = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, label, max_rows)), "doc_id").select("text", F.least(F.greatest("y", F.lit(0)), F.lit(1)).alias("y"))
    share = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    clean, toxic = share.get(0, 0), share.get(1, 0)
    prior = float(np.log((toxic + 0.5) / (clean + 0.5)))
    if not clean or not toxic:
        return Model(characters, np.zeros(BUCKETS), np.array([prior, 0.0, 0.0]))
    found = sample.mapInArrow(_lexicon_counts(shared), "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[found.column("y").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    odds = np.log((counts[1] + 0.5) / (toxic + 1)) - np.log((counts[0] + 0.5) / (clean + 1))
    weight = np.maximum(0.0, odds - 3 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5)))
    model = Model(characters, weight, np.zeros(3))
    whole = context.broadcast(model)

    def run(batches):
        restore = Restorer(whole.value.characters)
        for batch in batches:
            x = measures(batch.column("text"), whole.value, restore)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("y")], names=["most", "total", "y"])

    rows = sample.mapInArrow(run, "most double, total double, y int").toArrow()
    x = np.stack([rows.column("most").to_numpy(), rows.column("total").to_numpy()], axis=1)
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((x[:, 1], x[:, 0], y))
    model.logistic = _logistic(x[order], y[order])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        restore = Restorer(m.characters)
        for batch in batches:
            x = measures(batch.column("text"), m, restore)
            score = 1 / (1 + np.exp(-np.clip(m.logistic[0] + x @ m.logistic[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def restore_texts(docs: DataFrame, characters: np.ndarray) -> DataFrame:
    """doc_id and the restored text of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def run(batches):
        restore = Restorer(shared.value)
        for batch in batches:
            data, offsets = restored(*utf8(batch.column("text")), restore)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, restored string")
