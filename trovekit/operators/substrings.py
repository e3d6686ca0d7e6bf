"""Which answers occur in which chunks of their entity, by a posting table of q-grams.

Chunks of an entity lie in slices, its different answers in parts; a slice meets the
parts of its entity once, however many questions share an answer.  In the task the
slice's hashed byte q-grams become a posting table; an answer looks up its rarest gram
and only the chunks listed there are searched for the whole answer.  Answers shorter
than a gram are searched for in every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: chunks of a slice, answers of a part
SLICE_CHUNKS = 64
PART_ANSWERS = 4096
#: below so many (answer, chunk) pairs they are searched without a posting table
FEW_PAIRS = 1024


class Postings:
    """Chunks of a slice by the byte q-grams they hold."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        if len(data) < GRAM:
            self.keys, self.chunks = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        grams = _grams(data)
        chunk = np.repeat(np.arange(len(texts)), sizes)
        whole = chunk[: len(grams)] == chunk[GRAM - 1 :]  # a gram does not reach into the next chunk
        both = np.unique(grams[whole] * len(texts) + chunk[: len(grams)][whole])
        self.keys, self.chunks = np.divmod(both, len(texts))

    def candidates(self, answers: list[bytes]) -> Iterator[np.ndarray]:
        """Per answer of at least ``GRAM`` bytes the chunks that hold its rarest gram."""
        sizes = np.array([len(a) for a in answers], np.int64)
        data = np.frombuffer(b"".join(answers), np.uint8).astype(np.int64)
        grams, starts = _grams(data), np.cumsum(sizes) - sizes
        first, last = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        for at, size in zip(starts.tolist(), sizes.tolist()):
            span = slice(at, at + size - GRAM + 1)
            rarest = at + int(np.argmin(last[span] - first[span]))
            yield self.chunks[first[rarest] : last[rarest]]


def _grams(data: np.ndarray) -> np.ndarray:
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def occurrences(texts: list[bytes], answers: list[bytes]) -> dict[int, list[int]]:
    """Answer number -> numbers of the texts that contain it, for answers found at all."""
    found: dict[int, list[int]] = {}
    short = range(len(answers))
    if len(texts) * len(answers) > FEW_PAIRS:
        short = [i for i, a in enumerate(answers) if len(a) < GRAM]
        long = [i for i, a in enumerate(answers) if len(a) >= GRAM]
        if long:
            for i, chunks in zip(long, Postings(texts).candidates([answers[i] for i in long])):
                if hits := [c for c in chunks.tolist() if answers[i] in texts[c]]:
                    found[i] = hits
    for i in short:
        if hits := [c for c, t in enumerate(texts) if answers[i] in t]:
            found[i] = hits
    return found


def answer_parts(answers: DataFrame, key: str, part_answers: int = PART_ANSWERS) -> DataFrame:
    """(key, answers, parts): the different answers of a key, cut into parts by their hash where they are many."""
    rows = answers.where(F.col("answer").isNotNull() & F.col(key).isNotNull()).distinct()
    many = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / part_answers).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(many, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("answer"), F.col("parts")).alias("part")
    return rows.groupBy(key, "parts", part).agg(F.collect_list("answer").alias("answers")).drop("part")


def answer_hits(
    chunks: DataFrame, answers: DataFrame, key: str = "entity_id", slice_chunks: int = SLICE_CHUNKS, part_answers: int = PART_ANSWERS
) -> DataFrame:
    """Slices with the answers found in them: key, slice, parts, chunks (ord, did), hits.

    ``chunks`` has key, ``ord`` (a place in the key), ``did`` and ``txt``; ``answers`` key and
    ``answer``.  ``hits`` maps an answer to the places in ``chunks`` that contain it.  A
    slice comes once for each part of its key's answers.
    """
    at = F.floor(F.col("ord") / slice_chunks).alias("slice")
    slices = chunks.where(F.col(key).isNotNull()).groupBy(key, at).agg(F.array_sort(F.collect_list(F.struct("ord", "did", "txt"))).alias("held"))
    met = slices.join(answer_parts(answers, key, part_answers), key)
    kind = lambda c: met.schema[c].dataType.simpleString()
    entry = chunks.schema
    held = f"array<struct<ord: {entry['ord'].dataType.simpleString()}, did: {entry['did'].dataType.simpleString()}>>"
    schema = f"{key} {kind(key)}, slice long, parts int, chunks {held}, hits map<string, array<int>>"
    met = met.select(
        key,
        "slice",
        "parts",
        F.transform("held", lambda h: F.struct(h["ord"].alias("ord"), h["did"].alias("did"))).alias("chunks"),
        F.transform("held", lambda h: h["txt"]).alias("texts"),
        "answers",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits_type = pa.map_(pa.string(), pa.list_(pa.int32()))
        for batch in batches:
            out = []
            for texts, wanted in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                # a NULL text holds nothing: no answer is as long as this
                raw = [b"" if t is None else t.encode() for t in texts]
                found = occurrences(raw, [a.encode() for a in wanted])
                hits = {wanted[i]: [c for c in at if texts[c] is not None] for i, at in found.items()}
                out.append([(a, at) for a, at in hits.items() if at])
            columns = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, hits_type)], [*batch.schema.names[:4], "hits"])

    return met.mapInArrow(run, schema)


def whole_slices(hits: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row per slice of ``answer_hits`` (a written table): key, slice, slices (of the key), chunks, hits."""
    merged = F.map_from_entries(F.flatten(F.collect_list(F.map_entries("hits"))))
    many = hits.where("parts > 1").groupBy(key, "slice").agg(F.first("chunks").alias("chunks"), merged.alias("hits"))
    columns = [key, "slice", "chunks", "hits"]
    one = hits.where("parts = 1").select(columns).unionByName(many.select(columns))
    return one.withColumn("slices", F.count(F.lit(1)).over(Window.partitionBy(key)))


def places_of(options: Column, hits: str = "hits") -> Column:
    """Places in the slice that contain any of ``options``; empty for NULL options."""
    each = F.transform(options, lambda a: F.coalesce(F.try_element_at(F.col(hits), a), F.array().cast("array<int>")))
    return F.coalesce(F.array_distinct(F.flatten(each)), F.array().cast("array<int>"))
