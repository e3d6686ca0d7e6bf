"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash.  A copy's virtual finish time is
the running number of its source's words divided by the source's target; all
copies are put in one global order of finish times and taken until the total
budget is used.  A source is read up to ``max_epochs`` times, so its target stops
at that multiple of its size and the excess goes to the others by weight.

Every row is a document.  Rows that are equal in all columns the operator returns
are counted first and numbered from that count, so a frequent row is never
gathered; texts move once to meet the copies taken and once into the mix's order.

Edge cases: NULL text has size 0 (a document of size 0 is never taken, as it adds
no words); NULL source is a source of its own, last in order; repeated rows, ids and
NULL ids are as many documents as there are rows, each with its own place in the
shuffle; a source or table without words has target 0; other columns are ignored, or
handed through by ``mixed_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovekit.llm.common import each_time, running_total, split_buckets, word_count
from trovekit.operators.numbering import number_rows
from trovekit.session import materialize, release

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size).

    Water level: with sources ordered by cap / weight, the ones below the level
    are capped and the rest share what is left by weight.  Sources are numbered and
    summed up bucket by bucket; one row, the first that is not capped, reaches the
    driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = number_rows(per, [F.col("source").isNull(), "source"], "place")
    per = per.withColumn("w", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("level", F.col("cap") / F.col("w"))
    bucket = F.floor(F.log2(F.col("level") + 1) * 64).cast("long")
    per = materialize(per.withColumn("_b", bucket).withColumn("_one", F.lit(0)), "mix-sources")
    total = per.agg(F.sum("source_size"), F.sum("w")).first()
    budget, all_w = total[0] or 0, total[1] or 0
    order = ["level", "place"]
    run = running_total(per, "cap", ["_one"], "_b", order, "capped").withColumn("capped", F.col("capped") - F.col("cap"))
    rise = running_total(per, "w", ["_one"], "_b", order, "below").select("place", (F.lit(all_w) - F.col("below") + F.col("w")).alias("open_w"))
    fits = F.col("cap") * F.col("open_w") >= F.col("w") * (F.lit(budget) - F.col("capped"))
    edge = run.join(rise, "place").filter(fits).agg(F.min(F.struct("level", "place", (F.lit(budget) - F.col("capped")).alias("left"), "open_w")).alias("e")).first()[0]
    if edge is None:
        return per.select("source", "source_size", F.lit(0.0).alias("target"))
    capped = (F.col("level") < edge.level) | ((F.col("level") == edge.level) & (F.col("place") < edge.place))
    share = (F.col("w") * F.lit(edge.left)).cast("double") / F.lit(edge.open_w)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _same_text() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _whole_row(docs: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))


def _entries(docs: DataFrame, row: Column | None) -> DataFrame:
    """Different rows: doc_id, source, size, ident (of the text), row (of the whole row), n equal ones, and ``first``, the number before theirs.

    Rows that share doc_id, source and text are numbered on, so with or without
    the other columns they have the same places in the shuffle.
    """
    row = F.lit("") if row is None else row
    keys = ["doc_id", "source", "size", "ident", "row"]
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), _same_text().alias("ident"), row.alias("row"))
    rows = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    name = F.md5(F.to_json(F.struct("doc_id", "source", "ident")))
    often = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("name")
    often = materialize(often, "mix-often")
    if often.isEmpty():
        release(often)
        return rows.withColumn("first", F.lit(0).cast("long"))
    named = rows.withColumn("name", name)
    once = named.join(often, "name", "left_anti").withColumn("first", F.lit(0).cast("long"))
    many = materialize(named.join(often, "name", "left_semi").withColumn("_b", F.conv(F.substring("row", 1, 4), 16, 10).cast("long")), "mix-many")
    many = running_total(many, "n", ["name"], "_b", ["row"], "upto").withColumn("first", F.col("upto") - F.col("n"))
    return once.select(*keys, "n", "first").unionByName(many.select(*keys, "n", "first"))


def _numbered(entries: DataFrame, seed: str) -> DataFrame:
    """One row per document with its place ``ord`` in the shuffle."""
    rows = each_time(entries.withColumn("times", F.col("n")), "times", "number")
    number = (F.col("first") + F.col("number")).cast("string")
    ident = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "ident", number)
    return rows.select("doc_id", "source", "size", "row", "n", F.md5(ident).alias("ord"))


def fair_queue(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source).

    Returns two written tables: one row per document with ord (its place in the
    shuffle, which names it), size, source_size and target; and one row per copy taken
    with ord, epoch, finish (virtual finish time) and upto (words of the mix up to and
    including it, the global order).  ``row`` names a whole row; both carry it, and n,
    how many rows are equal to it.
    """
    rows = materialize(_numbered(_entries(docs, row), seed), "mix-sizes")
    n, budget = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    # a NULL source gets a non-null key of its own
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    per = targets(rows, weights, max_epochs).withColumn("_k", key).drop("source")
    bits = split_buckets(n).bit_length() - 1
    start = F.conv(F.substring("ord", 1, 8), 16, 10).cast("long")
    keyed = rows.withColumn("_k", key).withColumn("_b", F.shiftright(start, 32 - min(bits, 31)))
    run = running_total(keyed, "size", ["_k"], "_b", ["ord", "doc_id"], "run")
    documents = materialize(run.join(per, "_k").select("doc_id", "source", "ord", "row", "n", "size", "source_size", "target", "run"), "mix-runs")
    release(rows)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    ahead = F.col("epoch") * F.col("source_size") + F.col("run")
    copies = documents.filter("size > 0").withColumn("epoch", epochs).filter(ahead - F.col("size") < F.col("target"))
    copies = copies.withColumn("finish", ahead.cast("double") / F.col("target"))
    cells = split_buckets(3 * n)
    copies = copies.withColumn("_f", F.least(F.floor(F.col("finish") * cells), F.lit(2 * cells)).cast("long")).withColumn("_one", F.lit(0))
    copies = materialize(copies.select("source", "ord", "row", "n", "size", "epoch", "finish", "_f", "_one"), "mix-copies")
    queue = running_total(copies, "size", ["_one"], "_f", ["finish", F.asc_nulls_last("source"), "ord", "epoch"], "upto")
    taken = materialize(queue.filter(F.col("upto") <= (budget or 0)).select("ord", "row", "n", "size", "epoch", "finish", "upto"), "mix-taken")
    release(copies)
    return documents, taken


def mix_table(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source."""
    documents, taken = fair_queue(docs, weights, max_epochs, seed)
    sums = taken.groupBy("ord").agg(F.sum("size").alias("words"))
    return documents.join(sums, "ord", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source"
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, one for each copy, range-sorted by the place in the global queue.

    No row comes more than ``max_epochs`` times.  ``docs`` is read twice.
    """
    documents, taken = fair_queue(docs, weights, max_epochs, seed, _whole_row(docs))
    release(documents)
    named = docs.select(_whole_row(docs).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    mixed = named.join(taken.filter("n = 1").select("row", "upto"), "row").select("held", "upto")
    again = taken.filter("n > 1").select("row", "upto")
    if not again.isEmpty():
        # equal rows meet in the tasks that read them, before any of them moves
        one = named.join(again.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("held").alias("held"))
        mixed = mixed.unionByName(one.join(again, "row").select("held", "upto"))
    return mixed.repartitionByRange(F.col("upto")).sortWithinPartitions("upto").select("held.*")
