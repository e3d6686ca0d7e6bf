"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Items and documents are lower-cased (A-Z) and cut into words.  Every window of
``n`` item words (an item with fewer words is one window) enters a table keyed by
a 64-bit hash; the document's windows at each word position are looked up in it
inside the scan, hits are verified word by word.  Only hits, and one row per
document, leave the scan.

The table is broadcast while it has at most ``MAX_BROADCAST_WINDOWS`` rows; a
larger one is joined by shuffle, with the same result.

Edge cases: NULL or wordless texts have no words and no hits; NULL doc_ids are values
like others; words of an item with NULL item_id are hit, but it is not listed or counted;
repeated rows are scanned like others and come out as often; without items nothing is
hit; other columns are ignored, or handed through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit.llm.common import each_time
from trovekit.session import materialize, release

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: the same in a text that has its capitals
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_WINDOWS = 1_000_000


def words(text: Column | str) -> Column:
    """Normalised words; NULL gives an empty array."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(t, UPPER, LOWER), SEPARATORS + "+"), "")


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, m, win): all windows of each item; m words each, fewer than n only for a short item."""
    w = items.select("item_id", words("text").alias("ws")).filter(F.size("ws") > 0)
    w = w.withColumn("m", F.least(F.lit(n), F.size("ws")))
    w = w.select("item_id", "ws", "m", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1)).alias("at"))
    return w.select("item_id", "m", F.slice("ws", F.col("at"), F.col("m")).alias("win")).distinct()


def scan(docs: DataFrame, items: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Look all document windows up.

    Returns (hits, windows).  ``hits`` has one row with ``at`` -1 per document and
    one per verified window: doc_id, text_hash, n_words, at (0-based word), m, wid, and
    times, the number of rows that share doc_id and text.  ``windows`` maps wid to
    item_id.  Both are written tables.
    """
    found = materialize(item_windows(items, n).withColumn("h", F.xxhash64("win")), "bench-windows")
    known = found.select("m", "win", "h").distinct()
    sizes = [r[0] for r in found.select("m").distinct().collect()] or [n]
    small = known.count() <= MAX_BROADCAST_WINDOWS
    known = known.select(F.col("h"), F.col("win"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("ws"))
    base = base.withColumn("n_words", F.size("ws"))
    rows = base.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - 1, F.lit(-1)))).alias("at"))
    if len(sizes) > 1:
        rows = rows.select("*", F.explode(F.array(*[F.lit(m) for m in sorted(sizes)])).alias("m"))
    else:
        rows = rows.withColumn("m", F.lit(sizes[0]))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("m") <= F.col("n_words"))
    rows = rows.withColumn("key", F.when(fits, F.xxhash64(F.slice("ws", F.col("at") + 1, F.col("m")))))
    if not small:
        # the words of one window travel instead of the whole document
        rows = rows.withColumn("ws", F.when(fits, F.slice("ws", F.col("at") + 1, F.col("m")))).withColumn("off", F.lit(0))
    else:
        rows = rows.withColumn("off", F.col("at"))
    looked = rows.join(F.broadcast(known) if small else known, rows["key"] == known["h"], "left")
    same = F.slice("ws", F.col("off") + 1, F.col("m")) == F.col("win")
    looked = looked.filter((F.col("at") == -1) | (F.col("h").isNotNull() & same))
    wid = F.xxhash64("win", F.lit("window"))
    each = looked.groupBy("doc_id", "text_hash", "n_words", "at", "m", "h", wid.alias("wid")).agg(F.count(F.lit(1)).alias("times"))
    if len(sizes) > 1:
        # a document's own row came once for each size of window
        each = each.withColumn("m", F.when(F.col("at") >= 0, F.col("m")))
        each = each.groupBy("doc_id", "text_hash", "n_words", "at", "m", "h", "wid").agg(F.max("times").alias("times"))
    hits = materialize(each, "bench-hits")
    windows = found.withColumn("wid", wid).select("h", "wid", "item_id")
    windows._scratch = found._scratch
    return hits, windows


def spans(hits: DataFrame) -> DataFrame:
    """Maximal runs of hit words: doc_id, text_hash, first, last (0-based, last excluded)."""
    real = hits.filter("at >= 0").select("doc_id", "text_hash", "at", (F.col("at") + F.col("m")).alias("end")).distinct()
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("at", "end")
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    real = real.withColumn("new", F.when(reach.isNull() | (F.col("at") > reach), 1).otherwise(0))
    real = real.withColumn("run", F.sum("new").over(doc))
    return real.groupBy("doc_id", "text_hash", "run").agg(F.min("at").alias("first"), F.max("end").alias("last")).drop("run")


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, windows = scan(docs, items, n)
    key = ["doc_id", "text_hash"]
    base = hits.filter("at = -1").select(*key, "n_words", "times")
    # the rows of one document carry its counts: no join of whole tables, only two grouped unions
    runs = spans(hits).groupBy(*key).agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"))
    by_item = hits.filter("at >= 0").select(*key, "h", "wid").distinct().join(windows, ["h", "wid"])
    by_item = by_item.select(*key, F.col("item_id").cast("string").alias("item_id")).distinct()
    by_item = by_item.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    merged = (
        base.unionByName(runs, allowMissingColumns=True).unionByName(by_item, allowMissingColumns=True)
    )
    merged = merged.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("n_words", "times", "n_hit")], F.first("items", ignorenulls=True).alias("items"))
    merged = each_time(merged, "times")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return merged.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _held(docs: DataFrame) -> DataFrame:
    """``docs`` as one column beside what names a row, so their column names cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Rows of ``docs`` without any hit window."""
    hits, windows = scan(docs, items, n)
    bad = materialize(hits.filter("at >= 0").select("doc_id", "text_hash").distinct(), "bench-bad")
    release(hits, windows)
    held = _held(docs)
    return held.join(bad, held["id"].eqNullSafe(bad["doc_id"]) & (held["hash"] == bad["text_hash"]), "left_anti").select("held.*")


def cut_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Rows of ``docs`` with hit words, and the separators after them, cut out of ``text``; other texts stay as they are."""
    hits, windows = scan(docs, items, n)
    release(windows)
    runs = spans(hits).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    held = _held(docs)
    joined = held.join(runs, held["id"].eqNullSafe(runs["doc_id"]) & (held["hash"] == runs["text_hash"]), "left")
    old = F.col("held.text")
    word = RAW_SEPARATORS.replace("[", "[^") + "+" + RAW_SEPARATORS + "*"
    lead = F.regexp_extract(old, "^" + RAW_SEPARATORS + "*", 0)
    pieces = F.regexp_extract_all(old, F.lit(word), 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i < r["last"])))
    text = F.when(F.col("runs").isNull(), old).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"held.`{c}`") for c in docs.columns])


