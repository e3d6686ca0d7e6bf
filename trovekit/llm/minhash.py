"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, each a 64-bit hash.  Its
sketch is the ``k`` smallest hashes.

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. Inverted lists: a sketch value that two classes hold is a list of them.  A pair
   at the threshold shares at least ``need`` sketch values (the estimate of the
   union sketch, less a margin of 0.3, more than six standard errors at k = 64; the
   exact bound where sketches are whole sets), so a class enters only the lists of
   its rarest values, all but need - 1 of those it shares with others, and no list
   at all when it shares fewer.
3. Pairs of a list: short lists give all pairs, long ones the pairs with one
   pivot.  The union sketch estimates their similarity and drops the distant ones;
   exact sizes of full sets decide the rest.
4. Long lists that still hold several components are settled exactly: their
   members outside the largest component meet all others block by block, and only
   links between components leave a task.  So no list of pairs is ever built for a
   large group, and no link between components is lost.
5. Components of the links; the smallest doc_id of each stays.

Edge cases: texts without words (and NULL) have an empty set and link with
nothing; fewer words than a shingle make one shingle of all; rows with NULL doc_id
get a NULL component and stay; rows that repeat a doc_id are one document that
has each of the sets; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovekit.llm.common import drop, written
from trovekit.llm.components import components
from trovekit.llm.textbatch import run_hash, utf8

K, MARGIN, SHORT_LIST, BLOCK = 64, 0.30, 16, 256
WORDS = 5
PIECE = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each row, as signed integers."""
    n = len(offsets) - 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    solid = (low != 32) & ((low < 9) | (low > 13))
    first = np.zeros(len(low) + 1, bool)
    first[offsets[:-1]] = True
    begins = solid & first[:-1]
    begins[1:] |= solid[1:] & ~solid[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(len(low)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(low)]))))
    word = run_hash(low, solid, starts, place)
    count = np.bincount(row, minlength=n)
    until = np.cumsum(count)[row]  # number of the first word of the next row
    at = np.arange(len(starts))
    left = np.minimum(until - at, words)
    keep = (left == words) | (at == until - count[row])  # full shingles, and the only one of a short row
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            part = np.zeros(len(starts), np.uint64)
            part[: len(starts) - j] = word[j:] if j else word
            total += np.where(j < left, part * np.uint64(2 * j + 0x9E3779B97F4A7C15), np.uint64(j + 1))
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    h, r = total[keep].view(np.int64), row[keep]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(r[new], minlength=n))))


def _rows(column: pa.Array):
    """Shingle sets of an Arrow text column in pieces of whole rows: (first row, hashes, offsets)."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        h, at = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, h, at
        first = last


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (set size), low and high (128-bit identity of the set), sketch of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for first, h, at in _rows(batch.column("text")):
                size = np.diff(at)
                mixed = h.view(np.uint64) * np.uint64(0x94D049BB133111EB)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                low = np.add.reduceat(np.append(h, 0), at[:-1]) * (size > 0)
                high = np.add.reduceat(np.append(mixed, np.uint64(0)), at[:-1]).view(np.int64) * (size > 0)
                kept = np.minimum(size, k)
                take = np.concatenate(([0], np.cumsum(kept)))
                index = np.arange(take[-1]) + np.repeat(at[:-1] - take[:-1], kept)
                sketch = pa.ListArray.from_arrays(pa.array(take.astype(np.int32)), pa.array(h[index]))
                ids = batch.column("doc_id").slice(first, len(size))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(low), pa.array(high), sketch], names=["doc_id", "n", "low", "high", "sketch"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, low long, high long, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """node, set of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for first, h, at in _rows(batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h))], names=["node", "set"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"node {kind}, set array<long>")


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity estimated from the union sketch: the share of its values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _lists(classes: DataFrame, percent: int, tau: float, k: int) -> DataFrame:
    """(value, node, n): each class in the inverted lists of its rarest shared sketch values."""
    post = classes.select("node", "n", F.explode("sketch").alias("value"))
    shared = post.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    post = post.join(shared, "value")
    ranked = post.withColumn("at", F.row_number().over(Window.partitionBy("node", "n").orderBy("df", "value")))
    ranked = ranked.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("node", "n")))
    # the sketches of both documents are their whole sets where n is at most percent of k
    whole = F.floor((F.col("n") * percent + 99) / 100)
    need = F.when(F.col("n") * 100 <= percent * k, whole).otherwise(F.ceil(F.lit(tau) * F.least("n", F.lit(k))))
    return ranked.filter(F.col("at") <= F.col("held") - need + 1).select("value", "node", "n")


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a < b): all of short lists, those with one pivot of long ones."""
    stats = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("pivot")).filter("size > 1")
    some = lists.join(stats.filter(F.col("size") <= SHORT_LIST).select("value"), "value", "left_semi")
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb"))
    star = lists.join(stats.filter(F.col("size") > SHORT_LIST).select("value", "pivot"), "value").filter("node > pivot.node")
    star = star.select(F.col("pivot.node").alias("a"), F.col("pivot.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.unionByName(star).filter(close).select("a", "b").distinct()


def _rest(lists: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a long list: (a, b), one per pair of components and block pair.

    Long lists that share members are one cluster.  Its largest component is cut
    into blocks, and so are all its other members; every block of others meets all
    blocks in a task of its own, where full sets are compared by products of
    incidence matrices.  Blocks of the largest component need not meet.
    """
    members = lists.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    stats = members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("node").alias("first"))
    mixed = stats.filter((F.col("size") > SHORT_LIST) & (F.col("c0") != F.col("c1"))).select("value", "first")
    inside = written(members.join(mixed, "value").select("node", "c", "first").distinct(), "mixed-lists")
    cluster = components(inside.select(F.col("first").alias("a"), F.col("node").alias("b")), label="clusters")
    placed = written(inside.select("node", "c").distinct().join(cluster, "node").select("node", "c", F.col("component").alias("k")), "clusters")
    sizes = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"))
    shape = sizes.groupBy("k").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("k", "main", blocks(F.col("m")).alias("mains"), blocks(F.col("all") - F.col("m")).alias("others"))
    rows = placed.join(shape, "k").withColumn("is_main", F.col("c") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    to = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i)
    with_main = F.transform(to(F.col("mains")), lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(
        to(F.col("others")),
        lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.when(F.col("own") <= j, 0).otherwise(1).alias("side")),
    )
    as_main = F.transform(to(F.col("others")), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
    places = F.when(F.col("is_main"), as_main).otherwise(F.concat(with_main, with_others))
    spread = rows.filter("others > 0").select("k", "node", "c", F.explode(places).alias("p"))
    kind = placed.schema["node"].dataType.simpleString()
    meet = spread.select("k", "p.i", "p.j", "p.side", "node", "c").join(sets, "node")
    return meet.groupBy("k", "i", "j").applyInArrow(_block_links(percent), f"a {kind}, b {kind}").distinct()


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side, node, c = (table.column(x).to_numpy() for x in ("side", "node", "c"))
        column = table.column("set").combine_chunks()
        size = np.diff(column.offsets.to_numpy())
        value = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if int(table.column("i")[0].as_py()) == int(table.column("j")[0].as_py()):
            y = x
        row = np.repeat(np.arange(len(size)), size)
        both = _overlaps(row, value, x, y, len(size))
        union = size[x][:, None] + size[y][None, :] - both
        hit = (100 * both >= percent * union) & (c[x][:, None] != c[y][None, :])
        i, j = np.nonzero(hit)
        a, b = x[i], y[j]
        # one link joins two components; the others between them add nothing
        low, high = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
        _, first = np.unique(np.stack([low, high]), axis=1, return_index=True)
        a, b = a[first], b[first]
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    return run


def _overlaps(row: np.ndarray, value: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``x`` and ``y``, ``columns`` values at a time."""
    in_x, in_y = np.full(n, -1), np.full(n, -1)
    in_x[x], in_y[y] = np.arange(len(x)), np.arange(len(y))
    seen_x, seen_y = (np.bincount(value[p[row] >= 0], minlength=value.max(initial=0) + 1) > 0 for p in (in_x, in_y))
    shared = seen_x & seen_y
    place = np.cumsum(shared) - 1
    keep = shared[value]
    row, value = row[keep], place[value[keep]]
    out = np.zeros((len(x), len(y)))
    for first in range(0, int(shared.sum()), columns):
        part = (value >= first) & (value < first + columns)
        sides = []
        for p, count in ((in_x, len(x)), (in_y, len(y))):
            m = np.zeros((count, columns), np.float32)
            mine = part & (p[row] >= 0)
            m[p[row[mine]], value[mine] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def links(docs: DataFrame, percent: int = 85, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, members, components).

    ``documents`` has doc_id and n of every row; ``members`` maps doc_id to the
    nodes of its classes; ``components`` (node, component) covers linked nodes.
    """
    tau = percent / 100 - MARGIN
    every = written(sketches(docs, k), "sketches")
    usable = every.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    ident = ["low", "high", "n"]
    heads = usable.groupBy(*ident).agg(F.min("doc_id").alias("node"))
    joined = usable.join(heads, ident)
    members = written(joined.select("doc_id", "node").distinct(), "members")
    classes = joined.filter(F.col("doc_id") == F.col("node")).select("node", *ident, "sketch").dropDuplicates(["node", *ident])
    classes = written(classes.select("node", "n", "sketch"), "classes")
    lists = written(_lists(classes, percent, tau, k), "lists")
    active = lists.select("node").distinct()
    bits = written(classes.join(active, "node", "left_semi"), "active")
    texts = docs.select("doc_id", "text").join(active, F.col("doc_id") == F.col("node"), "left_semi")
    sets = written(full_sets(texts).distinct(), "sets")
    drop(classes)
    # a doc_id with several texts joins their classes
    first = members.groupBy("doc_id").agg(F.min("node").alias("a"))
    edges = written(members.join(first, "doc_id").filter("a != node").select("a", F.col("node").alias("b")).distinct(), "links")
    pairs = written(_pairs(lists, percent), "pairs")
    edges = edges.unionByName(written(_verified(pairs, bits, sets, percent, tau, k), "links"))
    found = written(components(edges), "components")
    more = written(_rest(lists, found, sets, percent), "links")
    if not more.isEmpty():
        old, found = found, written(components(edges.unionByName(more)), "components")
        drop(old)
    drop(pairs, lists, bits, sets)
    return every.select("doc_id", "n"), members, found


def _verified(pairs: DataFrame, bits: DataFrame, sets: DataFrame, percent: int, tau: float, k: int) -> DataFrame:
    one = bits.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = bits.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").filter(_estimate(F.col("sa"), F.col("sb"), k) >= tau).select("a", "b").distinct()
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    sure = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return near.join(one, "a").join(two, "b").filter(sure).select("a", "b").distinct()


def classify(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    every, members, found = links(docs, percent, k)
    named = members.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    named = named.groupBy("doc_id").agg(F.min("c").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return every.join(named, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_row_per_group(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """Rows of ``docs``, one of each group of near copies, whatever their ids and column names.

    Rows are linked by a number of their own, so NULL and repeated ids count like
    any other row.  The row with the smallest doc_id stays (NULL comes last, then
    the text's hash decides); rows without words link with nothing and stay.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = written(docs.select(held, F.monotonically_increasing_id().alias("row")), "numbered")
    _, members, found = links(rows.select(F.col("row").alias("doc_id"), F.col("held.text").alias("text")), percent, k)
    group = members.join(found, "node", "left").select(F.col("doc_id").alias("row"), F.coalesce("component", "node").alias("c"))
    own = F.col("held.doc_id")
    rank = F.struct(own.isNull().alias("last"), own.alias("id"), F.xxhash64("held.text").alias("h"), F.col("row").alias("row"))
    group = written(rows.select("row", rank.alias("rank")).join(group, "row"), "groups")
    first = group.groupBy("c").agg(F.min("rank").alias("first")).select(F.col("first.row").alias("row"))
    gone = written(group.select("row").join(first, "row", "left_anti"), "removed")
    drop(members, found, group)
    return rows.join(gone, "row", "left_anti").select("held.*")
