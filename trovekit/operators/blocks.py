"""Exact nearest neighbours by blocked matrix products.

Vectors are packed into blocks of rows inside the scan tasks.  Query blocks are
grouped; a pool block meets every query group once, a query block meets every
pool slice once.  Each task then streams its pool blocks past one group of
queries and keeps a running top k per query, so neither side is ever held as a
whole, no pair of rows is materialised, and the output is k rows per query and
pool slice.  Every pair is scored: the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit.session import materialize

BLOCK_ROWS = 1024
GROUP_ROWS = 16_384
#: queries whose products with a pool block are held at once
STRIP_ROWS = 1024
#: cells of a search at least, where the pool has the rows, and pool rows of a cell at most
LEAST_CELLS = 48
CELL_ROWS = 512 * BLOCK_ROWS
SENT_BYTES = 64 * 1024 * 1024
DIGITS = 6

_PACKED = "seq long, ids binary, mat binary, dim int, n int"


def _matrix(column: pa.Array, width: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.zeros((0, 0), width)
    dim, rest = divmod(len(flat), len(column))
    if rest:
        raise ValueError("vectors of one column must have the same length")
    return flat.reshape(len(column), dim).astype(width, copy=False)


def _block(part: pa.RecordBatch, width: str) -> dict[str, pa.Array]:
    """One packed row of the rows (id, vector) of ``part``."""
    mat = _matrix(part.column(1), width)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", part.column(0).type)])) as writer:
        writer.write_batch(pa.record_batch([part.column(0)], names=["id"]))
    return {
        "ids": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        "mat": pa.array([np.ascontiguousarray(mat).tobytes()], pa.binary()),
        "dim": pa.array([mat.shape[1]], pa.int32()),
        "n": pa.array([mat.shape[0]], pa.int32()),
    }


def _pack_batches(width: str, rows: int):
    def pack(batches):
        seq = 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield pa.record_batch({"seq": pa.array([seq], pa.int64()), **_block(batch.slice(start, rows), width)})
                seq += 1

    return pack


def _pack_by_key(width: str, rows: int):
    """Blocks of (id, vector, key) that hold one key each; a key's rows are gathered over the batches of a task."""

    def pack(batches):
        held: dict[str, list[pa.RecordBatch]] = {}

        def blocks(key, least):
            parts = held.pop(key)
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            for start in range(0, whole.num_rows, rows):
                part = whole.slice(start, rows)
                if part.num_rows < least:
                    held[key] = [part]
                else:
                    yield pa.record_batch({"key": pa.array([key], pa.string()), **_block(part, width)})

        for batch in batches:
            keys = np.array(batch.column(2).to_pylist(), object)
            data = batch.select([0, 1])
            for key in dict.fromkeys(keys.tolist()):
                held.setdefault(key, []).append(data.take(pa.array(np.flatnonzero(keys == key))))
                if sum(b.num_rows for b in held[key]) >= rows:
                    yield from blocks(key, rows)
        for key in list(held):
            yield from blocks(key, 1)

    return pack


def _width(df: DataFrame, vector: str) -> str:
    element = df.schema[vector].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def pack_blocks(df: DataFrame, key: str, vector: str, width: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: the ids and the row-major matrix as bytes.

    A block never holds more than ``rows`` vectors.
    """
    packed = df.select(key, vector).mapInArrow(_pack_batches(width, rows), _PACKED)
    # Spread blocks evenly by the hash of their content, which a re-run repeats.
    return packed.withColumn("tag", F.xxhash64("ids"))


def _unpack_ids(payload) -> np.ndarray:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_all().column(0).to_numpy()


class _Group:
    """Running top k of one query group over the pool blocks seen so far."""

    def __init__(self, k: int, metric: str, digits: int = DIGITS):
        self.k, self.metric, self.digits = k, metric, digits
        self.parts, self.names = [], []
        self.q64 = None

    def add_queries(self, ids, mat):
        self.names.append(ids)
        self.parts.append(mat)

    def _start(self):
        self.q64 = np.concatenate(self.parts).astype("f8")
        self.names = np.concatenate(self.names)
        self.parts = []
        if self.metric == "cosine":
            self.q64 = _unit(self.q64)
        # zero queries tie with everything: they share one list, the smallest ids of the pool
        zero = np.zeros(len(self.q64), bool) if self.metric == "l2" else ~self.q64.any(1)
        self.zeros, self.smallest = self.names[zero], np.empty(0, object)
        self.names, self.q64 = self.names[~zero], self.q64[~zero]
        self.squares = np.einsum("ij,ij->i", self.q64, self.q64)
        # doubles beyond the range of single precision are multiplied as they are
        self.narrow = self.metric == "cosine" or _fits(self.squares)
        if self.narrow:
            self.q32 = self._factors(self.q64).astype("f4")
        n = len(self.q64)
        self.scores = np.full((n, self.k), -np.inf)
        self.ids = np.empty((n, self.k), object)
        self.floor = np.full(n, -np.inf)

    def _factors(self, queries):
        """Left factor of the product that orders a pool block; for l2 one more column takes up the pool's squares."""
        return np.hstack([queries, np.ones((len(queries), 1))]) if self.metric == "l2" else queries

    def add_pool(self, ids, mat):
        if self.q64 is None:
            if not self.parts:
                return
            self._start()
        ids, mat = self._without_spare_copies(ids, mat)
        p64 = mat.astype("f8")
        if self.metric == "cosine":
            p64 = _unit(p64)
        squares = np.einsum("ij,ij->i", p64, p64)
        right = np.hstack([p64, -squares[:, None] / 2]) if self.metric == "l2" else p64
        # A single-precision product finds the candidates; the margin covers its
        # rounding error and the final rounding, then exact scores decide.
        narrow = self.narrow and (self.metric == "cosine" or _fits(squares))
        margin = max(1e-5, 10.0**-self.digits)
        if narrow:
            longest = np.sqrt(np.nanmax(squares, initial=0.0))
            size = np.sqrt(self.squares) * longest + (longest**2 / 2 if self.metric == "l2" else 0)
            margin = margin + 2.0**-21 * (p64.shape[1] + 4) * size
            right = right.astype("f4")
        margin = np.broadcast_to(margin, len(self.q64))
        _, rank = np.unique(ids, return_inverse=True)
        if len(self.zeros):
            sound = np.flatnonzero(np.isfinite(p64).all(1))
            self._add_smallest(ids[sound[np.argsort(rank[sound], kind="stable")[: self.k]]])
        for start in range(0, len(self.q64), STRIP_ROWS):
            strip = slice(start, start + STRIP_ROWS)
            left = self.q32[strip] if narrow else self._factors(self.q64[strip])
            self._add_strip(strip, left @ right.T, margin[strip], ids, rank, p64)

    def _add_strip(self, strip: slice, rough, margin, ids, rank, p64):
        """Meet the queries of ``strip`` with a pool block; only their products ``rough`` are held at once."""
        n = rough.shape[1]
        if not n:
            return
        floor = self.floor[strip]
        if self.metric == "l2":  # rough is half the score, without the query's own square
            floor = (floor + self.squares[strip]) / 2
        lower = lambda cut: np.nextafter(cut.astype(rough.dtype), rough.dtype.type(-np.inf))[:, None]
        least = lower(floor - margin)
        # After the first blocks few queries find a candidate; a product that is no number hides none.
        rows = np.flatnonzero(~(rough.max(axis=1) < least[:, 0]))
        if not len(rows):
            return
        rough, floor, margin = rough[rows], floor[rows], margin[rows]
        hits = rough >= least[rows]
        # Rows that still pass many candidates (the first blocks) get a tighter
        # cut: the k-th best of this block alone.
        if n > self.k and np.count_nonzero(hits) > 2 * self.k:
            wide = np.flatnonzero(np.count_nonzero(hits, axis=1) > 2 * self.k)
            if len(wide):
                kth = np.partition(rough[wide], n - self.k, axis=1)[:, n - self.k]
                hits[wide] &= rough[wide] >= lower(np.fmax(floor[wide], kth) - margin[wide])
        qi, pi = np.divmod(np.flatnonzero(hits), n)
        if not len(qi):
            return
        qi = rows[qi] + strip.start
        exact = np.empty(len(qi))
        step = 65_536
        for a in range(0, len(qi), step):
            q, p = self.q64[qi[a : a + step]], p64[pi[a : a + step]]
            if self.metric == "l2":
                exact[a : a + step] = -((q - p) ** 2).sum(1)
            else:
                exact[a : a + step] = np.einsum("ij,ij->i", q, p)
        exact = np.round(exact, self.digits) + 0.0
        # What cannot enter the lists goes first; ties with the current last
        # place only count for a smaller id.
        useful = exact > self.floor[qi]
        tied = np.flatnonzero((exact == self.floor[qi]) & np.isfinite(exact))
        if len(tied):
            useful[tied] = (ids[pi[tied]].astype(object) < self.ids[qi[tied], self.k - 1]).astype(bool)
        qi, pi, exact = qi[useful], pi[useful], exact[useful]
        # The block's own top k per query, on integer id ranks.
        order = np.lexsort((rank[pi], -exact, qi))
        qi, pi, exact = qi[order], pi[order], exact[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < self.k
        if best.any():
            self._merge(qi[best], exact[best], ids[pi[best]])

    def _add_smallest(self, ids):
        merged = np.concatenate([self.smallest, ids.astype(object)])
        _, rank = np.unique(merged, return_inverse=True)
        self.smallest = merged[np.argsort(rank, kind="stable")[: self.k]]

    def _without_spare_copies(self, ids, mat):
        """Of equal vectors only the k smallest ids can be among the best k.

        All copies score the same for every query and ties go to the smaller
        id, so this leaves every result unchanged however many copies there are.
        """
        rows = np.ascontiguousarray(mat)
        rows = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        distinct, same = np.unique(rows, return_inverse=True)
        if len(rows) - len(distinct) < self.k:
            return ids, mat
        _, rank = np.unique(ids, return_inverse=True)
        order = np.lexsort((rank, same))
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order], side="left")
        keep = np.sort(order[place < self.k])
        return ids[keep], mat[keep]

    def _merge(self, qi, scores, ids):
        """Merge new candidates into the lists of the queries they belong to."""
        rows = np.unique(qi)
        old_r, old_c = np.nonzero(np.isfinite(self.scores[rows]))
        q = np.concatenate([rows[old_r], qi])
        s = np.concatenate([self.scores[rows[old_r], old_c], scores])
        d = np.concatenate([self.ids[rows[old_r], old_c], ids.astype(object)])
        order = np.lexsort((-s, q))
        q, s, d = q[order], s[order], d[order]
        # only ids of equal scores are compared
        same = np.flatnonzero((q[1:] == q[:-1]) & (s[1:] == s[:-1]))
        if len(same):
            tied = np.union1d(same, same + 1)
            _, rank = np.unique(d[tied], return_inverse=True)
            d[tied] = d[tied][np.lexsort((rank, -s[tied], q[tied]))]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        q, s, d, place = q[keep], s[keep], d[keep], place[keep]
        self.scores[rows] = -np.inf
        self.scores[q, place] = s
        self.ids[q, place] = d
        self.floor[rows] = self.scores[rows, self.k - 1]

    def result(self):
        if self.q64 is None:
            return None
        q, place = np.nonzero(np.isfinite(self.scores))
        names = np.concatenate([self.names[q], np.repeat(self.zeros, len(self.smallest))])
        ids = np.concatenate([self.ids[q, place], np.tile(self.smallest, len(self.zeros))])
        scores = np.concatenate([self.scores[q, place], np.zeros(len(ids) - len(q))])
        return (names, ids, scores) if len(names) else None


def _fits(squares: np.ndarray) -> bool:
    """Whether vectors of these squared lengths can be multiplied in single precision."""
    return bool((squares < 1e30).all())


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    norm[norm == 0] = 1.0
    return m / norm


def _found_rows(group, qtype: pa.DataType, dtype: pa.DataType):
    found = group.result() if group else None
    if found is None:
        return
    q, d, s = found
    for a in range(0, len(q), 50_000):
        yield pa.record_batch(
            {
                "qid": pa.array(list(q[a : a + 50_000]), qtype),
                "did": pa.array(list(d[a : a + 50_000]), dtype),
                "score": pa.array(s[a : a + 50_000], pa.float64()),
            }
        )


def _search_sent(k: int, metric: str, width: str, digits: int, qtype: pa.DataType, dtype: pa.DataType, shared):
    """Search of the pool blocks of a task for one group of queries sent to it."""

    def search(batches):
        group = _Group(k, metric, digits)
        for ids, mat in shared.value:
            group.add_queries(ids, mat)
        for batch in batches:
            dim, n = batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            for i in range(batch.num_rows):
                ids = _unpack_ids(batch.column("ids")[i].as_buffer())
                group.add_pool(ids, np.frombuffer(batch.column("mat")[i].as_buffer(), width).reshape(n[i], dim[i]))
        yield from _found_rows(group, qtype, dtype)

    return search


def _search_batches(k: int, metric: str, width: str, digits: int, qtype: pa.DataType, dtype: pa.DataType):
    def search(batches):
        current, group = None, None
        for batch in batches:
            side, slot, grp, dim, n = (batch.column(c).to_numpy() for c in ("side", "slot", "grp", "dim", "n"))
            for i in range(batch.num_rows):
                key = (slot[i], grp[i])
                if key != current:
                    yield from _found_rows(group, qtype, dtype)
                    current, group = key, _Group(k, metric, digits)
                ids = _unpack_ids(batch.column("ids")[i].as_buffer())
                mat = np.frombuffer(batch.column("mat")[i].as_buffer(), width).reshape(n[i], dim[i])
                if side[i] == 0:
                    # queries outlive their Arrow batch
                    group.add_queries(ids.copy(), mat.copy())
                else:
                    group.add_pool(ids, mat)
        yield from _found_rows(group, qtype, dtype)

    return search


def blocked_top_k(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    query_id: str = "qid",
    query_vector: str = "embedding",
    pool_id: str = "did",
    pool_vector: str = "embedding",
    metric: str = "cosine",
    slices: int | None = None,
    group_rows: int = GROUP_ROWS,
    digits: int = DIGITS,
    n_queries: int | None = None,
    packed_pool: DataFrame | None = None,
    n_pool: int | None = None,
) -> DataFrame:
    """(query id, pool id, score, rank): the k best pool rows per query.

    ``metric``: ``cosine`` (inner product of unit vectors), ``ip`` or ``l2``
    (negative squared distance).  Scores are rounded to ``digits``; ties go to
    the smaller id.  Up to ``group_rows`` queries of measured size are sent to
    the pool's own tasks and the pool is not shuffled.  More are cut into groups
    and the pool into ``slices`` (default: by its size, at most the session's
    shuffle partitions and what keeps all cores busy); a group has fewer than ``group_rows`` rows and one block.
    ``n_queries`` is kept for callers that know it; the packed blocks are counted.
    ``packed_pool`` holds the pool's blocks where ``pack_pool`` has stored them.
    ``n_pool``, the rows of the pool, spares a count that would compute vectors; it decides the slices, no result.
    """
    spark = queries.sparkSession
    width = max(_width(queries, query_vector), _width(pool, pool_vector))
    from pyspark.sql.pandas.types import to_arrow_type

    qt, dt = queries.schema[query_id].dataType, pool.schema[pool_id].dataType
    types = (to_arrow_type(qt), to_arrow_type(dt))
    schema = T.StructType(
        [T.StructField("qid", qt), T.StructField("did", dt), T.StructField("score", T.DoubleType())]
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    packed = materialize(pack_blocks(queries, query_id, query_vector, width, min(BLOCK_ROWS, group_rows)), "query-blocks")
    blocks, n_queries, entries = packed.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n").cast("long") * F.col("dim"))).first()
    p = packed_pool if packed_pool is not None else pack_blocks(pool, pool_id, pool_vector, width)
    if not slices and (n_queries or 0) <= group_rows and (entries or 0) * 8 <= SENT_BYTES:
        # one group of a measured size travels to the pool, which stays where it is read
        rows = [(_unpack_ids(r["ids"]).copy(), np.frombuffer(r["mat"], width).reshape(r["n"], r["dim"])) for r in packed.orderBy("tag").collect()]
        shared = spark.sparkContext.broadcast(rows)
        partial = p.select("ids", "mat", "dim", "n").mapInArrow(_search_sent(k, metric, width, digits, *types, shared), schema)
    else:
        groups, placed = _query_groups(packed, group_rows, blocks or 0)
        slices = slices or _pool_slices(pool, int(spark.conf.get("spark.sql.shuffle.partitions")), groups, n_pool)
        q = placed.select(
            F.lit(0).alias("side"),
            "grp",
            F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slot"),
            "ids",
            "mat",
            "dim",
            "n",
        )
        p = p.select(
            F.lit(1).alias("side"),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
            F.pmod("tag", F.lit(slices)).cast("int").alias("slot"),
            "ids",
            "mat",
            "dim",
            "n",
        )
        # One partition per (slice, group): direct ids avoid collisions of a hash.
        target = F.col("slot") * groups + F.col("grp")
        met = q.unionByName(p).repartitionById(slices * groups, target).sortWithinPartitions("slot", "grp", "side")
        partial = met.mapInArrow(_search_batches(k, metric, width, digits, *types), schema)
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(query_id), F.col("did").alias(pool_id), "score", "rank")


_KEYED = "key string, ids binary, mat binary, dim int, n int"


def _search_sent_keyed(searches, metric: str, width: str, digits: int, qtype, dtype, shared):
    """Pool blocks of a task, each met by the queries of the searches of its pool."""

    def search(batches):
        groups: dict[str, _Group] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                pool, dim, n = (batch.column(c)[row].as_py() for c in ("key", "dim", "n"))
                ids = _unpack_ids(batch.column("ids")[row].as_buffer())
                mat = np.frombuffer(batch.column("mat")[row].as_buffer(), width).reshape(n, dim)
                for name, qset, k in searches.get(pool, ()):
                    if name not in groups:
                        groups[name] = _Group(k, metric, digits)
                        for q in shared.value.get(qset, ()):
                            groups[name].add_queries(*q)
                    groups[name].add_pool(ids, mat)
        for name, group in groups.items():
            yield from _tagged(_found_rows(group, qtype, dtype), name, group.k)

    return search


def _tagged(batches, name: str, k: int):
    for batch in batches:
        n = batch.num_rows
        more = [pa.array([name] * n, pa.string()), pa.array([k] * n, pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "search", "k"])


def _search_cells(metric: str, width: str, digits: int, qtype, dtype):
    """Rows sorted by (cell, side): the queries of a cell, then the pool blocks it meets."""

    def search(batches):
        current, name, group = None, None, None
        for batch in batches:
            side, cell, dim, n, k = (batch.column(c).to_numpy() for c in ("side", "cell", "dim", "n", "k"))
            for i in range(batch.num_rows):
                if cell[i] != current:
                    if group:
                        yield from _tagged(_found_rows(group, qtype, dtype), name, group.k)
                    current, name, group = cell[i], batch.column("search")[i].as_py(), _Group(int(k[i]), metric, digits)
                ids = _unpack_ids(batch.column("ids")[i].as_buffer())
                mat = np.frombuffer(batch.column("mat")[i].as_buffer(), width).reshape(n[i], dim[i])
                if side[i] == 0:
                    group.add_queries(ids.copy(), mat.copy())
                else:
                    group.add_pool(ids, mat)
        if group:
            yield from _tagged(_found_rows(group, qtype, dtype), name, group.k)

    return search


def top_k_of_pools(
    queries: DataFrame,
    pools: DataFrame,
    searches: DataFrame,
    metric: str = "cosine",
    group_rows: int = GROUP_ROWS,
    sent_bytes: int = SENT_BYTES,
    slice_rows: int = 8 * BLOCK_ROWS,
    digits: int = DIGITS,
) -> DataFrame:
    """Exact top k of many (query set, pool) pairs in one job: (search, qid, did, score, rank).

    ``queries`` has qset, qid and embedding, ``pools`` pool, did and embedding,
    ``searches`` (configuration) search, qset, pool and k.  Blocks carry the name of
    their set or pool; a pool block meets the query groups of the searches of its
    pool and no others, so neither the plan nor the number of jobs depends on the
    number of searches.  Few queries travel to the pools, which are then not
    shuffled; else every (search, query group, pool slice) is a cell of its own.
    """
    spark = queries.sparkSession
    width = max(_width(queries, "embedding"), _width(pools, "embedding"))
    from pyspark.sql.pandas.types import to_arrow_type

    qt, dt = queries.schema["qid"].dataType, pools.schema["did"].dataType
    types = (to_arrow_type(qt), to_arrow_type(dt))
    fields = [("qid", qt), ("did", dt), ("score", T.DoubleType()), ("search", T.StringType()), ("k", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    searches = searches.select(F.col("search").cast("string"), "qset", "pool", F.col("k").cast("int"))
    pack = lambda df, key, row, rows: df.select(row, "embedding", key).mapInArrow(_pack_by_key(width, rows), _KEYED)
    q = materialize(pack(queries, "qset", "qid", min(BLOCK_ROWS, group_rows)).withColumn("tag", F.xxhash64("ids")), "query-blocks")
    asked = q.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("long") * F.col("dim")).alias("entries"))
    used = F.broadcast(searches).join(asked, searches["qset"] == asked["key"])
    total, entries = used.agg(F.sum("rows"), F.sum("entries")).first()
    p = pack(pools, "pool", "did", BLOCK_ROWS)
    if (total or 0) <= group_rows and (entries or 0) * 8 <= sent_bytes:
        by_pool: dict[str, list] = {}
        for r in searches.collect():  # configuration
            by_pool.setdefault(r.pool, []).append((r.search, r.qset, r.k))
        sent: dict[str, list] = {}
        for r in q.orderBy("key", "tag").collect():  # of measured size
            sent.setdefault(r.key, []).append((_unpack_ids(r.ids).copy(), np.frombuffer(r.mat, width).reshape(r.n, r.dim)))
        shared = spark.sparkContext.broadcast(sent)
        partial = p.mapInArrow(_search_sent_keyed(by_pool, metric, width, digits, *types, shared), schema)
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("tag").rowsBetween(Window.unboundedPreceding, -1))
        # one row per block: groups of consecutive blocks
        grouped = q.select("key", "tag", "n").withColumn("grp", F.floor(F.coalesce(before, F.lit(0)) / group_rows).cast("int"))
        grouped = materialize(grouped.select("key", "tag", "grp").distinct(), "groups")
        sizes = pools.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"))
        sizes = sizes.select("pool", F.least(F.lit(parts), F.ceil(F.col("rows") / slice_rows)).cast("int").alias("slices"))
        sets = grouped.groupBy(F.col("key").alias("qset")).agg((F.max("grp") + 1).alias("groups"))
        # one row per search
        enough = F.ceil(F.lit(_cells(spark)) / F.col("groups")).cast("int")
        cells = searches.join(sets, "qset").join(sizes, "pool").withColumn("slices", F.least("slices", enough))
        cells = cells.withColumn("cells", F.col("groups") * F.col("slices"))
        upto = F.sum("cells").over(Window.orderBy("search"))
        cells = materialize(cells.withColumn("first", upto - F.col("cells")), "cells")
        n_cells = cells.agg(F.sum("cells")).first()[0] or 1
        place = (F.col("first") + F.col("slot") * F.col("groups") + F.col("grp")).cast("int").alias("cell")
        row = ["search", "k", place, "ids", "mat", "dim", "n"]
        c = F.broadcast(cells)
        left = q.join(grouped, ["key", "tag"]).join(c, F.col("key") == c["qset"])
        left = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(F.lit(0).alias("side"), *row)
        right = p.withColumn("tag", F.xxhash64("ids")).join(c, F.col("key") == c["pool"])
        right = right.withColumn("slot", F.pmod("tag", F.col("slices"))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        met = left.unionByName(right.select(F.lit(1).alias("side"), *row))
        # cells are numbered through, so they are dealt evenly
        many = min(int(n_cells), 4 * parts)
        met = met.repartitionById(many, F.pmod("cell", F.lit(many))).sortWithinPartitions("cell", "side")
        partial = met.mapInArrow(_search_cells(metric, width, digits, *types), schema)
    best = Window.partitionBy("search", "qid").orderBy(F.desc("score"), "did")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("k"))
    return ranked.select("search", "qid", "did", "score", "rank")


def pack_pool(
    pool: DataFrame, queries: DataFrame, pool_id: str = "did", pool_vector: str = "embedding", query_vector: str = "embedding"
) -> DataFrame:
    """Blocks of a pool, written once, for many searches by vectors like those of ``queries``."""
    width = max(_width(queries, query_vector), _width(pool, pool_vector))
    return materialize(pack_blocks(pool, pool_id, pool_vector, width), "pool-blocks")


def _query_groups(packed: DataFrame, group_rows: int, blocks: int) -> tuple[int, DataFrame]:
    """Blocks with their group: consecutive blocks until a group holds ``group_rows`` rows.

    Only (tag, n) of the blocks is ordered globally, one row per block.
    """
    before = F.sum("n").over(Window.orderBy("tag").rowsBetween(Window.unboundedPreceding, -1))
    start = packed.select("tag", "n").withColumn("before", F.coalesce(before, F.lit(0)))
    grouped = materialize(start.select("tag", F.floor(F.col("before") / group_rows).cast("int").alias("grp")).distinct(), "groups")
    groups = 1 + (grouped.agg(F.max("grp")).first()[0] or 0)
    return groups, packed.join(grouped, "tag")


def _cells(spark) -> int:
    """Cells of (query group, pool slice) that keep all cores busy."""
    return max(LEAST_CELLS, 4 * spark.sparkContext.defaultParallelism)


def _pool_slices(pool: DataFrame, most: int, groups: int, n_pool: int | None = None) -> int:
    """Slices of a pool: one for a few blocks, at most ``most``, and no more than keep all cores busy and a cell small.

    Every slice adds k rows per query to the shuffle after the kernel, and every cell
    starts without a list.  The more groups there are, the fewer slices it takes.
    """
    rows = pool.count() if n_pool is None else n_pool
    enough = min(-(-rows // (8 * BLOCK_ROWS)), -(-_cells(pool.sparkSession) // groups))
    return max(1, min(most, max(enough, -(-rows // CELL_ROWS))))


def row_dot(a: str, b: str):
    """Inner product of two vector columns on Arrow batches (bulk path)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def kernel(x: pa.Array, y: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.einsum("ij,ij->i", _matrix(x, "<f8"), _matrix(y, "<f8")))

    return kernel(F.col(a), F.col(b))


def row_cosine(a: str, b: str):
    """Cosine of two vector columns on Arrow batches (bulk path)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def kernel(x: pa.Array, y: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.float64())
        return pa.array(np.einsum("ij,ij->i", _unit(_matrix(x, "<f8")), _unit(_matrix(y, "<f8"))))

    return kernel(F.col(a), F.col(b))


__all__ = ["blocked_top_k", "pack_blocks", "pack_pool", "row_cosine", "row_dot", "top_k_of_pools"]
