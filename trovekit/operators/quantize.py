"""Residual quantisation: train codebooks, encode vectors, diagnose codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovekit import constants as K
from trovekit.functions.codes import same_levels
from trovekit.functions.stable import SEED
from trovekit.functions.vectors import mean_squared_error, normalize
from trovekit.operators.blocks import _matrix, _unit, blocked_top_k
from trovekit.operators.numbering import number_by_hash
from trovekit.operators.skew import chunked_changes, chunked_running_sum, lookup_join
from trovekit.session import materialize, release

BROADCAST_BYTES = 256 * 1024 * 1024
#: vectors of a group and centroids of a slice that meet in a task
GROUP_ROWS = 16_384
SLICE_ROWS = 1_024


def codebook_bytes(codebooks: DataFrame) -> int:
    """Size of the codebooks as a double-precision matrix."""
    row = codebooks.agg(F.sum(F.size("centroid").cast("long") * 8 + 8)).first()
    return int(row[0] or 0)


def codebook_levels(codebooks: DataFrame, limit: int = BROADCAST_BYTES) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Per level the codes in order and their centroids; None beyond the size limit.

    Codes need not be 0, 1, ...: a level may have gaps.
    """
    if codebook_bytes(codebooks) > limit:
        return None
    table = codebooks.select("level", "code", "centroid").toArrow().combine_chunks()
    level, code = table["level"].to_numpy(), table["code"].to_numpy()
    centroids = _matrix(table["centroid"].combine_chunks(), "<f8")
    books = []
    for current in np.unique(level):
        mine = np.flatnonzero(level == current)
        mine = mine[np.argsort(code[mine])]
        books.append((code[mine], centroids[mine]))
    return books


DISTANCE_DIGITS = 12


def _nearest(residual: np.ndarray, book: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Row of the nearest centroid: squared distance, rounded to twelve digits, ties to the first row.

    A matrix product finds the rows that can win; where there are several, their
    directly computed distances decide, as they do in the joined form.
    """
    norms = (book * book).sum(1)
    out = np.empty(len(residual), "i8")
    for a in range(0, len(residual), rows):
        part = residual[a : a + rows]
        rough = norms[None, :] - 2 * (part @ book.T)
        out[a : a + rows] = rough.argmin(1)
        close = rough <= rough.min(1, keepdims=True) + 1e-9 * (1 + norms.max(initial=0.0))
        for i in np.flatnonzero(close.sum(1) > 1):
            options = np.flatnonzero(close[i])
            exact = np.round(((part[i] - book[options]) ** 2).sum(1), DISTANCE_DIGITS)
            out[a + i] = options[exact.argmin()]
    return out


def _list_array(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype="i4")
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), kind))


def encode_codes(
    vectors: DataFrame,
    codebooks: DataFrame,
    key: str = "did",
    vector: str = "embedding",
    limit: int = BROADCAST_BYTES,
    group_rows: int = GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(key, code, quant): nearest centroid per level on the residual.

    Vectors are normalised first; ``quant`` is the normalised sum of the chosen
    centroids.  Codebooks within ``limit`` bytes travel with the tasks and the
    whole pass is one scan; the slices of larger ones stream past groups of vectors.
    """
    books = codebook_levels(codebooks, limit)
    if books is None:
        return _encode_streamed(vectors, codebooks, key, vector, group_rows, slice_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    key_type = vectors.schema[key].dataType

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            residual = _unit(_matrix(batch.column(1), "<f8"))
            total = np.zeros_like(residual)
            codes = []
            for names, book in shared.value:
                row = _nearest(residual, book)
                total += book[row]
                residual = residual - book[row]
                codes.append(names[row])
            yield pa.record_batch(
                [batch.column(0), _list_array(np.stack(codes, 1), pa.int32()), _list_array(_unit(total), pa.float64())],
                names=[key, "code", "quant"],
            )

    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("code", T.ArrayType(T.IntegerType())),
            T.StructField("quant", T.ArrayType(T.DoubleType())),
        ]
    )
    return vectors.select(key, vector).mapInArrow(run, schema)


# -- codebooks too large to send -------------------------------------------------


def stream_slices(codebooks: DataFrame, groups: int, rows: int = SLICE_ROWS) -> DataFrame:
    """Slices of up to ``rows`` centroids, each sent to every group: grp, side 1, level, slice, codes, flat.

    A slice is a range of codes, so within a level slices rise with the codes.
    """
    numbered = codebooks.select("level", "code", "centroid", F.floor(F.col("code") / rows).cast("int").alias("slice"))
    held = numbered.groupBy("level", "slice").agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("c"))
    return held.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
        F.lit(1).alias("side"),
        "level",
        "slice",
        F.transform("c", lambda x: x["code"]).alias("codes"),
        F.flatten(F.transform("c", lambda x: x["centroid"])).alias("flat"),
    )


def met_by_group(rows: DataFrame, slices: DataFrame, groups: int, columns: list[str]) -> DataFrame:
    """Rows of each group, then the slices in order, in one partition per group."""
    names = ["grp", "side", "level", "slice", *columns, "codes", "flat"]
    one = rows.select("grp", F.lit(0).alias("side"), F.lit(-1).alias("level"), F.lit(-1).alias("slice"), *columns)
    both = one.unionByName(slices, allowMissingColumns=True).select(*names)
    return both.repartitionById(groups, "grp").sortWithinPartitions("grp", "side", "level", "slice")


def slices_of(batches, new):
    """Drive a stream of ``met_by_group``: ``new()`` makes the state of a group, which gets the
    group's rows by ``add``, then each slice by ``slice``, and yields its output at its ``end``."""
    current, state = None, None
    for batch in batches:
        grp, side, level = (batch.column(c).to_numpy() for c in ("grp", "side", "level"))
        edges = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if grp[lo] != current:
                if state is not None:
                    yield from state.end()
                current, state = grp[lo], new()
            if side[lo] == 0:
                state.add(batch.slice(lo, hi - lo))
                continue
            for i in range(lo, hi):
                codes = batch.column("codes").slice(i, 1).flatten().to_numpy()
                flat = batch.column("flat").slice(i, 1).flatten().to_numpy()
                state.slice(int(level[i]), codes, flat.reshape(len(codes), -1))
    if state is not None:
        yield from state.end()


def _groups(rows: DataFrame, group_rows: int) -> int:
    return max(1, -(-rows.count() // group_rows))


class _Encoding:
    """Vectors of a group; centroids pass by level after level, with a running nearest one."""

    def __init__(self, key: str):
        self.key, self.parts, self.level = key, [], None
        self.codes: list[np.ndarray] = []

    def add(self, batch):
        self.parts.append((batch.column(self.key), _unit(_matrix(batch.column("vector"), "<f8"))))

    def slice(self, level, codes, centroids):
        if not self.parts:
            return  # no vector fell into the group
        if level != self.level:
            self._settle()
            if self.level is None:
                self.rest = np.concatenate([m for _, m in self.parts])
                self.total = np.zeros_like(self.rest)
            self.level = level
            self.best, self.choice, self.near = np.full(len(self.rest), np.inf), np.zeros(len(self.rest), "i8"), np.zeros_like(self.rest)
        row = _nearest(self.rest, centroids)
        away = np.round(((self.rest - centroids[row]) ** 2).sum(1), DISTANCE_DIGITS)
        nearer = away < self.best  # codes rise, so a tie stays with the smaller one
        self.best[nearer], self.choice[nearer], self.near[nearer] = away[nearer], codes[row[nearer]], centroids[row[nearer]]

    def _settle(self):
        if self.level is not None:
            self.codes.append(self.choice)
            self.total += self.near
            self.rest = self.rest - self.near

    def end(self):
        self._settle()
        if self.parts and self.codes:
            keys = pa.chunked_array([k for k, _ in self.parts]).combine_chunks()
            yield pa.record_batch([keys, _list_array(np.stack(self.codes, 1), pa.int32()), _list_array(_unit(self.total), pa.float64())], names=[self.key, "code", "quant"])


def _encode_streamed(vectors: DataFrame, codebooks: DataFrame, key: str, vector: str, group_rows: int, slice_rows: int) -> DataFrame:
    """The same result for codebooks too large to send to every task: one shuffle for all levels.

    Vectors lie in groups; the slices of all levels pass each group once, and what a
    level leaves of a vector stays in the task.
    """
    rows = materialize(vectors.select(key, F.col(vector).alias("vector")), "encode")
    groups = _groups(rows, group_rows)
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    met = met_by_group(dealt, stream_slices(codebooks, groups, slice_rows), groups, [key, "vector"])
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, code array<int>, quant array<double>"
    return met.mapInArrow(lambda batches: slices_of(batches, lambda: _Encoding(key)), schema)


def _encode_by_search(vectors: DataFrame, codebooks: DataFrame, key: str, vector: str) -> DataFrame:
    """The same by one search per level; the streamed form is tested against it."""
    levels = [r[0] for r in codebooks.select("level").distinct().orderBy("level").collect()]
    state = vectors.select(
        key,
        normalize(vector).alias("residual"),
        F.transform(vector, lambda x: F.lit(0.0)).alias("total"),
        F.array().cast("array<int>").alias("code"),
    )
    for level in levels:
        book = codebooks.where(F.col("level") == level).select(F.col("code").alias("choice"), "centroid")
        best = blocked_top_k(
            state,
            book,
            1,
            query_id=key,
            query_vector="residual",
            pool_id="choice",
            pool_vector="centroid",
            metric="l2",
            digits=DISTANCE_DIGITS,
        ).select(key, "choice")
        chosen = lookup_join(best, book, "choice")
        state = state.join(chosen, key).select(
            key,
            F.zip_with("residual", "centroid", lambda r, c: r - c).alias("residual"),
            F.zip_with("total", "centroid", lambda t, c: t + c).alias("total"),
            F.concat("code", F.array("choice")).alias("code"),
        )
        done, state = state, materialize(state, "encode")
        release(done)
    return state.select(key, "code", normalize("total").alias("quant"))


def train_codebooks(
    vectors: DataFrame,
    sizes: list[int] | None = None,
    vector: str = "embedding",
    seed: int = 2023,
    iterations: int = 20,
) -> DataFrame:
    """(level, code, centroid): k-means per level on what the levels before left.

    ``sizes`` is the number of codes per level (default: one per modality, then the
    reported configuration's vocabulary at every level).  Residuals are written once per level, so a lost executor
    never replays earlier levels.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from trovekit import schemas

    spark = vectors.sparkSession
    sizes = sizes or [len(K.MODALITY_CODES)] + [K.CODE_VOCABULARY] * K.CODE_LEVELS
    residual = materialize(vectors.select(normalize(vector).alias("residual")), "residual")
    books = []
    for level, size in enumerate(sizes):
        features = residual.select(array_to_vector("residual").alias("features"))
        model = KMeans(k=size, seed=seed + level, maxIter=iterations, initMode="k-means||").fit(features)
        # k-means may return fewer centres than asked for; codes stay dense.
        centers = np.array(model.clusterCenters())
        books.append(
            pa.table(
                {
                    "level": pa.array(np.full(len(centers), level, "i4")),
                    "code": pa.array(np.arange(len(centers), dtype="i4")),
                    "centroid": _list_array(centers, pa.float64()),
                }
            )
        )
        if level + 1 < len(sizes):
            done, residual = residual, materialize(_subtract_nearest(residual, centers), "residual")
            release(done)
    release(residual)
    return spark.createDataFrame(pa.concat_tables(books), schemas.CODEBOOK)


# -- upkeep ----------------------------------------------------------------------


def codebook_state(codebooks: DataFrame, size: float = 1.0) -> DataFrame:
    """(level, code, size, total): running averages that begin at given centroids, each as if it had ``size`` vectors."""
    total = F.transform("centroid", lambda x: x * F.lit(float(size)))
    return codebooks.select("level", "code", F.lit(float(size)).alias("size"), total.alias("total"))


def state_codebooks(state: DataFrame) -> DataFrame:
    """(level, code, centroid) of running averages."""
    return state.select("level", "code", F.transform("total", lambda x: x / F.col("size")).alias("centroid"))


def update_codebooks(
    state: DataFrame,
    vectors: DataFrame,
    key: str = "did",
    vector: str = "embedding",
    decay: float = 0.8,
    least: float = 2.0,
    seed: int | str = SEED,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """One mini-batch of upkeep: running averages of every code, and codes that have died begin anew.

    Each vector of the batch goes to its nearest centroid level by level, on what the
    levels before left.  ``size`` and ``total`` of a code decay and take in the number
    and the sum of what came to it.  A code whose size falls under ``least`` takes the
    place of a vector of the batch at its level, with that size; the vectors are the
    first in hash order of their ids, one for each dead code of a level in the order of
    codes.  Codes for which the batch has no vector stay.  The codebooks of a state
    must be within ``limit`` bytes.
    """
    books = codebook_levels(state_codebooks(state), limit)
    if books is None:
        raise ValueError("the codebooks are larger than the limit")
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def levels_of(m):
        """(level, rows of the book, what was left before it) of unit vectors."""
        rest = m
        for level, (names, book) in enumerate(shared.value):
            row = _nearest(rest, book)
            yield level, names, row, rest
            rest = rest - book[row]

    def sums(batches):
        held = [(np.zeros(len(names), "i8"), np.zeros(book.shape)) for names, book in shared.value]
        for batch in batches:
            if batch.num_rows:
                for level, _, row, rest in levels_of(_unit(_matrix(batch.column(0), "<f8"))):
                    n, total = held[level]
                    n += np.bincount(row, minlength=len(n))
                    np.add.at(total, row, rest)
        for level, (n, total) in enumerate(held):
            used = np.flatnonzero(n)
            if len(used):
                names = shared.value[level][0]
                yield pa.record_batch(
                    [pa.array(np.full(len(used), level, "i4")), pa.array(names[used].astype("i4")), pa.array(n[used]), _list_array(total[used], pa.float64())],
                    names=["level", "code", "n", "part"],
                )

    parts = vectors.select(vector).mapInArrow(sums, "level int, code int, n long, part array<double>")
    # a handful of parts for each code, one per task
    zero = F.transform(F.get("parts", F.lit(0)), lambda x: F.lit(0.0))
    came = parts.groupBy("level", "code").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    came = came.select("level", "code", "n", F.aggregate("parts", zero, lambda a, p: F.zip_with(a, p, lambda x, y: x + y)).alias("sum"))
    taken = lambda old, new: old * F.lit(decay) + new * F.lit(1 - decay)
    joined = state.join(came, ["level", "code"], "left")
    nothing = F.transform("total", lambda x: F.lit(0.0))
    moved = joined.select(
        "level",
        "code",
        taken(F.col("size"), F.coalesce("n", F.lit(0))).alias("size"),
        F.zip_with("total", F.coalesce("sum", nothing), taken).alias("total"),
    )
    moved = materialize(moved, "upkeep")
    dead = moved.where(F.col("size") < least).withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("code")))
    most = dead.agg(F.max("place")).first()[0]
    if most is None:
        return moved

    def rests(batches):
        for batch in batches:
            if batch.num_rows:
                for level, _, _, rest in levels_of(_unit(_matrix(batch.column(1), "<f8"))):
                    yield pa.record_batch([pa.array(np.full(len(rest), level, "i4")), batch.column(0), _list_array(rest, pa.float64())], names=["level", "place", "rest"])

    # at most as many vectors as a level has codes
    first = number_by_hash(vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")), "__key", seed, "place", limit=most)
    fresh = first.select(F.col("place").cast("long").alias("place"), "__vector").mapInArrow(rests, "level int, place long, rest array<double>")
    begun = dead.select("level", "code", "place").join(fresh, ["level", "place"]).select("level", "code", "rest")
    joined = moved.join(begun, ["level", "code"], "left")
    return joined.select(
        "level",
        "code",
        F.when(F.col("rest").isNull(), F.col("size")).otherwise(F.lit(float(least))).alias("size"),
        F.when(F.col("rest").isNull(), F.col("total")).otherwise(F.transform("rest", lambda x: x * F.lit(float(least)))).alias("total"),
    )


def _subtract_nearest(residual: DataFrame, centers: np.ndarray) -> DataFrame:
    shared = residual.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), "<f8")
                yield pa.record_batch([_list_array(m - shared.value[_nearest(m, shared.value)], pa.float64())], names=["residual"])

    return residual.mapInArrow(run, residual.schema)


def reconstruct(
    codes: DataFrame,
    codebooks: DataFrame,
    key: str = "did",
    limit: int = BROADCAST_BYTES,
    group_rows: int = GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(key, quant) from codes: normalised sum of the chosen centroids.

    Codebooks within ``limit`` bytes travel with the tasks; the slices of larger
    ones stream past groups of codes.  A code without a centroid adds nothing.
    """
    books = codebook_levels(codebooks, limit)
    if books:
        return _reconstruct_with(codes, books, key)
    rows = materialize(codes.select(key, F.col("code").alias("chosen")), "reconstruct")
    groups = _groups(rows, group_rows)
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    met = met_by_group(dealt, stream_slices(codebooks, groups, slice_rows), groups, [key, "chosen"])
    schema = T.StructType([T.StructField(key, codes.schema[key].dataType), T.StructField("quant", T.ArrayType(T.DoubleType()))])
    return met.mapInArrow(lambda batches: slices_of(batches, lambda: _Adding(key)), schema)


class _Adding:
    """Codes of a group; each takes its centroids as they pass."""

    def __init__(self, key: str):
        self.key, self.parts, self.total = key, [], None

    def add(self, batch):
        self.parts.append((batch.column(self.key), _matrix(batch.column("chosen"), "i8")))

    def slice(self, level, codes, centroids):
        if not self.parts:
            return
        if self.total is None:
            self.code = np.concatenate([c for _, c in self.parts])
            self.total = np.zeros((len(self.code), centroids.shape[1]))
        if level < self.code.shape[1]:
            row = np.minimum(np.searchsorted(codes, self.code[:, level]), len(codes) - 1)
            known = codes[row] == self.code[:, level]
            self.total[known] += centroids[row[known]]

    def end(self):
        if self.total is not None:
            keys = pa.chunked_array([k for k, _ in self.parts]).combine_chunks()
            yield pa.record_batch([keys, _list_array(_unit(self.total), pa.float64())], names=[self.key, "quant"])


def _reconstruct_with(codes: DataFrame, books: list[tuple[np.ndarray, np.ndarray]], key: str) -> DataFrame:
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _matrix(batch.column(1), "i8")
            total = np.zeros((len(code), shared.value[0][1].shape[1]))
            for level, (names, book) in enumerate(shared.value[: code.shape[1]]):
                row = np.minimum(np.searchsorted(names, code[:, level]), len(names) - 1)
                known = names[row] == code[:, level]
                total[known] += book[row[known]]
            yield pa.record_batch([batch.column(0), _list_array(_unit(total), pa.float64())], names=[key, "quant"])

    schema = T.StructType([T.StructField(key, codes.schema[key].dataType), T.StructField("quant", T.ArrayType(T.DoubleType()))])
    return codes.select(key, "code").mapInArrow(run, schema)


def unique_codes(
    coded: DataFrame, position: str = "pos", code: str = "code", vector: str = "embedding", tolerance: float = 1e-5
) -> DataFrame:
    """Append a running number that tells different vectors of one code apart.

    Counts, in position order, the vectors that are not close to the first
    vector of their code; a vector close to the first takes the current count.
    Vectors are compared after scaling to unit length.
    """
    coded = coded.withColumn("__given", F.col(vector)).withColumn(vector, normalize(vector))
    first = coded.groupBy(code).agg(F.min_by(vector, position).alias("__first"))
    joined = lookup_join(coded, first, code)
    apart = F.exists(
        F.zip_with("__first", vector, lambda a, b: F.abs(a - b) > tolerance + 1e-5 * F.abs(b)), lambda x: x
    )
    counted = chunked_running_sum(joined, code, position, apart.cast("int"), "suffix")
    return counted.withColumn("unique_code", F.concat(code, F.array(F.col("suffix").cast("int")))).withColumn(vector, F.col("__given")).drop("__first", "__given")


# -- diagnostics ---------------------------------------------------------------


def collisions(codes: DataFrame, position: str = "pos", code: str = "code", key: str = "did") -> DataFrame:
    """Per code: changes of id in arrival order, and distinct ids beyond one."""
    changes = chunked_changes(codes, code, position, key, out="changes")
    distinct = codes.select(code, key).distinct().groupBy(code).agg((F.count(F.lit(1)) - 1).alias("extra_ids"))
    return changes.join(distinct, code)


def collision_totals(per_code: DataFrame) -> DataFrame:
    return per_code.agg(F.sum("changes").alias("collisions"), F.sum("extra_ids").alias("extra_ids"))


def perplexity(codes: DataFrame, code: str = "code") -> DataFrame:
    """Perplexity of the code distribution per level."""
    total = codes.agg(F.count(F.lit(1))).scalar()
    used = codes.select(F.posexplode(code).alias("level", "c")).groupBy("level", "c").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / total
    return used.groupBy("level").agg(F.exp(-F.sum(p * F.log(p + 1e-6))).alias("perplexity"), F.count(F.lit(1)).alias("used"))


def mean_perplexity(per_level: DataFrame) -> DataFrame:
    return per_level.agg(F.avg("perplexity").alias("perplexity"))


def bucket_sizes(codes: DataFrame, code: str = "code") -> DataFrame:
    """How many codes hold how many candidates."""
    sizes = codes.groupBy(code).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("codes"))


def prefix_accuracy(pairs: DataFrame, predicted: str = "predicted", target: str = "target") -> DataFrame:
    """Agreement after the modality level on 1, 2, 3 levels, and of whole codes."""

    def share(c):
        return F.avg(c.cast("int"))

    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col(predicted) == F.col(target)).alias("all_levels"),
        share(same_levels(predicted, target, 1, 1)).alias("level_1"),
        share(same_levels(predicted, target, 1, 2)).alias("level_12"),
        share(same_levels(predicted, target, 1, 3)).alias("level_123"),
    )


def quantisation_error(pairs: DataFrame, original: str = "embedding", quant: str = "quant") -> DataFrame:
    return pairs.agg(F.avg(mean_squared_error(original, quant)).alias("mse"), F.count(F.lit(1)).alias("n"))
