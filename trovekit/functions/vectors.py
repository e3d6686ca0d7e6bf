"""Vector arithmetic on array columns.

Built-in array expressions for single rows.  Bulk kernels (search, encoding)
live in ``operators`` and work on Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovekit.functions.stable import hash_int


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(v) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    # Bound once through a one-element array: the norm is taken once per row.
    scaled = F.transform(F.array(l2_norm(v)), lambda n: F.transform(doubles(v), lambda x: x / F.nullif(n, F.lit(0.0))))
    return F.when(l2_norm(v) == 0, doubles(v)).otherwise(F.get(scaled, F.lit(0)))


def cosine(a, b) -> Column:
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def squared_distance(a, b) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def mean_squared_error(a, b) -> Column:
    return squared_distance(a, b) / F.size(_col(a))


def add(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def fuse(img, txt, img_mask, txt_mask) -> Column:
    """Masked sum of the image and the text vector."""
    i, t = _col(img_mask).cast("double"), _col(txt_mask).cast("double")
    return F.zip_with(doubles(img), doubles(txt), lambda x, y: x * i + y * t)


def text_with_mask(txt) -> Column:
    """``(txt, mask)``: absent text is "" with mask 0."""
    c = _col(txt)
    present = c.isNotNull() & (c != "")
    return F.struct(F.coalesce(c, F.lit("")).alias("txt"), present.cast("int").alias("mask"))


def image_with_mask(vector, dim: int) -> Column:
    """``(vector, mask)``: an absent image is a zero vector with mask 0."""
    c = doubles(vector)
    return F.struct(
        F.coalesce(c, F.array_repeat(F.lit(0.0), dim)).alias("img"), c.isNotNull().cast("int").alias("mask")
    )


def argmax(v) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(_col(v), F.array_max(_col(v))) - 1).cast("int")


def _middle(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def mix_up(q, p, key, seed: int | str = 2023) -> Column:
    """Unit vector of ``sqrt(s) q + sqrt(1-s) p`` with s ~ Beta(2, 2) per entry.

    Beta(2, 2) is the law of the median of three uniforms; these come from the
    hash of the row key and the entry position, so the mix is reproducible.
    """

    def uniform(i, salt):
        return hash_int(F.concat_ws(":", _col(key).cast("string"), i.cast("string"), F.lit(salt)), seed) / F.lit(
            4294967296.0
        )

    pairs = F.arrays_zip(doubles(q).alias("q"), doubles(p).alias("p"))

    def mix(pair, i):
        weight = F.array(_middle(uniform(i, "a"), uniform(i, "b"), uniform(i, "c")))
        mixed = F.transform(weight, lambda s: F.sqrt(s) * pair["q"] + F.sqrt(1 - s) * pair["p"])
        return F.get(mixed, F.lit(0))

    return normalize(F.transform(pairs, mix))
