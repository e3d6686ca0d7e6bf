"""Discrete codes (arrays of ints, one per level) and their token strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovekit import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_to_tokens(code, separator: str = "") -> Column:
    """``[1, 402]`` -> ``<a1><b402>``; the letter names the level."""
    tokens = F.transform(
        _col(code),
        lambda v, i: F.concat(F.lit("<"), F.chr(i + 97), v.cast("string"), F.lit(">")),
    )
    return F.array_join(tokens, separator)


def tokens_to_code(tokens) -> Column:
    values = F.regexp_extract_all(_col(tokens), F.lit(r"<([a-z])(\d+)>"), F.lit(2))
    return values.cast("array<int>")


def modality_code(modality) -> Column:
    """First code position when the modality is known."""
    pairs = [F.lit(x) for item in K.MODALITY_CODES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(modality))


def same_levels(a, b, first: int, last: int) -> Column:
    """Whether two codes agree on the levels ``first..last`` (0-based, inclusive)."""
    n = last - first + 1
    return F.slice(_col(a), first + 1, n) == F.slice(_col(b), first + 1, n)
