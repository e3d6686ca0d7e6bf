"""Ids ``"<dataset>:<n>"``, their packed integer form and the name tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovekit import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def id_dataset(c) -> Column:
    """Dataset part of an id, as text."""
    return F.split_part(_col(c), F.lit(":"), F.lit(1))


def id_number(c) -> Column:
    """Number part of an id; sorting by it is the numeric id order."""
    return F.split_part(_col(c), F.lit(":"), F.lit(2)).cast("long")


def make_id(dataset, number) -> Column:
    dataset = F.lit(dataset) if isinstance(dataset, int) else _col(dataset)
    return F.concat_ws(":", dataset.cast("string"), _col(number).cast("string"))


def _pack(c, bound: int) -> Column:
    return id_dataset(c).cast("long") * F.lit(bound) + id_number(c)


def _unpack(c, bound: int, dataset=None) -> Column:
    c = _col(c).cast("long")
    if dataset is not None:
        part = _col(dataset).cast("long")
        return make_id(part, c - part * F.lit(bound))
    number = F.pmod(c, F.lit(bound).cast("long"))
    return F.concat_ws(":", ((c - number) / bound).cast("long").cast("string"), number.cast("string"))


def hash_qid(c) -> Column:
    return _pack(c, K.QUERY_ID_BOUND)


def unhash_qid(c, dataset=None) -> Column:
    """Query id of a packed one.

    An id that overflows packs to the same integer as one of a later dataset; only
    with its ``dataset`` it is told from that.
    """
    return _unpack(c, K.QUERY_ID_BOUND, dataset)


def hash_did(c) -> Column:
    return _pack(c, K.CANDIDATE_ID_BOUND)


def unhash_did(c, dataset=None) -> Column:
    """Candidate id of a packed one; ``dataset`` as in ``unhash_qid``."""
    return _unpack(c, K.CANDIDATE_ID_BOUND, dataset)


def qid_overflows(c) -> Column:
    """True when packing the query id would run into the next dataset."""
    return id_number(c) >= K.QUERY_ID_BOUND


def did_overflows(c) -> Column:
    """True when packing the candidate id would run into the next dataset."""
    return id_number(c) >= K.CANDIDATE_ID_BOUND


def dataset_id(name) -> Column:
    return _lookup(K.DATASET_IDS, _col(name))


def dataset_name(c) -> Column:
    """Dataset name of an id ``"<dataset>:<n>"``."""
    names = {number: name for name, number in K.DATASET_IDS.items()}
    return _lookup(names, id_dataset(c).cast("int"))


def dataset_domain(name) -> Column:
    return _lookup(K.DATASET_DOMAINS, _col(name))


def task_id(query_modality, candidate_modality) -> Column:
    return _lookup(K.TASK_IDS, F.concat(_col(query_modality), F.lit(" -> "), _col(candidate_modality)))


def task_name(task) -> Column:
    names = {number: name for name, number in K.TASK_IDS.items()}
    return _lookup(names, _col(task).cast("int"))


def task_modalities(task) -> Column:
    """``[query modality, candidate modality]`` of a task id."""
    return F.split(task_name(task), " -> ")
