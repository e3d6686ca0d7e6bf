"""The path-compressed prefix index and the search in the tasks against their plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovekit.operators import beam, prefix


def codes_of(seed, n, levels, vocabulary, lengths=None):
    rng = random.Random(seed)
    return [[rng.choice(vocabulary) for _ in range(rng.choice(lengths) if lengths else levels)] for _ in range(n)]


def table(spark, codes):
    return spark.createDataFrame([(c,) for c in codes], "code array<int>")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("case", [(200, 5, range(3), None), (80, 0, range(4), [1, 2, 3, 6, 9]), (300, 9, range(50), None), (1, 4, range(2), None)])
def test_compact_index_holds_the_same_codes(spark, case):
    n, levels, vocabulary, lengths = case
    held = codes_of(4, n, levels, list(vocabulary), lengths) * 2
    codes = table(spark, held)
    compact, plain = prefix.compact_index(codes), prefix.prefix_index(codes)
    distinct = {tuple(c) for c in held}
    assert compact.count() <= 2 * len(distinct)
    assert {tuple(r.code) for r in prefix.compact_codes(compact).collect()} == distinct
    assert rows(prefix.expand_index(compact)) == rows(plain)
    asked = {(), (99,), *[c[:i] for c in distinct for i in range(1, len(c) + 1)], *[(*c, 1) for c in distinct]}
    ask = spark.createDataFrame([(list(a), "kept") for a in asked], "prefix array<int>, more string")
    assert rows(prefix.compact_lookup(ask, compact)) == rows(prefix.lookup(ask, plain).select("prefix", "more", "nexts"))


def test_empty_index(spark):
    none = table(spark, [[1]]).limit(0)
    assert prefix.compact_index(none).count() == 0 and prefix.expand_index(prefix.compact_index(none)).count() == 0


@pytest.mark.parametrize("levels,vocabulary,beams", [(3, 8, 5), (5, 3, 50), (2, 40, 7)])
def test_search_in_tasks_equals_the_joined_search(spark, levels, vocabulary, beams, monkeypatch):
    rng = np.random.default_rng(levels)
    books = [(level, 2 * code + 1, rng.normal(size=6).round(2).tolist()) for level in range(levels) for code in range(vocabulary)]
    codebooks = spark.createDataFrame(books, "level int, code int, centroid array<double>")
    held = [[2 * c + 1 for c in code] for code in codes_of(7, 150, levels, list(range(vocabulary)))] + [[1] * (levels - 1) + [888]]
    queries = spark.createDataFrame([(f"q{i}", rng.normal(size=6).tolist()) for i in range(40)], "qid string, embedding array<double>")
    index = prefix.prefix_index(table(spark, held))
    sent = rows(beam.beam_search(queries, index, codebooks, beams, levels))
    monkeypatch.setattr(beam, "BLOCK_SCORES", 64)
    assert rows(beam.beam_search(queries, index, codebooks, beams, levels)) == sent
    monkeypatch.setattr(beam, "index_bytes", lambda index: 1 << 60)
    assert rows(beam.beam_search(queries, index, codebooks, beams, levels)) == sent
    for group_rows in (2_048, 7):
        streamed = beam.beam_search(queries, index, codebooks, beams, levels, limit=0, group_rows=group_rows)
        assert rows(streamed) == sent and streamed.count() > 0
        # a query's beams carry no vector between levels
        assert "residual" not in streamed._jdf.queryExecution().executedPlan().toString()
    # an index without codes finds nothing
    monkeypatch.undo()
    assert beam.beam_search(queries, index.limit(0), codebooks, beams, levels).count() == 0
    assert beam.beam_search(queries.where(F.lit(False)), index, codebooks, beams, levels).count() == 0
