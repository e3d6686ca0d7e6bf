"""Prefix index over discrete codes, as a table.

``prefix_index`` lists every prefix with its next tokens.  ``compact_index`` is the
same tree with chains of single children as one labelled edge: a row per edge from
a prefix where codes part (or the root, or a code that others go on from), at most
two for each code however long codes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.operators.skew import lookup_join
from trovekit.session import materialize


def prefix_edges(codes: DataFrame, code: str = "code") -> DataFrame:
    """(prefix, next, n_codes): every extension of every prefix.

    Codes are counted once first, and each edge is counted with map-side
    partial sums, so the root prefix is as cheap as any other.
    """
    distinct = codes.groupBy(code).agg(F.count(F.lit(1)).alias("__rows"))
    steps = distinct.select(
        F.col(code).alias("code"), F.explode(F.sequence(F.lit(0), F.size(code) - 1)).alias("__l")
    )
    edges = steps.select(F.slice("code", F.lit(1), F.col("__l")).alias("prefix"), F.get("code", F.col("__l")).alias("next"))
    return edges.groupBy("prefix", "next").agg(F.count(F.lit(1)).alias("n_codes"))


def prefix_index(codes: DataFrame, code: str = "code") -> DataFrame:
    """(prefix, nexts, n_codes); the empty prefix lists the roots.

    ``nexts`` holds distinct values of one code level, at most the vocabulary.
    """
    return prefix_edges(codes, code).groupBy("prefix").agg(
        F.sort_array(F.collect_list("next")).alias("nexts"), F.sum("n_codes").alias("n_codes")
    )


def extend_index(index: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Index after adding codes to an existing one (``n_codes`` adds up for
    codes that were not in it)."""
    edges = index.select("prefix", F.explode("nexts").alias("next")).unionByName(
        prefix_edges(codes, code).select("prefix", "next")
    )
    return edges.distinct().groupBy("prefix").agg(F.sort_array(F.collect_list("next")).alias("nexts"))


def lookup(prefixes: DataFrame, index: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Next tokens of each asked prefix; unknown and complete ones get none."""
    nexts = index.select(F.col("prefix").alias(prefix), "nexts")
    joined = lookup_join(prefixes, nexts, prefix, "left")
    return joined.withColumn("nexts", F.coalesce("nexts", F.array().cast("array<int>")))


def chained_lookup(prefixes: DataFrame, first: DataFrame, second: DataFrame, bos: int) -> DataFrame:
    """Look-up in an index whose ``bos`` root stands for a second index.

    For the empty prefix, ``bos`` is replaced by the roots of the second index;
    a prefix that the first index does not know is looked up in the second.
    """
    # A complete code is a known prefix without successors; only real misses
    # go to the second index.
    known = first.select("prefix").unionByName(
        first.select(F.explode(F.transform("nexts", lambda n: F.concat("prefix", F.array(n)))).alias("prefix"))
    ).distinct()
    roots = second.where(F.size("prefix") == 0).select(F.col("nexts").alias("roots"), F.lit(1).alias("__root"))
    a = lookup(prefixes, first).withColumnRenamed("nexts", "a")
    b = lookup(a, second).withColumnRenamed("nexts", "b")
    flagged = lookup_join(b, known.withColumn("__known", F.lit(True)), "prefix", "left")
    # one row of roots, at most the vocabulary long
    is_root = F.size("prefix") == 0
    joined = flagged.withColumn("__root", is_root.cast("int")).join(F.broadcast(roots), "__root", "left")
    swapped = F.when(
        F.array_contains("a", bos), F.concat(F.filter("a", lambda n: n != bos), F.coalesce("roots", F.array().cast("array<int>")))
    ).otherwise(F.col("a"))
    nexts = F.when(is_root, swapped).when(F.col("__known"), F.col("a")).otherwise(F.col("b"))
    return joined.select(*prefixes.columns, nexts.alias("nexts"))


def enumerate_codes(index: DataFrame) -> DataFrame:
    """All complete codes of an index: extensions that are no prefix themselves."""
    full = index.select(F.explode(F.transform("nexts", lambda n: F.concat("prefix", F.array(n)))).alias("code"))
    return full.join(index.select(F.col("prefix").alias("code")), "code", "left_anti")


def code_count(codes: DataFrame, code: str = "code") -> DataFrame:
    """Sequences added (repeats count) and distinct sequences."""
    per_code = codes.groupBy(code).agg(F.count(F.lit(1)).alias("c"))
    return per_code.agg(F.sum("c").alias("n_sequences"), F.count(F.lit(1)).alias("n_codes"))


# -- path-compressed form ------------------------------------------------------


def compact_index(codes: DataFrame, code: str = "code") -> DataFrame:
    """(prefix, label, n_codes, leaf): the edges between prefixes where codes part or end.

    ``label`` is the run of tokens from ``prefix`` to the next such place, ``n_codes``
    the codes below it, ``leaf`` whether a code ends there.  A node keeps its place in
    the tree if it is the root, has several children, or is itself a code.
    """
    distinct = materialize(codes.select(F.col(code).alias("code")).distinct(), "distinct-codes")
    steps = distinct.select("code", F.explode(F.sequence(F.lit(0), F.size("code"))).alias("at"))
    steps = steps.select("code", "at", F.slice("code", F.lit(1), F.col("at")).alias("prefix"), F.get("code", F.col("at")).alias("next"))
    # a prefix of one code only, or with one way on, is inside an edge
    nodes = steps.groupBy("prefix").agg((F.count_distinct("next") > 1).alias("parts"), F.max(F.col("next").isNull()).alias("ends"))
    nodes = nodes.where(F.col("parts") | F.col("ends") | (F.size("prefix") == 0)).select("prefix", "ends")
    stops = steps.join(nodes, "prefix").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("at", "ends"))).alias("stops"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("stops") - 1),
        lambda i: F.struct(F.get("stops", i - 1)["at"].alias("a"), F.get("stops", i)["at"].alias("b"), F.get("stops", i)["ends"].alias("leaf")),
    )
    edges = stops.where(F.size("stops") > 1).select("code", F.inline(pairs))
    ends = edges.select(
        F.slice("code", F.lit(1), F.col("a")).alias("prefix"), F.slice("code", F.col("a") + 1, F.col("b") - F.col("a")).alias("label"), "leaf"
    )
    return ends.groupBy("prefix", "label").agg(F.count(F.lit(1)).alias("n_codes"), F.first("leaf").alias("leaf"))


def expand_index(compact: DataFrame) -> DataFrame:
    """The (prefix, nexts, n_codes) of ``prefix_index`` from a compact one."""
    steps = compact.select(
        "prefix", "label", "n_codes", F.explode(F.sequence(F.lit(0), F.size("label") - 1)).alias("at")
    )
    edges = steps.select(
        F.concat("prefix", F.slice("label", F.lit(1), F.col("at"))).alias("prefix"), F.get("label", F.col("at")).alias("next"), "n_codes"
    )
    return edges.groupBy("prefix").agg(F.sort_array(F.collect_list("next")).alias("nexts"), F.sum("n_codes").alias("n_codes"))


def compact_lookup(prefixes: DataFrame, compact: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``lookup`` in a compact index: a prefix may end at a node or inside an edge."""
    edges = compact.groupBy(F.col("prefix").alias("__node")).agg(F.collect_list("label").alias("__labels"))
    asked = prefixes.select(prefix).distinct()
    starts = asked.select(prefix, F.explode(F.sequence(F.lit(0), F.size(prefix))).alias("__at"))
    met = starts.withColumn("__node", F.slice(prefix, F.lit(1), F.col("__at"))).join(edges, "__node")
    # what is left of the prefix below the node must begin a label
    rest = F.slice(prefix, F.col("__at") + 1, F.size(prefix))
    fits = lambda x: (F.size(x) > F.size(rest)) & (F.slice(x, F.lit(1), F.size(rest)) == rest)
    nexts = F.transform(F.filter("__labels", fits), lambda x: F.get(x, F.size(rest)))
    found = met.select(prefix, nexts.alias("__nexts")).groupBy(prefix).agg(F.sort_array(F.flatten(F.collect_list("__nexts"))).alias("nexts"))
    joined = lookup_join(prefixes, found, prefix, "left")
    return joined.withColumn("nexts", F.coalesce("nexts", F.array().cast("array<int>")))


def compact_codes(compact: DataFrame) -> DataFrame:
    """All complete codes of a compact index."""
    return compact.where("leaf").select(F.concat("prefix", "label").alias("code"))
