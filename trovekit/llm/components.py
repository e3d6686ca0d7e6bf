"""Connected components of a link table by alternating large and small stars.

Each round replaces links by links to the smallest known neighbour, on the side
of larger neighbours, then on the side of smaller ones, until nothing changes; the
number of rounds grows with the logarithm of the graph.  Every round is an
aggregation and a join; its result is written to the shared folder, so a lost
executor costs one round at most.  Links never reach the driver.

Edge cases: self-links and repeated links change nothing; links with a NULL end
are ignored; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovekit.llm.common import drop, written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star step on links (u, v) that point from u to its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = links.join(least, "u")
    if larger:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link."""
    one = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(one.distinct(), label)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, larger=True), label)
        after = written(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False), label)
        drop(now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    # every link now leads from a node to its smallest one
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
