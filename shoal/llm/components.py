"""Connected components of a table of links, by alternating big and small stars.

Every round is written to the shared folder; nothing but counts and one checksum
comes to the driver. Rounds grow as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash


def _star(links: DataFrame) -> DataFrame:
    """Links of every node's greater neighbours to the least node next to it (big star), then small star."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a")
    out = small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (a long, b long); the component is its least node."""
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    was = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == was:
            break
        was = state
        if not state[0]:
            break
        now = stash(_star(now), "star")
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
