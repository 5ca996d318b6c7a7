"""Connected components by alternating large-star and small-star steps.

Links stay distributed; every round cuts its lineage in the shared folder and
removes the files of the round before.  A node with very many links (the centre
of a star) meets them by `spread_join`, where they are.  Links of at most `ALONE` rows,
which are counted first, are worked on in one task: its steps then shuffle nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, spread_join

#: Links that one task may have.
ALONE = 200_000
#: Rounds after which every further one is logged; the least node of a component
#: comes nearer in each, so the rounds end.
EXPECTED_ROUNDS = 30


def _alone(df: DataFrame, total: int) -> DataFrame:
    return df.coalesce(1) if total <= ALONE else df


def _met(links: DataFrame, least: DataFrame, total: int, times: int = 1) -> DataFrame:
    """Links (each `times` in it) with what is known of their ends u; `least` has a row for each."""
    return links.join(least.drop("n"), "u") if total <= ALONE else spread_join(links, least, "u", times * total)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour."""
    both = _alone(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), total)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _met(both, least, total, 2).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; here u > v."""
    links = _alone(links, total)
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _met(links, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _alone(moved.unionByName(least.select("u", F.col("m").alias("v"))), total).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the least node reachable.

    Links with a null end or equal ends are ignored.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    ends = ends.where("x is not null and y is not null and u <> v").select("u", "v")
    n = ends.count()
    now = cut(_alone(ends, n).distinct(), n)

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before, rounds = state(now), 0
    while before[0]:
        large = cut(_large_star(now, before[0]), before[0])
        after = cut(_small_star(large, before[0]), before[0])
        discard(now)
        discard(large)
        now, last, before = after, before, state(after)
        if before == last:
            break
        rounds += 1
        if rounds > EXPECTED_ROUNDS:
            logging.getLogger(__name__).warning("components: round %d, %d links", rounds, before[0])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
