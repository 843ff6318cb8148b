"""Groups of linked nodes, by joins alone."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Rounds, written
from .relational import numbered


def _nearer(links: DataFrame) -> DataFrame:
    """One round for the distinct links (u, v) with v < u: the greater neighbours of each node are
    linked to the least of its neighbours and itself; of what follows, each node and its lesser
    neighbours to the least of these."""
    ends = links.union(links.select("v", "u"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    greater = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    large = greater.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    rows = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    return rows.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each node of the distinct links (u, v) is linked to one lesser node, which is linked to none."""
    ends = links.select("u", F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
    return ends.groupBy("u").agg(F.count("*").alias("times"), F.sum("up").alias("up")).filter("up > 0 and times > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b); the component is its least node.

    Loops, repeats and nulls count for nothing. Rounds end when every node is linked to the least one
    of its component, after about the logarithm of the longest path; each is written to the shared folder.
    """
    rounds = Rounds(edges.sparkSession, "links")
    now = rounds.written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        now = rounds.written(_nearer(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def dense_clusters(edges: DataFrame, members: DataFrame, share: float, most_rounds: int = 1000) -> DataFrame:
    """(node, cluster) of clusters whose every member is linked with ``share`` of the others: 0.5 for
    half, 1.0 for all. ``members`` is (node, cluster) to begin with, such as components or stars.

    In each round the members of least share below it leave their cluster, to be alone (null).
    """
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).filter("node != other").distinct(), "both")
    rounds = Rounds(edges.sparkSession, "clusters")
    now = rounds.written(members.select("node", "cluster").filter("cluster is not null"))
    for _ in range(most_rounds):
        n = F.count("*").over(Window.partitionBy("cluster"))
        held = now.withColumnRenamed("cluster", "c").join(both, "node").join(now.select(F.col("node").alias("other"), F.col("cluster").alias("c")), ["other", "c"]).groupBy("node").agg(F.count("*").alias("links"))
        rows = now.join(held, "node", "left").withColumn("n", n).withColumn("share", F.when(F.col("n") > 1, F.coalesce("links", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0)))
        rows = rows.withColumn("least", F.min("share").over(Window.partitionBy("cluster")))
        stays = (F.col("share") >= share - 1e-9) | (F.col("share") > F.col("least"))
        new = rounds.written(rows.filter((F.col("n") > 1) & stays).select("node", "cluster"))
        if new.count() == now.count():
            break
        now = new
    return members.select("node").distinct().join(new, "node", "left")


def star_clusters(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, lead): leads are nodes heavier than all free neighbours; the others join their heaviest lead.

    ``weights`` is (node, weight), ties to the lesser node. Every member is linked with its
    lead; nodes whose neighbours all joined others lead themselves alone.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct()
    w = weights.select(F.col("node").alias("b"), F.struct(F.col("weight"), (-F.col("node")).alias("n")).alias("wb"))
    both = written(both.join(w, "b").join(w.select(F.col("b").alias("a"), F.col("wb").alias("wa")), "a"), "links")
    done = both.select(F.col("a").alias("node"), F.col("b").alias("lead")).limit(0)
    free = both
    while not free.isEmpty():
        leads = free.groupBy("a").agg(F.first("wa").alias("wa"), F.max("wb").alias("top")).filter("wa > top").select("a")
        joined = free.join(leads.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("wb", "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("lead"))
        done = written(done.union(leads.select(F.col("a").alias("node"), F.col("a").alias("lead"))).union(joined), "stars")
        taken = done.select("node")
        rest = free.join(taken.withColumnRenamed("node", "a"), "a", "left_anti").join(taken.withColumnRenamed("node", "b"), "b", "left_anti")
        free = written(rest.select(both.columns), "free")
    alone = both.select(F.col("a").alias("node")).distinct().join(done.select("node"), "node", "left_anti")
    return done.union(alone.select("node", F.col("node").alias("lead")))


def ring_order(edges: DataFrame, nodes: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, chain, place, length, position): an order of the nodes on a circle in which similar ones are neighbours.

    Every node begins as a chain. In each round every chain names the strongest edge (a, b, sim) from one of its ends
    to an end of another (ties to the lesser nodes), and two chains that name the same edge are joined there, one of
    them turned round if need be. Chains that no edge joins follow one another by their least node. This takes the
    edges that a greedy choice from the strongest edge on would take; nothing is random, and a round is a few joins.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    links = written(links, "links")
    rounds = Rounds(edges.sparkSession, "ring")
    now = rounds.written(nodes.select("node").distinct().select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("length")))
    for _ in range(most_rounds):
        ends = now.filter("place = 0 or place = length - 1")
        a, b = (ends.select(F.col("node").alias(n), F.col("chain").alias(f"chain_{n}"), F.col("place").alias(f"place_{n}"), F.col("length").alias(f"length_{n}")) for n in "ab")
        open_ = written(links.join(a, "a").join(b, "b").filter("chain_a <> chain_b"), "open")
        if open_.isEmpty():
            break
        order = F.struct((-F.col("sim")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
        named = [open_.groupBy(F.col(c).alias("chain")).agg(F.min(order).alias("o")) for c in ("chain_a", "chain_b")]
        best = named[0].union(named[1]).groupBy("chain").agg(F.min("o").alias("o")).select("chain", F.col("o.x").alias("a"), F.col("o.y").alias("b"))
        agreed = best.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
        joined = open_.join(agreed, ["a", "b"])
        # The chain of the lesser name comes first, with the joined end last; the other follows, with its end first.
        first = F.col("chain_a") < F.col("chain_b")
        side = lambda n: F.struct(F.col(f"chain_{n}").alias("c"), F.col(f"place_{n}").alias("p"), F.col(f"length_{n}").alias("l"))
        one = joined.select(F.when(first, side("a")).otherwise(side("b")).alias("f"), F.when(first, side("b")).otherwise(side("a")).alias("g"))
        total = (F.col("f.l") + F.col("g.l")).alias("total")
        turns = one.select(F.col("f.c").alias("chain"), (F.col("f.p") != F.col("f.l") - 1).alias("turned"), F.lit(0).cast("long").alias("offset"), F.col("f.c").alias("into"), total)
        turns = turns.union(one.select("g.c", F.col("g.p") != 0, "f.l", "f.c", total))
        place = F.when(F.col("turned"), F.col("length") - 1 - F.col("place")).otherwise(F.col("place")) + F.col("offset")
        moved = now.join(turns, "chain", "left").select("node", F.coalesce("into", "chain").alias("chain"), F.coalesce(place, F.col("place")).alias("place"), F.coalesce("total", "length").alias("length"))
        now = rounds.written(moved)
    return numbered(now, ["chain", "place"], "position", first=0).select("node", "chain", "place", "length", "position")


def ring_clusters(edges: DataFrame, ring: DataFrame, share: float = 0.0) -> DataFrame:
    """(node, cluster) of groups around the nodes of greatest total similarity, among neighbours on the ring: an edge
    (a, b, sim) counts if its nodes are at most sqrt(n) + 1 places apart on the circle. With ``share`` every member is
    linked with so many of the others (0.5 for half, 1.0 for all); groups of one are null."""
    n = ring.count()
    reach = isqrt(n) + 1
    a, b = (ring.select(F.col("node").alias(x), F.col("position").alias(f"p{x}")) for x in "ab")
    apart = F.abs(F.col("pa") - F.col("pb"))
    near = written(edges.join(a, "a").join(b, "b").filter(F.least(apart, F.lit(n) - apart) <= reach).select("a", "b", "sim"), "near")
    weights = near.select(F.col("a").alias("node"), "sim").union(near.select("b", "sim")).groupBy("node").agg(F.sum(F.round(F.col("sim") * 1e9).cast("long")).alias("weight"))
    stars = written(star_clusters(near, weights).select("node", F.col("lead").alias("cluster")), "members")
    groups = dense_clusters(near, stars, share) if share else stars
    sizes = groups.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size")).filter("size > 1").select("cluster")
    return ring.select("node").join(groups.join(sizes, "cluster").select("node", "cluster"), "node", "left")
