"""Links followed to their end: aliases and role memberships, by pointer doubling until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.sources.tables import stored


def follow(links: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """links: id (each once), next, an id of either table. last: id of the nodes with which chains end. Returns id, root, hops, the links from each node to its last one; and id, next of the nodes whose chain never ends, by a step of doubled links, or None.

    After r rounds a step covers 2^r links. As long as a chain is longer, others of its
    nodes are just within reach, so the number of open nodes falls in each round; once
    it does not, what is open leads into loops. Rounds grow with the logarithm of the
    longest chain, and each is one join by node. What has ended is not written again,
    and the hops of a step need no column.
    """
    step, covers = links.select("id", "next"), 1
    ended = last.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("hops"))
    left = step.count()
    while left:
        none = F.lit(None).cast("long")
        onward = step.select(F.col("id").alias("next"), F.col("next").alias("then"), none.alias("root"), none.alias("hops")).unionByName(ended.select(F.col("id").alias("next"), none.alias("then"), "root", "hops"))
        round_ = stored(step.join(onward, "next").select("id", F.col("then").alias("next"), "root", (F.col("hops") + covers).alias("hops")))
        ended = ended.unionByName(round_.where("root IS NOT NULL").select("id", "root", "hops"))
        step, before, covers = round_.where("root IS NULL").select("id", "next"), left, 2 * covers
        left = step.count()
        if left == before:
            return ended, step
    return ended, None


def loop_nodes(step: DataFrame) -> DataFrame:
    """id: those in loops. step: id, next, of which every next is an id; so many links for all. The image of all nodes under ever longer steps shrinks to the loops, and stays as it is once a doubled step loses none."""
    size = step.select("next").distinct().count()
    while True:
        step = stored(step.join(step.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
        before, size = size, step.select("next").distinct().count()
        if size == before:
            return step.select(F.col("next").alias("id")).distinct()


def resolve_aliases(aliases: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, alias, canonical, hops, looped: each alias followed within its scope to the name that is no alias. scope: columns, as tenant and domain; an alias has one target in it.

    Chains may have any length. An alias that leads into a loop has the loop's first name
    on its way as canonical one, itself if it is part of the loop. Null names link
    nothing. An empty table gives an empty result. Names are joined once to become
    numbers, and once to come back; rounds move numbers.
    """
    node = lambda name: F.struct(*scope, F.col(name).alias("name"))
    names = stored(aliases.where("alias IS NOT NULL AND canonical IS NOT NULL").select(node("alias").alias("a"), node("canonical").alias("b")).withColumn("id", F.monotonically_increasing_id()))
    links = stored(names.select("id", "b").join(names.select(F.col("a").alias("b"), F.col("id").alias("next")), "b", "left").select("id", "next", F.when(F.col("next").isNull(), F.col("b")).alias("end")))
    ended, astray = follow(links.where("next IS NOT NULL"), links.where("next IS NULL"))
    ways, ends = ended.withColumn("looped", F.lit(False)), links.where("next IS NULL").select(F.col("id").alias("root"), "end")
    if astray is not None:
        loops = stored(loop_nodes(astray))
        tails = links.select("id", "next").join(astray.select("id"), "id", "left_semi").join(loops, "id", "left_anti")
        entry = loops.select(F.col("id").alias("next"), F.lit(True).alias("enters"))
        tails = stored(tails.join(entry, "next", "left"))
        into, _ = follow(tails.where("enters IS NULL"), tails.where("enters"))
        ways = ways.unionByName(into.withColumn("looped", F.lit(True)))
        entered = tails.where("enters").select(F.col("id").alias("root"), "next").join(names.select(F.col("id").alias("next"), F.col("a").alias("end")), "next")
        ends = ends.unionByName(entered.select("root", "end"))
    found = ways.join(ends, "root").join(names.select("id", "a"), "id").select("a", "end", (F.col("hops") + 1).alias("hops"), "looped")
    if astray is not None:
        found = found.unionByName(names.join(loops, "id").select("a", F.col("a").alias("end"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("looped")))
    return found.select(*[f"a.{s}" for s in scope], F.col("a.name").alias("alias"), F.col("end.name").alias("canonical"), "hops", "looped")


def reachable(members: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, member, role, hops: all roles that a member has, by itself or through roles that are members of roles, each with its shortest way. members: scope, member, role (of any number); loops are allowed, and a role reached from itself counts as any other.

    Each round joins the ways found last with the links, and keeps what is new, until
    nothing is; rounds are as many as the longest of the shortest ways.
    """
    links = stored(members.where("member IS NOT NULL AND role IS NOT NULL").select(*scope, "member", "role").distinct())
    found = last = stored(links.withColumn("hops", F.lit(1).cast("long")))
    hops = 1
    while True:
        hops += 1
        onward = links.withColumnsRenamed({"member": "via", "role": "next"})
        ways = last.withColumnRenamed("role", "via").join(onward, [*scope, "via"]).select(*scope, "member", F.col("next").alias("role")).distinct()
        new = stored(ways.join(found.select(*scope, "member", "role"), [*scope, "member", "role"], "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        if new.isEmpty():
            return found
        found, last = found.unionByName(new), new
