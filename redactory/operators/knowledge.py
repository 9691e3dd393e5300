"""Claims: schema guard, conflicts, co-occurrence, aliases, relation scores; and patterns over their graph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.sources.tables import stored

#: Ranks of at most so many times are broadcast; with more, Spark shuffles both sides.
MOST_BROADCAST = 100_000
#: Pairs a cell up to which the cells of a fact are compared with each other.
MOST_PAIRS = 32


#: Kinds of attributes, and the JSON values that they take; a boolean counts as a whole number, a number without a fraction does not.
ATTRIBUTES = {"int": "^(TINYINT|SMALLINT|INT|BIGINT|BOOLEAN)", "float": "^(TINYINT|SMALLINT|INT|BIGINT|BOOLEAN|FLOAT|DOUBLE|DECIMAL)", "string": "^STRING"}


def schema_guard(claims: DataFrame, entities: DataFrame, rules: DataFrame, attributes: DataFrame | None = None, properties: str | None = None) -> DataFrame:
    """Adds violation, or null: the first of unknown_predicate, unknown_subject, unknown_object, domain_mismatch, range_mismatch, attribute_mismatch.

    rules: predicate, domain, range (arrays, '*' for any), a table of fixed size. An
    entity that is not there has no type and fits '*' only. attributes: predicate,
    name, kind (of ATTRIBUTES; others take anything), a table of fixed size; properties:
    a column with a JSON object. Attributes that no rule names, and nulls, are left alone.
    """
    types = entities.select("entity_id", "entity_type")
    typed = claims.join(types.withColumnsRenamed({"entity_id": "subject_id", "entity_type": "subject_type"}), "subject_id", "left").join(types.withColumnsRenamed({"entity_id": "object_id", "entity_type": "object_type"}), "object_id", "left")
    fits = lambda allowed, kind: F.coalesce(F.array_contains(allowed, kind), F.lit(False)) | F.array_contains(allowed, F.lit("*"))
    rows, wrong = typed.join(rules, "predicate", "left"), F.lit(False)
    if attributes is not None:
        kinds = attributes.groupBy("predicate").agg(F.map_from_entries(F.collect_list(F.struct("name", "kind"))).alias("kinds"))
        rows = rows.join(F.broadcast(kinds), "predicate", "left").withColumn("given", F.try_variant_get(F.try_parse_json(properties), "$", "map<string,variant>"))
        of_kind = lambda value, kind: functools.reduce(lambda a, k: F.when(kind == k, F.schema_of_variant(value).rlike(ATTRIBUTES[k])).otherwise(a), ATTRIBUTES, F.lit(True))
        odd = F.map_filter("given", lambda name, value: F.coalesce(F.map_contains_key("kinds", name), F.lit(False)) & F.coalesce(F.schema_of_variant(value) != "VOID", F.lit(False)) & ~of_kind(value, F.try_element_at("kinds", name)))
        wrong = F.coalesce(F.size(odd) > 0, F.lit(False))
    no_type = lambda allowed, kind: F.col(kind).isNull() & ~F.array_contains(allowed, F.lit("*"))
    violation = (
        F.when(F.col("domain").isNull(), "unknown_predicate").when(no_type("domain", "subject_type"), "unknown_subject").when(no_type("range", "object_type"), "unknown_object")
        .when(~fits("domain", F.col("subject_type")), "domain_mismatch").when(~fits("range", F.col("object_type")), "range_mismatch").when(wrong, "attribute_mismatch")
    )
    out = rows.withColumn("violation", violation)
    return out.drop("kinds", "given") if attributes is not None else out


def ranked(fact: DataFrame) -> tuple[DataFrame, int]:
    """fact with lo and hi, the ranks of window_start and window_end among all such times from 1 on (0 and one past the last where they are missing), and the bits that the ranks take."""
    times = stored(fact.select(F.explode(F.array("window_start", "window_end")).alias("t")).where("t IS NOT NULL").distinct().repartitionByRange("t").sortWithinPartitions("t").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, n = [], 0
    for r in times.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before += [F.lit(r.part), F.lit(n)]
        n += r.n
    base = F.try_element_at(F.create_map(*before), part) if before else F.lit(0)
    ranks = times.select("t", (base + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1).cast("long").alias("rank"))
    if n <= MOST_BROADCAST:
        ranks = F.broadcast(ranks)
    for bound, out, open_ in (("window_start", "lo", 0), ("window_end", "hi", n + 1)):
        fact = fact.join(ranks.withColumnsRenamed({"t": bound, "rank": out}), bound, "left").withColumn(out, F.coalesce(out, F.lit(open_).cast("long"))).drop(bound)
    return fact, (n + 1).bit_length()


def above(point: Column, bits: int) -> Column:
    """The nodes of a binary tree over ranks that hold a rank: level, node."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(point, k).alias("node")) for k in range(bits + 1)])


def cover(low: Column, high: Column, bits: int) -> Column:
    """The fewest nodes that hold the ranks from low to high and no others, two a level at most; none if low is above high."""
    found = []
    for k in range(bits + 1):
        a, b = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high + 1, k)
        for fits, node in ((a % 2 == 1, a), (b % 2 == 1, b - 1)):
            found.append(F.when((a < b) & fits, F.struct(F.lit(k).alias("level"), node.alias("node"))))
    return F.array_compact(F.array(*found))


def crossed(a: Column, b: Column, side: int) -> Column:
    """Places in a plane of two such trees: each node of a with each of b."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y")))))


def smallest(offers: DataFrame, asks: DataFrame, offered: Column, asked: Column) -> DataFrame:
    """cell, other: for each place that an asking cell names, the smallest claim of the other polarity that is offered there. Offers are reduced to a row per place before the join."""
    keys = ["p", "s", "o", "polarity", "place"]
    best = offers.select("p", "s", "o", "polarity", F.explode(offered).alias("place"), "claim_id").groupBy(*keys).agg(F.min("claim_id").alias("other"))
    against = F.when(F.col("polarity") == "positive", "negative").otherwise("positive")
    return asks.select("p", "s", "o", against.alias("polarity"), F.explode(asked).alias("place"), "cell").join(best, keys).groupBy("cell").agg(F.min("other").alias("other"))


def conflicts(claims: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """claim_id, conflicting_id: for each claim the first (smallest) other of opposite polarity about the same fact, directly or by the inverse predicate, whose window overlaps.

    Facts are turned to one direction first, so both cases meet in one equi-join.
    Windows are closed; a missing bound is open. A window that ends before it starts
    meets those that hold both its bounds.

    Only facts that are both asserted and denied go on. Claims about one fact with one
    window are one cell, with its smallest claim. The cells of a fact are compared in
    pairs where these are at most MOST_PAIRS a cell. For the other facts no pairs are
    made: of two windows that overlap, the one that starts later starts inside the
    other. Bounds become ranks; a window is cut into nodes of a binary tree over them, a
    start lies in one node of each level, and cells meet in nodes, each reduced to its
    smallest claim. Rows per cell grow with the logarithm of the number of distinct times.
    """
    named = ["p", "s", "o"]
    turned = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair]) if inverse else F.create_map().cast("map<string,string>")
    other = F.try_element_at(turned, "predicate")
    flip = other.isNotNull() & (other < F.col("predicate"))
    fact = claims.select(
        "claim_id", "polarity", "window_start", "window_end", F.when(flip, other).otherwise(F.col("predicate")).alias("p"), F.when(flip, F.col("object_id")).otherwise(F.col("subject_id")).alias("s"), F.when(flip, F.col("subject_id")).otherwise(F.col("object_id")).alias("o")
    )
    fact = fact.where("polarity IN ('positive', 'negative')")
    contested = fact.groupBy(*named).agg(F.min("polarity").alias("least"), F.max("polarity").alias("most")).where("least <> most").select(*named)
    fact, bits = ranked(stored(fact.join(contested, named, "left_semi")))
    fact = stored(fact)
    window_of = [*named, "polarity", "lo", "hi"]
    every, fact = fact, stored(fact.groupBy(*window_of).agg(F.min("claim_id").alias("claim_id")).withColumn("cell", F.monotonically_increasing_id()))  # claims about a fact with one window ask and offer the same
    sizes = fact.groupBy(*named).agg(F.count_if(F.col("polarity") == "positive").alias("n"), F.count_if(F.col("polarity") == "negative").alias("m"))
    few = sizes.where(F.col("n") * F.col("m") <= MOST_PAIRS * (F.col("n") + F.col("m"))).select(*named)
    near = fact.join(few, named, "left_semi")
    found = near.join(near.selectExpr(*named, "polarity AS against", "lo AS since", "hi AS until", "claim_id AS other"), named).where("polarity <> against AND lo <= until AND since <= hi").groupBy("cell").agg(F.min("other").alias("other"))
    many = stored(fact.join(few, named, "left_anti"))
    if not many.isEmpty():
        found = found.unionByName(overlapping(many, bits))
    asked = fact.drop("claim_id").join(found, "cell")
    return every.join(asked, window_of).groupBy("claim_id").agg(F.min("other").alias("conflicting_id"))


def overlapping(fact: DataFrame, bits: int) -> DataFrame:
    """cell, other: of each cell (p, s, o, polarity, lo, hi, claim_id) the smallest claims against it, by the nodes that conflicts() tells of."""
    lo, hi = F.col("lo"), F.col("hi")
    start, window = above(lo, bits), cover(lo, hi, bits)
    sided = lambda nodes, side: F.transform(nodes, lambda x: F.struct(F.lit(side).alias("side"), x.alias("x")))
    straight, turned_back = fact.where("lo <= hi"), fact.where("lo > hi")
    found = smallest(straight, straight, F.concat(sided(start, 0), sided(window, 1)), F.concat(sided(window, 0), sided(start, 1)))
    if not turned_back.isEmpty():
        # Overlap as it is defined: the other starts at hi or before, and ends at lo or after.
        of_fact = straight.join(turned_back.select("p", "s", "o").distinct(), ["p", "s", "o"], "left_semi")
        offered = crossed(above(lo, bits), above(hi, bits), 0)
        asked = crossed(cover(F.lit(0).cast("long"), hi, bits), cover(lo, F.lit((1 << bits) - 1).cast("long"), bits), 0)
        found = found.unionByName(smallest(of_fact, turned_back, offered, asked)).unionByName(smallest(turned_back, of_fact, offered, asked))
    return found


def cooccurrences(mentions: DataFrame, by: str, name: str, place: str) -> DataFrame:
    """first, second, n: how many texts name both, each unordered pair of distinct names once per text. A text's distinct names are paired inside its own row."""
    names = mentions.groupBy(by).agg(F.array_sort(F.collect_set(name)).alias("names"))
    pairs = names.select(F.posexplode("names").alias("i", "first"), "names").select("first", F.explode(F.slice("names", F.col("i") + 2, F.greatest(F.size("names") - F.col("i") - 1, F.lit(0)))).alias("second"))
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"))


def isolated(text: Column, subject: Column, object_: Column, predicate: Column, cues: dict[str, tuple[str, ...]], margin: int = 10) -> Column:
    """The predicate, or co_occurs_with if no cue of it stands around the two names."""
    s, o = F.call_function("instr", text, subject), F.call_function("instr", text, object_)
    left = F.greatest(F.lit(1), F.least(s, o) - margin)
    right = F.greatest(s + F.length(subject), o + F.length(object_)) + margin
    around = F.substring(text, left, right - left)
    out = predicate
    for p, words in cues.items():
        seen = F.lit(False)
        for w in words:
            seen = seen | around.contains(w)
        out = F.when((predicate == p) & ((s == 0) | (o == 0) | ~seen), F.lit("co_occurs_with")).otherwise(out)
    return out


def hop(edges: DataFrame, n: int) -> DataFrame:
    """Edges with the n-th hop's column names."""
    return edges.select(F.col("edge_id").alias(f"e{n}"), F.col("subject_id").alias(f"v{n - 1}"), F.col("object_id").alias(f"v{n}"), F.col("predicate").alias(f"p{n}"))


def walk(edges: DataFrame, hops: int, tenant_id: str, domain: str, now: Column, directed: bool = True) -> DataFrame:
    """v0, e1, p1, v1, ...: walks of hops edges in a scope, over active, valid edges, no edge twice. Scope and validity are applied at the scan of each hop."""
    if not 1 <= hops <= 4:
        raise ValueError("one to four hops")
    open_ = edges.where((F.col("tenant_id") == tenant_id) & (F.col("domain") == domain) & F.col("is_active") & (F.col("valid_until") > now))
    if not directed:
        back = open_.select("edge_id", F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), "predicate")
        open_ = open_.select("edge_id", "subject_id", "object_id", "predicate").unionByName(back)
    path = hop(open_, 1)
    for n in range(2, hops + 1):
        path = path.join(hop(open_, n), f"v{n - 1}")
        for k in range(1, n):
            path = path.where(F.col(f"e{k}") != F.col(f"e{n}"))
    return path


def elements(path: DataFrame, hops: int) -> DataFrame:
    """kind, id: the distinct nodes and edges of walks."""
    nodes = F.array(*[F.struct(F.lit("node").alias("kind"), F.col(f"v{n}").cast("string").alias("id")) for n in range(hops + 1)])
    edges = F.array(*[F.struct(F.lit("edge").alias("kind"), F.col(f"e{n}").cast("string").alias("id")) for n in range(1, hops + 1)])
    return path.select(F.explode(F.concat(nodes, edges)).alias("x")).select("x.*").distinct()


def latest(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The last row of each group."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(o).desc() for o in order]))
    return rows.withColumn("n", n).where("n = 1").drop("n")
