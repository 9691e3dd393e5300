"""Mixing sources to target weights with hash-threshold histograms.

Sizes are words. Each source gets a target, whole copies of the source cover the
whole multiples of its size in the target, and a threshold on a hash of the row
picks the documents that get one copy more. The threshold comes from histograms:
words are summed by source and hash bucket, the bucket in which the budget runs
out is found, and only its rows are summed again by the next bits of the hash.
Nothing is sorted, and a lower budget always takes a subset of a higher one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.llm.common import WHITE, if_small, stored, table

#: The hash has LEVELS times BITS bits; each level of the histogram uses BITS.
BITS, LEVELS = 10, 6


def n_words(text: Column) -> Column:
    """Number of runs of characters other than WHITE; null has none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def row_hash() -> Column:
    """60 bits of the MD5 of the id and the text's MD5; equal rows get equal hashes."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes: a row per source (key, source, source_size). Adds target: the shares by weight, none above cap times the source's size.

    Sources reach their cap in the order of size over weight. With the first k
    capped, the others share what is left by weight; the first source whose share
    is below its cap ends the capping.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")).withColumn("most", (F.col("source_size") * cap).cast("double"))
    everyone = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        weighed.withColumn("left_over", F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("free", F.col("most") * F.col("left_w") > F.col("left_over") * F.col("w"))
    )
    first_free = F.min_by(F.struct("left_over", "left_w"), F.when(F.col("free"), F.col("most") / F.col("w"))).over(everyone)
    return shared.withColumn("f", first_free).select("key", "source_size", F.when(F.col("free"), F.col("f.left_over") * F.col("w") / F.col("f.left_w")).otherwise(F.col("most")).alias("target"))


def thresholds(lots: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """lots: key, h, size, n (rows with them). budgets: key, budget. Returns key, edge, fit: rows of the source with a hash below edge fit the budget, and of those at edge so many that it is met as nearly as can be."""
    state = budgets.select("key", "budget", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("done"))
    for level in range(1, LEVELS + 1):
        low = BITS * (LEVELS - level)
        sums = (
            lots.join(if_small(state.select("key", "budget", "edge", "done"), n_sources), "key")
            .where(F.shiftright("h", low + BITS) == F.col("edge"))
            .groupBy("key", F.shiftright("h", low).alias("bucket"))
            .agg(F.sum(F.col("size") * F.col("n")).alias("z"), F.sum("n").alias("n"), F.first("budget").alias("budget"), F.first("done").alias("done"))
        )
        upto = F.col("done") + F.sum("z").over(Window.partitionBy("key").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        edge = over.groupBy("key").agg(F.min_by(F.struct("bucket", "z", "n", "upto", "budget"), "bucket").alias("e"))
        state = edge.select("key", F.col("e.budget").alias("budget"), F.col("e.bucket").alias("edge"), (F.col("e.upto") - F.col("e.z")).alias("done"), F.col("e.z").alias("z"), F.col("e.n").alias("n"))
    nearest = F.ceil((F.col("budget") - F.col("done")) * F.col("n") / F.col("z") - 0.5)
    return state.select("key", "edge", F.least(F.greatest(nearest, F.lit(0)), F.col("n")).cast("long").alias("fit"))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Stored rows with row (from monotonically_increasing_id) -> nth besides, from 1 on within each by. Rows of one by are numbered partition by partition, and the partitions' counts added up, so that none makes one task's group."""
    part = F.shiftright("row", 33)
    marked = rows.withColumn("part", part)
    before = marked.groupBy(*by, "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")).drop("n")
    return marked.withColumn("i", F.row_number().over(Window.partitionBy(*by, "part").orderBy("row"))).join(before, [*by, "part"]).withColumn("nth", F.col("i") + F.col("before")).drop("part", "i", "before")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target (of the source, in words), copies (how often the mix takes the row), taken (size times copies), h.

    docs needs doc_id, text and source; other columns are left alone. weights go to
    the sources in code point order, null last, over and over. Null and empty texts
    have size 0 and so add nothing to taken. Rows with the same doc_id and text have one
    hash and are a lot: where a lot lies on the threshold, so many of its rows are taken
    once more as come nearest to the target. An empty table gives an empty result; a
    source without words has target 0. A very long text counts as one row, so a source
    is off its target by half the size of one row at most. Targets are one task's work,
    with a row per source.
    """
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = stored(docs.select("doc_id", "source", key.alias("key"), n_words(F.col("text")).alias("size"), row_hash().alias("h"), F.monotonically_increasing_id().alias("row")))
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")))
    n_sources = goals.count()
    budgets = goals.where("source_size > 0").select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    edges = stored(thresholds(rows.select("key", "size", "h", F.lit(1).alias("n")), budgets, n_sources))
    plan = goals.join(if_small(edges, n_sources), "key", "left")
    planned = rows.join(if_small(plan, n_sources), "key")
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    more = F.coalesce(F.col("h") < F.col("edge"), F.lit(False)).cast("long")
    out = ["doc_id", "size", "source_size", "target", "h"]
    sure = planned.where(~at_edge).select(*out, (F.col("whole") + more).alias("copies"))
    lots = numbered(planned.where(at_edge), "key").select(*out, (F.col("whole") + (F.col("nth") <= F.col("fit")).cast("long")).alias("copies"))
    both = sure.unionByName(lots).withColumn("copies", F.least(F.lit(cap), F.col("copies")))
    return both.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "h")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with all its columns, whatever their names and types. Of rows with the same doc_id and text any may be those that are taken once more. Null ids and texts, repeated rows and empty tables as in mix()."""
    lots = stored(mix(docs, weights, cap).groupBy(F.col("doc_id").alias("id"), "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0"))
    lots = lots.select("id", "h", F.floor(F.col("copies") / F.col("n")).cast("int").alias("each"), (F.col("copies") % F.col("n")).alias("rest"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").alias("of"), row_hash().alias("of_h"))
    found = whole.join(lots, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_h") == F.col("h"))).select("whole", "id", "h", "each", "rest")
    even = found.where("rest = 0").select("whole", "each")
    uneven = stored(found.where("rest > 0").withColumn("row", F.monotonically_increasing_id()))  # a lot for each source at most
    picked = numbered(uneven.select("row", F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id"), "h", "rest"), "id", "h").where("nth <= rest").select("row")
    odd = uneven.join(picked.withColumn("one", F.lit(1)), "row", "left").select("whole", (F.col("each") + F.coalesce("one", F.lit(0))).alias("each"))
    times = F.sequence(F.lit(1), F.col("each"))
    return even.unionByName(odd).where("each > 0").select("whole", F.explode(times)).select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, sum(size)::DOUBLE * 3 AS most, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((k - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS left_over, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
    FROM w WINDOW b AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * left_w > left_over * w AS free FROM l),
e AS (SELECT min_by(left_over, most / w) AS lo, min_by(left_w, most / w) AS lw FROM f WHERE free),
t AS (SELECT source, source_size, CASE WHEN free THEN lo * w / lw ELSE most END AS target FROM f LEFT JOIN e ON true),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto, sum(d.size) OVER lot AS z, count(*) OVER lot AS n, row_number() OVER lot AS nth
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW lot AS (PARTITION BY d.source, d.h)),
r AS (SELECT *, target - whole * source_size AS budget FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    (size * least(3, whole + CASE WHEN upto <= budget OR (upto - z <= budget AND nth <= ceil((budget - (upto - z)) * n / z - 0.5)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
