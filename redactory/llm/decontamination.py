"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of a benchmark item is contained in a document only if all its tokens
are, so the necessary prefix of a window, with its tokens ordered by rarity in
the documents, is its rarest token alone. Documents are joined with the windows
on that token; the offset of the token in the window and the lengths of both give
the only place where the window can stand, which must lie inside the document.
The words at that place are then compared with the whole window.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import id_back, id_key, if_small, stored, table, text_hash

#: Broadcast at most so many windows or prefix tokens (some 100 bytes each); with more, Spark shuffles both sides.
MOST_BROADCAST = 100_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, letters a-z and characters from U+0080 on."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, text -> a row per distinct window: ws (its words), wtext (them, joined), len, items (ids that have it). An item of fewer words is one window; one without words has none."""
    w = items.select("item_id", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("ws"))
    return cut.groupBy("ws").agg(F.collect_set("item_id").alias("items")).select("ws", F.array_join("ws", " ").alias("wtext"), F.size("ws").alias("len"), "items")


def rarest(found: DataFrame, docs: DataFrame) -> DataFrame:
    """windows() -> token, off, len, wtext, items: each window by the token that fewest places in docs have."""
    tokens = found.select("wtext", F.posexplode("ws").alias("off", "token"))
    vocabulary = stored(tokens.select("token").distinct())
    n = vocabulary.count()
    all_words = docs.select(F.explode(words(F.col("text"))).alias("token"))
    if n <= MOST_BROADCAST:
        counts = all_words.join(F.broadcast(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    else:  # aggregated first, as a frequent word would make one large group in the join
        counts = all_words.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token", "left_semi")
    first = tokens.join(if_small(stored(counts), n, MOST_BROADCAST), "token", "left").groupBy("wtext").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p"))
    return found.join(first, "wtext").select(F.col("p.token").alias("token"), F.col("p.off").alias("off"), "len", "wtext", "items")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (array of strings, sorted; the items with windows in the document), for each row of docs.

    docs: doc_id, text; items: item_id, text; other columns are left alone. A word of
    a document is hit if it stands in an occurrence of a window of width consecutive
    words of an item. Null and empty texts have no words and no hits, on either side;
    a null item_id counts for n_hit but names no item. Rows with the same doc_id are
    judged by their own texts. With no items nothing is hit; an empty table of documents
    gives an empty result. A very long text is one row, its words one array.
    """
    return judged(docs, items, width).select(id_back("k").alias("doc_id"), "n_words", "n_hit", "item_ids")


def judged(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """decontaminate() with the key of each row, k and th, in place of doc_id."""
    found = stored(windows(items, width))
    prefix = stored(rarest(found, docs))
    n, size = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("wtext") + 16 * F.size("items")), F.lit(0))).first()
    rows = docs.select(id_key().alias("k"), text_hash().alias("th"), "text")
    places = rows.select("k", "th", F.explode(F.array(words(F.col("text")))).alias("w")).select("k", "th", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
    candidates = (
        places.join(if_small(prefix, n, MOST_BROADCAST, size), "token")
        .withColumn("start", F.col("pos") - F.col("off"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .groupBy("k", "th")
        .agg(F.collect_set(F.struct("start", "len", "wtext", "items")).alias("c"))
    )
    whole = rows.join(candidates, ["k", "th"], "left").select("k", "th", "c", F.explode(F.array(words(F.col("text")))).alias("w"))
    sure = whole.select("k", "th", F.size("w").alias("n_words"), F.filter("c", lambda c: F.array_join(F.slice(F.col("w"), c.start + 1, c.len), " ") == c.wtext).alias("hits"))
    sure = sure.withColumn("hits", F.coalesce("hits", F.array().cast(sure.schema["hits"].dataType)))
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c.start, c.start + c.len - 1))))
    ids = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda c: c["items"])), lambda i: i.cast("string"))))
    return sure.select("k", "th", F.col("n_words").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_hit"), ids.alias("item_ids"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS t FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS x FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t
    FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
h AS (SELECT p.r, p.i, p.n, win.item_id FROM p JOIN win USING (n, t)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)
"""
