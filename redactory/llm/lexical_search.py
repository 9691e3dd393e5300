"""Ranked lexical search of items in documents.

The terms of all items make a vocabulary. Postings are a DataFrame with a row per
document and vocabulary term that it holds, ordered by buckets of terms. Counted, they
give the documents of each term and so its weight; joined with the items' terms, each
match is scored in integers, the scores are summed by item and document, and a window
by item keeps the best. Each of the whole documents counts for all statistics.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.llm.common import MOST_BYTES, id_back, id_key, if_small, slices, stored, table, text_runs

#: Term buckets of the postings.
BUCKETS = 64
#: Up to so many terms the documents are read against a broadcast vocabulary; beyond, all their terms are joined with it.
MOST_TERMS = 200_000
#: Rows of items' terms (some 50 bytes each) that are broadcast at most.
MOST_WEIGHTS = 500_000
#: Joins without a broadcast split each term over so many keys, as a frequent one has a third of all documents.
SALTS = 32
#: The term of a posting that stands for the document itself.
WHOLE = -1

SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(i + 32 if 65 <= i <= 90 else 32 if i in SEPARATORS else i for i in range(256))


def terms(text: Column) -> Column:
    """The different terms of a text: maximal runs of digits, letters A-Z, lower-cased, and a-z, and characters from U+0080 on. Null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), ""))


def counted(docs: DataFrame, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """row (a number of its own for each row of docs), k, n, terms, tfs: a document's numbers of terms of the vocabulary, or all its terms without one, and how often it has each; then WHOLE, or an empty string, with n. Documents without terms are left out."""
    kind = pa.int64() if vocabulary is not None else pa.string()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for run in text_runs(texts):
                at, sizes, ends, names, tfs = [], [], [0], [], []
                for i in run:
                    if words := texts[i].encode().translate(FOLD).split():
                        found = Counter(words)
                        if vocabulary is None:
                            names += [w.decode() for w in found] + [""]
                            tfs += found.values()
                        else:
                            held = [(vocabulary[w], c) for w, c in found.items() if w in vocabulary]
                            names += [w for w, _ in held] + [WHOLE]
                            tfs += [c for _, c in held]
                        tfs.append(len(words))
                        at.append(i)
                        sizes.append(len(words))
                        ends.append(len(tfs))
                offsets, where = pa.array(ends, pa.int32()), pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.compute.add(where, row), batch.column(0).take(where), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(names, kind)), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                    names=["row", "k", "n", "terms", "tfs"],
                )
            row += len(texts)

    return docs.select(id_key().alias("k"), "text").mapInArrow(build, f"row long, k long, n long, terms array<{'long' if vocabulary is not None else 'string'}>, tfs array<long>")


def salted(df: DataFrame, by: str | None) -> DataFrame:
    """df with a salt: of column by, or, for None, each row once with every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))) if by is None else F.pmod(by, F.lit(SALTS)).cast("int"))


def postings(docs: DataFrame, vocabulary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """bucket, term (its number), row, k, n (terms of the document, with repeats), tf: a row per document and term of the vocabulary (term, name) in it, and one with term WHOLE per document with any term. Ordered by bucket and term within partitions; partitions are parts of docs, so a document's postings lie together."""
    n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name") + 100), F.lit(0))).first()
    small = n <= most and size <= MOST_BYTES
    found = counted(docs, {r["name"].encode(): r["term"] for r in vocabulary.collect()} if small else None)
    each = found.select("row", "k", "n", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("p")).select("row", "k", "n", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
    if not small:
        names = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("", WHOLE)], "name string, term long"))
        each = salted(each.withColumnRenamed("term", "name"), "row").join(salted(names, None), ["name", "salt"]).select("row", "k", "n", "term", "tf")
    bucket = F.when(F.col("term") == WHOLE, F.lit(WHOLE)).otherwise(F.pmod("term", F.lit(BUCKETS))).cast("int")
    return each.select(bucket.alias("bucket"), "term", "row", "k", "n", "tf").sortWithinPartitions("bucket", "term")


def search(docs: DataFrame, items: DataFrame, top: int = 50, most_terms: int = MOST_TERMS, most_weights: int = MOST_WEIGHTS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its top documents (doc_id, text) by score above 0; other columns are left alone.

    With N documents that have a term, L terms in them, df documents with a term, n
    terms in a document: a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 +
    50 n N div L, and each of the item's different terms that the document has tf times
    adds w (10^9 tf div (1000 tf + 20 m)). Equal scores are ordered by doc_id, null first,
    and rows of one doc_id are ranked each on its own, in no set order if their scores
    are equal. Null and empty texts have no terms: such documents count for nothing,
    such items return nothing. Rows of items are answered each on its own, with null ids
    too. A very long text is one task's. Empty tables give an empty result.
    """
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    asked = stored(numbered.select("item", "item_id", F.explode(terms(F.col("text"))).alias("name")))
    vocabulary = stored(asked.select("name").distinct().withColumn("term", F.monotonically_increasing_id()))
    index = stored(postings(docs, vocabulary, most_terms))
    n_docs, n_terms = index.where(F.col("bucket") == WHOLE).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = index.where(F.col("bucket") >= 0)
    df = parts.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(asked.join(vocabulary, "name").join(df, "term").select("item", "term", weight.alias("w")).where("w > 0"))
    rows = weights.count()
    m = f"(50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    scored = parts.select("term", "row", "k", F.expr(f"(1000000000L * tf) div (1000L * tf + 20L * {m})").alias("part"))
    if rows <= most_weights:  # dealt by document first, so that all matches of a document meet where they are made
        matches = scored.repartition("row").join(F.broadcast(weights), "term")
    else:
        matches = salted(scored, "row").join(salted(weights, None), ["term", "salt"])
    sums = matches.groupBy("item", "row", "k").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "k", "row"))).where(F.col("rank") <= top)
    ids = asked.groupBy("item").agg(F.first("item_id").alias("item_id"))
    return best.join(if_small(ids, rows, most_weights), "item").select("item_id", "rank", id_back("k").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT i, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
s AS (SELECT i, item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN tf USING (t) JOIN df USING (t), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
