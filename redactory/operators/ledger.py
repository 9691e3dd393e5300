"""Commands folded into states, request histories, and token labels decoded into entities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.sources.tables import slices

#: From which states a command leads where; other commands leave the state alone.
STEPS = {("proposed", "publish"): "published", ("proposed", "reject"): "rejected", ("proposed", "dispute"): "disputed", ("disputed", "reject"): "rejected", ("published", "withdraw"): "withdrawn", ("proposed", "withdraw"): "withdrawn", ("rejected", "revise"): "proposed", ("withdrawn", "revise"): "proposed"}


def fold_ranges(rows: DataFrame, key: str, states: list[str]) -> DataFrame:
    """rows: key, o, command, sorted in their partitions. Returns a row per key and partition: key, o, command (its first), and for each state that it may start in, by the state's number, the last state's number, the revisions and the commands applied. Rows stream by in constant memory."""
    n = len(states)
    moves: dict[str, list[int]] = {}
    for (s, c), to in STEPS.items():
        moves.setdefault(c, list(range(n)))[states.index(s)] = states.index(to)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        first: list[pa.Array] = []
        for batch in slices(batches, 10_000):
            keys, done = batch.column(0).to_pylist(), []
            for i, (k, c) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                if held is None or k != held[0]:
                    if held:
                        done.append((first, held))
                    held, first = [k, list(range(n)), [0] * n, [0] * n], [batch.column(j).slice(i, 1) for j in range(3)]
                if (to := moves.get(c)) is None:
                    continue
                _, at, revised, applied = held
                for s in range(n):
                    if to[at[s]] != at[s]:
                        at[s] = to[at[s]]
                        revised[s] += c == "revise"
                        applied[s] += 1
            if done:
                yield packed(done)
        if held:
            yield packed([(first, held)])

    def packed(done: list) -> pa.RecordBatch:
        heads = [pa.concat_arrays([f[j] for f, _ in done]) for j in range(3)]
        return pa.RecordBatch.from_arrays([*heads, *(pa.array([h[j] for _, h in done], pa.list_(pa.int64())) for j in (1, 2, 3))], names=[key, "o", "command", "at", "revised", "applied"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(fold, f"{kinds}, at array<long>, revised array<long>, applied array<long>")


def fold_states(commands: DataFrame, key: str, order: str, command: str, first: str = "proposed") -> DataFrame:
    """key, state, version (1 and one more per revision), n_applied: the commands of a key in order, those of one order by name.

    Commands are dealt by ranges of key and order, so one key may span partitions.
    Each range gives its outcome for every state that it may start in; a key's
    ranges, a row per partition at most, are then composed.
    """
    states = sorted({first, *(s for s, _ in STEPS), *STEPS.values()})
    rows = commands.select(key, F.col(order).alias("o"), F.col(command).alias("command")).repartitionByRange(key, "o", "command").sortWithinPartitions(key, "o", "command")
    parts = fold_ranges(rows, key, states).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "command", "at", "revised", "applied"))).alias("c"))
    start = F.struct(F.lit(states.index(first)).cast("long").alias("at"), F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("n_applied"))

    def step(acc: Column, c: Column) -> Column:
        told = lambda name: F.element_at(c[name], (acc["at"] + 1).cast("int"))
        return F.struct(told("at").alias("at"), (acc["version"] + told("revised")).alias("version"), (acc["n_applied"] + told("applied")).alias("n_applied"))

    names = F.array(*map(F.lit, states))
    return parts.select(key, F.aggregate("c", start, step).alias("s")).select(key, F.element_at(names, (F.col("s.at") + 1).cast("int")).alias("state"), "s.version", "s.n_applied")


def history(requests: DataFrame, now: Column, model: str | None = None, protocol: str | None = None, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Metadata of the unexpired requests that fit; the stages' contents are not read."""
    fits = F.col("expires_at") > now
    for column, value in (("model", model), ("protocol", protocol), ("status", status)):
        if value is not None:
            fits = fits & (F.col(column) == value)
    if since is not None:
        fits = fits & (F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        fits = fits & (F.col("created_at") < F.lit(until).cast("timestamp"))
    return requests.where(fits)


def decode_labels(tokens: DataFrame, by: str, order: str) -> DataFrame:
    """tokens: by, order, label (B-X, I-X or O), start, end. Returns by, entity_type, start, end: an I after another type or after O begins an entity as a B does."""
    w = Window.partitionBy(by).orderBy(order)
    kind = F.when(F.col("label") != "O", F.expr("substring(label, 3)"))
    t = tokens.withColumn("entity_type", kind)
    before = F.lag("entity_type").over(w)
    t = t.withColumn("begins", F.when(F.col("entity_type").isNotNull() & (F.col("label").startswith("B-") | before.isNull() | (before != F.col("entity_type"))), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("entity", F.sum("begins").over(upto))
    # Entities are numbered along the order, so the greatest pairs up to a token are of its own entity: nothing is grouped.
    low, high = F.max(F.struct("entity", F.bitwise_not("start").alias("x"))).over(upto), F.max(F.struct("entity", F.col("end").alias("x"))).over(upto)
    last = F.lead("entity_type").over(w).isNull() | (F.lead("begins").over(w) == 1)
    t = t.select(by, "entity_type", F.bitwise_not(low["x"]).alias("start"), high["x"].alias("end"), last.alias("last"))
    return t.where("entity_type IS NOT NULL AND last").drop("last")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_first: bool) -> DataFrame:
    """One row per key of both: the first or the last by order, as ON CONFLICT DO NOTHING or DO UPDATE gives."""
    by = F.col(order).asc() if keep_first else F.col(order).desc()
    return old.unionByName(new).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("n = 1").drop("n")
