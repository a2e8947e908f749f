"""What a crawl's frontier makes of discovered URLs: dedup, caps, terminal states, and their accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import transient
from .graph import ensure_checkpoints

STATES = ["fetched", "errored", "out_of_scope", "duplicate_key"]


def distinct_keys(found: DataFrame) -> DataFrame:
    """Each canon_key of found (seq, canon_key, …) as it was first discovered; rows of a key are reduced before they are shuffled."""
    others = [x for x in found.columns if x != "canon_key"]
    first = found.groupBy("canon_key").agg(F.min_by(F.struct(*others), "seq").alias("_first"))
    return first.select(*(F.col("canon_key") if x == "canon_key" else F.col("_first")[x].alias(x) for x in found.columns))


def _dealt(keys: DataFrame, by: str) -> DataFrame:
    """keys by ranges of `by` in _part, as many as they fill, kept in the checkpoint folder as ranges are sampled anew each time."""
    ensure_checkpoints(keys)
    return keys.repartitionByRange(by).withColumn("_part", F.spark_partition_id()).checkpoint()


def _placed(dealt: DataFrame, by: str) -> DataFrame:
    """rank, 1 onwards, over all rows: the number of rows in the ranges before, and the place in the range."""
    counts, offsets, total = sorted(dealt.groupBy("_part").count().collect()), [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    before = dealt.sparkSession.createDataFrame(offsets, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + own).drop("_before")


def ranked(keys: DataFrame, by: str = "seq") -> DataFrame:
    """rank, 1 onwards, over all rows. No task sorts all rows, and only a count for each range is gathered."""
    return _placed(_dealt(keys, by), by).drop("_part")


def capped(keys: DataFrame, max_keys: int, max_per_template: int, seen: int = 0, taken: DataFrame | None = None) -> DataFrame:
    """keys (seq, canon_key, template, in_scope), distinct, with rank and state: enqueued, out_of_scope, global or template.

    Keys out of scope pass by both caps, but count as seen for the global one. seen keys came before, and taken
    (template, n) of them were enqueued. A template's keys are counted by ranges first, so that they don't meet in a task.
    """
    rows = _placed(_dealt(keys, "seq"), "seq")
    may = F.col("in_scope") & (F.col("rank") + seen <= max_keys)
    parts = rows.filter(may).groupBy("template", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("template").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("template", "_part", F.coalesce(before, F.lit(0)).alias("_n"))
    rows = rows.join(parts, ["template", "_part"], "left")
    if taken is not None:
        rows = rows.join(taken.select("template", F.col("n").alias("_taken")), "template", "left")
    own = F.sum(may.cast("int")).over(Window.partitionBy("template", "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.coalesce("_n", F.lit(0)) + own + (F.coalesce("_taken", F.lit(0)) if taken is not None else 0)
    state = F.when(~F.col("in_scope"), "out_of_scope").when(~may, "global").when(place > max_per_template, "template").otherwise("enqueued")
    return rows.withColumn("state", state).select(*keys.columns, "rank", "state")


def accounting(states: DataFrame) -> DataFrame:
    """(state, n) for every terminal state, zeros too."""
    domain = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return domain.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def unaccounted(seen: DataFrame, states: DataFrame, k: int = 10) -> DataFrame:
    """The first k keys that were seen and have no terminal state."""
    return seen.select("canon_key").join(states.filter(F.col("state").isin(STATES)).select("canon_key"), "canon_key", "left_anti").orderBy("canon_key").limit(k)


def assert_accounted(seen: DataFrame, states: DataFrame) -> None:
    """Raises an AssertionError unless as many keys are in a terminal state as were seen."""
    total, n = states.filter(F.col("state").isin(STATES)).count(), seen.select("canon_key").distinct().count()
    if total != n:
        raise AssertionError(f"{total} keys in a terminal state, {n} seen; without one: {[r[0] for r in unaccounted(seen, states).collect()]}")


def outcomes(log: DataFrame) -> DataFrame:
    """(canon_key, state, retries) of attempts (seq, canon_key, status, error): a transient failure is tried once more, after all others.

    retries is 0 for a key that was fetched, and 2 for one whose second attempt was transient as well.
    """
    attempt = F.struct(transient(F.col("status"), F.col("error")).alias("again"), F.col("error").isNull().alias("ok"))
    tried = log.groupBy("canon_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", attempt.alias("a")))), 1, 2).alias("t"))
    first, last = F.col("t")[0]["a"], F.element_at("t", -1)["a"]
    end = F.when(first["again"], last).otherwise(first)
    ok = ~end["again"] & end["ok"]
    both = first["again"] & last["again"] & (F.size("t") > 1)
    return tried.select("canon_key", F.when(ok, "fetched").otherwise("errored").alias("state"), F.when(ok, 0).when(both, 2).when(first["again"], 1).otherwise(0).alias("retries"))


def unfetched(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """(canon_key) of references that no row has."""
    return edges.select(F.col("dst").alias("canon_key")).distinct().join(manifest.select("canon_key"), "canon_key", "left_anti")
