"""Change events: debounced batches, transactions and bursts, for tables and for streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, key: str, kind: str, at: str, gap: str, watermark: str | None = None) -> DataFrame:
    """One row for each run of events of a key without a pause of ``gap``: its bounds, size and last event.

    On a stream, a watermark bounds the open sessions; a run is given out once it is past.
    """
    if watermark:
        events = events.withWatermark(at, watermark)
    runs = events.groupBy(key, F.session_window(at, gap).alias("w"))
    return runs.agg(F.count("*").alias("n_events"), F.max(F.struct(at, kind)).alias("last"), F.min(at).alias("begins")).select(key, "begins", F.col(f"last.{at}").alias("ends"), "n_events", F.col(f"last.{kind}").alias("last_event"))


def busy(events: DataFrame, key: str, at: str, seconds: int, keys: int, same: int) -> DataFrame:
    """Events of a table with ``busy``: whether in the ``seconds`` up to them at least ``keys`` keys changed, or their own at least ``same`` times.

    Each key counts as changing from its first event until ``seconds`` after the last one of a run without a longer pause.
    So how many keys change at a time is a running sum of begins and ends; it is taken in buckets of time, to which
    the sum of the buckets before is added, so no task sees all events and no row looks back over a frame.
    """
    span = seconds * 1_000_000
    of_key, over = Window.partitionBy(key).orderBy("_us"), Window.orderBy("_bucket")
    before, after = F.lag("_us").over(of_key), F.lead("_us").over(of_key)
    known = F.col(key).isNotNull() & F.col("_us").isNotNull()
    placed = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumns({
        "_begins": known & (before.isNull() | (F.col("_us") - before > span)), "_ends": known & (after.isNull() | (after - F.col("_us") > span)),
        "_enough": F.lag("_us", max(same - 1, 0)).over(of_key) >= F.col("_us") - span,
    })
    own = F.coalesce(F.max("_enough").over(Window.partitionBy(key, "_us")), F.lit(False)) | F.lit(same <= 0)  # of events at one time only the last sees all of them
    step = lambda us, change, event: F.struct(us.alias("us"), change.cast("int").alias("change"), F.lit(event).alias("event"))
    steps = F.array_compact(F.array(step(F.col("_us"), F.col("_begins"), True), F.when(F.col("_ends"), step(F.col("_us") + span + 1, F.lit(-1), False))))
    line = placed.withColumn("_own", own).withColumn("_step", F.explode(steps)).withColumn("_bucket", F.floor(F.col("_step.us") / (8 * span)))
    sums = line.groupBy("_bucket").agg(F.sum("_step.change").alias("_sum"))
    carried = sums.select(F.col("_bucket").alias("_at"), F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inside = F.sum("_step.change").over(Window.partitionBy("_bucket").orderBy("_step.us").rangeBetween(Window.unboundedPreceding, 0))
    seen = line.withColumn("_inside", inside).filter("_step.event").join(carried, F.col("_bucket") == F.col("_at"), "left")
    return seen.withColumn("busy", (F.col("_inside") + F.coalesce("_carried", F.lit(0)) >= keys) | F.col("_own")).select(*events.columns, "busy")


def adaptive_debounced(events: DataFrame, key: str, kind: str, at: str, rest: int, longer: int, seconds: int, keys: int, same: int) -> DataFrame:
    """As ``debounced``, for a table: a run ends after ``rest`` seconds, but ``longer`` after an event of a busy time (see ``busy``)."""
    gap = F.when(F.col("busy"), F.lit(f"{longer} seconds")).otherwise(F.lit(f"{rest} seconds"))
    at_once = busy(events, key, at, seconds, keys, same).withColumn("_gap", gap)
    sessions = at_once.groupBy(key, F.session_window(at, F.col("_gap")).alias("w"))
    return sessions.agg(F.count("*").alias("n_events"), F.max(F.struct(at, kind)).alias("last"), F.min(at).alias("begins")).select(key, "begins", F.col(f"last.{at}").alias("ends"), "n_events", F.col(f"last.{kind}").alias("last_event"))


def batch_shapes(batches: DataFrame, batch: str, path: str) -> DataFrame:
    """What holds the paths of each batch together: one folder, one base name (but for endings and test marks), or nothing: batch, n_paths, shape."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    base = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"((\.|_)(test|spec))?(\.[A-Za-z]+)+$|^test_", "")
    base = F.regexp_replace(base, r"^test_", "")
    counts = batches.groupBy(batch).agg(F.countDistinct(path).alias("n_paths"), F.countDistinct(folder).alias("_folders"), F.countDistinct(base).alias("_bases"))
    return counts.select(batch, "n_paths", F.when(F.col("_folders") == 1, "folder").when(F.col("_bases") == 1, "base_name").otherwise("none").alias("shape"))


def in_update(changes: DataFrame, updates: DataFrame, grace: str = "2 seconds") -> DataFrame:
    """Changes with ``in_update``: whether they fall into an update of their path's root, or within ``grace`` after its end.

    updates: root, started_at, finished_at (null while it runs). changes: path, root, changed_at. An equi-join by root.
    """
    u = updates.select("root", "started_at", (F.col("finished_at") + F.expr(f"interval {grace}")).alias("until")).distinct()
    c = changes.withColumn("_n", F.monotonically_increasing_id())
    hit = (F.col("changed_at") >= F.col("started_at")) & (F.col("until").isNull() | (F.col("changed_at") < F.col("until")))
    marked = c.join(u, "root", "left").groupBy(*changes.columns, "_n").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("in_update"))
    return marked.drop("_n")


def transactions(events: DataFrame, key: str, at: str, gap: str, least: int = 2, watermark: str | None = None) -> DataFrame:
    """Runs of events over all keys in which at least ``least`` keys change."""
    if watermark:
        events = events.withWatermark(at, watermark)
    runs = events.groupBy(F.session_window(at, gap).alias("w"))
    return runs.agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(key)).alias("keys"), F.min(at).alias("begins"), F.max(at).alias("ends")).filter(F.size("keys") >= least)


def runs(events: DataFrame, at: str, gap_seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """Events of a table with ``run``: when the run of events without a longer pause began that they are part of.

    Runs go over all events, so they are found in buckets of time: within each by its order, and across
    them by one row a bucket, which tells the last event and the last beginning before it.
    """
    micros = F.unix_micros(F.col(at))
    placed = events.withColumn("_bucket", F.floor(micros / (bucket_seconds * 1_000_000)))
    own, over = Window.partitionBy("_bucket").orderBy(at), Window.orderBy("_bucket")
    ends = placed.groupBy("_bucket").agg(F.max(at).alias("_last")).select("_bucket", F.lag("_last").over(over).alias("_before"))
    known = placed.join(ends, "_bucket").withColumn("_prior", F.coalesce(F.lag(at).over(own), "_before"))
    fresh = F.col("_prior").isNull() | (micros - F.unix_micros("_prior") > gap_seconds * 1_000_000)
    known = known.withColumn("_begins", F.when(fresh, F.col(at)))
    begun = known.groupBy("_bucket").agg(F.max("_begins").alias("_begun")).select("_bucket", F.max("_begun").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max("_begins").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("_inside", inside).join(begun, "_bucket").withColumn("run", F.coalesce("_inside", "_carried")).drop("_bucket", "_before", "_prior", "_begins", "_inside", "_carried")


def transactions_of_table(events: DataFrame, key: str, at: str, gap_seconds: int, least: int = 2) -> DataFrame:
    """As ``transactions``, for a table of any size; the keys of one run are gathered, all else is summed before."""
    grouped = runs(events, at, gap_seconds).groupBy("run").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(key)).alias("keys"), F.min(at).alias("begins"), F.max(at).alias("ends"))
    return grouped.filter(F.size("keys") >= least).drop("run")


def bursts(events: DataFrame, key: str, at: str, seconds: int, least: int) -> DataFrame:
    """Events of a table with whether ``least`` events of their key lie in the ``seconds`` up to them."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count("*").over(w)).withColumn("in_burst", F.col("n_recent") >= least)


def own_writes(changes: DataFrame, writes: DataFrame, ttl: str, watermark: str) -> DataFrame:
    """Changes that are not the echo of an own write of the same path and hash within ``ttl``; stream or table.

    A stream-stream outer join: state is bounded by the watermarks and the time bound.
    """
    c = changes.withWatermark("changed_at", watermark)
    w = writes.withWatermark("written_at", watermark).select(F.col("path").alias("w_path"), F.col("hash").alias("w_hash"), "written_at")
    on = (F.col("path") == F.col("w_path")) & (F.col("hash") == F.col("w_hash")) & (F.col("changed_at") >= F.col("written_at")) & (F.col("changed_at") <= F.col("written_at") + F.expr(f"interval {ttl}"))
    return c.join(w, on, "left_outer").filter("w_path is null").drop("w_path", "w_hash", "written_at")


def refresh(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands each batch of changes, last one of each path, to ``apply``.

    ``apply`` must be safe to repeat for the same batch number, as a batch may run again after a failure.
    """

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("path").agg(F.max(F.struct("changed_at", "event", "hash")).alias("c")).select("path", "c.*")
        apply(last, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
