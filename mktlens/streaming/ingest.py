"""Structured Streaming jobs.

* ``daily_state_stream``: snapshot files -> mergeable daily states. Each
  micro-batch's states are written under ``batch_id=N`` (overwritten on replay,
  so a re-run batch never double counts); readers merge the parts
  (``read_daily_parts``), exactly like a background merge of aggregate states.
  Late snapshots therefore merge into their day however late they arrive (T4).
  Each batch logs the dates it touched; ``compact_daily_parts`` rewrites those
  dates of the base table and nothing else.
* ``ingest_stream``: mixed crawler events -> routed, flattened facts appended
  per batch (T1, T7), same idempotence rule; sellers and categories are merged by key into
  stored tables (``sources.versions``), which rewrite the touched key buckets only.
* ``payment_state_stream`` and ``subscription_stream``: streams with state by payment and by user; the state is a
  stored table of key buckets, each batch one set-based fold of its events into it.

Checkpoints and sinks live under the shared folder the session names in
``spark.checkpoint.dir`` (a scratch folder is taken only when it is unset).
A failing batch fails the query and is replayed from the checkpoint (T2: no
silent loss).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.daily import daily_state, merge_daily
from ..session import ensure_checkpoint_dir
from ..sources.events import category_nodes, extract_sellers, flatten_categories, flatten_products, map_positions, route_events
from ..sources.schema import DAILY
from ..sources.versions import fold_keyed, manifest, merge_keyed, path_exists, read_parts, replace_parts


def scratch_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/mktlens/{name}-{uuid.uuid4().hex[:12]}"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _arrived(spark: SparkSession, batch: DataFrame, checkpoint: str) -> DataFrame:
    """The rows of a micro-batch, stored until the next one: its sources are read once, and jobs on it are ordinary batch jobs."""
    path = f"{checkpoint}/arrived"
    batch.write.mode("overwrite").parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def daily_state_stream(spark: SparkSession, source_dir: str, schema, sink: str, checkpoint: str,
                       max_files_per_trigger: int = 1, available_now: bool = True):
    """Stream snapshot files into daily-state parts, with a log of the dates of each; returns the started query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        part = f"{sink}/parts/batch_id={batch_id}"
        daily_state(batch).write.mode("overwrite").partitionBy("date").parquet(part)
        _write_batch(batch.sparkSession.read.parquet(part).select("date").distinct().coalesce(1), f"{sink}/touched", batch_id)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _daily_parts(spark: SparkSession, sink: str, after: int) -> DataFrame:
    """The parts of batches after the one that was compacted last."""
    schema = T.StructType([*DAILY.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{sink}/parts").filter(F.col("batch_id") > after).select(*DAILY.names)


def read_daily_parts(spark: SparkSession, sink: str) -> DataFrame:
    """Merged daily states: the compacted base and all parts written since."""
    base = read_parts(spark, f"{sink}/base", DAILY)
    return merge_daily(base.unionByName(_daily_parts(spark, sink, manifest(spark, f"{sink}/base")[0])))


def compact_daily_parts(spark: SparkSession, sink: str) -> list[str]:
    """T4: merge the parts written since the last compaction into the base; only the dates they touched are rewritten.

    Returns those dates. The base's version is the last batch it holds, so readers skip that batch's parts and
    those before, and a run that failed can simply be run again.
    """
    done = manifest(spark, f"{sink}/base")[0]
    log = spark.read.schema("date date, batch_id long").parquet(f"{sink}/touched").filter(F.col("batch_id") > done)
    last = log.agg(F.max("batch_id")).first()[0]
    if last is None:
        return []
    dates = [str(r["date"]) for r in log.select("date").distinct().collect()]  # a row a day
    new = _daily_parts(spark, sink, done).filter(F.col("date").isin([dt.date.fromisoformat(d) for d in dates]))
    merged = merge_daily(read_parts(spark, f"{sink}/base", DAILY, dates).unionByName(new), compact=True)
    return sorted(replace_parts(merged, f"{sink}/base", last, F.col("date")))


SELLER_SCHEMA = T.StructType([T.StructField("seller_id", T.LongType()), T.StructField("account_id", T.LongType()),
                              T.StructField("link", T.StringType()), T.StructField("title", T.StringType())])
CATEGORY_SCHEMA = T.StructType([T.StructField("category_id", T.LongType()), T.StructField("parent_category_id", T.LongType()),
                                T.StructField("title", T.StringType())])


def ingest_stream(spark: SparkSession, source_dir: str, schema, sinks: dict[str, str], checkpoint: str,
                  max_files_per_trigger: int = 1, available_now: bool = True):
    """Route mixed events; append flattened products, positions and seller parts per batch.

    The sinks ``seller_table`` and ``category_table`` are stored tables that every batch is merged into by key (read
    with ``versions.read_parts`` and the schemas above); category payloads are trees of any depth, as VARIANT, JSON
    text or a typed struct.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(source_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            routes = route_events(batch)
            if "product" in routes and "product" in sinks:
                _write_batch(flatten_products(routes["product"]), sinks["product"], batch_id)
            if "product" in routes and "seller" in sinks:
                _write_batch(extract_sellers(routes["product"]), sinks["seller"], batch_id)
            if "product" in routes and "seller_table" in sinks:
                merge_keyed(extract_sellers(routes["product"]), sinks["seller_table"], batch_id, ["seller_id", "account_id"], SELLER_SCHEMA)
            if "position" in routes and "position" in sinks:
                _write_batch(map_positions(routes["position"]), sinks["position"], batch_id)
            if "category" in batch.columns and "category_table" in sinks:
                merge_keyed(flatten_categories(category_nodes(batch, "category")), sinks["category_table"], batch_id,
                            ["category_id"], CATEGORY_SCHEMA)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def streaming_daily_state(spark: SparkSession, snap: DataFrame, n_files: int = 6,
                          max_files_per_trigger: int = 2, compact: bool = False) -> DataFrame:
    """Replay ``snap`` as a stream of ``n_files`` time-ordered files and return the merged daily states.

    Used to check that the streaming job equals the batch job.
    """
    root = scratch_root(spark, "daily-stream")
    src = f"{root}/source"
    snap.repartitionByRange(n_files, "ts").write.parquet(src)
    q = daily_state_stream(spark, src, snap.schema, f"{root}/daily", f"{root}/checkpoint", max_files_per_trigger)
    q.awaitTermination()
    if compact:
        compact_daily_parts(spark, f"{root}/daily")
    return read_daily_parts(spark, f"{root}/daily")


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Event-time column for watermarks: ``withWatermark`` needs TIMESTAMP, snapshots carry TIMESTAMP_NTZ."""
    return df.withColumn("event_time", F.col(col).cast("timestamp"))


# --------------------------------------------------------------------------- payments

LEDGER_SCHEMA = "user_id long, payment_id long, paid_on date, days long, subscription_end date"
LEDGER_STATE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("end", T.LongType())])


def ledger_fold(payments: DataFrame, state: DataFrame) -> DataFrame:
    """Ledger rows of new payments: the fold ``end = max(end, paid_on) + days`` per user, from the end kept in state.

    With P the running sum of the days, ``end_m = P_m + max(end_0, max_{k<=m}(paid_on_k - P_{k-1}))`` (the batch job's
    closed form): a user's state is a first row of 0 days in two running aggregates over one sort that spills.
    """
    epoch = F.lit("1970-01-01").cast("date")
    known = state.select("user_id", F.lit(None).cast("long").alias("payment_id"), F.lit(None).cast("date").alias("paid_on"),
                         F.lit(0).cast("long").alias("days"), F.col("end").alias("_end_0"))
    rows = known.unionByName(payments.select("user_id", "payment_id", "paid_on", "days", F.lit(None).cast("long").alias("_end_0")))
    upto = (Window.partitionBy("user_id").orderBy(F.col("_end_0").isNull(), F.asc_nulls_last("paid_on"), F.asc_nulls_last("payment_id"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_P", F.sum("days").over(upto))
    start = F.coalesce(F.col("_end_0"), F.datediff("paid_on", epoch) - (F.col("_P") - F.col("days")))
    rows = rows.withColumn("_m", F.max(start).over(upto)).filter("_end_0 IS NULL")
    return rows.select("user_id", "payment_id", "paid_on", "days",
                       F.date_add(epoch, (F.col("_P") + F.col("_m")).cast("int")).alias("subscription_end"))


def subscription_stream(spark: SparkSession, source_dir: str, schema, sink: str, checkpoint: str,
                        available_now: bool = True):
    """Streaming subscription ledger with state by user: each user's end, in a stored table beside the checkpoint.

    Successful payments only; days = 30 x multiply (at least 30). A batch takes all files
    that are there: the fold needs time order, which files of one delivery don't have. Each batch is folded
    set-based from the ends before it, and rewrites the key buckets of its users; a replayed batch replaces itself.
    """
    pay = (spark.readStream.schema(schema).parquet(source_dir)
           .filter(F.col("status") == "success")
           .select("user_id", "payment_id", F.to_date("created_at").alias("paid_on"),
                   (F.lit(30) * F.greatest(F.coalesce("multiply", F.lit(1)), F.lit(1))).cast("long").alias("days")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        new = _arrived(spark, batch, checkpoint)

        def ends(state: DataFrame) -> DataFrame:
            _write_batch(ledger_fold(new, state), sink, batch_id)
            folded = spark.read.schema(LEDGER_SCHEMA).parquet(f"{sink}/batch_id={batch_id}")
            end = F.datediff("subscription_end", F.lit("1970-01-01").cast("date")).cast("long").alias("end")
            return state.unionByName(folded.select("user_id", end)).groupBy("user_id").agg(F.max("end").alias("end"))  # ends only grow

        fold_keyed(new, f"{checkpoint}/keyed", batch_id, ["user_id"], LEDGER_STATE, ends)

    w = pay.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def streaming_subscription_ledger(spark: SparkSession, payments: DataFrame, n_ranges: int = 3) -> DataFrame:
    """Replay ``payments`` in time order through the stateful stream; returns the ledger rows.

    The payments are cut at day boundaries into ``n_ranges`` time ranges; each
    range is appended to the source folder and drained (``availableNow`` on the
    same checkpoint) before the next one arrives, as a live feed would deliver
    them.
    """
    root = scratch_root(spark, "ledger-stream")
    src, sink, ckpt = f"{root}/source", f"{root}/ledger", f"{root}/checkpoint"
    day = F.datediff(F.to_date("created_at"), F.lit("1970-01-01").cast("date"))
    cuts = payments.select(day.alias("_d")).approxQuantile("_d", [i / n_ranges for i in range(1, n_ranges)], 0.001)
    bounds = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = payments
        if lo is not None:
            part = part.filter(day > lo)
        if hi is not None:
            part = part.filter(day <= hi)
        part.write.mode("append").parquet(src)
        subscription_stream(spark, src, payments.schema, sink, ckpt).awaitTermination()
    if not path_exists(spark, sink):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(sink).drop("batch_id")


def payment_stream(spark: SparkSession, created_dir: str, created_schema, status_events: DataFrame,
                   table_root: str, checkpoint: str, available_now: bool = True):
    """S12 + I11/I12: apply created-payment events batch by batch to a versioned payments table.

    Each batch writes ``version=<batch_id>`` = previous version + the batch's
    events (idempotent on replay); readers take the highest version.
    """
    from ..plans.accounts import apply_payment_events

    stream = spark.readStream.schema(created_schema).parquet(created_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the version before this batch's, so a replay neither reads nor needs what it overwrites
        current = latest_payments(spark, table_root, before=batch_id)
        nxt = apply_payment_events(current, batch, status_events)
        nxt.write.mode("overwrite").parquet(f"{table_root}/version={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_payments(spark: SparkSession, table_root: str, before: int | None = None) -> DataFrame:
    """The newest version of the payments table, or the newest before one; empty where there is none yet."""
    from ..plans.accounts import PAYMENT_SCHEMA

    if not path_exists(spark, table_root):
        return spark.createDataFrame([], PAYMENT_SCHEMA)
    versions = spark.read.schema(T.StructType([*PAYMENT_SCHEMA.fields, T.StructField("version", T.LongType())])).parquet(table_root)
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


PAYMENT_CHANGE = ("payment_id long, kind string, number long, user_id long, created_at string, status string, paid boolean,"
                  " amount double, subscription_type string, multiply long")
#: A payment's state: its created event (null: not yet come), its status events in order, each once, the extensions due after
#: its last change and those due before it, how often it changed, and the batch of the last events.
PAYMENT_STATE = T.StructType([
    T.StructField("payment_id", T.LongType()),
    T.StructField("first", T.StructType([
        T.StructField("at", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("status", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("subscription_type", T.StringType()), T.StructField("multiply", T.LongType())])),
    T.StructField("statuses", T.ArrayType(T.StructType([
        T.StructField("at", T.TimestampNTZType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType())]))),
    *[T.StructField(n, T.LongType()) for n in ("given", "due", "changes", "batch")]])


def payment_fold(events: DataFrame, state: DataFrame, batch_id: int) -> DataFrame:
    """The state after a batch: events (payment_id, first, statuses) put to what is known of their payments.

    Events may come in any order and repeatedly: what is known so far is put in order of event time, as the batch job
    does. An event that comes late never takes an extension back, as the number of changes into success only grows
    with more events, so the extensions already given are the first of those due. Status events wait for their payment.
    """
    new = events.select("*", *[F.lit(0).cast("long").alias(c) for c in ("given", "due", "changes")], F.lit(batch_id).cast("long").alias("batch"))
    rows = state.unionByName(new).groupBy("payment_id").agg(
        F.min("first").alias("first"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("statuses")))).alias("statuses"),
        F.max("given").alias("given"), F.max("due").alias("before"), F.max("changes").alias("changes"), F.max("batch").alias("batch"))
    steps = F.concat(F.array(F.col("first.status")), F.transform("statuses", lambda s: s["status"]))
    into_success = lambda s: F.size(F.filter(s, lambda x, i: (x == "success") & ~F.get(s, i - 1).eqNullSafe(F.lit("success"))))
    due = F.element_at(F.transform(F.array(steps), into_success), 1).cast("long")  # the steps worked out once
    touched, known = F.col("batch") == batch_id, F.col("first").isNotNull()
    return rows.select("payment_id", "first", "statuses", F.when(touched, F.col("before")).otherwise(F.col("given")).alias("given"),
                       F.when(known, due).otherwise(F.lit(0)).cast("long").alias("due"),
                       (F.col("changes") + (touched & known).cast("long")).alias("changes"), "batch")


def payment_changes(state: DataFrame, batch_id: int) -> DataFrame:
    """What a batch changed: the row of every payment with events in it, and every extension that it fired, exactly once."""
    changed = state.filter((F.col("batch") == batch_id) & F.col("first").isNotNull())
    now = F.coalesce(F.try_element_at("statuses", F.lit(-1))["status"], F.col("first.status"))
    row = lambda kind, number, status: F.struct(F.lit(kind).alias("kind"), number.alias("number"), status.alias("status"))
    fired = F.when(F.col("due") > F.col("given"), F.sequence(F.col("given") + 1, F.col("due"))).otherwise(F.array().cast("array<bigint>"))
    rows = F.concat(F.array(row("payment", F.col("changes"), now)), F.transform(fired, lambda n: row("extension", n, F.lit("success"))))
    return changed.select("payment_id", "first", F.explode(rows).alias("x")).select(
        "payment_id", "x.kind", "x.number", "first.user_id", F.date_format("first.at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        "x.status", (F.col("x.status") == "success").alias("paid"), "first.amount", "first.subscription_type", "first.multiply")


def payment_state_stream(created: DataFrame, status_events: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """The created and the status stream of payments as one stream with state by payment.

    ``created`` and ``status_events`` are streaming DataFrames with the columns of the batch job (``plans.accounts``). The
    sink's rows are payments (number: the change) and extensions (number: the payment's nth). The state is a stored table
    beside the checkpoint; a batch rewrites the key buckets of its payments, and a replayed batch replaces itself.
    """
    from ..plans.accounts import PAYMENT_STATUS, PLAN_CODES

    spark = created.sparkSession
    plan_map = F.create_map(*[x for k, v in PLAN_CODES.items() for x in (F.lit(k), F.lit(v))])
    status = F.when(F.col("status").isin(list(PAYMENT_STATUS)), F.col("status")).otherwise(F.lit("unknown"))
    of = {f.name: f.dataType for f in PAYMENT_STATE.fields}
    first = F.struct(F.col("created_at").cast("timestamp_ntz").alias("at"), F.col("user_id").cast("long").alias("user_id"), status.alias("status"),
                     (F.col("amount_minor") / 100).alias("amount"),
                     F.element_at(plan_map, F.col("plan_code").cast("int")).alias("subscription_type"),
                     F.coalesce(F.col("multiply"), F.lit(1)).cast("long").alias("multiply"))
    one = created.select("payment_id", first.alias("first"), F.array().cast(of["statuses"]).alias("statuses")).filter("first.subscription_type IS NOT NULL")
    known = F.struct(F.col("event_ts").cast("timestamp_ntz").alias("at"), F.col("event_seq").cast("long").alias("seq"), F.col("status").alias("status"))
    two = (status_events.filter(F.col("status").isin(list(PAYMENT_STATUS)))
           .select("payment_id", F.lit(None).cast(of["first"]).alias("first"), F.array(known).cast(of["statuses"]).alias("statuses")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        new = _arrived(spark, batch, checkpoint)
        root = f"{checkpoint}/keyed"
        parts = fold_keyed(new, root, batch_id, ["payment_id"], PAYMENT_STATE, lambda state: payment_fold(new, state, batch_id))
        if parts:
            _write_batch(payment_changes(read_parts(spark, root, PAYMENT_STATE, parts), batch_id), sink, batch_id)

    w = one.unionByName(two).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def streamed_payments(spark: SparkSession, created: DataFrame, status_events: DataFrame, n_ranges: int = 2) -> DataFrame:
    """Replay payment events through the stateful stream, status events out of order and before their payments, part of all
    events twice; returns each payment's last row and its number of extensions."""
    root = scratch_root(spark, "payment-stream")
    day = F.pmod(F.hash("payment_id", "event_ts"), F.lit(n_ranges))
    again = F.col("payment_id") % 4 == 0
    deliveries = [(created.filter(F.col("payment_id") % 2 == 0), status_events.filter(day == n_ranges - 1)),
                  (created.filter(again | (F.col("payment_id") % 2 == 1)), status_events.filter(again | (day != n_ranges - 1)))]
    for c, e in deliveries:
        c.write.mode("append").parquet(f"{root}/created")
        e.write.mode("append").parquet(f"{root}/status")
        sources = [spark.readStream.schema(df.schema).parquet(f"{root}/{name}") for df, name in ((created, "created"), (status_events, "status"))]
        payment_state_stream(*sources, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    changes = (spark.read.schema(PAYMENT_CHANGE).parquet(f"{root}/changes") if path_exists(spark, f"{root}/changes")
               else spark.createDataFrame([], PAYMENT_CHANGE))
    last = F.max_by(F.struct("user_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "status", "paid", "amount",
                             "subscription_type", "multiply"), F.when(F.col("kind") == "payment", F.col("number")))
    return (changes.groupBy("payment_id").agg(last.alias("p"), F.count_if(F.col("kind") == "extension").alias("extensions"))
            .select("payment_id", "p.*", "extensions"))


def day_bucket(ts_col: str = "ts"):
    """T5: tumbling one-day event-time window (start of the day)."""
    return F.window(F.col(ts_col), "1 day")["start"]
