"""Plans, access checks, shared API keys, payments and the subscription ledger.

Set-based jobs over request / payment logs: each decision is a column, never
a per-request service call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import running_aggs, running_sums

# Fixed values of the plans: (name, min days, max days, shop reports a day, category reports a day).
PLANS = [
    ("demo", 1, 30, 10, 10),
    ("default", 1, 30, 100, 0),
    ("advanced", 1, 90, 100, 100),
    ("pro", 1, 120, 100, 100),
]
# Payment status codes and plan codes of payment events.
PAYMENT_STATUS = {"pending": "pending", "canceled": "canceled", "failed": "failed", "success": "success"}
PLAN_CODES = {1: "default", 2: "advanced", 3: "pro"}
DAYS_PER_PAYMENT_UNIT = 30


def plans(spark: SparkSession) -> DataFrame:
    """The plan table (four literal rows; joins to it are broadcast by size)."""
    schema = "subscription_type string, min_days int, max_days int, shop_reports int, category_reports int"
    return spark.createDataFrame(PLANS, schema)


def _active(as_of: str):
    return F.col("subscription_end_at") >= F.lit(as_of).cast("date")


def access_check(requests: DataFrame, users: DataFrame, plan: DataFrame, as_of: str) -> DataFrame:
    """E2 + E3: days-range and history access for every request (``days``, ``from_date``).

    Range: active subscription and ``days`` within the plan's range; a range of
    0 days or less is always allowed. History: non-pro plans may not start
    before ``as_of - (max_days + 1)``.
    """
    r = requests.join(users, "user_id", "left").join(F.broadcast(plan), "subscription_type", "left")
    active = F.col("subscription_type").isNotNull() & _active(as_of)
    days_ok = (F.col("days") <= 0) | (active & F.col("days").between(F.col("min_days"), F.col("max_days")))
    earliest = F.date_sub(F.lit(as_of).cast("date"), (F.col("max_days") + 1))
    hist_ok = active & ((F.col("subscription_type") == "pro") | (F.col("from_date") >= earliest))
    verdict = lambda ok: F.when(ok, "PERMIT").otherwise("PROHIBIT")
    return r.select("request_id", "user_id", "days", "from_date",
                    verdict(days_ok).alias("days_access"), verdict(hist_ok).alias("history_access"))


def report_quota(requests: DataFrame, users: DataFrame, plan: DataFrame, as_of: str) -> DataFrame:
    """The n-th report request of a user, type and day is allowed iff the subscription is active and n <= limit.

    The count of earlier requests the same day is a running count per (user,
    type, day) ordered by (created_at, report_id), split by hour so a user
    flooding one day is not one task.
    """
    # rank within (user, type, day) as a skew-split running count (hour buckets), not one window per user-day
    r = running_sums(requests.withColumn("date", F.to_date("created_at")), ["user_id", "report_type", "date"],
                     F.hour("created_at"), ["created_at", "report_id"], {"_rank": F.lit(1).cast("long")})
    r = (r.withColumn("_before", F.col("_rank") - 1)
         .join(users, "user_id", "left").join(F.broadcast(plan), "subscription_type", "left"))
    limit = F.when(F.col("report_type") == "seller", F.col("shop_reports")).otherwise(F.col("category_reports"))
    ok = F.col("subscription_type").isNotNull() & _active(as_of) & (F.col("_before") < limit)
    return r.select("report_id", "user_id", "report_type", "date",
                    F.when(ok, "PERMIT").otherwise("PROHIBIT").alias("decision"))


def shared_keys(access_log: DataFrame, window: str = "3 hours") -> DataFrame:
    """E5: per API key and tumbling window, flag keys used from too many places.

    Only keys seen from more than 2 (ip, browser) pairs are judged; they are
    flagged with more than 6 ips or any ip with more than 3 browsers.
    """
    per_ip = (access_log.groupBy("api_key", F.window("ts", window).alias("w"), "ip")
              .agg(F.count_distinct("browser").alias("browsers")))
    per_key = (per_ip.groupBy("api_key", "w")
               .agg(F.sum("browsers").alias("pairs"), F.count(F.lit(1)).alias("ips"),
                    F.max("browsers").alias("max_browsers_per_ip")))
    flagged = (F.col("pairs") > 2) & ((F.col("ips") > 6) | (F.col("max_browsers_per_ip") > 3))
    return per_key.select("api_key", F.col("w.start").alias("window_start"), "pairs", "ips",
                          "max_browsers_per_ip", flagged.alias("flagged"))


def subscription_ledger(payments: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Subscription end after each successful payment, per user.

    The fold ``end = max(end, paid_on) + days`` is evaluated in closed form:
    with P_m the running sum of days, ``end_m = P_m + max(end_0, max_{k<=m}(paid_on_k - P_{k-1}))``
    -- a running sum and a running max over the user's payments (no sequential
    loop). Days = 30 x multiply (at least 30). Without ``users`` every user
    starts without a subscription.
    """
    p = (payments.filter(F.col("status") == "success")
         .withColumn("paid_on", F.to_date("created_at"))
         .withColumn("days", DAYS_PER_PAYMENT_UNIT * F.greatest(F.coalesce("multiply", F.lit(1)), F.lit(1))))
    epoch = F.lit("1970-01-01").cast("date")
    month = F.date_trunc("month", F.col("paid_on"))
    order = ["paid_on", "payment_id"]
    # two skew-split running aggregates per user (month buckets): P = sum of days, M = max of (t - P_prev)
    p = running_sums(p, "user_id", month, order, {"_P": F.col("days")})
    p = running_aggs(p, "user_id", month, order,
                     {"_m": ("max", F.datediff("paid_on", epoch) - (F.col("_P") - F.col("days")))})
    base = F.col("_m")
    if users is not None:
        p = p.join(users.select("user_id", F.datediff("subscription_end_at", epoch).alias("_e0")), "user_id", "left")
        base = F.greatest(F.col("_m"), F.coalesce(F.col("_e0"), F.col("_m")))
    return p.select("user_id", "payment_id", "paid_on", "days",
                    F.date_add(epoch, (F.col("_P") + base).cast("int")).alias("subscription_end"))


def subscription_status(users: DataFrame, as_of: str) -> DataFrame:
    """Active iff the end is after ``as_of``."""
    return users.select("user_id", "subscription_type", "subscription_end_at",
                        (F.col("subscription_end_at") > F.lit(as_of).cast("date")).alias("active"))


PAYMENT_SCHEMA = T.StructType([
    T.StructField("payment_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("status", T.StringType()),
    T.StructField("paid", T.BooleanType()), T.StructField("amount", T.DoubleType()),
    T.StructField("subscription_type", T.StringType()), T.StructField("multiply", T.LongType())])


def created_payments(created: DataFrame) -> DataFrame:
    """Created-payment events as payment rows, one a payment (the earliest event; ties by the whole row).

    Amounts come in minor units, plans as codes; events without a known plan don't count. The status is the event's
    ('unknown' if it is none of the known ones, 'pending' if events carry none); a payment created as a success is paid.
    """
    plan_map = F.create_map(*[x for k, v in PLAN_CODES.items() for x in (F.lit(k), F.lit(v))])
    sent = F.col("status") if "status" in created.columns else F.lit("pending")
    status = F.when(sent.isin(list(PAYMENT_STATUS)), sent).otherwise(F.lit("unknown"))
    rows = created.select("payment_id", F.struct(
        F.col("created_at").cast("timestamp_ntz").alias("created_at"), "user_id", status.alias("status"),
        (status == "success").alias("paid"), (F.col("amount_minor") / 100).alias("amount"),
        F.element_at(plan_map, F.col("plan_code").cast("int")).alias("subscription_type"),
        F.col("multiply").cast("long").alias("multiply")).alias("x")).filter("x.subscription_type IS NOT NULL")
    first = rows.groupBy("payment_id").agg(F.min("x").alias("x"))
    return first.select("payment_id", "x.user_id", "x.created_at", "x.status", "x.paid", "x.amount", "x.subscription_type", "x.multiply")


def _payment_table(payments: DataFrame, created: DataFrame) -> DataFrame:
    """Stored payments and those created whose id is unseen, with ``_new``."""
    new = created_payments(created).join(payments.select("payment_id"), "payment_id", "left_anti")
    return (payments.select(*[c.name for c in PAYMENT_SCHEMA], F.lit(False).alias("_new"))
            .unionByName(new.withColumn("_new", F.lit(True))))


def known_status_events(status_events: DataFrame) -> DataFrame:
    """Status events (payment_id, status, event_ts, event_seq) of known statuses, each once however often it was sent."""
    return status_events.filter(F.col("status").isin(list(PAYMENT_STATUS))).select(
        "payment_id", "status", "event_ts", "event_seq").distinct()


def apply_payment_events(payments: DataFrame, created: DataFrame, status_events: DataFrame) -> DataFrame:
    """I11 + I12: insert created payments whose id is unseen, then apply the latest status change per payment.

    Status events carry (payment_id, status, event_ts, event_seq); ties on (event_ts, event_seq) resolve to the
    greatest status name. Unknown statuses are ignored; a payment is paid as long as its last status is 'success'.
    """
    latest = (known_status_events(status_events).groupBy("payment_id")
              .agg(F.max_by("status", F.struct("event_ts", "event_seq", "status")).alias("_now")))
    return (_payment_table(payments, created).join(latest, "payment_id", "left")
            .withColumn("status", F.coalesce("_now", "status"))
            .withColumn("paid", F.coalesce(F.col("_now") == "success", F.col("paid"))).drop("_now", "_new"))


def payment_extensions(payments: DataFrame, created: DataFrame, status_events: DataFrame) -> DataFrame:
    """The subscription extensions that payment events fire, (payment_id, extension, user_id, paid_on, subscription_type, days).

    A payment extends its user's subscription each time it becomes a success, also by being created as one; a success that
    follows a success fires nothing, nor do payments that were stored as successes. Numbered per payment in order of events.
    """
    table = _payment_table(payments, created)
    first = table.select("payment_id", F.lit(0).alias("_o"), F.lit(None).cast("timestamp_ntz").alias("event_ts"),
                         F.lit(None).cast("long").alias("event_seq"), "status", "_new")
    later = (known_status_events(status_events).join(table.select("payment_id"), "payment_id", "left_semi")
             .select("payment_id", F.lit(1).alias("_o"), F.col("event_ts").cast("timestamp_ntz"), F.col("event_seq").cast("long"),
                     "status", F.lit(True).alias("_new")))
    order = Window.partitionBy("payment_id").orderBy("_o", "event_ts", "event_seq", "status")  # a payment's few events
    fired = (first.unionByName(later).withColumn("_before", F.lag("status").over(order))
             .filter((F.col("status") == "success") & F.col("_new") & ~F.col("_before").eqNullSafe(F.lit("success"))))
    numbered = fired.select("payment_id", F.row_number().over(order).cast("long").alias("extension"))
    days = (DAYS_PER_PAYMENT_UNIT * F.greatest(F.coalesce("multiply", F.lit(1)), F.lit(1))).cast("long")
    return numbered.join(table.select("payment_id", "user_id", F.to_date("created_at").alias("paid_on"), "subscription_type",
                                      days.alias("days")), "payment_id")


def apply_grants(users: DataFrame, grants: DataFrame) -> DataFrame:
    """I13 (manual side): subscription grants ``(user_id, kind, subscription_type, days, granted_at)``.

    * ``kind = 'set'``: the plan becomes the grant's plan and the end is
      extended like a payment, ``end = max(end, granted_on) + days`` in grant
      order (closed form of ``subscription_ledger``, seeded with the user's
      current end); the last grant's plan wins.
    * ``kind = 'demo'``: only for a user without any plan (and no 'set' grant);
      the first demo grant applies, ``end = granted_on + days``; later ones are
      rejected.

    Returns the users table with grants applied (new users included).
    """
    epoch = F.lit("1970-01-01").cast("date")
    # grants are ordered by (granted_at, a tie-breaking hash of the grant), like payments by (paid_on, payment_id)
    p = (grants.filter(F.col("kind") == "set")
         .select("user_id", "subscription_type", F.col("days").cast("long").alias("days"),
                 F.to_date("granted_at").alias("paid_on"),
                 F.xxhash64("granted_at", "subscription_type", "days").alias("payment_id")))
    month = F.date_trunc("month", F.col("paid_on"))
    p = running_sums(p, "user_id", month, ["paid_on", "payment_id"], {"_P": F.col("days")})
    p = running_aggs(p, "user_id", month, ["paid_on", "payment_id"],
                     {"_m": ("max", F.datediff("paid_on", epoch) - (F.col("_P") - F.col("days")))})
    e0 = users.select("user_id", F.datediff("subscription_end_at", epoch).alias("_e0"))
    p = p.join(e0, "user_id", "left").withColumn(
        "_end", F.col("_P") + F.greatest(F.col("_m"), F.coalesce(F.col("_e0"), F.col("_m"))))
    set_final = (p.groupBy("user_id")
                 .agg(F.max_by(F.struct(F.date_add(epoch, F.col("_end").cast("int")).alias("end"),
                                        F.col("subscription_type").alias("plan")),
                               F.struct("paid_on", "payment_id")).alias("s"))
                 .select("user_id", F.col("s.plan").alias("_set_plan"), F.col("s.end").alias("_set_end")))
    has_plan = users.filter(F.col("subscription_type").isNotNull()).select("user_id")
    demo = (grants.filter(F.col("kind") == "demo")
            .join(has_plan, "user_id", "left_anti").join(set_final.select("user_id"), "user_id", "left_anti")
            .groupBy("user_id")
            .agg(F.min_by(F.date_add(F.to_date("granted_at"), F.col("days").cast("int")), "granted_at")
                 .alias("_demo_end")))
    out = (users.select("user_id", "subscription_type", "subscription_end_at")
           .join(set_final, "user_id", "full_outer").join(demo, "user_id", "full_outer"))
    return out.select(
        "user_id",
        F.coalesce(F.col("_set_plan"), F.when(F.col("_demo_end").isNotNull(), F.lit("demo")),
                   F.col("subscription_type")).alias("subscription_type"),
        F.coalesce(F.col("_set_end"), F.col("_demo_end"), F.col("subscription_end_at")).alias("subscription_end_at"))
