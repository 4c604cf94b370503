"""Health report and alert rules over run, call and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.scores import rate

# Alert thresholds.
LEAST_SUCCESS, MOST_ERRORS, MOST_BUDGET, BACKUP_HOURS, MOST_QUEUE = 0.80, 0.20, 0.80, 36, 500
AUDIT_STATUSES = ("done", "skipped", "robots_blocked", "unreachable", "bot_challenge", "not_readable", "failed")


def job_rates(runs: DataFrame, since: Column) -> DataFrame:
    s = F.col("status")
    counted = runs.where(F.col("created_at") >= since).groupBy("kind").agg(F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "cancelled").alias("cancelled"))
    return counted.withColumn("total", F.col("done") + F.col("failed") + F.col("cancelled")).withColumn("success_rate", rate(F.col("done"), F.col("done") + F.col("failed")))


def percentiles(df: DataFrame, key: str, value: str, **at: float) -> DataFrame:
    """(key, n, a column for each of ``at``): exact interpolated percentiles of ``value``.

    Counts of equal values are made first, with partial aggregation, so that what is put in order is the
    distinct values and not the rows. Null values do not count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    return counted.groupBy(key).agg(F.sum("__n").alias("n"), *[F.round(F.percentile("__v", p, F.col("__n")), 3).alias(name) for name, p in at.items()])


def timings(runs: DataFrame, since: Column) -> DataFrame:
    """(kind, n, p50, p95) of the seconds that finished runs took."""
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return percentiles(runs.where((F.col("status") == "done") & (F.col("created_at") >= since)).withColumn("took", took), "kind", "took", p50=0.5, p95=0.95)


def source_errors(sources: DataFrame, calls: DataFrame, since: Column) -> DataFrame:
    bad = F.col("error_class").isNotNull() | (F.col("status_code") >= 400)
    counted = calls.where(F.col("created_at") >= since).groupBy("source_id").agg(F.count("*").alias("calls"), F.count_if(F.coalesce(bad, F.lit(False))).alias("errors"))
    return sources.join(counted, sources["id"] == counted["source_id"]).select("name", "calls", "errors", rate(F.col("errors"), F.col("calls")).alias("error_rate"))


def duplicate_rate(runs: DataFrame, candidates: DataFrame, since: Column) -> DataFrame:
    """One row: records that runs linked by themselves, and pairs sent to review by what came of them.

    ``runs``: (kind, status, finished_at, result_summary JSON); ``candidates``: (status, created_at).
    """
    linked = F.get_json_object("result_summary", "$.linked_existing").cast("long")
    done = runs.where((F.col("kind") == "resolution") & (F.col("status") == "done") & (F.col("finished_at") >= since))
    s = F.col("status")
    counts = {"merged_by_review": "merged", "kept_apart": "kept_apart", "pending_review": "pending"}
    sent = candidates.where(F.col("created_at") >= since).agg(F.count("*").alias("sent_to_review"), *[F.count_if(s == v).alias(k) for k, v in counts.items()])
    return done.agg(F.coalesce(F.sum(linked), F.lit(0)).alias("auto_merged")).join(sent)


def summarize(outcomes: DataFrame) -> DataFrame:
    """One row of counts over (outcome): processed, invalid, needs_review, created, linked_existing."""
    o = F.col("outcome")
    return outcomes.agg(F.count("*").alias("processed"), *[F.count_if(o == k).alias(k) for k in ("invalid", "needs_review", "created", "linked_existing")])


def needs_resolution(record: DataFrame) -> DataFrame:
    """Adds ``needs_resolution`` to (status, resolved_at, updated_at): not while it waits for review, else if it is new or has changed since."""
    changed = F.col("updated_at") > F.col("resolved_at")
    return record.withColumn("needs_resolution", F.when(F.col("status") == "needs_review", False).when((F.col("status") == "pending") | F.col("resolved_at").isNull(), True).otherwise(F.coalesce(changed, F.lit(False))))


def stale_runs(runs: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Runs without a heartbeat for 30 minutes, and queued ones that no queue holds."""
    late = F.expr("interval 30 minutes")
    silent = runs.where((F.col("status") == "running") & (F.col("updated_at") < now - late)).withColumn("why", F.lit("no heartbeat"))
    lost = runs.where((F.col("status") == "queued") & (F.col("created_at") < now - late)).join(live.select("id"), "id", "left_anti").select(*runs.columns).withColumn("why", F.lit("not in the queue"))
    return silent.unionByName(lost)


def firing(health: DataFrame) -> DataFrame:
    """(rule, details) of one row of health figures (success_rate, error_rate, budget_ratio, backup_age_hours, queue_length, calls_ratio)."""
    rules = [
        ("job_success", F.col("success_rate") < LEAST_SUCCESS, "success_rate"), ("source_errors", F.col("error_rate") > MOST_ERRORS, "error_rate"), ("ai_budget", F.col("budget_ratio") >= MOST_BUDGET, "budget_ratio"),
        ("backup_age", F.coalesce(F.col("backup_age_hours") > BACKUP_HOURS, F.lit(True)), "backup_age_hours"), ("queue_length", F.col("queue_length") > MOST_QUEUE, "queue_length"),
        ("places_budget", F.col("calls_ratio") >= MOST_BUDGET, "calls_ratio"),
    ]
    told = [F.when(c, F.struct(F.lit(name).alias("rule"), F.col(of).cast("string").alias("details"))) for name, c, of in rules]
    return health.select(F.inline(F.array_compact(F.array(*told))))


def needs_audit(businesses: DataFrame, audits: DataFrame, now: Column, version: int, max_days: int = 30, failed_hours: int = 6, backoff_days: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """Businesses due for an audit: never audited, by an older version, or past the wait of their newest status.

    The wait after failures to reach grows with how many of the newest audits in a row were unreachable.
    """
    from tamarack.operators.relational import newest, streak

    last = newest(audits.select("business_id", "id", "created_at", "status", "version"), "business_id", ["created_at", "id"])
    runs = streak(audits, "business_id", ["created_at", "id"], "status").select("business_id", "streak")
    joined = businesses.select("business_id").join(last.join(runs, "business_id"), "business_id", "left")
    steps = F.array(*[F.lit(d) for d in backoff_days])
    hours = F.when(F.col("status") == "unreachable", 24 * F.element_at(steps, F.least(F.col("streak"), F.lit(len(backoff_days))).cast("int"))).when(F.col("status") == "failed", failed_hours).when(F.col("status") == "bot_challenge", 24 * 7).otherwise(24 * max_days)
    due = F.col("id").isNull() | (F.col("version") < version) | (F.unix_timestamp("created_at") + hours * 3600 <= F.unix_timestamp(now))
    return joined.where(due).select("business_id")
