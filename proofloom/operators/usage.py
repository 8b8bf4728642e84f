"""Token usage, quotas, counters and activity over append-only logs.

A log row is ``(id, user_id, amount, purpose, created_at)``.  Totals are plain
aggregates; only quota admission depends on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import latest_per, range_blocks, running_sum, top_per
from proofloom.functions.scalars import day_key, period_key
from proofloom.rules import fixed as R
from proofloom.session import stored


def normalize_usage(raw: DataFrame) -> DataFrame:
    """Missing or non-numeric token fields become 0; rows without tokens drop out."""
    num = lambda c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))
    return raw.withColumn("amount", num("total_tokens")).withColumn("prompt_tokens", num("prompt_tokens")).withColumn(
        "completion_tokens", num("completion_tokens")).filter("amount > 0")


def since(logs: DataFrame, now: Column, days: int) -> DataFrame:
    return logs.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


def usage_stats(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = since(logs, now, days)
    return recent.agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_usage"), F.count("*").alias("total_requests"),
        F.coalesce(F.round(F.sum("amount") / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0)).alias("avg_usage"))


def by_purpose(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return since(logs, now, days).groupBy(F.coalesce("purpose", F.lit("unknown")).alias("purpose")).agg(
        F.count("*").alias("count"), F.sum("amount").alias("total"))


def by_day(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return since(logs, now, days).groupBy(day_key(F.col("created_at")).alias("day")).agg(
        F.count("*").alias("count"), F.sum("amount").alias("total"))


def used_per_user(logs: DataFrame) -> DataFrame:
    return logs.groupBy("user_id").agg(F.sum("amount").alias("used"))


def quota_status(profiles: DataFrame, logs: DataFrame, threshold: float = R.TOKEN_WARNING_SHARE) -> DataFrame:
    """Remaining tokens, share used in percent and a warning flag per user."""
    p = profiles.join(used_per_user(logs), profiles["id"] == F.col("user_id"), "left")
    quota, used = F.col("token_quota"), F.coalesce("used", F.lit(0))
    share = F.when(quota > 0, used / quota).otherwise(0.0)
    return p.select(
        F.col("id").alias("user_id"), quota, used.alias("used"), (quota - used).alias("remaining"),
        F.round(share * 100, 2).alias("usage_percentage"), (share >= threshold).alias("warning"))


def token_usage(profiles: DataFrame, logs: DataFrame, now: Column) -> DataFrame:
    """Quota, use, remainder, share and today's use per user."""
    sums = logs.groupBy("user_id").agg(
        F.sum("amount").alias("all_used"), F.sum(F.when(F.col("created_at") >= F.date_trunc("day", now), F.col("amount"))).alias("today"))
    p = profiles.join(sums, profiles["id"] == F.col("user_id"), "left")
    quota = F.coalesce("token_quota", F.lit(R.DEFAULT_TOKEN_QUOTA))
    used = F.coalesce("all_used", F.lit(0))
    return p.select(
        F.col("id").alias("user_id"), quota.alias("token_quota"), used.alias("token_used"), (quota - used).alias("token_remaining"),
        F.when(quota > 0, F.round(used / quota * 100, 2)).otherwise(0.0).alias("usage_percentage"),
        F.coalesce("today", F.lit(0)).alias("today_usage"))


def admin_user_stats(profiles: DataFrame, logs: DataFrame, now: Column) -> DataFrame:
    users = profiles.agg(
        F.count("*").alias("total_users"),
        F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("new_users_7d"),
        F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")).alias("new_users_30d"))
    tokens = logs.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total_tokens_used"))
    # Both sides are single-row totals.
    return users.withColumn("__k", F.lit(1)).join(tokens.withColumn("__k", F.lit(1)), "__k").drop("__k")


def admin_token_daily(logs: DataFrame) -> DataFrame:
    per_user = logs.groupBy(
        F.to_date("created_at").alias("date"), F.coalesce("purpose", F.lit("unknown")).alias("purpose"), "user_id"
    ).agg(F.sum("amount").alias("t"), F.count("*").alias("n"))
    return per_user.groupBy("date", "purpose").agg(
        F.sum("t").alias("total_tokens"), F.sum("n").alias("total_requests"), F.count("*").alias("active_users"))


def usage_history(logs: DataFrame, limit: int = 50) -> DataFrame:
    return logs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def expire_logs(logs: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    return since(logs, now, keep_days)


def usage_counters(logs: DataFrame) -> DataFrame:
    """Monthly counters per user; the daily one covers the last day seen in the month."""
    counted = logs.withColumn("period_key", period_key(F.col("created_at"))).withColumn("day", day_key(F.col("created_at")))
    daily = counted.groupBy("user_id", "period_key", "day").agg(
        F.count_if(F.col("purpose") == "ai_qa").alias("qa"), F.count_if(F.col("purpose") == "ai_parse").alias("parse"),
        F.count_if(F.col("purpose") == "rule_check").alias("rule"))
    return daily.groupBy("user_id", "period_key").agg(
        F.max("day").alias("day_key"), F.sum("qa").alias("ai_qa_used"), F.sum("parse").alias("ai_parse_used"),
        F.max_by("rule", "day").alias("rule_check_used_today"))


# --- quota admission ----------------------------------------------------------

def admit(logs: DataFrame, profiles: DataFrame, ranges: int = 0, spent: DataFrame | None = None) -> DataFrame:
    """Accept a log row only while the month's quota covers it; rejected rows do not count. Amounts are not negative.

    Let ``unit`` be the largest power of two that is not above what is left. Until what is left falls below it, all smaller rows
    are in, so a running sum tells where that happens; of the others the first that still fits brings it about. Rows up to there
    are decided at once, and what is left has at most half as many units. So there are as many rounds as the quota has binary
    digits, whatever the amounts, and each is a running sum over ranges of rows: a hot user and month spans many tasks.
    ``spent``: user_id, period_key, used: tokens used before the first row.
    """
    keys, order, block = ["user_id", "period_key"], ["created_at", "id"], [F.col("__block")]
    base = logs.join(profiles.select(F.col("id").alias("user_id"), F.col("token_quota").alias("__left")), "user_id")
    base = base.withColumn("period_key", period_key(F.col("created_at"))).withColumn("__amount", F.coalesce("amount", F.lit(0)))
    if spent is not None:
        base = base.join(spent, keys, "left").withColumn("__left", F.col("__left") - F.coalesce("used", F.lit(0))).drop("used")
    amount, left, place = F.col("__amount"), F.col("__left"), F.struct(*order)
    unit = F.when(left > 0, F.expr("shiftleft(1L, length(bin(__left)) - 1)")).otherwise(1)
    small, rest = amount < unit, left - F.col("__sum")
    columns = [*logs.columns, "period_key"]
    out, open_rows = None, range_blocks(base, keys, order, parts=ranges)
    while True:
        sums = stored(running_sum(open_rows.filter(amount <= left), keys, order, block, __sum=F.when(small, amount)), "admission")
        rejected = open_rows.filter(amount > left).select(*columns, F.lit(False).alias("accepted"))
        out = rejected if out is None else out.unionByName(rejected)
        if sums.isEmpty():
            return out
        ends = (left > 0) & F.when(small, rest < unit).otherwise(amount <= rest)
        after = F.when(small, rest).otherwise(rest - amount)
        end = stored(sums.filter(ends).groupBy(*keys).agg(F.min(F.struct(*order, after.alias("left"))).alias("__end")), "admission-ends")
        marked, last = sums.join(end, keys, "left"), F.struct(*[F.col("__end")[c].alias(c) for c in order])
        decided = marked.filter(F.col("__end").isNull() | (place <= last))
        out = out.unionByName(decided.select(*columns, (small | F.coalesce(place == last, F.lit(False))).alias("accepted")))
        open_rows = marked.filter(place > last).withColumn("__left", F.col("__end.left")).select(*open_rows.columns)


# --- recency -------------------------------------------------------------------

def recent_files(opens: DataFrame, n: int = 10) -> DataFrame:
    """Latest opening per path, newest ``n`` per user (user_id, path, name, opened_at)."""
    latest = opens.groupBy("user_id", "path").agg(F.max("opened_at").alias("opened_at"), F.max_by("name", "opened_at").alias("name"))
    return top_per(latest, ["user_id"], [F.col("opened_at").desc(), F.col("path")], n)


def activity_feed(activities: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` activities per team."""
    return top_per(activities, ["team_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def latest_jobs(updates: DataFrame, n: int = 20) -> DataFrame:
    """Current state per job, newest ``n`` jobs per team."""
    current = latest_per(updates, ["id"], ["updated_at"])
    return top_per(current, ["team_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def latest_activity(tables: dict[str, tuple[DataFrame, list[str]]], now: Column,
                    warn_days: float = R.ACTIVITY_WARN_DAYS, critical_days: float = R.ACTIVITY_CRITICAL_DAYS) -> DataFrame:
    """Latest time per table (first time column that is filled) and overall health."""
    rows = None
    for name, (df, columns) in tables.items():
        one = df.agg(*[F.max(c).alias(f"__{c}") for c in columns]).select(
            F.lit(name).alias("table"),
            F.coalesce(*[F.when(F.col(f"__{c}").isNotNull(), F.lit(c)) for c in columns]).alias("timestamp_field"),
            F.coalesce(*[F.col(f"__{c}") for c in columns]).alias("latest"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.filter(F.col("latest").isNotNull())
    top = rows.agg(F.max("latest").alias("latest"), F.max_by("table", F.struct("latest", "table")).alias("table"))
    age = (F.unix_micros(now) - F.unix_micros("latest")) / F.lit(86400000000.0)
    health = F.when(F.col("latest").isNull() | (age >= critical_days), "critical").when(age >= warn_days, "warning").otherwise("ok")
    total = top.select(F.lit("(all)").alias("table"), F.col("table").alias("timestamp_field"), "latest", F.round(age, 4).alias("age_days"), health.alias("severity"))
    return rows.select("table", "timestamp_field", "latest", F.lit(None).cast("double").alias("age_days"), F.lit(None).cast("string").alias("severity")).unionByName(total)


def with_default_settings(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Stored settings map per user, the defaults when there is none."""
    default = F.create_map(*[F.lit(x) for kv in R.DEFAULT_SETTINGS.items() for x in kv])
    return users.join(settings, "user_id", "left").withColumn("settings", F.coalesce("settings", default))
