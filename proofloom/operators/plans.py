"""Plan entitlements and gates over profiles and usage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.scalars import lookup, parse_iso_ts
from proofloom.rules import fixed as R

TIERS = [p[0] for p in R.PLANS]


def normalize_tier(tier: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(tier, F.lit("free"))))
    return F.when(t.isin(TIERS), t).otherwise("free")


def normalize_status(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit("active"))))
    return F.when(F.length(s) > 0, s).otherwise("active")


def is_active(status: Column, period_end: Column, now: Column) -> Column:
    """Active or trialing and not past its end; an unreadable end counts as open."""
    end = parse_iso_ts(period_end.cast("string"))
    return normalize_status(status).isin("active", "trialing") & F.coalesce(end >= now, F.lit(True))


def _plan_value(tier: Column, i: int) -> Column:
    return lookup(tier, {p[0]: p[i] for p in R.PLANS if p[i] is not None}).cast("int" if i > 1 else "string")


def plan_features(tier: Column) -> Column:
    out = None
    for p in R.PLANS:
        m = F.create_map(*[F.lit(x) for f in R.PLAN_FEATURES for x in (f, f in p[6])])
        out = F.when(tier == p[0], m) if out is None else out.when(tier == p[0], m)
    return out


def entitlements(profiles: DataFrame, counters: DataFrame, now: Column) -> DataFrame:
    """Effective tier, status, limits, features and usage per user.

    The four plans are constants of the expression, so only the usage counters
    are joined.  Feature flags of the profile override the plan's features.
    """
    live = is_active(F.col("plan_status"), F.col("period_end"), now)
    p = profiles.withColumn("tier", F.when(live, normalize_tier(F.col("plan_tier"))).otherwise("free")).withColumn(
        "status", F.when(live, normalize_status(F.col("plan_status"))).otherwise("expired"))
    tier = F.col("tier")
    p = p.select(
        F.col("id").alias("user_id"), "tier", "status", _plan_value(tier, 1).alias("label"), _plan_value(tier, 2).alias("file_size_mb"),
        _plan_value(tier, 3).alias("rule_checks_per_day"), _plan_value(tier, 4).alias("ai_qa_per_month"), _plan_value(tier, 5).alias("ai_parse_per_month"),
        F.map_concat(plan_features(tier), F.coalesce("feature_flags", F.create_map().cast("map<string,boolean>"))).alias("features"))
    used = ["ai_qa_used", "ai_parse_used", "rule_check_used_today"]
    return p.join(counters.select("user_id", *used), "user_id", "left").na.fill(0, used)


def upgrade_target(feature: Column) -> Column:
    return F.coalesce(lookup(feature, R.UPGRADE_TARGETS), F.lit("pro"))


def feature_gate(features: Column, feature: Column) -> Column:
    """``OK`` or ``FEATURE_LOCKED``."""
    return F.when(F.coalesce(F.try_element_at(features, feature), F.lit(False)), "OK").otherwise("FEATURE_LOCKED")


def quota_gate(usage_name: str) -> Column:
    """``OK`` or ``QUOTA_EXCEEDED``; a null limit is unlimited."""
    if usage_name not in R.USAGE_LIMITS:
        return F.lit("OK")
    used, limit = R.USAGE_LIMITS[usage_name]
    return F.when(F.col(limit).isNull() | (F.col(used) < F.col(limit)), "OK").otherwise("QUOTA_EXCEEDED")


def file_size_limit(tier: Column) -> Column:
    """Megabytes a plan allows per file, null for no limit."""
    return _plan_value(tier, 2)


def file_size_gate(size: Column, limit_mb: Column = None) -> Column:
    limit = F.col("file_size_mb") if limit_mb is None else limit_mb
    return F.when(limit.isNull() | (size <= limit * F.lit(1024 * 1024).cast("bigint")), "OK").otherwise("FILE_TOO_LARGE_FOR_PLAN")


def audit(ents: DataFrame, file_sizes=(1, 10 * 1024 * 1024, 200 * 1024 * 1024)) -> DataFrame:
    """Every gate for every user, counted by tier, check and reason.

    The checks are a fixed list per row, exploded in place.
    """
    checks = [F.struct(F.lit(f).alias("check"), feature_gate(F.col("features"), F.lit(f)).alias("reason")) for f in R.PLAN_FEATURES]
    checks += [F.struct(F.lit("quota:" + u).alias("check"), quota_gate(u).alias("reason")) for u in R.USAGE_LIMITS]
    checks += [F.struct(F.lit(f"file:{n}").alias("check"), file_size_gate(F.lit(n)).alias("reason")) for n in file_sizes]
    rows = ents.select("tier", F.inline(F.array(*checks)))
    return rows.groupBy("tier", "check", "reason").agg(F.count("*").alias("users"))
