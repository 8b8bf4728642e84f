"""Teams, members, invites, activation codes and row visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per, latest_per, range_blocks, running_sum, top_per
from proofloom.session import stored


def admin_role(claims: Column) -> Column:
    """Role from token claims: application metadata first, then the top level."""
    return F.coalesce(F.get_json_object(claims, "$.app_metadata.role"), F.get_json_object(claims, "$.role"))


def visible_teams(viewers: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """(viewer_id, team_id) pairs: owned or joined; admins see all and are
    returned as one row with a null team."""
    role = admin_role(F.col("claims"))
    plain = viewers.filter(~F.coalesce(role == "admin", F.lit(False)))
    own = plain.join(teams, plain["viewer_id"] == teams["owner_user_id"]).select("viewer_id", F.col("id").alias("team_id"))
    joined = plain.join(members, plain["viewer_id"] == members["user_id"]).select("viewer_id", "team_id")
    admins = viewers.filter(F.coalesce(role == "admin", F.lit(False))).select("viewer_id", F.lit(None).cast("bigint").alias("team_id"))
    return own.unionByName(joined).distinct().unionByName(admins)


def visible_rows(rows: DataFrame, viewer_id: int, claims_role: str | None, teams: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with a ``team_id`` that one viewer may read."""
    if claims_role == "admin":
        return rows
    own = teams.filter(F.col("owner_user_id") == viewer_id).select(F.col("id").alias("team_id"))
    joined = members.filter(F.col("user_id") == viewer_id).select("team_id")
    return rows.join(own.unionByName(joined).distinct(), "team_id", "left_semi")


def unused_codes(codes: DataFrame) -> DataFrame:
    return codes.filter(F.coalesce("redeemed_count", F.lit(0)) == 0)


def seat_occupancy(teams: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("team_id").agg(F.count("*").alias("members"))
    return teams.join(n, teams["id"] == n["team_id"], "left").select(
        "id", "seat_limit", F.coalesce("members", F.lit(0)).alias("members"),
        (F.coalesce("members", F.lit(0)) >= F.coalesce("seat_limit", F.lit(0))).alias("full"))


def redeem(attempts: DataFrame, codes: DataFrame, order: list[str], ranges: int = 0) -> tuple[DataFrame, DataFrame]:
    """Outcome of each redemption attempt in order, and the plan each user ends up with.

    ``k``-th valid attempt on a code succeeds while ``k`` fits the redemptions
    left.  Attempts are counted in ranges of about equal size (``ranges`` of them,
    0: as a shuffle has), so one popular code of one day is many tasks.
    """
    a = range_blocks(attempts.join(codes, "code", "left"), ["code"], order, parts=ranges)
    known, ts = F.col("max_redemptions").isNotNull(), F.col("ts")
    expired = F.coalesce(F.col("expires_at") < ts, F.lit(False))
    a = a.withColumn("__valid", known & ~expired)
    a = stored(running_sum(a, ["code"], order, [F.col("__block")], __k=F.col("__valid").cast("int")), "attempts")
    ok = F.col("__valid") & (F.col("__k") <= F.col("max_redemptions") - F.coalesce("redeemed_count", F.lit(0)))
    outcome = F.when(~known, "CODE_NOT_FOUND").when(expired, "CODE_EXPIRED").when(ok, "OK").otherwise("CODE_EXHAUSTED")
    end = F.col("ts") + F.make_interval(days=F.col("duration_days"))
    a = a.withColumn("outcome", outcome).withColumn("period_end", F.when(outcome == "OK", end))
    won = a.filter("outcome = 'OK'").select("user_id", "plan_tier", F.col("ts").alias("period_start"), "period_end", "code", *[c for c in order if c != "ts"])
    last = won.groupBy("user_id").agg(F.max_by(
        F.struct("plan_tier", "period_start", "period_end"),
        F.struct("period_start", *[c for c in order if c != "ts"])).alias("p")).select(
        "user_id", "p.*", F.lit("active").alias("plan_status"), F.lit("activation_code").alias("plan_source"))
    return a.drop("__valid", "__k", "__block"), last


def invite(requests: DataFrame, teams: DataFrame, users: DataFrame, members: DataFrame, order: list[str], ranges: int = 0) -> DataFrame:
    """Ordered checks of invite requests (team_id, actor_id, email, role).

    A seat is taken by each earlier accepted request, so requests that pass the
    other checks are counted per team, in ranges of about equal size as in
    :func:`redeem`; of two for the same user the first counts.
    """
    email = F.lower(F.trim(F.col("email")))
    by_mail = first_per(users.select(F.lower("email").alias("__mail"), F.col("id").alias("target_id")), ["__mail"], ["target_id"])
    t = teams.select(F.col("id").alias("team_id"), "owner_user_id", "seat_limit")
    held = members.groupBy("team_id").agg(F.count("*").alias("__held"))
    joined = members.select("team_id", F.col("user_id").alias("target_id"), F.lit(True).alias("__member")).distinct()
    r = requests.withColumn("__mail", email).join(t, "team_id", "left").join(by_mail, "__mail", "left")
    r = r.join(joined, ["team_id", "target_id"], "left").join(held, "team_id", "left")
    early = (
        F.when(F.col("actor_id").isNull(), "NOT_AUTHENTICATED").when(F.col("owner_user_id").isNull(), "TEAM_NOT_FOUND")
        .when(F.col("owner_user_id") != F.col("actor_id"), "TEAM_OWNER_REQUIRED").when(F.col("target_id").isNull(), "USER_NOT_FOUND")
        .when(F.col("__member"), "TEAM_MEMBER_EXISTS"))
    r = range_blocks(r.withColumn("__early", early), ["team_id"], order, parts=ranges)
    passed = r.filter(F.col("__early").isNull())
    first = passed.groupBy("team_id", "target_id").agg(F.min(F.struct(*order)).alias("__first"))
    passed = passed.join(first, ["team_id", "target_id"])
    is_first = F.struct(*order) == F.col("__first")
    passed = stored(running_sum(passed, ["team_id"], order, [F.col("__block")], __k=is_first.cast("int")), "invites")
    seats = F.coalesce("seat_limit", F.lit(0)) - F.coalesce("__held", F.lit(0))
    # A repeat finds a member only when its first request got a seat; seats never come back.
    got = passed.filter(is_first & (F.col("__k") <= seats)).select("team_id", "target_id", F.lit(True).alias("__got"))
    passed = passed.join(got, ["team_id", "target_id"], "left")
    late = F.when(is_first & (F.col("__k") <= seats), "OK").when(F.col("__got"), "TEAM_MEMBER_EXISTS").otherwise("TEAM_SEAT_LIMIT_REACHED")
    role = F.when(F.lower(F.coalesce("role", F.lit("member"))) == "owner", "owner").otherwise("member")
    columns = [*requests.columns, "target_id"]
    return passed.select(*columns, late.alias("outcome"), role.alias("granted_role")).unionByName(
        r.filter(F.col("__early").isNotNull()).select(*columns, F.col("__early").alias("outcome"), role.alias("granted_role")))


def accept_invites(members: DataFrame, accepts: DataFrame, now: Column) -> DataFrame:
    """Pending memberships named in ``accepts`` (team_id, user_id) become active."""
    hit = accepts.select("team_id", "user_id").distinct().withColumn("__hit", F.lit(True))
    m = members.join(hit, ["team_id", "user_id"], "left")
    go = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "pending")
    return m.withColumn("accepted_at", F.when(go, now)).withColumn("joined_at", F.when(go, F.coalesce("joined_at", now)).otherwise(F.col("joined_at"))).withColumn(
        "status", F.when(go, "active").otherwise(F.col("status"))).drop("__hit")


def accept_requests(requests: DataFrame, teams: DataFrame, members: DataFrame, order: list[str]) -> DataFrame:
    """Outcome of each request (team_id, user_id) to accept an invite: the first for a pending membership takes it."""
    known = teams.select(F.col("id").alias("team_id"), F.lit(True).alias("__team"))
    pending = members.filter("status = 'pending'").select("team_id", "user_id", F.lit(True).alias("__pending")).distinct()
    r = requests.join(known, "team_id", "left").join(pending, ["team_id", "user_id"], "left")
    first = r.filter("__pending").groupBy("team_id", "user_id").agg(F.min(F.struct(*order)).alias("__first"))
    r = r.join(first, ["team_id", "user_id"], "left")
    outcome = (F.when(F.col("user_id").isNull(), "NOT_AUTHENTICATED").when(F.col("__team").isNull(), "TEAM_NOT_FOUND")
               .when(F.col("__first") == F.struct(*order), "OK").otherwise("TEAM_INVITE_NOT_FOUND"))
    return r.select(*requests.columns, outcome.alias("outcome"))


def joined_profiles(profiles: DataFrame, accepted: DataFrame, order: list[str]) -> DataFrame:
    """Profiles after accepted invites (rows of :func:`accept_requests`): the last team joined, and its plan."""
    last = accepted.filter("outcome = 'OK'").groupBy(F.col("user_id").alias("id")).agg(F.max_by("team_id", F.struct(*order)).alias("__team"))
    got, plan = F.col("__team").isNotNull(), {"plan_tier": "team", "plan_status": "active", "plan_source": "team_invite"}
    p = profiles if "plan_source" in profiles.columns else profiles.withColumn("plan_source", F.lit(None).cast("string"))
    p = p.join(last, "id", "left").withColumn("team_id", F.coalesce("__team", "team_id"))
    for name, value in plan.items():
        p = p.withColumn(name, F.when(got, value).otherwise(F.col(name)))
    return p.drop("__team")


def cancel_invites(members: DataFrame, cancels: DataFrame) -> DataFrame:
    """Drop pending memberships matched by team and e-mail."""
    gone = cancels.select("team_id", F.lower(F.trim("email")).alias("__mail")).distinct()
    keyed = members.withColumn("__mail", F.when(F.col("status") == "pending", F.lower(F.coalesce("invite_email", F.lit("")))))
    return keyed.join(gone, ["team_id", "__mail"], "left_anti").drop("__mail").select(*members.columns)


def create_workspaces(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Teams and owner memberships from (team_id, name, user_id, seat_limit, ts)."""
    seats = F.greatest(F.coalesce("seat_limit", F.lit(5)), F.lit(1))
    teams = requests.select(F.col("team_id").alias("id"), "name", F.col("user_id").alias("owner_user_id"), seats.alias("seat_limit"), F.lit("active").alias("status"))
    owners = latest_per(requests.select("team_id", "user_id", F.lit("owner").alias("role"), "ts"), ["team_id", "user_id"], ["ts"])
    return teams, owners


def workspace_outcomes(requests: DataFrame) -> DataFrame:
    """Outcome per request: only a signed-in user gets a workspace."""
    return requests.withColumn("outcome", F.when(F.col("user_id").isNull(), "NOT_AUTHENTICATED").otherwise("OK"))


def workspace_profiles(profiles: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Profiles after :func:`create_workspaces`: each user is in the last workspace they made."""
    last = requests.filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("id")).agg(F.max_by("team_id", F.struct(*order)).alias("__team"))
    return profiles.join(last, "id", "left").withColumn("team_id", F.coalesce("__team", "team_id")).drop("__team")


def backfill_invites(members: DataFrame, users: DataFrame) -> DataFrame:
    """Fill status, acceptance time and e-mail where one of them is missing."""
    u = users.select(F.col("id").alias("user_id"), F.lower(F.trim("email")).alias("__mail"))
    m = members.join(u, "user_id", "left")
    touch = (F.coalesce("status", F.lit("")) == "") | F.col("accepted_at").isNull() | F.col("invite_email").isNull()
    return m.select(
        "team_id", "user_id", F.when(touch, "active").otherwise(F.col("status")).alias("status"),
        F.when(touch, F.coalesce("accepted_at", "joined_at")).otherwise(F.col("accepted_at")).alias("accepted_at"),
        F.when(touch, F.coalesce("invite_email", "__mail")).otherwise(F.col("invite_email")).alias("invite_email"), "joined_at")


def workspaces(teams: DataFrame, members: DataFrame, activities: DataFrame, jobs: DataFrame, recent: int = 20) -> DataFrame:
    """Per team: member and pending counts, newest activities and jobs as lists.

    Only the newest ``recent`` rows per team are collected.
    """
    m = members.groupBy("team_id").agg(F.count("*").alias("members"), F.count_if(F.col("status") == "pending").alias("pending_invites"))
    newest = [F.col("created_at").desc(), F.col("id").desc()]

    def ids(df: DataFrame, name: str) -> DataFrame:
        top = top_per(df, ["team_id"], newest, recent)
        return top.groupBy("team_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))

    out = teams.withColumnRenamed("id", "team_id").join(m, "team_id", "left")
    return out.join(ids(activities, "activity_ids"), "team_id", "left").join(ids(jobs, "job_ids"), "team_id", "left")


def workspace_members(members: DataFrame, users: DataFrame) -> DataFrame:
    """Member rows of every workspace with the members' mail."""
    return members.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left").select("team_id", "user_id", "email", "role", "status")


def team_rules(saves: DataFrame, order: list[str]) -> DataFrame:
    """The rules each team has after all saves (team_id, rules_json, updated_by): a later save replaces an earlier one."""
    return latest_per(saves, ["team_id"], order)


def pending_invitations(members: DataFrame, teams: DataFrame) -> DataFrame:
    """Pending memberships of each user in the order of invitation, with the team they are to."""
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "owner_user_id", "seat_limit")
    rows = members.filter("status = 'pending'").join(t, "team_id", "left")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("invited_at", "team_id")))
