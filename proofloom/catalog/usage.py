"""Queries for usage, quota, plans and teams (B9-B12, C19-C20, D14-D24, E18-E27, F3, G3, H*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog.registry import query
from proofloom.catalog.views import _split, table, usage_sql, usage_view
from proofloom.functions import scalars as X
from proofloom.operators import plans as P
from proofloom.operators import teams as T
from proofloom.operators import usage as U

NOW_SQL = "CAST('2024-01-31' AS TIMESTAMP)"


def now():
    """The moment all usage queries are asked at; built when a session is there."""
    return F.lit("2024-01-31").cast("timestamp")

LOGS = f"WITH {usage_sql('token_logs')}"


def _v(name):
    return lambda spark, d: usage_view(spark, d, name)


logs, profiles, codes, attempts, teams, members, activities, jobs = (
    _v(n) for n in ("token_logs", "profiles", "codes", "attempts", "teams", "members", "activities", "jobs"))

# --- token usage -----------------------------------------------------------------------------

_RECENT = f"created_at >= {NOW_SQL} - INTERVAL 20 DAY"
query("D14_token_usage_stats", f"{LOGS} SELECT CAST(sum(amount) AS BIGINT) AS total_usage, count(*) AS total_requests, round(sum(amount) / count(*), 2) AS avg_usage FROM token_logs WHERE {_RECENT}")(
    lambda spark, d: U.usage_stats(logs(spark, d), now(), 20))
query("D15_token_by_purpose", f"{LOGS} SELECT coalesce(purpose, 'unknown') AS purpose, count(*) AS count, CAST(sum(amount) AS BIGINT) AS total FROM token_logs WHERE {_RECENT} GROUP BY 1")(
    lambda spark, d: U.by_purpose(logs(spark, d), now(), 20))
query("D16_token_by_day", f"{LOGS} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count, CAST(sum(amount) AS BIGINT) AS total FROM token_logs WHERE {_RECENT} GROUP BY 1")(
    lambda spark, d: U.by_day(logs(spark, d), now(), 20))
_PU = f"WITH {usage_sql('token_logs', 'profiles')}, u AS (SELECT user_id, CAST(sum(amount) AS BIGINT) AS used, CAST(sum(CASE WHEN created_at >= CAST('2024-01-15' AS TIMESTAMP) THEN amount END) AS BIGINT) AS today FROM token_logs GROUP BY 1)"
query("D17_quota_status", f"""{_PU} SELECT id AS user_id, token_quota, coalesce(used, 0) AS used, token_quota - coalesce(used, 0) AS remaining,
    CASE WHEN token_quota > 0 THEN round(coalesce(used, 0) / token_quota * 100, 2) ELSE 0.0 END AS usage_percentage,
    CASE WHEN token_quota > 0 THEN coalesce(used, 0) / token_quota >= 0.8 ELSE false END AS warning FROM profiles LEFT JOIN u ON user_id = id""")(
    lambda spark, d: U.quota_status(profiles(spark, d), logs(spark, d)))
query("D18_token_usage_user", f"""{_PU} SELECT id AS user_id, token_quota, coalesce(used, 0) AS token_used, token_quota - coalesce(used, 0) AS token_remaining,
    CASE WHEN token_quota > 0 THEN round(coalesce(used, 0) / token_quota * 100, 2) ELSE 0.0 END AS usage_percentage, coalesce(today, 0) AS today_usage
    FROM profiles LEFT JOIN u ON user_id = id""")(lambda spark, d: U.token_usage(profiles(spark, d), logs(spark, d), F.lit("2024-01-15 10:00:00").cast("timestamp")))
query("D19_admin_user_stats", f"""{_PU} SELECT count(*) AS total_users, count_if(created_at >= {NOW_SQL} - INTERVAL 7 DAY) AS new_users_7d,
    count_if(created_at >= {NOW_SQL} - INTERVAL 30 DAY) AS new_users_30d, (SELECT CAST(sum(amount) AS BIGINT) FROM token_logs) AS total_tokens_used FROM profiles""")(
    lambda spark, d: U.admin_user_stats(profiles(spark, d), logs(spark, d), now()))
query("D20_admin_token_daily", f"""{LOGS} SELECT CAST(created_at AS DATE) AS date, coalesce(purpose, 'unknown') AS purpose, CAST(sum(amount) AS BIGINT) AS total_tokens,
    CAST(count(*) AS BIGINT) AS total_requests, count(DISTINCT user_id) AS active_users FROM token_logs GROUP BY ALL""")(lambda spark, d: U.admin_token_daily(logs(spark, d)))
query("F3_usage_history", f"{LOGS} SELECT * FROM token_logs ORDER BY created_at DESC, id DESC LIMIT 50")(lambda spark, d: U.usage_history(logs(spark, d)))
query("G3_expire_logs", f"{LOGS} SELECT * FROM token_logs WHERE {_RECENT}")(lambda spark, d: U.expire_logs(logs(spark, d), now(), 20))
query("E19_usage_counter_state", f"""{LOGS}, c AS (SELECT *, strftime(created_at, '%Y-%m') AS period_key, strftime(created_at, '%Y-%m-%d') AS day FROM token_logs),
    m AS (SELECT user_id, period_key, max(day) AS day_key, count_if(purpose = 'ai_qa') AS ai_qa_used, count_if(purpose = 'ai_parse') AS ai_parse_used FROM c GROUP BY ALL)
    SELECT m.*, (SELECT count(*) FROM c WHERE c.user_id = m.user_id AND c.day = m.day_key AND purpose = 'rule_check') AS rule_check_used_today FROM m""")(
    lambda spark, d: U.usage_counters(logs(spark, d)))
query("E18_quota_admission", f"""WITH RECURSIVE {usage_sql('token_logs', 'profiles')}, b AS (SELECT l.*, token_quota, strftime(l.created_at, '%Y-%m') AS period_key,
      row_number() OVER (PARTITION BY user_id, strftime(l.created_at, '%Y-%m') ORDER BY l.created_at, l.id) AS r FROM token_logs l JOIN profiles p ON p.id = user_id),
    w AS (SELECT user_id, period_key, r, id, amount <= token_quota AS accepted, CASE WHEN amount <= token_quota THEN amount ELSE 0 END AS used FROM b WHERE r = 1
      UNION ALL SELECT b.user_id, b.period_key, b.r, b.id, w.used + b.amount <= b.token_quota, w.used + CASE WHEN w.used + b.amount <= b.token_quota THEN b.amount ELSE 0 END
      FROM w JOIN b ON b.user_id = w.user_id AND b.period_key = w.period_key AND b.r = w.r + 1)
    SELECT id, user_id, period_key, accepted FROM w""")(
    lambda spark, d: U.admit(logs(spark, d), profiles(spark, d)).select("id", "user_id", "period_key", "accepted"))

# --- recency ---------------------------------------------------------------------------------

_OPEN = "user_id, event_type || '/' || (event_id % 9) AS path, 'n' || event_id AS name, ts AS opened_at"
query("E20_recent_files", f"""WITH o AS (SELECT {_OPEN} FROM events), g AS (SELECT user_id, path, max(opened_at) AS opened_at, arg_max(name, opened_at) AS name FROM o GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY opened_at DESC, path) AS rank FROM g QUALIFY rank <= 10""")(
    lambda spark, d: U.recent_files(table(spark, d, "events").selectExpr(*[c.strip() for c in _split(_OPEN)])))
query("E21_activity_feed", f"""WITH {usage_sql('activities')} SELECT id, team_id, event_type, row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) AS rank
    FROM activities QUALIFY rank <= 20""")(lambda spark, d: U.activity_feed(activities(spark, d), 20).select("id", "team_id", "event_type", "rank"))
query("E22_latest_jobs", f"""WITH {usage_sql('jobs')} SELECT id, team_id, status, row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) AS rank
    FROM jobs QUALIFY rank <= 20""")(
    lambda spark, d: U.latest_jobs(jobs(spark, d).select("id", "team_id", "created_at", F.inline(F.array(
        F.struct(F.lit("queued").alias("status"), F.lit(0).alias("updated_at")), F.struct(F.col("status"), F.lit(1).alias("updated_at")))))).select("id", "team_id", "status", "rank"))
query("D23_latest_activity", f"""WITH a AS (SELECT 'token_logs' AS "table", 'created_at' AS timestamp_field, max(ts) AS latest FROM events
      UNION ALL SELECT 'documents', 'updated_at', max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'templates', 'created_at', max(l_shipdate) FROM lineitem)
    SELECT "table", timestamp_field, latest, CAST(NULL AS DOUBLE) AS age_days, NULL AS severity FROM a
    UNION ALL SELECT '(all)', arg_max("table", latest), max(latest), round(epoch_us(CAST('2024-02-06' AS TIMESTAMP)) / 86400000000.0 - epoch_us(max(latest)) / 86400000000.0, 4),
      CASE WHEN epoch_us(CAST('2024-02-06' AS TIMESTAMP)) - epoch_us(max(latest)) >= 6.9 * 86400000000 THEN 'critical' WHEN epoch_us(CAST('2024-02-06' AS TIMESTAMP)) - epoch_us(max(latest)) >= 6 * 86400000000 THEN 'warning' ELSE 'ok' END FROM a""")(
    lambda spark, d: U.latest_activity({
        "token_logs": (table(spark, d, "events").select(F.col("ts").alias("created_at")), ["created_at"]),
        "documents": (table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("updated_at"), F.col("o_orderdate").alias("created_at")), ["updated_at", "created_at"]),
        "templates": (table(spark, d, "lineitem").select(F.lit(None).cast("timestamp").alias("updated_at"), F.col("l_shipdate").alias("created_at")), ["updated_at", "created_at"]),
    }, F.lit("2024-02-06").cast("timestamp")))

# --- scalar conversions on log rows ------------------------------------------------------------

query("H14_period_keys", """SELECT event_id, strftime(ts, '%Y-%m') AS period, strftime(ts, '%Y-%m-%d') AS day, date_trunc('month', ts) + INTERVAL 1 MONTH AS next_reset FROM events""")(
    lambda spark, d: table(spark, d, "events").select("event_id", X.period_key(F.col("ts")).alias("period"), X.day_key(F.col("ts")).alias("day"), X.next_reset(F.col("ts")).alias("next_reset")))
_ISO = "CASE event_id % 4 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || 'Z' WHEN 1 THEN substr(CAST(ts AS STRING), 1, 19) WHEN 2 THEN 'soon' ELSE '' END"
query("H15_parse_iso_ts", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts) END AS parsed FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", X.parse_iso_ts(F.expr(_ISO)).alias("parsed")))
_TOK = ("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS total_tokens, "
        "CASE event_id % 3 WHEN 0 THEN 'x' ELSE CAST(event_id % 7 AS STRING) END AS prompt_tokens, CAST(NULL AS STRING) AS completion_tokens")
query("H17_normalize_usage", """SELECT event_id, CAST(floor(value) AS BIGINT) AS amount, CASE event_id % 3 WHEN 0 THEN 0 ELSE event_id % 7 END AS prompt_tokens, 0 AS completion_tokens
    FROM events WHERE event_id % 5 > 1 AND floor(value) > 0""")(
    lambda spark, d: U.normalize_usage(table(spark, d, "events").selectExpr("event_id", *[c.strip() for c in _split(_TOK)])).select(
        "event_id", "amount", "prompt_tokens", "completion_tokens"))
query("H20_default_settings", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'A4' END AS paper FROM customer""")(
    lambda spark, d: (lambda c: U.with_default_settings(c, c.filter("user_id % 3 = 0").select("user_id", F.create_map(F.lit("theme"), F.lit("dark")).alias("settings"))).select(
        "user_id", F.try_element_at("settings", F.lit("theme")).alias("theme"), F.try_element_at("settings", F.lit("default_paper_size")).alias("paper")))(
        table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))))

# --- plans -------------------------------------------------------------------------------------

_TIER = "CASE WHEN lower(trim(plan_tier)) IN ('free', 'pro', 'team', 'enterprise') THEN lower(trim(plan_tier)) ELSE 'free' END"
_STATUS = "CASE WHEN coalesce(trim(plan_status), '') = '' THEN 'active' ELSE lower(trim(plan_status)) END"
_ACTIVE = f"({_STATUS} IN ('active', 'trialing') AND coalesce(TRY_CAST(replace(replace(period_end, 'T', ' '), 'Z', '') AS TIMESTAMP) >= {NOW_SQL}, true))"
_CNT = """cn AS (SELECT user_id, count_if(purpose = 'ai_qa') AS qa, count_if(purpose = 'ai_parse') AS parse, count_if(purpose = 'rule_check') AS rule FROM token_logs GROUP BY 1)"""
_ENT = f"""WITH {usage_sql('token_logs', 'profiles')}, {_CNT},
    e0 AS (SELECT *, CASE WHEN {_ACTIVE} THEN {_TIER} ELSE 'free' END AS tier, CASE WHEN {_ACTIVE} THEN {_STATUS} ELSE 'expired' END AS status FROM profiles),
    e AS (SELECT id AS user_id, tier, status, CASE tier WHEN 'free' THEN '免费版' WHEN 'pro' THEN '专业版' WHEN 'team' THEN '团队版' ELSE '机构版' END AS label,
      CASE tier WHEN 'free' THEN 5 WHEN 'pro' THEN 30 WHEN 'team' THEN 100 END AS file_size_mb, CASE tier WHEN 'free' THEN 10 END AS rule_limit, CASE tier WHEN 'free' THEN 3 END AS ai_limit,
      coalesce(deep_xref_flag, tier <> 'free') AS deep_xref, tier IN ('team', 'enterprise') AS batch_check, tier <> 'free' AS personal,
      coalesce(qa, 0) AS ai_qa_used, coalesce(parse, 0) AS ai_parse_used, coalesce(rule, 0) AS rule_used FROM e0 LEFT JOIN cn ON cn.user_id = id)"""


def _ents(spark, d):
    counters = logs(spark, d).groupBy("user_id").agg(
        F.count_if(F.col("purpose") == "ai_qa").alias("ai_qa_used"), F.count_if(F.col("purpose") == "ai_parse").alias("ai_parse_used"),
        F.count_if(F.col("purpose") == "rule_check").alias("rule_check_used_today"))
    p = profiles(spark, d).withColumn("feature_flags", F.when(F.col("deep_xref_flag").isNotNull(), F.create_map(F.lit("deep_xref"), F.col("deep_xref_flag"))))
    return P.entitlements(p, counters, now())


query("K1_normalize_plan", f"WITH {usage_sql('profiles')} SELECT id, {_TIER} AS tier, {_STATUS} AS status FROM profiles")(
    lambda spark, d: profiles(spark, d).select("id", P.normalize_tier(F.col("plan_tier")).alias("tier"), P.normalize_status(F.col("plan_status")).alias("status")))
query("K2_plan_active", f"WITH {usage_sql('profiles')} SELECT id, {_ACTIVE} AS active FROM profiles")(
    lambda spark, d: profiles(spark, d).select("id", P.is_active(F.col("plan_status"), F.col("period_end"), now()).alias("active")))
_ENT_COLS = ["user_id", "tier", "status", "label", "file_size_mb", "ai_qa_used", "ai_parse_used"]
for _name in ("K3_entitlements", "C19_plan_join"):
    query(_name, f"{_ENT} SELECT {', '.join(_ENT_COLS)}, deep_xref, batch_check FROM e")(
        lambda spark, d: _ents(spark, d).select(*_ENT_COLS, F.col("features")["deep_xref"].alias("deep_xref"), F.col("features")["batch_check"].alias("batch_check")))
query("K4_feature_gate", f"{_ENT} SELECT user_id, CASE WHEN deep_xref THEN 'OK' ELSE 'FEATURE_LOCKED' END AS reason, CASE WHEN NOT deep_xref THEN 'pro' END AS upgrade_target FROM e")(
    lambda spark, d: _ents(spark, d).select("user_id", P.feature_gate(F.col("features"), F.lit("deep_xref")).alias("reason")).withColumn(
        "upgrade_target", F.when(F.col("reason") != "OK", P.upgrade_target(F.lit("deep_xref")))))
query("K5_quota_gate", f"{_ENT} SELECT user_id, CASE WHEN ai_limit IS NULL OR ai_qa_used < ai_limit THEN 'OK' ELSE 'QUOTA_EXCEEDED' END AS reason FROM e")(
    lambda spark, d: _ents(spark, d).select("user_id", P.quota_gate("ai_qa").alias("reason")))
query("K6_file_size_gate", f"{_ENT} SELECT user_id, CASE WHEN file_size_mb IS NULL OR user_id * 100000 <= file_size_mb * 1048576 THEN 'OK' ELSE 'FILE_TOO_LARGE_FOR_PLAN' END AS reason FROM e")(
    lambda spark, d: _ents(spark, d).select("user_id", P.file_size_gate(F.col("user_id") * 100000).alias("reason")))
_CHECKS = [("ai_qa", "true"), ("ai_parse", "true"), ("deep_xref", "deep_xref"), ("personal_rule_library", "personal"), ("team_rule_share", "batch_check"), ("batch_check", "batch_check")]
query("K7_plan_audit", f"{_ENT}, c AS (" + " UNION ALL ".join(
    [f"SELECT tier, '{c}' AS \"check\", CASE WHEN {x} THEN 'OK' ELSE 'FEATURE_LOCKED' END AS reason FROM e" for c, x in _CHECKS]
    + [f"SELECT tier, 'quota:{c}', CASE WHEN {lim} IS NULL OR {u} < {lim} THEN 'OK' ELSE 'QUOTA_EXCEEDED' END FROM e" for c, u, lim in (("ai_qa", "ai_qa_used", "ai_limit"), ("ai_parse", "ai_parse_used", "ai_limit"), ("rule_check", "rule_used", "rule_limit"))]
    + [f"SELECT tier, 'file:{n}', CASE WHEN file_size_mb IS NULL OR {n} <= file_size_mb * 1048576 THEN 'OK' ELSE 'FILE_TOO_LARGE_FOR_PLAN' END FROM e" for n in (1, 10485760, 209715200)])
    + ") SELECT tier, \"check\", reason, count(*) AS users FROM c GROUP BY ALL")(lambda spark, d: P.audit(_ents(spark, d)))

# --- teams -------------------------------------------------------------------------------------

_CLAIMS = """CASE c_custkey % 20 WHEN 0 THEN '{"app_metadata": {"role": "admin"}, "role": "user"}' WHEN 1 THEN '{"role": "admin"}' ELSE '{"role": "user"}' END"""
query("B10_row_visibility", f"""WITH {usage_sql('teams', 'members')}, v AS (SELECT c_custkey AS viewer_id, c_custkey % 20 < 2 AS admin FROM customer)
    SELECT DISTINCT viewer_id, team_id FROM (SELECT viewer_id, id AS team_id FROM v JOIN teams ON owner_user_id = viewer_id WHERE NOT admin
      UNION ALL SELECT viewer_id, team_id FROM v JOIN members ON user_id = viewer_id WHERE NOT admin) UNION ALL SELECT viewer_id, NULL FROM v WHERE admin""")(
    lambda spark, d: T.visible_teams(table(spark, d, "customer").selectExpr("c_custkey AS viewer_id", f"{_CLAIMS} AS claims"), teams(spark, d), members(spark, d)))
query("B10_visible_activities", f"""WITH {usage_sql('activities', 'teams', 'members')} SELECT id, team_id FROM activities
    WHERE team_id IN (SELECT id FROM teams WHERE owner_user_id = 30 UNION SELECT team_id FROM members WHERE user_id = 30)""")(
    lambda spark, d: T.visible_rows(activities(spark, d), 30, "user", teams(spark, d), members(spark, d)).select("id", "team_id"))
query("B12_unused_codes", f"WITH {usage_sql('codes')} SELECT code, plan_tier FROM codes WHERE redeemed_count = 0")(
    lambda spark, d: T.unused_codes(codes(spark, d)).select("code", "plan_tier"))
query("D24_seat_occupancy", f"""WITH {usage_sql('teams', 'members')} SELECT id, seat_limit, coalesce(n, 0) AS members, coalesce(n, 0) >= seat_limit AS "full"
    FROM teams LEFT JOIN (SELECT team_id, count(*) AS n FROM members GROUP BY 1) ON team_id = id""")(lambda spark, d: T.seat_occupancy(teams(spark, d), members(spark, d)))
_RO = ["ts", "attempt_id", "sk"]
_REDEEM = f"""WITH {usage_sql('codes', 'attempts')}, a AS (SELECT attempts.*, plan_tier, duration_days, max_redemptions, redeemed_count, max_redemptions IS NOT NULL AS known, coalesce(expires_at < ts, false) AS expired
      FROM attempts LEFT JOIN codes USING (code)),
    k AS (SELECT *, sum(CASE WHEN known AND NOT expired THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY ts, attempt_id, sk) AS k FROM a),
    o AS (SELECT *, CASE WHEN NOT known THEN 'CODE_NOT_FOUND' WHEN expired THEN 'CODE_EXPIRED' WHEN k <= max_redemptions - redeemed_count THEN 'OK' ELSE 'CODE_EXHAUSTED' END AS outcome FROM k)"""


def _redeem(spark, d):
    return T.redeem(attempts(spark, d), codes(spark, d), _RO)


query("E23_redeem_codes", f"{_REDEEM} SELECT attempt_id, sk, code, outcome, CASE WHEN outcome = 'OK' THEN ts + duration_days * INTERVAL 1 DAY END AS period_end FROM o")(
    lambda spark, d: _redeem(spark, d)[0].select("attempt_id", "sk", "code", "outcome", "period_end"))
query("E23_redeemed_profiles", f"""{_REDEEM} SELECT user_id, plan_tier, ts AS period_start, 'active' AS plan_status FROM o WHERE outcome = 'OK'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, attempt_id DESC, sk DESC) = 1""")(
    lambda spark, d: _redeem(spark, d)[1].select("user_id", "plan_tier", "period_start", "plan_status"))

_REQ = ("o_orderkey AS id, o_orderdate AS ts, CAST(o_orderkey % 27 AS BIGINT) AS team_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 5 ELSE CAST(o_orderkey % 27 AS BIGINT) * 3 END AS actor_id, "
        "' USER' || (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000000 ELSE 0 END) || '@example.com ' AS email, CASE WHEN o_orderkey % 2 = 0 THEN 'Owner' END AS role")
query("E24_member_invites", f"""WITH {usage_sql('teams', 'members', 'profiles')}, r AS (SELECT {_REQ} FROM orders),
    h AS (SELECT team_id, count(*) AS held FROM members GROUP BY 1),
    x AS (SELECT r.*, t.owner_user_id, t.seat_limit, u.id AS target_id, m.user_id IS NOT NULL AS is_member, coalesce(held, 0) AS held FROM r LEFT JOIN teams t ON t.id = r.team_id
      LEFT JOIN profiles u ON lower(u.email) = lower(trim(r.email)) LEFT JOIN members m ON m.team_id = r.team_id AND m.user_id = u.id LEFT JOIN h ON h.team_id = r.team_id),
    y AS (SELECT *, CASE WHEN actor_id IS NULL THEN 'NOT_AUTHENTICATED' WHEN owner_user_id IS NULL THEN 'TEAM_NOT_FOUND' WHEN owner_user_id <> actor_id THEN 'TEAM_OWNER_REQUIRED'
      WHEN target_id IS NULL THEN 'USER_NOT_FOUND' WHEN is_member THEN 'TEAM_MEMBER_EXISTS' END AS early FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY team_id, target_id ORDER BY ts, id) AS nth FROM y WHERE early IS NULL),
    q AS (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY team_id ORDER BY ts, id) AS k FROM z),
    g AS (SELECT team_id, target_id FROM q WHERE nth = 1 AND k <= seat_limit - held)
    SELECT id, CASE WHEN nth = 1 AND k <= seat_limit - held THEN 'OK' WHEN g.team_id IS NOT NULL THEN 'TEAM_MEMBER_EXISTS' ELSE 'TEAM_SEAT_LIMIT_REACHED' END AS outcome FROM q LEFT JOIN g USING (team_id, target_id)
    UNION ALL SELECT id, early FROM y WHERE early IS NOT NULL""")(
    lambda spark, d: T.invite(table(spark, d, "orders").selectExpr(*[c.strip() for c in _split(_REQ)]), teams(spark, d), profiles(spark, d),
                              members(spark, d), ["ts", "id"]).select("id", "outcome"))


query("E25_accept_invites", f"""WITH {usage_sql('members')} SELECT team_id, user_id, CASE WHEN status = 'pending' AND user_id % 2 = 0 THEN 'active' ELSE status END AS status,
    CASE WHEN status = 'pending' AND user_id % 2 = 0 THEN {NOW_SQL} END AS accepted_at FROM members""")(
    lambda spark, d: (lambda m: T.accept_invites(m, m.filter("user_id % 2 = 0").select("team_id", "user_id"), now().cast("timestamp_ntz")).select("team_id", "user_id", "status", "accepted_at"))(members(spark, d)))
query("E25_cancel_invites", f"""WITH {usage_sql('members')} SELECT team_id, user_id, status FROM members WHERE NOT (status = 'pending' AND invite_email IS NOT NULL AND user_id % 5 = 0)""")(
    lambda spark, d: (lambda m: T.cancel_invites(m, m.filter("user_id % 5 = 0 AND invite_email IS NOT NULL").select("team_id", F.concat(F.lit(" "), F.upper("invite_email")).alias("email"))).select(
        "team_id", "user_id", "status"))(members(spark, d)))
_ACC = "o_orderkey AS id, o_orderdate AS ts, CAST(o_orderkey % 27 AS BIGINT) AS team_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS user_id"
_ACCEPTED = f"""WITH {usage_sql('teams', 'members', 'profiles')}, r AS (SELECT {_ACC} FROM orders),
    x AS (SELECT r.*, t.id IS NOT NULL AS known, m.user_id IS NOT NULL AS pending FROM r LEFT JOIN teams t ON t.id = r.team_id LEFT JOIN members m ON m.team_id = r.team_id AND m.user_id = r.user_id AND m.status = 'pending'),
    y AS (SELECT *, row_number() OVER (PARTITION BY team_id, user_id, pending ORDER BY ts, id) AS nth FROM x),
    o AS (SELECT *, CASE WHEN user_id IS NULL THEN 'NOT_AUTHENTICATED' WHEN NOT known THEN 'TEAM_NOT_FOUND' WHEN pending AND nth = 1 THEN 'OK' ELSE 'TEAM_INVITE_NOT_FOUND' END AS outcome FROM y)"""


def _accepted(spark, d):
    return T.accept_requests(table(spark, d, "orders").selectExpr(*[c.strip() for c in _split(_ACC)]), teams(spark, d), members(spark, d), ["ts", "id"])


query("E25_accept_outcomes", f"{_ACCEPTED} SELECT id, outcome FROM o")(lambda spark, d: _accepted(spark, d).select("id", "outcome"))
query("E25_accepted_profiles", f"""{_ACCEPTED}, w AS (SELECT user_id, arg_max(team_id, (ts, id)) AS joined FROM o WHERE outcome = 'OK' GROUP BY 1)
    SELECT p.id, coalesce(joined, team_id) AS team_id, CASE WHEN joined IS NOT NULL THEN 'team' ELSE plan_tier END AS plan_tier, CASE WHEN joined IS NOT NULL THEN 'active' ELSE plan_status END AS plan_status,
      CASE WHEN joined IS NOT NULL THEN 'team_invite' END AS plan_source FROM profiles p LEFT JOIN w ON w.user_id = p.id""")(
    lambda spark, d: T.joined_profiles(profiles(spark, d), _accepted(spark, d), ["ts", "id"]).select("id", "team_id", "plan_tier", "plan_status", "plan_source"))
_WS = "o_orderkey AS team_id, 'team ' || o_orderkey AS name, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 9 - 2 AS INT) END AS seat_limit, o_orderdate AS ts"
query("E26_create_workspaces", """SELECT o_orderkey AS id, o_custkey AS owner_user_id, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE greatest(CAST(o_orderkey % 9 - 2 AS INT), 1) END AS seat_limit, 'owner' AS role FROM orders""")(
    lambda spark, d: (lambda t, o: t.join(o, (t["id"] == o["team_id"]) & (t["owner_user_id"] == o["user_id"])).select("id", "owner_user_id", "seat_limit", "role"))(
        *T.create_workspaces(table(spark, d, "orders").selectExpr(*[c.strip() for c in _split(_WS)]))))
_WS_NULL = _WS.replace("o_custkey AS user_id", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS user_id")
query("E26_workspace_outcomes", "SELECT o_orderkey AS team_id, CASE WHEN o_orderkey % 11 = 0 THEN 'NOT_AUTHENTICATED' ELSE 'OK' END AS outcome FROM orders")(
    lambda spark, d: T.workspace_outcomes(table(spark, d, "orders").selectExpr(*[c.strip() for c in _split(_WS_NULL)])).select("team_id", "outcome"))
query("E26_workspace_profiles", f"""WITH {usage_sql('profiles')}, w AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS made FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1)
    SELECT p.id, coalesce(made, team_id) AS team_id FROM profiles p LEFT JOIN w USING (id)""")(
    lambda spark, d: T.workspace_profiles(profiles(spark, d), table(spark, d, "orders").selectExpr(*[c.strip() for c in _split(_WS_NULL)]), ["ts", "team_id"]).select("id", "team_id"))
query("E27_invite_backfill", f"""WITH {usage_sql('members', 'profiles')} SELECT m.team_id, user_id, 'active' AS status, joined_at AS accepted_at, coalesce(invite_email, lower(email)) AS invite_email
    FROM members m JOIN profiles p ON p.id = user_id""")(
    lambda spark, d: T.backfill_invites(members(spark, d).withColumn("accepted_at", F.lit(None).cast("timestamp")), profiles(spark, d)).drop("joined_at"))
query("C20_team_workspace", f"""WITH {usage_sql('teams', 'members', 'activities', 'jobs')},
    a AS (SELECT team_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS activity_ids FROM (SELECT * FROM activities QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) <= 20) GROUP BY 1),
    j AS (SELECT team_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS job_ids FROM (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) <= 20) GROUP BY 1),
    m AS (SELECT team_id, count(*) AS members, count_if(status = 'pending') AS pending_invites FROM members GROUP BY 1)
    SELECT t.id AS team_id, name, members, pending_invites, activity_ids, job_ids FROM teams t LEFT JOIN m ON m.team_id = t.id LEFT JOIN a ON a.team_id = t.id LEFT JOIN j ON j.team_id = t.id""")(
    lambda spark, d: T.workspaces(teams(spark, d), members(spark, d), activities(spark, d), jobs(spark, d)).select(
        "team_id", "name", "members", "pending_invites", F.array_join(F.col("activity_ids").cast("array<string>"), ",").alias("activity_ids"),
        F.array_join(F.col("job_ids").cast("array<string>"), ",").alias("job_ids")))
query("C20_workspace_members", f"""WITH {usage_sql('members', 'profiles')} SELECT m.team_id, user_id, email, role, status FROM members m LEFT JOIN profiles p ON p.id = user_id""")(
    lambda spark, d: T.workspace_members(members(spark, d), profiles(spark, d)))
_SAVES = "CAST(s_nationkey AS BIGINT) AS team_id, '{\"size\": ' || s_suppkey || '}' AS rules_json, s_suppkey AS updated_by"
query("C20_team_rules", f"SELECT * FROM (SELECT {_SAVES} FROM supplier) QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY updated_by DESC) = 1")(
    lambda spark, d: T.team_rules(table(spark, d, "supplier").selectExpr(*[c.strip() for c in _split(_SAVES)]), ["updated_by"]))
query("C20_pending_invitations", f"""WITH {usage_sql('members', 'teams')} SELECT m.team_id, user_id, name AS team_name, owner_user_id, seat_limit, row_number() OVER (PARTITION BY user_id ORDER BY joined_at, m.team_id) AS rank
    FROM members m LEFT JOIN teams t ON t.id = m.team_id WHERE status = 'pending'""")(
    lambda spark, d: T.pending_invitations(members(spark, d).withColumn("invited_at", F.col("joined_at")), teams(spark, d)).select(
        "team_id", "user_id", "team_name", "owner_user_id", "seat_limit", "rank"))
