"""Access logs, agents' activity and deadlines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from normwerk.functions import dates
from normwerk.operators import tables, traffic
from normwerk.plans import bridge
from normwerk.plans.bridge import ACCESS_SQL, AGENT_LOGS_SQL, PROJECTS_SQL, with_views

DAY = "2024-01-10"
HOLIDAYS = tuple(dt.date(y, m, d) for y in range(1992, 1999) for m, d in ((1, 1), (1, 2), (3, 8), (5, 1), (5, 9), (12, 16)))


def _access(spark, sf_dir):
    return traffic.parsed(bridge.access_lines(spark, sf_dir))[0]


def access_parsed(spark, sf_dir):
    """Lines and sums of their fields by class; what can't be read is quarantined (none here)."""
    good, bad = traffic.parsed(bridge.access_lines(spark, sf_dir))
    g = good.groupBy("is_bot").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.crossJoin(F.broadcast(bad.agg(F.count("*").alias("quarantined"))))


def traffic_by_class(spark, sf_dir):
    lines = traffic.of_day(bridge.access_lines(spark, sf_dir), DAY)
    return traffic.by_class(traffic.parsed(lines)[0], DAY)


def traffic_week(spark, sf_dir):
    return traffic.daily(_access(spark, sf_dir), "2024-01-27", "2024-02-02")


def response_codes(spark, sf_dir):
    return _access(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def top_human_ips(spark, sf_dir):
    return traffic.top(_access(spark, sf_dir), "ip", 10, bots=False)


def top_human_paths(spark, sf_dir):
    return traffic.top(_access(spark, sf_dir), "path", 20, bots=False)


def top_human_agents(spark, sf_dir):
    return traffic.top(_access(spark, sf_dir), "ua", 10, bots=False)


def top_bot_ips(spark, sf_dir):
    return traffic.top(_access(spark, sf_dir), "ip", 15, bots=True)


def top_bot_agents(spark, sf_dir):
    return traffic.top(_access(spark, sf_dir), "ua", 15, bots=True)


def requests_of_ip(spark, sf_dir):
    a = _access(spark, sf_dir).filter("ip = '10.1.1.1'")
    return a.select("ts", "path", "status").orderBy(F.desc("ts"), "path", "status").limit(50)


def ips_with_place(spark, sf_dir):
    """Distinct addresses of a day with the label of their place, where a table has one."""
    n = bridge.table(spark, sf_dir, "nation")
    geo = n.select(F.concat(F.lit("10.1.1."), (F.col("n_nationkey") * 10 + 1).cast("string")).alias("ip"), F.col("n_name").alias("city"), F.lit("KZ").alias("country"), F.lit("isp").alias("isp"))
    return traffic.labelled(_access(spark, sf_dir).select("ip").distinct(), geo)


def daily_activity(spark, sf_dir):
    logs = bridge.agent_logs(spark, sf_dir)
    return logs.groupBy(F.to_date("created_at").alias("day"), "agent_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("error"), F.round(F.avg("duration_ms")).cast("int").alias("mean_ms")
    )


def business_days(spark, sf_dir):
    p = bridge.projects(spark, sf_dir)
    return p.select("project_id", dates.business_days(F.col("start"), F.col("end"), HOLIDAYS).alias("days"))


def deadlines(spark, sf_dir):
    p = bridge.projects(spark, sf_dir)
    return p.select("project_id", dates.deadline(F.col("answer"), F.col("status"), F.lit(dt.date(1995, 6, 1))).alias("d")).select("project_id", "d.*")


def next_deadlines(spark, sf_dir):
    p = bridge.projects(spark, sf_dir).withColumn("d", dates.deadline(F.col("answer"), F.col("status"), F.lit(dt.date(1995, 6, 1))))
    return p.filter("d.urgent").select("project_id", F.col("d.days_to_answer").alias("days"), "status").orderBy("days", "project_id").limit(100)


QUERIES = {f.__name__: f for f in (access_parsed, traffic_by_class, traffic_week, response_codes, top_human_ips, top_human_paths, top_human_agents, top_bot_ips, top_bot_agents, requests_of_ip, ips_with_place, daily_activity, business_days, deadlines, next_deadlines)}


def _top(column: str, n: int, bots: bool) -> str:
    return with_views(ACCESS_SQL, then=f"SELECT {column} AS value, count(*) AS n FROM access WHERE is_bot = {str(bots).upper()} GROUP BY 1 ORDER BY n DESC, value LIMIT {n}")


_HOLIDAY_LIST = "[" + ", ".join(f"DATE '{d}'" for d in HOLIDAYS if d.weekday() < 5) + "]"
ORACLE_SQL = {
    "access_parsed": with_views(ACCESS_SQL, then="SELECT is_bot, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts, CAST(0 AS BIGINT) AS quarantined FROM access GROUP BY is_bot"),
    "traffic_by_class": with_views(ACCESS_SQL, f"a AS (SELECT * FROM access WHERE CAST(ts AS DATE) = DATE '{DAY}')", then="SELECT CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS class, count(DISTINCT ip) AS ips, count(*) AS requests FROM a GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT ip), count(*) FROM a"),
    "traffic_week": with_views(ACCESS_SQL, "d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day)",
        then="SELECT day, count(DISTINCT ip) FILTER (WHERE NOT is_bot) AS human_ips, count(*) FILTER (WHERE NOT is_bot) AS human_requests, count(DISTINCT ip) FILTER (WHERE is_bot) AS bot_ips, count(*) FILTER (WHERE is_bot) AS bot_requests FROM d LEFT JOIN access ON CAST(ts AS DATE) = day GROUP BY day"),
    "response_codes": with_views(ACCESS_SQL, then="SELECT status, count(*) AS n FROM access GROUP BY status"),
    "top_human_ips": _top("ip", 10, False), "top_human_paths": _top("path", 20, False), "top_human_agents": _top("ua", 10, False), "top_bot_ips": _top("ip", 15, True), "top_bot_agents": _top("ua", 15, True),
    "requests_of_ip": with_views(ACCESS_SQL, then="SELECT ts, path, status FROM access WHERE ip = '10.1.1.1' ORDER BY ts DESC, path, status LIMIT 50"),
    "ips_with_place": with_views(ACCESS_SQL, "geo AS (SELECT '10.1.1.' || CAST(n_nationkey * 10 + 1 AS VARCHAR) AS ip, n_name || ', KZ [isp]' AS place FROM nation)", then="SELECT DISTINCT ip, place FROM access LEFT JOIN geo USING (ip)"),
    "daily_activity": with_views(AGENT_LOGS_SQL, then="SELECT CAST(created_at AS DATE) AS day, agent_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error, CAST(floor(avg(duration_ms) + 0.5) AS INTEGER) AS mean_ms FROM agent_logs GROUP BY 1, 2"),
    "business_days": with_views(PROJECTS_SQL, then=f"SELECT project_id, CASE WHEN end_ IS NOT NULL THEN CAST(len(list_filter(generate_series(start_, end_, INTERVAL 1 DAY), lambda x: isodow(x) < 6 AND NOT list_contains({_HOLIDAY_LIST}, CAST(x AS DATE)))) AS INTEGER) END AS days FROM projects"),
    "deadlines": with_views(PROJECTS_SQL, then="SELECT project_id, CAST(answer - DATE '1995-06-01' AS INTEGER) AS days_to_answer, answer < DATE '1995-06-01' AND status <> 'done' AS overdue, answer - DATE '1995-06-01' BETWEEN 0 AND 1 AS urgent FROM projects"),
    "next_deadlines": with_views(PROJECTS_SQL, then="SELECT project_id, CAST(answer - DATE '1995-06-01' AS INTEGER) AS days, status FROM projects WHERE answer - DATE '1995-06-01' BETWEEN 0 AND 1 ORDER BY days, project_id LIMIT 100"),
}
