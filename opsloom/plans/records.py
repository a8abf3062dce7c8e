"""Queries over records in files and text: log lines, metrics text, comparator signals, evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import head_tail, safe_ratio, short_number
from opsloom.functions.sql import register_functions, register_tables
from opsloom.operators import detect as dt
from opsloom.operators import logs as lg
from opsloom.plans.detection import _R, _readings
from opsloom.plans.relational import ev
from opsloom.shared import shared_dir
from opsloom.sources import readers
from opsloom.tables import table


def log_jsonl_scan(s, d):
    """Events written as JSON-lines log entries and read back by the strict reader."""
    path = f"{shared_dir(s)}/logs-{uuid.uuid4().hex}"
    severity = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    entry = ev(s, d).select(F.col("event_id").cast("string").alias("insertId"), severity.alias("severity"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("textPayload"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))
    readers.write_jsonl(entry, path)
    return readers.read_logs(s, path).select(F.col("insertId").cast("long").alias("event_id"), "severity", "message", "is_corrupt")


def exposition_render(s, d):
    e = ev(s, d).select("event_id", F.concat(F.col("event_type"), F.lit("_total")).alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")).alias("labels"), "value")
    return lg.render_exposition(e, "name", "labels", "value").select("event_id", "text")


def baseline_signals(s, d):
    """The comparator's signals: totals taken as rates, and the same from the change since the hour before."""
    h = ev(s, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value"))), 4).alias("errors"), F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), 4).alias("views"))
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts")
    total = F.sum("errors").over(day.rowsBetween(Window.unboundedPreceding, 0))
    return h.select("ts", F.round(total, 4).alias("errors_as_rate"), F.round(F.col("errors") / 3600.0, 6).alias("errors_per_s"), F.round(safe_ratio(F.col("errors"), F.col("views")), 6).alias("error_ratio"))


def attribution_evidence(s, d):
    """A line of evidence a family, strongest first, for each user and day."""
    c = dt.contribution_share(_readings(s, d), ["user_id", "day"]).withColumn("share", F.round("share", 4)).filter("share > 0")
    line = F.concat("family", F.lit(" by "), "feature")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "family", line.alias("t"))))
    return c.groupBy("user_id", "day").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "; ").alias("evidence"))


def number_text(s, d):
    """Event values as the shortest text, as they are and a hundred million times smaller."""
    return ev(s, d).select("event_id", short_number(F.col("value")).alias("plain"), short_number(F.col("value") * 0 - F.round("value") / 1e8).alias("small"))


def sql_functions(s, d):
    """The registered functions and views, called from SQL."""
    register_functions(s)
    register_tables(s, d, ["events"])
    return s.sql("""WITH b AS (SELECT *, date_trunc('DAY', ts) + make_dt_interval(0, floor(hour(ts) / 6) * 6) AS six FROM events),
    span AS (SELECT CAST(min(six) AS TIMESTAMP_NTZ) AS first, CAST(max(six) AS TIMESTAMP_NTZ) AS last FROM b),
    x AS (SELECT g.ts, b.event_id, b.value, ops_severity(ops_robust_z(b.value, 20, 2, 0.01)) AS severity
      FROM span, LATERAL ops_time_grid(span.first, span.last, INTERVAL '0 06:00:00' DAY TO SECOND) g LEFT JOIN b ON CAST(b.six AS TIMESTAMP_NTZ) = g.ts),
    y AS (SELECT ts, count(event_id) AS n, max(severity) AS severity, sum(value) AS total, max(value) AS peak FROM x GROUP BY ts),
    z AS (SELECT ts, n, severity, ops_safe_ratio(total, n) AS mean, ops_logistic(ops_clamp(peak / 100, 0, 2)) AS p FROM y)
    SELECT ts, n, round(severity, 6) AS severity, round(mean, 6) AS mean, round(p, 6) AS p FROM z""")


def _folder(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def topology_scan(s, d):
    """A topology file of nations in their regions, read back as edges with both ends' kinds."""
    entity = lambda df, i, n, kind: df.select(F.col(i).cast("string").alias("entity_id"), F.lit(kind).alias("kind"), F.struct(F.lit(kind).alias("type"), F.create_map(F.lit("name"), F.col(n)).alias("labels")).alias("log_resource"))
    nations, regions = table(s, d, "nation").withColumn("i", F.concat(F.lit("n"), "n_nationkey")), table(s, d, "region").withColumn("i", F.concat(F.lit("r"), "r_regionkey"))
    entities = entity(nations, "i", "n_name", "node").unionByName(entity(regions, "i", "r_name", "switch")).agg(F.collect_list(F.struct("entity_id", "kind", "log_resource")).alias("entities"))
    edges = nations.agg(F.collect_list(F.array(F.lit("contains"), F.concat(F.lit("r"), "n_regionkey"), "i")).alias("edges"))
    path = _folder(s, "topology")
    entities.crossJoin(edges).coalesce(1).write.json(path)  # one row: a topology file is one document
    found, links = readers.read_topology(s, path)
    kind = lambda end: found.select(F.col("entity_id").alias(end), F.col("kind").alias(f"{end}_kind"), F.element_at("log_resource.labels", "name").alias(f"{end}_name"))
    return links.join(kind("src"), "src").join(kind("dst"), "dst").select("relation", "src", "dst", "src_kind", "dst_kind", "src_name", "dst_name")


def calendar_scan(s, d):
    """A change calendar with a change a region over its nations, one of them over the whole estate, read back a row an entity."""
    per = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    change = F.struct(F.concat(F.lit("c"), "n_regionkey").alias("change_id"), F.lit("maintenance").alias("kind"), F.when(F.col("n_regionkey") > 0, F.col("names")).alias("entities"), F.lit("2024-01-01T00:00:00Z").alias("start"), F.lit("2024-01-01T12:00:00Z").alias("end"), F.lit("x").alias("description"))
    path = _folder(s, "calendar")
    per.agg(F.collect_list(change).alias("changes")).coalesce(1).write.json(path)
    out = readers.read_calendar(s, path)
    return out.select("change_id", "entity", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.timestamp_diff("HOUR", "start_ts", "end_ts").alias("hours"))


def targets_scan(s, d):
    """A target file with a target a nation, attached to events by job and instance."""
    t = table(s, d, "nation").select(*[F.lit("x").alias(c) for c in ("project_id", "location", "cluster", "namespace")], F.lit("j").alias("job"), F.col("n_nationkey").cast("string").alias("instance"), F.col("n_name").alias("exporter"), F.lit("node").alias("entity_kind"))
    path = _folder(s, "targets")
    t.agg(F.collect_list(F.struct(*t.columns)).alias("targets")).coalesce(1).write.json(path)
    scrapes = ev(s, d).select("event_id", F.lit("j").alias("job"), (F.col("user_id") % 30).cast("string").alias("instance"))
    return readers.attach_targets(scrapes, readers.read_targets(s, path)).groupBy("exporter").agg(F.count("*").alias("n"))


def sink_append_once(s, d):
    """Two overlapping batches, one of them tried twice, stored and read back."""
    e, path = ev(s, d).select("event_id", "event_type", "value"), _folder(s, "sink")
    for batch, rows in (("0", "event_id % 3 <> 0"), ("1", "event_id % 2 = 0 or event_id % 3 = 0"), ("1", "event_id % 2 = 0 or event_id % 3 = 0")):
        readers.append_new(e.filter(rows), path, ["event_id"], e.columns, batch)
    return readers.read_once(s, path, ["event_id"])


def head_tail_text(s, d):
    return table(s, d, "benchmark").select("item_id", head_tail(F.col("text"), 60).alias("text"))


QUERIES = {f.__name__: f for f in (topology_scan, calendar_scan, targets_scan, sink_append_once, head_tail_text, sql_functions, number_text, log_jsonl_scan, exposition_render, baseline_signals, attribution_evidence)}
ORACLE = {
    "topology_scan": "SELECT 'contains' AS relation, 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'switch' AS src_kind, 'node' AS dst_kind, r_name AS src_name, n_name AS dst_name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "calendar_scan": "SELECT DISTINCT 'c' || n_regionkey AS change_id, CASE WHEN n_regionkey > 0 THEN n_name END AS entity, TIMESTAMP '2024-01-01' AS start_ts, 12::BIGINT AS hours FROM nation",
    "targets_scan": "SELECT n_name AS exporter, count(*) AS n FROM events LEFT JOIN nation ON n_nationkey = user_id % 30 GROUP BY ALL",
    "sink_append_once": "SELECT event_id, event_type, value FROM events",
    "head_tail_text": "SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE text[1:27] || ' ... ' || right(text, 28) END AS text FROM benchmark",
    "sql_functions": """SELECT g.ts, count(e.event_id) AS n, round(max(greatest(0, least(1, ((e.value - 20) / 2 - 1.6::DOUBLE) / 7.4::DOUBLE))), 6) AS severity, round(avg(e.value), 6) AS mean, round(1 / (1 + exp(-least(greatest(max(e.value) / 100, 0), 2))), 6) AS p
    FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, min(ts)), time_bucket(INTERVAL 6 HOUR, max(ts)), INTERVAL 6 HOUR)) AS ts FROM events) g LEFT JOIN events e ON e.ts >= g.ts AND e.ts < g.ts + INTERVAL 6 HOUR GROUP BY g.ts""",
    "number_text": "SELECT event_id, regexp_replace(value::VARCHAR, '\\.0$', '') AS plain, regexp_replace((value * 0 - round(value) / 1e8::DOUBLE)::VARCHAR, '^-0\\.0$|^0\\.0$', '0') AS small FROM events",
    "log_jsonl_scan": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'user=' || user_id END AS message, false AS is_corrupt FROM events",
    "exposition_render": """SELECT event_id, event_type || '_total{props="' || replace(props, '"', '\\"') || '",user="' || user_id || '"} ' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS text FROM events""",
    "baseline_signals": """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value) FILTER (WHERE event_type = 'error'), 4) AS e, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS v FROM events GROUP BY ALL)
SELECT ts, round(sum(e) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS errors_as_rate, round(e / 3600.0::DOUBLE, 6) AS errors_per_s, round(CASE WHEN v > 0 THEN e / v END, 6) AS error_ratio FROM h""",
    "attribution_evidence": f"""WITH {_R}, s AS (SELECT user_id, day, family, feature, round(severity / nullif(sum(severity) OVER (PARTITION BY user_id, day), 0), 4) AS share FROM f)
SELECT user_id, day, string_agg(family || ' by ' || feature, '; ' ORDER BY share DESC, family) AS evidence FROM s WHERE share > 0 GROUP BY ALL""",
}
