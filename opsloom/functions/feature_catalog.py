"""Derived features as a declarative table over a wide frame (entity, ts, one column a level or rate).

Column names: ``r_*`` are rates (null after a counter reset), others levels.
``frac(a, b)`` is null unless b > 0; ``tol(a, b)`` adds and tolerates unknown
parts; plain + propagates unknown. Columns that a frame lacks count as unknown.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST, APP, DB, NET = ("app_server", "database", "node", "unknown"), ("app_server", "unknown"), ("database", "unknown"), ("switch", "unknown")
# Feature, kinds, formula, direction (1: up is bad), ceiling, scale floor.
FEATURES = [
    ("host.cpu_busy_ratio", HOST, "unit(1 - frac(r_cpu_idle, cores))", 1, "unit", 0.01),
    ("host.cpu_iowait_ratio", HOST, "frac(r_cpu_iowait, cores)", 1, "unit", 0.005),
    ("host.cpu_system_ratio", HOST, "frac(r_cpu_system, cores)", 1, "unit", 0.005),
    ("host.runq_per_cpu", HOST, "frac(load1, cores)", 1, "learned", 0.05),
    ("host.procs_blocked", HOST, "procs_blocked", 1, "learned", 0.5),
    ("host.disk_latency_seconds", HOST, "frac(r_io_weighted_s, tol(r_disk_reads, r_disk_writes))", 1, "learned", 0.0005),
    ("host.disk_busy_ratio", HOST, "unit(r_disk_busy_max)", 1, "unit", 0.01),
    ("host.fd_utilisation", HOST, "frac(fd_allocated, fd_maximum)", 1, "unit", 0.15),
    ("host.socket_pressure", HOST, "frac(tcp_inuse, fd_allocated)", 1, "unit", 0.9),
    ("host.tcp_orphan_ratio", HOST, "frac(tcp_orphan, tcp_inuse)", 1, "unit", 0.05),
    ("host.tcp_timewait_ratio", HOST, "frac(tcp_tw, tcp_inuse)", 1, "unit", 0.01),
    ("host.memory_used_ratio", HOST, "unit(1 - frac(mem_available, mem_total))", 1, "unit", 0.01),
    ("host.major_fault_rate", HOST, "r_major_faults", 1, "learned", 0.5),
    ("host.context_switch_rate", HOST, "r_context_switches", 1, "learned", 10.0),
    ("host.work_per_cpu_second", ("database", "node", "unknown"), "frac(tol(tol(r_disk_ops, r_net_rx), r_net_tx), cores - r_cpu_idle)", -1, "none", 1.0),
    ("app.request_rate", APP, "tol(r_tomcat_requests, r_apache_accesses)", -1, "none", 0.5),
    ("app.error_ratio", APP, "frac(r_tomcat_errors, r_tomcat_requests)", 1, "unit", 0.002),
    ("app.mean_latency_seconds", APP, "frac(r_request_ms, r_tomcat_requests) / 1000", 1, "learned", 0.002),
    ("app.thread_busy_ratio", APP, "frac(threads_busy, threads_count)", 1, "unit", 0.02),
    ("app.apache_busy_ratio", APP, "frac(apache_busy, tol(apache_busy, apache_idle))", 1, "unit", 0.02),
    ("app.scoreboard_wait_ratio", APP, "frac(scoreboard_idle, scoreboard_all)", -1, "none", 0.02),
    ("app.jvm_heap_ratio", APP, "frac(heap_used, heap_max)", 1, "unit", 0.01),
    ("app.jvm_gc_fraction", APP, "r_gc_seconds", 1, "unit", 0.005),
    ("app.jvm_blocked_ratio", APP, "frac(jvm_threads_blocked, jvm_threads_all)", 1, "unit", 0.01),
    ("app.jvm_waiting_ratio", APP, "frac(jvm_threads_waiting, jvm_threads_all)", 1, "unit", 0.01),
    ("app.jvm_deadlocked", APP, "jvm_deadlocked", 1, "learned", 0.5),
    ("app.session_reject_rate", APP, "r_sessions_rejected", 1, "learned", 0.05),
    ("app.work_per_cpu_second", APP, "frac(tol(r_tomcat_requests, r_apache_accesses), cores - r_cpu_idle)", -1, "none", 0.5),
    ("app.work_per_busy_thread", APP, "frac(tol(r_tomcat_requests, r_apache_accesses), threads_busy)", -1, "none", 0.02),
    ("db.lock_wait_rate", DB, "r_lock_waits", 1, "learned", 0.05),
    ("db.lock_current_waits", DB, "lock_current_waits", 1, "learned", 0.5),
    ("db.lock_time_avg_ms", DB, "lock_time_avg_ms", 1, "learned", 25.0),
    ("db.table_lock_contention", DB, "frac(r_table_locks_waited, tol(r_table_locks_waited, r_table_locks_immediate))", 1, "unit", 0.005),
    ("db.slow_query_rate", DB, "r_slow_queries", 1, "learned", 0.02),
    ("db.session_pool_ratio", DB, "frac(threads_connected, max_connections)", 1, "unit", 0.01),
    ("db.threads_running", DB, "threads_running", 1, "learned", 0.5),
    ("db.aborted_connect_rate", DB, "r_aborted_connects", 1, "learned", 0.02),
    ("db.buffer_pool_wait_rate", DB, "r_buffer_pool_waits", 1, "learned", 0.02),
    ("db.query_rate", DB, "r_questions", -1, "none", 1.0),
    ("db.work_per_running_session", DB, "frac(r_questions, threads_running)", -1, "none", 0.5),
    ("net.port_error_rate", NET, "tol(r_in_errors, r_out_errors)", 1, "learned", 0.05),
    ("net.loss_ratio", NET, "frac(tol(r_in_discards, r_out_discards), tol(r_delivered, tol(r_in_discards, r_out_discards)))", 1, "unit", 0.0005),
    ("net.discard_rate", NET, "tol(r_in_discards, r_out_discards)", 1, "learned", 0.05),
    ("net.port_down", NET, "CAST(oper_status <> 1 AS DOUBLE)", 1, "unit", 0.25),
    ("net.port_utilisation", NET, "frac(tol(r_in_octets, r_out_octets) * 8, speed_mbit * 1e6)", 1, "unit", 0.01),
    ("net.ospf_event_rate", NET, "r_ospf_events * 60", 1, "learned", 0.02),
    ("net.ospf_not_full", NET, "CAST(ospf_state <> 8 AS DOUBLE)", 1, "unit", 0.25),
]

_CALL = re.compile(r"\b(frac|tol|unit)\(")


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    depth, parts, at = 1, [], start
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return [*parts, text[at:i]], i + 1
        if text[i] == "," and depth == 1:
            parts.append(text[at:i])
            at = i + 1
    raise ValueError(text)


def to_sql(formula: str) -> str:
    """A formula as a Spark SQL expression."""
    m = _CALL.search(formula)
    if not m:
        return formula
    args, end = _arguments(formula, m.end())
    a = [to_sql(x.strip()) for x in args]
    if m[1] == "frac":
        new = f"(CASE WHEN ({a[1]}) > 0 THEN ({a[0]}) / ({a[1]}) END)"
    elif m[1] == "tol":
        new = f"(CASE WHEN ({a[0]}) IS NULL AND ({a[1]}) IS NULL THEN NULL ELSE coalesce({a[0]}, 0) + coalesce({a[1]}, 0) END)"
    else:
        new = f"(CASE WHEN ({a[0]}) IS NOT NULL THEN greatest(0.0D, least(1.0D, {a[0]})) END)"
    return formula[: m.start()] + new + to_sql(formula[end:])


def inputs() -> list[str]:
    """The columns that the formulas read, in order of name."""
    return sorted({w for _, _, f, *_ in FEATURES for w in re.findall(r"[a-z_][a-z_0-9]*", f)} - {"frac", "tol", "unit", "e6"})


def derive(wide: DataFrame, kind: str = "kind", keep: tuple[str, ...] = ("entity", "ts")) -> DataFrame:
    """entity, ts, feature, value, direction, ceiling, floor for every feature that applies to the entity's kind."""
    words = set(inputs())
    full = wide.withColumns({w: F.lit(None).cast("double") for w in words if w not in wide.columns}) if words - set(wide.columns) else wide
    items = [
        F.when(F.col(kind).isin(*kinds), F.struct(F.lit(n).alias("feature"), F.expr(to_sql(f)).cast("double").alias("value"), F.lit(d).alias("direction"), F.lit(c).alias("ceiling"), F.lit(fl).alias("floor")))
        for n, kinds, f, d, c, fl in FEATURES
    ]
    return full.select(*keep, F.inline(F.array_compact(F.array(*items)))).filter("value is not null")
