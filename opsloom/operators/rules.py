"""Strict readers as rule tables: every broken rule of a metrics document or a log entry is a row.

A rule is a boolean column; a row is exploded into the rules it breaks, and
rules about several rows (repeats, order, histogram totals) are aggregations
or windows within one document or batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.shared import rounds

# Fixed values of the metrics text format.
NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|[+-]Inf"
TYPES = ("counter", "gauge", "histogram", "summary", "untyped")
TARGET_LABELS = ("project_id", "location", "cluster", "namespace", "job", "instance")
MOST_KEY, MOST_VALUE = 100, 1024

_VALUE = r'"((?:[^"\\]|\\.)*)"'
_PAIR = r'([^\s=,{}"]+)[ \t]*=[ \t]*' + _VALUE
_SET = r'\{[ \t]*(?:' + r'[^\s=,{}"]+[ \t]*=[ \t]*"(?:[^"\\]|\\.)*"' + r'[ \t]*(?:,[ \t]*|(?=\})))*\}'


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules whose column is true; unknown counts as kept."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def _number(token: Column) -> Column:
    special = F.when(token == "NaN", F.lit(float("nan"))).when(token.isin("+Inf", "Inf"), F.lit(float("inf"))).when(token == "-Inf", F.lit(float("-inf")))
    return F.coalesce(special, F.when(token.rlike(f"^(?:{NUMBER})$"), token.try_cast("double")))


def _plain(value: Column) -> Column:
    out = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def exposition_lines(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row a line that is not blank: kind (sample, help, type), its parts, and the rules that the line breaks by itself."""
    lines = docs.select(*keep, F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")).alias("_i", "_l"))
    lines = lines.select(*keep, (F.col("_i") + 1).alias("line"), F.ltrim(F.col("_l"), F.lit(" \t")).alias("_l")).filter("_l <> ''")
    note = r"^#[ \t]*(HELP|TYPE)[ \t]+"
    kind = F.when(~F.col("_l").startswith("#"), F.lit("sample")).when(F.col("_l").rlike(note), F.lower(F.regexp_extract("_l", note, 1)))
    lines = lines.withColumn("kind", kind).filter("kind is not null")
    lines = lines.withColumn("_b", F.when(F.col("kind") == "sample", F.col("_l")).otherwise(F.regexp_replace("_l", note, "")))
    lines = lines.withColumn("name", F.regexp_extract("_b", f"^({NAME})", 1)).withColumn("_r", F.expr("substring(_b, length(name) + 1)"))
    sample, typed, helped = (F.col("kind") == k for k in ("sample", "type", "help"))
    labelled = F.col("_r").startswith("{")
    block = F.regexp_extract("_r", f"^({_SET})", 1)
    lines = lines.withColumns({"_s": F.when(sample & labelled, block).otherwise(F.lit("")), "_named": (F.col("name") != "") & (F.substring("_r", 1, 1).isin("", " ", "\t", "{") | F.col("_r").rlike(r"^(?:[ \t{]|$)"))})
    lines = lines.withColumn("_open", sample & labelled & (F.col("_s") == "")).withColumn("_rest", F.when(sample, F.expr("substring(_r, length(_s) + 1)")).otherwise(F.col("_r")))
    pairs = F.regexp_extract_all("_s", F.lit(_PAIR), F.lit(1)), F.regexp_extract_all("_s", F.lit(_PAIR), F.lit(2))
    lines = lines.withColumns({"_k": pairs[0], "_v": pairs[1], "_t": F.filter(F.split("_rest", r"[ \t]+"), lambda x: x != "")})
    token = lambda i: F.get("_t", F.lit(i))
    named = F.col("_named")
    good = sample & named & ~F.col("_open")
    lines = lines.withColumn("_x", F.when(good, _number(token(0))))
    rules = {
        "P02": ~named,
        "P03": F.exists("_k", lambda k: ~k.rlike(f"^{NAME}$") | k.startswith("__")),
        "P04": F.col("_open") & named,
        "P05": F.exists("_v", lambda v: F.replace(v, F.lit("\\\\"), F.lit("")).rlike(r'\\[^n"]')) | (helped & F.replace("_r", F.lit("\\\\"), F.lit("")).rlike(r"\\(?:[^n]|$)")),
        "P06": good & (token(0).isNull() | ~F.substring("_rest", 1, 1).isin(" ", "\t") | F.col("_x").isNull()),
        "P07": good & token(1).isNotNull() & ~token(1).rlike(r"^[+-]?[0-9]+$"),
        "P08": typed & named & ~F.coalesce(token(0).isin(*TYPES), F.lit(False)),
        "P10": F.size(F.array_distinct("_k")) < F.size("_k"),
        "P17": F.exists("_k", lambda k: k.isin(*TARGET_LABELS)),
        "P18": F.exists("_k", lambda k: F.length(k) > MOST_KEY) | F.exists("_v", lambda v: F.length(_plain(v)) > MOST_VALUE),
        "P19": (good & token(2).isNotNull()) | (typed & named & token(1).isNotNull()),
    }
    labels = F.array_sort(F.transform(F.arrays_zip("_k", "_v"), lambda p: F.struct(p["_k"].alias("k"), _plain(p["_v"]).alias("v"))))
    return lines.select(*keep, "line", "kind", "name", F.when(good, labels).alias("labels"), F.col("_x").alias("value"), F.when(typed, token(0)).alias("type"), broken(rules).alias("_broken"))


def _label(key: str) -> Column:
    return F.get(F.filter("labels", lambda p: p["k"] == key), F.lit(0))["v"]


def exposition_rules(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, rule, line for every rule P01 to P19 that a document breaks; line is null for rules about a whole document or family.

    ``keep`` identifies a document. Histograms are compared by family and by
    the labels other than ``le``.
    """
    whole = docs.filter(F.col(text).contains("\r") | ((F.col(text) != "") & ~F.col(text).endswith("\n")))
    whole = whole.select(*keep, F.lit("P01").alias("rule"), F.lit(None).cast("int").alias("line")).distinct()
    # The only shuffle of lines: documents are dealt before they are parsed, and all windows stay within a document. The number is named, since AQE would
    # deal by the size of the texts, and their lines are many times as large.
    dealt = docs.select(*keep, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep)
    lines = exposition_lines(dealt, text, keep)
    within = lambda *columns: Window.partitionBy(*keep, *columns)

    lines = lines.withColumn("_ok", (F.col("kind") == "sample") & F.col("value").isNotNull())
    same = ["name", "kind", "_ok", "labels"]
    lines = lines.sortWithinPartitions(*keep, *same, "line").withColumn("_n", F.row_number().over(within(*same).orderBy("line")))
    declared = (F.col("kind") == "type") & (F.col("_n") == 1)
    bare = F.regexp_replace("name", "_(?:bucket|sum|count)$", "")
    lines = lines.withColumn("_whole", F.max(F.when(declared, F.col("type"))).over(within("name"))).withColumn("_p", F.when(F.col("_ok"), bare).otherwise(F.col("name")))
    lines = lines.withColumn("_part", F.max(F.when(declared & F.col("type").isin("histogram", "summary"), F.col("type"))).over(within("_p")))
    part = F.col("_ok") & F.col("_whole").isNull() & F.col("_part").isNotNull()
    lines = lines.select(*keep, "line", "kind", "name", "labels", "value", "_broken", "_ok", "_n", F.when(part, F.col("_p")).otherwise(F.col("name")).alias("family"), F.when(part, F.col("_part")).otherwise(F.col("_whole")).alias("type"))

    ok, histogram, summary = F.col("_ok"), F.col("type") == "histogram", F.col("type") == "summary"
    bucket, total = F.col("name") == F.concat("family", F.lit("_bucket")), F.col("name").isin(F.concat(F.col("family"), F.lit("_sum")), F.concat(F.col("family"), F.lit("_count")))
    counted = F.coalesce(ok & histogram & (bucket | (F.col("name") == F.concat("family", F.lit("_count")))), F.lit(False))
    lines = lines.withColumns({"_le": F.when(ok, _label("le")), "_quantile": F.when(ok, _label("quantile")), "_bucket": bucket, "_counted": counted})
    lines = lines.withColumns({"group": F.when(F.col("_counted"), F.filter("labels", lambda p: p["k"] != "le")), "bound": F.when(F.col("_counted") & F.col("_bucket"), _number(F.col("_le")))})
    lines = lines.sortWithinPartitions(*keep, "family", "group", "bound", "line").withColumn("_first", F.min(F.when(ok, F.col("line"))).over(within("family")))
    run, group = within("family", "group").orderBy("bound", "line"), within("family", "group")
    height = F.when(F.col("_counted") & F.col("_bucket"), F.col("value"))
    lines = lines.withColumns({"_fall": F.coalesce(height < F.max(height).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)), "_g": F.row_number().over(run)})
    lines = lines.withColumns({
        "inf": F.max(F.when(F.col("bound") == float("inf"), F.col("value"))).over(group),
        "count": F.max(F.when(F.col("_counted") & ~F.col("_bucket"), F.col("value"))).over(group),
        "fall": F.max("_fall").over(group),
    })
    le, quantile = F.col("_le"), F.col("_quantile")
    one = {
        "P09": (F.col("kind") != "sample") & ((F.col("_n") > 1) | F.coalesce(F.col("_first") < F.col("line"), F.lit(False))),
        "P11": ok & (F.col("_n") > 1),
        "P12": ok & histogram & bucket & le.isNull(),
        "P15": ok & (((histogram | summary) & total & (le.isNotNull() | quantile.isNotNull())) | (~F.coalesce(histogram | summary, F.lit(False)) & le.isNotNull())),
        "P16": ok & ((histogram & bucket & le.isNotNull() & _number(le).isNull()) | (summary & quantile.isNotNull() & ~F.coalesce(_number(quantile).between(0, 1), F.lit(False)))),
    }
    once = F.col("_counted") & (F.col("_g") == 1)  # a group of a histogram speaks through one of its rows
    several = {"P12": once & F.col("inf").isNull(), "P13": once & F.col("inf").isNotNull() & ~F.coalesce(F.col("inf") == F.col("count"), F.lit(False)), "P14": once & F.col("fall")}
    found = F.concat(F.transform(F.concat("_broken", broken(one)), lambda r: F.struct(r.alias("rule"), F.col("line").alias("line"))), F.transform(broken(several), lambda r: F.struct(r.alias("rule"), F.lit(None).cast("int").alias("line"))))
    return lines.select(*keep, F.explode(found).alias("_f")).select(*keep, "_f.rule", "_f.line").distinct().unionByName(whole)


# Fixed values of the log entry format: fields and their kinds.
ENTRY = {
    "logName": "string", "resource": "resource", "protoPayload": "object", "textPayload": "string", "jsonPayload": "object", "timestamp": "time", "receiveTimestamp": "time", "severity": "severity",
    "insertId": "string", "httpRequest": "object", "labels": "labels", "operation": "object", "trace": "string", "spanId": "string", "traceSampled": "bool", "sourceLocation": "object", "split": "object",
}
PARTS = {
    "httpRequest": {"requestMethod": "string", "requestUrl": "string", "requestSize": "int64", "status": "int32", "responseSize": "int64", "userAgent": "string", "remoteIp": "string", "serverIp": "string", "referer": "string", "latency": "duration", "cacheLookup": "bool", "cacheHit": "bool", "cacheValidatedWithOriginServer": "bool", "cacheFillBytes": "int64", "protocol": "string"},
    "operation": {"id": "string", "producer": "string", "first": "bool", "last": "bool"},
    "sourceLocation": {"file": "string", "line": "int64", "function": "string"},
    "split": {"uid": "string", "index": "int32", "totalSplits": "int32"},
}
PAYLOADS = ("textPayload", "jsonPayload", "protoPayload")
SEVERITIES = ("DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY")
NEVER = ("errorGroups", "errorGroup", "metadata", "receiveLocation", "internalId", "ancestorInternalIds", "writerEmailAddress", "internalMetadata", "apphub", "apphubDestination", "apphubSource", "transformRevisions", "otel")
RESOURCES = {
    "gce_instance": ("project_id", "instance_id", "zone"),
    "k8s_container": ("project_id", "location", "cluster_name", "namespace_name", "pod_name", "container_name"),
    "k8s_pod": ("project_id", "location", "cluster_name", "namespace_name", "pod_name"),
    "k8s_node": ("project_id", "location", "cluster_name", "node_name"),
    "generic_node": ("project_id", "location", "namespace", "node_id"),
    "generic_task": ("project_id", "location", "namespace", "job", "task_id"),
    "gae_app": ("project_id", "module_id", "version_id", "zone"),
    "prometheus_target": ("project_id", "location", "cluster", "namespace", "job", "instance"),
}
ANY_TYPES = ("type.googleapis.com/google.cloud.audit.AuditLog", "type.googleapis.com/google.appengine.logging.v1.RequestLog")
LOG_NAME = r"^(?:projects|organizations|billingAccounts|folders)/[^/]+/logs/([^/]+)$"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?Z$"
MOST_LABEL_KEY, MOST_LABEL_VALUE = 512, 65536


def log_entry_rules(entries: DataFrame, raw: str, keep: list[str], batch: list[str] | None = None) -> DataFrame:
    """keep, rule for every rule L01 to L18 that an entry (one JSON text a row) breaks.

    Ids must be unique within ``batch`` columns (all rows, if there are none);
    every holder of a repeated id breaks L18.
    """
    batch = batch or []
    fields = F.from_json(raw, "map<string,string>")
    rows = entries.select(*dict.fromkeys([*keep, *batch]), F.col(raw).alias("_raw"), F.try_parse_json(raw).alias("_v"), fields.alias("_m")).withColumn("_keys", F.coalesce(F.map_keys("_m"), F.array().cast("array<string>")))

    def at(path: str) -> Column:
        return F.try_variant_get("_v", f"$.{path}", "variant")

    def kind(path: str) -> Column:
        """STRING, BIGINT, DECIMAL..., BOOLEAN, OBJECT<...>; null where the path is missing."""
        return F.schema_of_variant(at(path))

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get("_v", f"$.{path}", "string"))

    def is_object(path: str) -> Column:
        return F.coalesce(kind(path).startswith("OBJECT"), F.lit(True))

    def keys(path: str) -> Column:
        return F.coalesce(F.map_keys(F.from_json(F.get_json_object("_raw", f"$.{path}"), "map<string,string>")), F.array().cast("array<string>"))

    def wrong(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def any_of(columns: list[Column]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | wrong(c)
        return out

    of = lambda k: [f for f, t in ENTRY.items() if t == k] + [f"{m}.{f}" for m, fs in PARTS.items() for f, t in fs.items() if t == k]
    integer = lambda p: text(p).rlike(r"^-?(?:0|[1-9][0-9]*)$") & text(p).try_cast("long").isNotNull()
    whole = lambda p: F.try_variant_get("_v", f"$.{p}", "long")
    log_id = F.regexp_extract(text("logName"), LOG_NAME, 1)
    resource_type = text("resource.type")
    permitted = F.create_map(*[x for k, v in RESOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    labels = F.from_json(F.get_json_object("_raw", "$.labels"), "map<string,string>")
    payloads = F.size(F.filter("_keys", lambda k: k.isin(*PAYLOADS)))
    index, total = whole("split.index"), whole("split.totalSplits")
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    unpaired = F.regexp_replace(F.replace("_raw", F.lit("\\\\"), F.lit("")), high + low, "")
    rules = {
        "L01": F.col("_v").isNull() | ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
        | F.exists("_keys", lambda k: ~k.isin(*ENTRY, *NEVER))
        | any_of([F.size(F.array_except(keys(m), F.array(*map(F.lit, fs)))) > 0 for m, fs in PARTS.items()])
        | any_of([kind(p) != "STRING" for p in of("string")]) | any_of([kind(p) != "BOOLEAN" for p in of("bool")])
        | any_of([~is_object(p) for p in [*of("object"), *of("labels")]])
        | any_of([F.exists(F.map_values(F.from_json(F.get_json_object("_raw", "$.labels"), "map<string,variant>")), lambda x: F.schema_of_variant(x) != "STRING")]),
        "L02": F.col("_v").isNotNull() & (~F.array_contains("_keys", "logName") | ~F.array_contains("_keys", "resource")),
        "L03": text("logName").isNotNull() & (~text("logName").rlike(LOG_NAME) | ~F.coalesce(F.try_url_decode(log_id).rlike(r"^[A-Za-z0-9/_.-]{1,511}$"), F.lit(False))),
        "L04": kind("severity").isNotNull() & ~F.coalesce(text("severity").isin(*SEVERITIES), F.lit(False)),
        "L05": kind("resource").isNotNull() & (~is_object("resource") | ~F.coalesce(resource_type.isin(*RESOURCES), F.lit(False)) | (F.size(F.array_except(keys("resource"), F.array(F.lit("type"), F.lit("labels")))) > 0) | wrong(F.size(F.array_except(keys("resource.labels"), F.try_element_at(permitted, resource_type))) > 0)),
        "L06": F.col("_v").isNotNull() & (payloads != 1),
        "L07": kind("protoPayload").startswith("OBJECT") & ~F.coalesce(F.get_json_object("_raw", "$.protoPayload['@type']").isin(*ANY_TYPES), F.lit(False)),
        "L08": any_of([kind(p).isNotNull() & ~wrong(integer(p)) for p in of("int64")]),
        "L09": any_of([kind(p).isNotNull() & ~wrong((kind(p) == "BIGINT") & whole(p).between(-(2**31), 2**31 - 1)) for p in of("int32")]),
        "L10": any_of([kind(p).isNotNull() & ~wrong(text(p).rlike(TIME) & F.try_to_timestamp(text(p)).isNotNull()) for p in of("time")]),
        "L11": any_of([kind(p).isNotNull() & ~wrong(text(p).rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]{1,9})?s$")) for p in of("duration")]),
        "L12": text("spanId").isNotNull() & (~text("spanId").rlike("^[0-9a-f]{16}$") | text("spanId").rlike("^0+$")),
        "L13": wrong(index < 0) | wrong(total < 1) | wrong(index >= total),
        "L14": wrong(text("sourceLocation.line").try_cast("long") < 0),
        "L15": F.exists(F.map_entries(labels), lambda e: (F.octet_length(e["key"]) > MOST_LABEL_KEY) | (F.octet_length(e["value"]) > MOST_LABEL_VALUE)),
        "L16": unpaired.rlike(f"{high}|{low}"),
        "L17": F.exists("_keys", lambda k: k.isin(*NEVER)),
        "L18": F.col("_v").isNotNull() & (F.coalesce(text("insertId"), F.lit("")) == ""),
    }
    marked = rows.select(*dict.fromkeys([*keep, *batch]), broken(rules).alias("_broken"), text("insertId").alias("_id"))
    marked = rounds(entries.sparkSession, "entries")(marked, "marked")  # judged once; the filter that explode implies would copy all rules down to the scan, and again into each other
    again = marked.filter("_id <> ''").groupBy(*batch, "_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = marked.join(again, [*batch, "_id"]).select(*keep, F.lit("L18").alias("rule"))
    return marked.select(*keep, F.explode("_broken").alias("rule")).unionByName(repeated).distinct()


# Static alert rules (name, signal, threshold, kind of entity, track); all compare with >=.
STATIC_RULES = [
    ("cpu_saturation", "node_cpu_utilisation_ratio", 0.90, "node", "unresponsiveness"),
    ("memory_pressure", "node_memory_utilisation_ratio", 0.90, "node", "unresponsiveness"),
    ("io_wait", "node_cpu_iowait_ratio", 0.20, "node", "unresponsiveness"),
    ("disk_latency", "node_disk_io_time_seconds", 0.02, "node", "unresponsiveness"),
    ("fd_exhaustion", "process_open_fds_ratio", 0.85, "app_server", "unresponsiveness"),
    ("thread_pool_saturation", "tomcat_threads_busy_ratio", 0.90, "app_server", "unresponsiveness"),
    ("http_error_rate", "apache_http_5xx_ratio", 0.05, "app_server", "unresponsiveness"),
    ("response_latency", "apache_request_duration_seconds_p95", 2.0, "app_server", "unresponsiveness"),
    ("db_session_pool", "db_sessions_active_ratio", 0.90, "database", "cross_domain"),
    ("db_lock_waits", "db_lock_wait_seconds", 5.0, "database", "cross_domain"),
    ("db_long_queries", "db_longest_query_seconds", 60.0, "database", "cross_domain"),
    ("switch_port_errors", "switch_port_errors_per_second", 1.0, "switch", "cross_domain"),
    ("packet_loss", "switch_packet_loss_ratio", 0.01, "switch", "cross_domain"),
    ("ospf_flaps", "switch_ospf_state_changes_per_minute", 1.0, "switch", "cross_domain"),
]

# Gates (id, metric, comparison, bound).
GATES = [
    ("AC-05.recall", "recall", ">=", 0.80),
    ("AC-06.fpr", "fpr", "<=", 0.10),
    ("AC-07.lead_time_median_s", "lead_time_median_s", ">=", 900.0),
    ("AC-08.recall_unresponsiveness", "recall_unresponsiveness", ">=", 0.80),
    ("AC-08.fpr_unresponsiveness", "fpr_unresponsiveness", "<=", 0.10),
    ("AC-08.lead_time_median_unresponsiveness_s", "lead_time_median_unresponsiveness_s", ">=", 900.0),
    ("AC-08.recall_cross_domain", "recall_cross_domain", ">=", 0.80),
    ("AC-08.fpr_cross_domain", "fpr_cross_domain", "<=", 0.10),
    ("AC-08.lead_time_median_cross_domain_s", "lead_time_median_cross_domain_s", ">=", 900.0),
    ("AC-09.domain_accuracy", "domain_accuracy", ">=", 0.70),
    ("AC-10.db_cascade_attribution_accuracy", "db_cascade_attribution_accuracy", ">", 0.50),
    ("AC-11.patching_alert_reduction", "patching_alert_reduction", ">=", 0.50),
    ("AC-12.suppression_recall_delta_pp", "suppression_recall_delta_pp", "<=", 5.0),
    ("AC-13.upstream_faults_with_multiple_incidents", "upstream_faults_with_multiple_incidents", "==", 0.0),
    ("AC-13.upstream_faults_alerted", "upstream_faults_alerted", ">=", 1.0),
    ("AC-15.novel_signature_flagged", "novel_signature_flagged", ">", 0.0),
    ("AC-15.novel_signature_absence_proofs", "novel_signature_absence_proofs", ">=", 1.0),
]


def judge_gates(metrics: DataFrame, gates=GATES) -> DataFrame:
    """gate, metric, value, passed from (metric, value); an undefined value does not pass."""
    table = metrics.sparkSession.createDataFrame(gates, "gate string, metric string, op string, bound double")
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == ">=", v >= b).when(F.col("op") == "<=", v <= b).when(F.col("op") == ">", v > b).otherwise(v == b)
    return table.join(metrics, "metric", "left").select("gate", "metric", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


# Families whose name does not say whether they are counters, and that say the wrong thing.
COUNTERS = ("node_vmstat_pgmajfault", "node_vmstat_pgpgin", "node_vmstat_pgpgout", "container_memory_failcnt", "ifHCInOctets", "ifHCOutOctets", "ifHCInUcastPkts", "ifHCOutUcastPkts", "ifInErrors", "ifOutErrors", "ifInDiscards", "ifOutDiscards", "ospfNbrEvents")
LEVELS = ("apache_duration_ms_total",)
DISTRIBUTIONS = ("jvm_gc_collection_seconds",)


def is_counter(metric: Column, counters=COUNTERS, levels=LEVELS, distributions=DISTRIBUTIONS) -> Column:
    """Does a metric accumulate, so that its rate and not its level counts?

    Known names decide; else ``_total``, ``_sum`` and ``_count`` are counters,
    and ``_bucket`` is one of a known distribution.
    """
    base = F.regexp_replace(metric, "_(?:sum|count|bucket)$", "")
    part = metric != base
    of_known = F.when(base.isin(*distributions, *counters), F.lit(True)).when(base.isin(*levels), F.lit(False)).otherwise(~metric.endswith("_bucket"))
    return F.when(metric.isin(*counters), F.lit(True)).when(metric.isin(*levels, *distributions), F.lit(False)).when(part, of_known).otherwise(metric.endswith("_total"))


# Labels that may name an entity, in order.
ENTITY_LABELS = ("entity_id", "entity", "instance_id", "instance", "node_name", "node", "host", "hostname", "server", "database_id", "device", "target", "pod_name", "container_name", "cluster_name")


def first_label(labels: Column, keys=ENTITY_LABELS) -> Column:
    """The first of the labels that is there and not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(labels, F.lit(k))), F.lit("")) for k in keys])
