"""Log-text queries; conversation turns and document lines stand in for log lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.embedding import DIM, WEIGHTS, slot_weights
from opsloom.functions.scalar import epoch_ms
from opsloom.operators import folds
from opsloom.operators import logs as lg
from opsloom.operators import rules
from opsloom.shared import shared_dir
from opsloom.sources import readers
from opsloom.tables import table


def _turns(s, d):
    sev = F.get(F.array(*[F.lit(x) for x in lg.SEVERITY_RANK]), ((F.col("conv_id") + F.col("turn") * 3) % len(lg.SEVERITY_RANK)).cast("int"))
    text = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("  at "), F.col("text"))).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", F.lit("svc").alias("service"), sev.alias("severity"), text.alias("text"))


def stacktrace_coalesce(s, d):
    out = lg.coalesce_entries(_turns(s, d), ["conv_id"], ["service"], ["turn"], "text", "severity")
    return out.select("conv_id", F.col("block").cast("long").alias("block"), "text", "severity", "n_lines")


def log_normalize(s, d):
    """Simple rules only, on page addresses and event properties."""
    raw = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" took "), F.col("value").cast("string"), F.lit("ms for "), F.col("props"))
    return table(s, d, "events").select("event_id", lg.normalize(raw).alias("message"))


def log_signature(s, d):
    return table(s, d, "pages").select("page_id", lg.signature("url").alias("signature"))


def ngram_features(s, d):
    """Pairs of words, and character 3-grams of every word."""
    w = F.split(F.lower("text"), " ")
    grams = F.concat(lg.shingles(w, 2), F.flatten(F.transform(w, lambda x: lg.char_ngrams(x, 3))))
    return table(s, d, "benchmark").select("item_id", F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def sliding_count_chunks(s, d):
    """Windows of five events moving by two, per user, by position alone."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").withColumns({"rn": F.row_number().over(w), "ids": F.collect_list("event_id").over(w.rowsBetween(0, 4))})
    full = rows.filter((F.col("rn") % 2 == 1) & (F.size("ids") == 5))
    return full.select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def flushed_count_chunks(s, d):
    """The same windows with the flush rules, over every severity and some stack traces."""
    e = table(s, d, "events")
    sev = F.get(F.array(*[F.lit(x) for x in lg.SEVERITY_RANK]), (F.floor(F.col("event_id") / 7) % len(lg.SEVERITY_RANK)).cast("int"))
    body = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("Traceback (most recent call last):\n  "), F.col("props"))).otherwise(F.repeat(F.col("props"), (F.col("event_id") % 60).cast("int")))
    line = lg.chunk_line(F.col("event_id").cast("string"), sev, F.col("event_type"), F.col("user_id").cast("string"), body)
    rows = e.select("user_id", (epoch_ms("ts") / 1000.0).alias("at"), "event_id", sev.alias("severity"), line.alias("text"))
    out = folds.count_chunks(rows, ["user_id"], "at", "event_id", "severity", "text", gap_s=86400 * 3.0, limit=1500)
    return out.select("user_id", "chunk_id", F.array_join("log_ids", ",").alias("ids"), "severity", "has_stack_trace", "chunk_text")


def hashed_embedding(s, d):
    """Slots and values of the unit vector of each distinct signature."""
    sig = table(s, d, "pages").select(lg.signature("url").alias("signature"))
    return slot_weights(sig, "signature").select("signature", "slot", F.round("value", 6).alias("value"))


def exposition_parse(s, d):
    """Metrics text rendered from events and parsed again."""
    e = table(s, d, "events").select("event_id", F.concat(F.col("event_type"), F.lit("_total")).alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")).alias("labels"), "value")
    text = lg.render_exposition(e, "name", "labels", "value").withColumn("text", F.concat(F.lit("# HELP x y\n"), F.col("text"), F.lit("\n")))
    p = lg.parse_exposition(text.select("event_id", "text"), "text", ["event_id"])
    return p.select("event_id", "name", F.element_at("labels", "user").cast("long").alias("user_id"), F.element_at("labels", "props").alias("props"), "value", "error")


def histogram_validate(s, d):
    le = F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_linenumber").cast("double"))
    b = table(s, d, "lineitem").groupBy("l_orderkey", le.alias("le")).agg(F.sum("l_quantity").alias("n"))
    return lg.histogram_faults(b, ["l_orderkey"], "le", "n").select("l_orderkey", "n_falls")


#: For each rule a document of metrics text that breaks it, behind three good lines.
FAULTY_LINES = {
    2: "bad-name 1\n", 3: 'm_x{1a="b"} 1\n', 4: "m_x{a=b} 1\n", 5: 'm_x{a="\\q"} 1\n', 6: "m_x one\n", 7: "m_x 1 1.5\n", 8: "# TYPE m_x meter\n", 9: "# HELP m_total again\n", 10: 'm_x{a="1",a="2"} 1\n',
    11: 'm_x{a="1",b="2"} 1\nm_x{b="2",a="1"} 2\n', 12: '# TYPE h histogram\nh_bucket{le="1"} 1\nh_sum 1\nh_count 1\n', 13: '# TYPE h histogram\nh_bucket{le="+Inf"} 2\nh_sum 1\nh_count 3\n',
    14: '# TYPE h histogram\nh_bucket{le="1"} 5\nh_bucket{le="2"} 3\nh_bucket{le="+Inf"} 5\nh_count 5\n', 15: 'm_x{le="1"} 1\n', 16: '# TYPE s summary\ns{quantile="2"} 1\n', 17: 'm_x{job="a"} 1\n',
    18: 'm_x{' + "k" * 101 + '="1"} 1\n', 19: "m_x 1 2 3\n",
}


def exposition_rules(s, d):
    """Every rule of the metrics text, by documents that break one each; the others are clean."""
    k = F.col("event_id") % 20
    good = F.concat(F.lit('# HELP m_total h\\n\n# TYPE m_total counter\nm_total{u="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("value").cast("string"), F.lit("\n"))
    extra = F.lit("")
    for n, text in FAULTY_LINES.items():
        extra = F.when(k == n, F.lit(text)).otherwise(extra)
    text = F.when(k == 1, F.rtrim(good)).otherwise(F.concat(good, extra))
    docs = table(s, d, "events").select("event_id", F.when(k == 1, F.regexp_replace(text, "\n$", "")).otherwise(text).alias("text"))
    return rules.exposition_rules(docs, "text", ["event_id"]).select("event_id", "rule", F.col("line").cast("long").alias("line"))


#: For each rule a change of a good log entry: fields that replace or follow its own.
FAULTY_FIELDS = {
    1: '"foo":1', 4: '"severity":"LOUD"', 6: '"jsonPayload":{"a":1}', 8: '"httpRequest":{"requestSize":5}', 9: '"httpRequest":{"status":"200"}', 10: '"timestamp":"yesterday"', 11: '"httpRequest":{"latency":"1.5"}', 12: '"spanId":"0000000000000000"',
    13: '"split":{"index":3,"totalSplits":3}', 14: '"sourceLocation":{"line":"-1"}', 15: '"labels":{"' + "k" * 513 + '":"v"}', 16: '"trace":"\\ud800"', 17: '"errorGroups":[]',
}


def log_validate(s, d):
    """Every rule of the log entry format, by entries that break one each; rule 18 by ids that repeat."""
    k = F.col("event_id") % 19
    name = F.when(k == 3, F.lit("projects/p/logs/a b")).otherwise(F.lit("projects/p/logs/app"))
    resource = F.when(k == 2, F.lit("")).otherwise(F.concat(F.lit('"resource":{"type":"'), F.when(k == 5, F.lit("nothing")).otherwise(F.lit("gce_instance")), F.lit('","labels":{"zone":"z"}},')))
    payload = F.when(k == 7, F.lit('"protoPayload":{"@type":"x"}')).otherwise(F.concat(F.lit('"textPayload":"'), F.col("event_type"), F.lit('"')))
    extra = F.lit("")
    for n, text in FAULTY_FIELDS.items():
        extra = F.when(k == n, F.lit("," + text)).otherwise(extra)
    ident = F.when(k == 18, F.lit("again")).otherwise(F.col("event_id").cast("string"))
    raw = F.concat(F.lit('{"logName":"'), name, F.lit('",'), resource, F.lit('"insertId":"'), ident, F.lit('",'), payload, extra, F.lit("}"))
    return rules.log_entry_rules(table(s, d, "events").select("event_id", raw.alias("raw")), "raw", ["event_id"])


METRICS = ["click", "error", "purchase", "signup", "view"]


def promql_matrix_pivot(s, d):
    """Answers of a range query, a document for each user, metric and day, written by day and read back as one row per user and hour."""
    at = F.floor(epoch_ms("ts") / 3600000) * 3600
    e = table(s, d, "events").groupBy("user_id", "event_type", at.alias("at")).agg(F.max("value").alias("v"))
    point = F.concat(F.lit("["), F.col("at").cast("string"), F.lit(',"'), F.col("v").cast("string"), F.lit('"]'))
    day = F.timestamp_seconds("at").cast("date").cast("string").alias("day")
    values = e.groupBy("user_id", "event_type", day).agg(F.array_join(F.collect_list(point), ",").alias("points"))  # 24 points at most
    metric = F.to_json(F.struct(F.col("event_type").alias("__name__"), F.col("user_id").cast("string").alias("instance")))
    doc = F.concat(F.lit('{"status":"success","data":{"resultType":"matrix","result":[{"metric":'), metric, F.lit(',"values":['), "points", F.lit("]}]}}"))
    path = f"{shared_dir(s)}/query-range-{uuid.uuid4().hex}"
    values.select("day", doc.alias("value")).repartition("day").write.partitionBy("day").text(path)
    wide = readers.pivot_metrics(readers.read_query_range(s, path), METRICS)
    return wide.select(F.col("host").cast("long").alias("user_id"), "at", *METRICS)


def envelope_decode(s, d):
    """Base64 JSON messages, decoded and typed."""
    body = F.base64(F.to_json(F.struct("event_id", "event_type", "value")).cast("binary"))
    e = table(s, d, "events").select(F.to_json(F.struct(F.struct(body.alias("data")).alias("message"))).alias("envelope"))
    data = F.unbase64(F.get_json_object("envelope", "$.message.data")).cast("string")
    return e.select(F.from_json(data, "event_id long, event_type string, value double").alias("x")).select("x.*")


def refractory_fire(s, d):
    e = table(s, d, "events").groupBy("user_id", "ts").agg((F.max("value") / 60.0).alias("score"))
    return folds.refractory_fire(e, ["user_id"], "ts", "score", 0.30, 2, 86400).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("score", 6).alias("score"))


def rate_limit(s, d):
    """Errors of a user as calls, every fifth of them arriving late; calls as old as the window to the second are among them."""
    e = table(s, d, "events").filter("event_type = 'error'").select("user_id", "event_id", (F.floor(epoch_ms("ts") / 43_200_000) * 43200.0).alias("at"))
    late = e.withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 1500).otherwise(0))
    return folds.rate_limit(late, ["user_id"], "at", 43200, 3, 86400 * 3, ["arrival", "event_id"]).select("user_id", "event_id", "decision")


def static_threshold_alerts(s, d):
    """All static rules: each event is a sample of one rule's signal; an hour's mean over the threshold for an hour alerts, and again every six."""
    table_of = s.createDataFrame([(i, n, t) for i, (n, _, t, *_) in enumerate(rules.STATIC_RULES)], "k long, rule string, threshold double")
    sample = table(s, d, "events").withColumn("k", F.col("event_id") % len(rules.STATIC_RULES)).join(F.broadcast(table_of), "k")  # a row a rule
    signal = sample.groupBy("rule", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg((F.avg("value") / 20).alias("excess"))
    over = signal.select("rule", "ts", "excess")  # in units of the rule's threshold
    return folds.dwell_alerts(over, ["rule"], "ts", "excess", 1.0, 3600, 6 * 3600).select("rule", "ts", F.round("excess", 6).alias("excess"))


NAMES = [stacktrace_coalesce, log_normalize, log_signature, ngram_features, sliding_count_chunks, flushed_count_chunks, hashed_embedding, exposition_parse, exposition_rules, histogram_validate, log_validate, promql_matrix_pivot, envelope_decode, refractory_fire, rate_limit, static_threshold_alerts]
QUERIES = {f.__name__: f for f in NAMES}
SEVERITIES_SQL = ", ".join(f"({i}, '{n}', {r})" for i, (n, r) in enumerate(lg.SEVERITY_RANK.items()))
ORACLE = {
    "stacktrace_coalesce": f"""WITH k(i, severity, r) AS (VALUES {SEVERITIES_SQL}),
t AS (SELECT conv_id, turn, k.severity, k.r, CASE WHEN turn % 2 = 1 THEN '  at ' || text ELSE text END AS text FROM conversations JOIN k ON k.i = (conv_id + turn * 3) % 10),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND regexp_matches(string_split(text, chr(10))[1], '{lg.CONTINUATION}') AND NOT regexp_matches(string_split(text, chr(10))[1], '{lg.NEW_LINE}') THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM c),
m AS (SELECT *, max(r) OVER (PARTITION BY conv_id, block) AS top FROM b)
SELECT conv_id, block, string_agg(text, chr(10) ORDER BY turn) AS text, max(severity) FILTER (r = top) AS severity, count(*) AS n_lines FROM m GROUP BY conv_id, block""",
    "log_normalize": """SELECT event_id, 'user <NUM> ' || event_type || ' took <DURATION> for {"k": <NUM>}' AS message FROM events""",
    "ngram_features": """WITH b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), c AS (SELECT unnest(w) AS x FROM b),
g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b) UNION ALL SELECT ('#' || x || '#')[i:i + 2] FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM c)) SELECT gram, count(*) AS n FROM g GROUP BY gram""",
    "sliding_count_chunks": """WITH r AS (SELECT user_id, row_number() OVER w AS rn, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ids FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, array_to_string(ids, ',') AS ids FROM r WHERE rn % 2 = 1 AND len(ids) = 5""",
    "exposition_parse": "SELECT event_id, event_type || '_total' AS name, user_id, props, value, false AS error FROM events",
    "histogram_validate": """WITH b AS (SELECT l_orderkey, l_linenumber AS le, sum(l_quantity) AS n FROM lineitem GROUP BY ALL), f AS (SELECT *, CASE WHEN n < lag(n) OVER (PARTITION BY l_orderkey ORDER BY le) THEN 1 ELSE 0 END AS f FROM b)
SELECT l_orderkey, sum(f)::BIGINT AS n_falls FROM f GROUP BY l_orderkey HAVING sum(f) > 0 OR NOT bool_or(le = 7)""",
    "exposition_rules": """SELECT event_id, 'P' || lpad((event_id % 20)::VARCHAR, 2, '0') AS rule, CASE WHEN event_id % 20 IN (1, 12, 13, 14) THEN NULL WHEN event_id % 20 IN (11, 16) THEN 5 ELSE 4 END::BIGINT AS line FROM events WHERE event_id % 20 > 0""",
    "log_validate": "SELECT event_id, 'L' || lpad((event_id % 19)::VARCHAR, 2, '0') AS rule FROM events WHERE event_id % 19 > 0",
    "log_signature": r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(url, '\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s"''<>]+', '<url>', 'g'), '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g'), '(<[a-z]+>|[A-Za-z0-9_]+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\d+$') THEN '<num>' ELSE lower(t) END), ' ') AS signature FROM pages""",
    "hashed_embedding": f"""WITH s AS (SELECT DISTINCT '<url>' AS signature, ['<url>'] AS t FROM pages),
f AS (SELECT signature, 'token:' || unnest(t) AS f FROM s UNION ALL SELECT signature, 'char:' || ('#' || t[1] || '#')[i:i + n - 1] FROM (SELECT s.*, n, unnest(range(1, len(t[1]) + 4 - n)) AS i FROM s, (VALUES (3), (4), (5)) v(n)) UNION ALL SELECT signature, unnest(['shape:len1', 'shape:marks1']) FROM s),
c AS (SELECT signature, f, 1 + ln(count(*)) AS v, md5(f) AS h FROM f GROUP BY ALL),
x AS (SELECT signature, split_part(f, ':', 1) AS family, (('0x' || substr(h, 1, 8))::BIGINT % {DIM})::INT AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT >= 8 THEN v ELSE -v END) AS v FROM c GROUP BY ALL),
n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY signature, family)) AS n FROM x),
m AS (SELECT signature, slot, sum(CASE family WHEN 'token' THEN {WEIGHTS["token"]}::DOUBLE WHEN 'char' THEN {WEIGHTS["char"]}::DOUBLE ELSE {WEIGHTS["shape"]}::DOUBLE END * v / n) AS v FROM n WHERE n > 0 GROUP BY ALL)
SELECT signature, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY signature)), 6) AS value FROM m""",
    "flushed_count_chunks": f"""WITH RECURSIVE k(i, severity, r) AS (VALUES {SEVERITIES_SQL}),
e AS (SELECT user_id, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t0, event_id AS id, severity AS sev, r, event_id % 13 = 0 AS trace,
  '[' || event_id || '] [' || severity || '] [' || event_type || '@' || user_id || '] ' || CASE WHEN event_id % 13 = 0 THEN 'Traceback (most recent call last):' || chr(10) || '  ' || props ELSE repeat(props, event_id % 60) END AS line,
  row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) / 1000.0::DOUBLE, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events JOIN k ON k.i = event_id // 7 % 10),
r(user_id, rn, n, w, o1, o2) AS (
  SELECT DISTINCT user_id, 0::BIGINT, n, []::STRUCT(t0 DOUBLE, id BIGINT)[], []::STRUCT(t0 DOUBLE, id BIGINT)[], []::STRUCT(t0 DOUBLE, id BIGINT)[] FROM e
  UNION ALL SELECT user_id, rn, n, CASE WHEN len(x) >= 5 THEN x[3:] WHEN flush THEN (CASE WHEN len(x) > 2 THEN x[3:] ELSE [] END) ELSE x END, o1, CASE WHEN len(x) >= 5 THEN x[1:5] WHEN flush THEN x ELSE [] END FROM (
    SELECT *, CASE WHEN gap THEN w ELSE [] END AS o1, list_append(CASE WHEN gap THEN [] ELSE w END, {{'t0': t0, 'id': id}}) AS x FROM (
      SELECT e.user_id, e.rn, e.n, e.t0, e.id, e.trace OR e.sev IN ('ERROR', 'CRITICAL', 'FATAL') AS flush, r.w, len(r.w) > 0 AND e.t0 - r.w[1].t0 > 259200 AS gap FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))),
c AS (SELECT row_number() OVER () AS c, * FROM (SELECT user_id, o1 AS w FROM r UNION ALL SELECT user_id, o2 FROM r UNION ALL SELECT user_id, w FROM r WHERE rn = n) WHERE len(w) > 0),
l AS (SELECT c.c, any_value(c.user_id) AS user_id, any_value(w[1]) AS first, string_agg(e.id::VARCHAR, ',' ORDER BY e.rn) AS ids, arg_max(e.sev, e.r * 1000000 - e.rn) AS severity, bool_or(e.trace) AS trace, string_agg(e.line, chr(10) ORDER BY e.rn) AS body
  FROM (SELECT c, user_id, w, unnest(w).id AS id FROM c) c JOIN e ON e.id = c.id GROUP BY c.c)
SELECT user_id, sha256(user_id || '|' || first.t0 || '|' || first.id)[1:32] AS chunk_id, ids, severity, trace AS has_stack_trace,
  CASE WHEN length(body) > 1500 THEN body[1:727] || chr(10) || '... [CHUNK TRUNCATED FOR TOKEN LIMIT] ...' || chr(10) || body[-727:] ELSE body END AS chunk_text FROM l""",
    "refractory_fire": """WITH RECURSIVE e AS (SELECT user_id, ts, max(value) / 60.0::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events GROUP BY user_id, ts),
r(user_id, rn, ts, score, run, t0, last, fire) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::TIMESTAMP, NULL::DOUBLE, 0, NULL::TIMESTAMP, 0.0::DOUBLE, false FROM e
  UNION ALL SELECT user_id, rn, ts, score, run, CASE WHEN fire THEN ts ELSE t0 END, CASE WHEN fire THEN score ELSE last END, fire FROM (
    SELECT *, run >= 2 AND (t0 IS NULL OR epoch_us(ts) - epoch_us(t0) >= 86400000000 OR score >= last + 0.2::DOUBLE) AS fire FROM (
      SELECT e.user_id, e.rn, e.ts, e.score, CASE WHEN e.score >= 0.3 THEN r.run + 1 ELSE 0 END AS run, r.t0, r.last FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, ts, round(score, 6) AS score FROM r WHERE fire""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 43200000000 * 43200.0::DOUBLE AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id + CASE WHEN event_id % 5 = 0 THEN 1500 ELSE 0 END, event_id) AS rn FROM events WHERE event_type = 'error'),
r(user_id, rn, event_id, hot, decision) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], NULL::VARCHAR FROM e
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN decision = 'TRIGGERED' THEN list_append(hot, t0) ELSE hot END, decision FROM (
    SELECT *, CASE WHEN len(list_filter(hot, lambda t: abs(t0 - t) < 43200)) > 0 THEN 'SUPPRESSED_RATE_LIMIT' WHEN len(list_filter(hot, lambda t: abs(t0 - t) < 259200)) >= 3 THEN 'RATE_LIMITED_HOURLY_CAP' ELSE 'TRIGGERED' END AS decision FROM (
      SELECT e.user_id, e.rn, e.event_id, e.t0, list_filter(r.hot, lambda t: t > greatest(e.t0, coalesce(list_max(r.hot), e.t0)) - 259200) AS hot FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, event_id, decision FROM r WHERE rn > 0""",
    "promql_matrix_pivot": f"""SELECT user_id, epoch_us(ts) // 3600000000 * 3600 AS at, {", ".join(f"coalesce(max(value) FILTER (WHERE event_type = '{m}'), 0.0) AS {m}" for m in METRICS)} FROM events GROUP BY ALL""",
    "envelope_decode": "SELECT event_id, event_type, value FROM events",
    "static_threshold_alerts": f"""WITH RECURSIVE v(k, rule) AS (VALUES {", ".join(f"({i}, '{r[0]}')" for i, r in enumerate(rules.STATIC_RULES))}),
a AS (SELECT rule, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) / 20 AS v FROM events JOIN v ON v.k = event_id % {len(rules.STATIC_RULES)} GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts) AS rn FROM a),
r(rule, rn, ts, v, since, fired, fire) AS (
  SELECT rule, 0::BIGINT, NULL::TIMESTAMP, NULL::DOUBLE, NULL::TIMESTAMP, NULL::TIMESTAMP, false FROM (SELECT DISTINCT rule FROM h)
  UNION ALL SELECT rule, rn, ts, v, since, CASE WHEN fire THEN ts ELSE fired END, fire FROM (
    SELECT *, coalesce(v >= 1 AND ts - since >= INTERVAL 1 HOUR AND (fired IS NULL OR ts - fired >= INTERVAL 6 HOUR), false) AS fire FROM (
      SELECT h.rule, h.rn, h.ts, h.v, CASE WHEN h.v >= 1 THEN coalesce(r.since, h.ts) END AS since, CASE WHEN h.v >= 1 THEN r.fired END AS fired FROM r JOIN h ON h.rule = r.rule AND h.rn = r.rn + 1)))
SELECT rule, ts, round(v, 6) AS excess FROM r WHERE fire""",
}
