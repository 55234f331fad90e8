"""The query catalogue: every operator on the test tables, with the SQL that must give the same rows.

Logs are rendered from ``events`` and go through the real splitter, parsers and segmenters;
the SQL computes the expected values from the columns of ``events`` and never parses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.functions import clock, privacy, text, vectors
from sparklog.operators import analytics, retrieval
from sparklog.operators.bronze import FILE_KEY, archive, entries_of, ingest_to_bronze
from sparklog.operators.embed import HashingEmbedder, embed_segments, embed_texts
from sparklog.operators.gold import segment_exceptions, transform_to_gold
from sparklog.operators.parsers import get_parser
from sparklog.operators.parsers.windows_service import may_hold_exception
from sparklog.operators.silver import parse_entries, transform_to_silver
from sparklog.plans import rag
from sparklog.session import new_dir, pin_utc, spread
from sparklog.sources import synth
from sparklog.sources.config import SourceConfig
from sparklog.sources.tables import Store, first_of, latest_by

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WINDOWS = SourceConfig("events", "windows_service")
APACHE = SourceConfig("web", "apache_access")
TEST_KEY = b"published test key"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(pin_utc(spark), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(name: str) -> F.Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.windows_from_events(spread(table(spark, sf_dir, "events")))


def parsed(spark: SparkSession, sf_dir: str, policy: privacy.Policy | None = None) -> DataFrame:
    return parse_entries(windows(spark, sf_dir), WINDOWS, policy)


def apache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_entries(synth.apache_from_events(spread(table(spark, sf_dir, "events"))), APACHE)


def failures(entries: DataFrame) -> DataFrame:
    """Parsed entries with an exception; the others are left out by a cheap test first."""
    return parse_entries(entries.filter(may_hold_exception(F.col("raw_entry"))), WINDOWS).filter("is_exception")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = failures(windows(spark, sf_dir)).select("event_id", "user_id", "exception_text", "event_time_utc", "severity", "logger")
    return segment_exceptions(rows, "windows_service")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log text per user, entries in time order."""
    rows = windows(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "raw_entry"))).alias("e"))
    return rows.select("user_id", F.concat(F.array_join(F.transform("e", lambda x: x["raw_entry"]), "\n"), F.lit("\n")).alias("text"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


_K = "CAST(props->>'$.k' AS BIGINT)"
_FAM = ", ".join(f"({i}, {n}, '{kind}: {said}')" for i, (a, b, c, d) in enumerate(synth.FAMILIES) for n, kind, said in [(0, a, b), (1, c, d)] if kind)
_SIGNED = f"""e AS (SELECT *, date_trunc('second', ts) AS t, {_K} % 4 AS f FROM events WHERE event_type = 'error'),
fam(f, idx, sig) AS (VALUES {_FAM}), s AS (SELECT * FROM e JOIN fam USING (f))"""
_LEVEL = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'Debug' ELSE 'Information' END"
_SEVERITY = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
_STATUS = f"CASE {_K} % 8 WHEN 3 THEN 301 WHEN 4 THEN 404 WHEN 5 THEN 500 WHEN 6 THEN 502 WHEN 7 THEN 503 ELSE 200 END"


@query(f"WITH {_SIGNED} SELECT sig AS segment_text, count(*) AS occurrences, min(t) AS first_seen_utc, max(t) AS last_seen_utc FROM s GROUP BY sig")
def signature_frequency(spark, d):
    """Flagship: packed log texts, split, parsed, segmented, counted per signature."""
    entries = entries_of(packed(spark, d), get_parser("windows_service").header_pattern)
    found = failures(entries).select("event_time_utc", "exception_text")
    rows = segment_exceptions(found, "windows_service")
    return rows.groupBy("segment_text").agg(F.count("*").alias("occurrences"), F.min("event_time_utc").cast("timestamp_ntz").alias("first_seen_utc"), F.max("event_time_utc").cast("timestamp_ntz").alias("last_seen_utc"))


@query("SELECT user_id, count(*) AS entries, count(*) FILTER (event_type = 'error') AS with_block FROM events GROUP BY user_id")
def split_entries(spark, d):
    rows = entries_of(packed(spark, d), get_parser("windows_service").header_pattern)
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.count(F.when(F.col("raw_entry").contains("Exception Type"), 1)).alias("with_block"))


@query("SELECT doc_id, sha256(text) AS entry_hash FROM documents")
def entry_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("entry_hash"))


_LINES = "l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents)"


def doc_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("position", "raw_entry")).withColumn("entry_hash", F.sha2("raw_entry", 256))


@query(f"WITH {_LINES} SELECT source, count(*) AS offered, count(DISTINCT line) AS landed FROM l GROUP BY source")
def bronze_dedup(spark, d):
    rows = doc_lines(spark, d)
    landed = first_of(rows.select("source", "entry_hash", "doc_id", "position"), ["source", "entry_hash"], ["doc_id", "position"]).groupBy("source").agg(F.count("*").alias("landed"))
    return rows.groupBy("source").agg(F.count("*").alias("offered")).join(landed, "source")


@query(f"WITH {_LINES} SELECT lang, count(DISTINCT line) AS stored FROM l GROUP BY lang")
def silver_dedup(spark, d):
    return doc_lines(spark, d).select("lang", "entry_hash").distinct().groupBy("lang").agg(F.count("*").alias("stored"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_of_key(spark, d):
    """What stays of rows that share a unique key."""
    return first_of(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_antijoin(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def undigested_semijoin(spark, d):
    waiting = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(waiting, "c_custkey", "left_semi")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey")
def control_latest_version(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("version"))
    return latest_by(rows, ["o_custkey"], "version").select("o_custkey", "o_orderkey")


@query(f"SELECT event_id, date_trunc('second', ts) AS event_time_utc, {_SEVERITY} AS severity, {_LEVEL} AS severity_raw, 'Acme.Shop.Unit' || (user_id % 7) || '.Worker' AS logger, 'handled ' || event_type AS message, event_type = 'error' AS is_exception FROM events")
def parse_windows_core(spark, d):
    return parsed(spark, d).select("event_id", ntz("event_time_utc"), "severity", "severity_raw", "logger", "message", "is_exception")


@query(f"SELECT event_id, 'user_' || user_id AS user_field, printf('%.2f', value) AS amount, CAST({_K} AS VARCHAR) AS key_field, CASE WHEN event_type = 'error' THEN 'Failed' END AS status FROM events")
def parse_windows_extra(spark, d):
    get = lambda k, a: F.get_json_object("extra_fields", f"$.{k}").alias(a)
    return parsed(spark, d).select("event_id", get("User", "user_field"), get("Amount", "amount"), get("Key", "key_field"), get("Status", "status"))


_BLOCKS = " ".join(f"WHEN {i} THEN 'Exception Type : {a}' || chr(10) || '   Message    : {b}' || chr(10) || '   Stack Trace :' || chr(10) || '{a}: {b}{f' ---> {c}: {e}' if c else ''}' || chr(10) || '   at Acme.Shop.Worker.Run() in Worker.cs:line 42'" for i, (a, b, c, e) in enumerate(synth.FAMILIES))


@query(f"SELECT event_id, CASE {_K} % 4 {_BLOCKS} END AS exception_text FROM events WHERE event_type = 'error'")
def parse_windows_exception(spark, d):
    return failures(windows(spark, d)).select("event_id", "exception_text")


@query(f"SELECT event_id, date_trunc('second', ts) - INTERVAL 10 HOUR AS event_time_utc, date_trunc('second', ts) AS event_time_local, CASE WHEN {_STATUS} >= 500 THEN 'ERROR' WHEN {_STATUS} >= 400 THEN 'WARN' ELSE 'INFO' END AS severity, CAST({_STATUS} AS VARCHAR) AS severity_raw, 'GET /api/' || event_type || ' -> ' || {_STATUS} AS message, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip, CASE WHEN {_K} % 3 <> 0 THEN CAST({_K} AS VARCHAR) END AS bytes FROM events")
def parse_apache_core(spark, d):
    get = lambda k: F.get_json_object("extra_fields", f"$.{k}").alias(k)
    return apache(spark, d).select("event_id", ntz("event_time_utc"), "event_time_local", "severity", "severity_raw", "message", get("client_ip"), get("bytes"))


@query(r"SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 500) AS message, 'UNKNOWN' AS severity, regexp_replace(text, '^\s+|\s+$', '', 'g') AS unparsed FROM documents")
def parse_apache_unparsed(spark, d):
    rows = parse_entries(table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_entry")), APACHE)
    return rows.select("doc_id", "message", "severity", F.get_json_object("extra_fields", "$.unparsed").alias("unparsed"))


@query("SELECT event_id, timezone('UTC', timezone('Australia/Sydney', ts)) AS utc FROM events")
def to_utc_iana(spark, d):
    return table(spark, d, "events").select("event_id", clock.local_to_utc(F.col("ts"), "Australia/Sydney").cast("timestamp_ntz").alias("utc"))


@query(f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_distribution(spark, d):
    return parsed(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {_STATUS} >= 500 THEN 'ERROR' WHEN {_STATUS} >= 400 THEN 'WARN' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY 1")
def status_severity(spark, d):
    return apache(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {_SIGNED} SELECT event_id, CAST(idx AS INTEGER) AS segment_index, CASE idx WHEN 0 THEN 'signature' ELSE 'inner_signature' END AS segment_type, sig AS segment_text FROM s")
def segment_windows(spark, d):
    return segments(spark, d).select("event_id", "segment_index", "segment_type", "segment_text")


@query(f"SELECT event_id, CAST(0 AS INTEGER) AS segment_index, 'HTTP ' || {_STATUS} || ' GET /api/' || event_type AS segment_text FROM events WHERE {_STATUS} >= 500")
def segment_apache(spark, d):
    rows = apache(spark, d).filter("is_exception").select("event_id", "exception_text")
    return segment_exceptions(rows, "apache_access").select("event_id", "segment_index", "segment_text")


@query("SELECT event_id, '[REDACTED]' AS user_field, printf('%.2f', value) AS amount FROM events")
def pii_redact(spark, d):
    rows = parsed(spark, d, privacy.Policy({"User": "redact"}))
    return rows.select("event_id", F.get_json_object("extra_fields", "$.User").alias("user_field"), F.get_json_object("extra_fields", "$.Amount").alias("amount"))


def _hmac_sql(value: str) -> str:
    pad = lambda x: "".join(f"{b ^ x:02x}" for b in TEST_KEY.ljust(64, b"\0"))
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({value}))))"


@query(f"SELECT event_id, {_hmac_sql('CAST(user_id AS VARCHAR)')} AS fingerprint FROM events")
def pii_hmac(spark, d):
    return table(spark, d, "events").select("event_id", privacy.hmac_udf(TEST_KEY)(F.col("user_id").cast("string")).alias("fingerprint"))


@query(f"SELECT {_hmac_sql('CAST(user_id AS VARCHAR)')} AS fingerprint, count(*) AS n FROM events GROUP BY 1")
def pii_group_by_fingerprint(spark, d):
    """Grouping by fingerprint needs no key; here from built-in functions with a published key."""
    return table(spark, d, "events").groupBy(privacy.hmac_expression(F.col("user_id").cast("string"), TEST_KEY).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (json_exists(props, '$.k')) AS with_key, count(*) FILTER (json_exists(props, '$.User')) AS with_user FROM events GROUP BY 1")
def json_key_exists(spark, d):
    has = lambda k: F.count(F.when(F.array_contains(F.json_object_keys("props"), k), 1))
    return table(spark, d, "events").groupBy("event_type").agg(has("k").alias("with_key"), has("User").alias("with_user"))


@query(f"SELECT event_id, {_K} AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", synth.props_key().alias("k"))


_NEAR = "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round({_NEAR}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_NEAR}, e.vec_id LIMIT 10")
def retrieve_occurrences(spark, d):
    found = retrieval.rank_occurrences(table(spark, d, "embeddings").select("vec_id", "embedding"), query_vector(spark, d), 10, ["vec_id"])
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.label, round(min({_NEAR}), 6) AS distance, count(*) AS occurrences FROM embeddings e, embeddings q WHERE q.vec_id = 0 GROUP BY e.label ORDER BY min({_NEAR}), e.label LIMIT 5")
def retrieve_distinct(spark, d):
    rows = table(spark, d, "embeddings").withColumn("at", F.lit(None).cast("timestamp"))
    return retrieval.rank_distinct(rows, query_vector(spark, d), 5, "label", "at").select("label", F.round("distance", 6).alias("distance"), "occurrences")


@query(f"SELECT e.vec_id, v.event_type, round({_NEAR}, 6) AS distance FROM embeddings e JOIN events v ON v.event_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND v.event_type = 'error' AND v.ts >= TIMESTAMP '2024-01-01 06:00:00' AND v.ts <= TIMESTAMP '2024-01-25' ORDER BY {_NEAR}, e.vec_id LIMIT 10")
def retrieve_filtered(spark, d):
    about = table(spark, d, "events").select("event_id", F.col("event_type").alias("severity"), F.col("ts").cast("timestamp").alias("ts"))
    about = retrieval.filtered(about, severity="error", from_utc="2024-01-01T06:00:00", to_utc="2024-01-25T00:00:00+00:00", time="ts")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").join(about, F.col("vec_id") == F.col("event_id"))
    return retrieval.rank_occurrences(rows, query_vector(spark, d), 10, ["vec_id"]).select("vec_id", F.col("severity").alias("event_type"), F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, row_id, CAST(r AS INTEGER) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id AS row_id, {_NEAR} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 3")
def batch_retrieve(spark, d):
    """Every row whose id is divisible by 100 asks all rows."""
    rows = table(spark, d, "embeddings")
    return retrieval.batch_retrieve(rows.filter("vec_id % 100 = 0"), rows, 3, "vec_id", "vec_id").select("query_id", "row_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {_SIGNED} SELECT DISTINCT sig AS segment_text, CAST(1 AS DOUBLE) AS length, CAST(384 AS BIGINT) AS dim FROM s")
def embed_normalized(spark, d):
    """Distinct signature texts embedded: unit vectors of the pinned dimension."""
    rows = embed_texts(segments(spark, d).select("segment_text").distinct(), HashingEmbedder())
    return rows.select("segment_text", F.round(vectors.norm(F.col("embedding")), 4).alias("length"), F.size("embedding").cast("long").alias("dim"))


@query()
def ann_lsh_topk(spark, d):
    return retrieval.approximate(table(spark, d, "embeddings"), query_vector(spark, d), 10, "vec_id")


@query()
def cluster_signatures(spark, d):
    return analytics.cluster(table(spark, d, "embeddings"), 10, "vec_id")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def bucket_counts(spark, d):
    return analytics.bucket_counts(table(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query("WITH a AS (SELECT ts, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY ts), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM a), r AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS run FROM b) SELECT 'error' AS event_type, min(ts) AS burst_start, max(ts) AS burst_end, CAST(sum(c) AS BIGINT) AS n FROM r GROUP BY run HAVING sum(c) >= 3")
def incident_bursts(spark, d):
    return analytics.bursts(table(spark, d, "events").filter("event_type = 'error'"), "ts", 600, 3, ["event_type"])


@query("WITH k AS (SELECT DISTINCT date_trunc('hour', ts) AS b, event_type AS t FROM events) SELECT x.t AS first_kind, y.t AS second_kind, count(*) AS buckets FROM k x JOIN k y ON x.b = y.b AND x.t < y.t GROUP BY 1, 2")
def cooccurrence(spark, d):
    return analytics.cooccurrence(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.ts BETWEEN e.ts - INTERVAL 5 MINUTE AND e.ts + INTERVAL 5 MINUTE WHERE e.event_type = 'error' AND p.event_type = 'purchase'")
def temporal_correlation(spark, d):
    events = table(spark, d, "events")
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    bought = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return analytics.correlate(errors, bought, "error_ts", "purchase_ts", 300).select("error_id", "purchase_id")


@query("SELECT event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def first_last_seen(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND event_type = 'error'")
def time_window_filter(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_time_utc"), F.col("event_type").alias("log_type"))
    return retrieval.filtered(rows, from_utc="2024-01-10", to_utc="2024-01-20", log_type="error").agg(F.count("*").alias("n"))


@query("SELECT 'docs' AS source_id, count(*) AS entries, count(*) AS failed, CAST(1 AS DOUBLE) AS failure_rate FROM documents UNION ALL SELECT 'web', count(*), 0, 0 FROM events")
def dq_parse_failure_rate(spark, d):
    web = synth.apache_from_events(table(spark, d, "events")).select(F.lit("web").alias("source_id"), "raw_entry")
    docs = table(spark, d, "documents").select(F.lit("docs").alias("source_id"), F.col("text").alias("raw_entry"))
    return analytics.parse_failures(parse_entries(web.unionByName(docs), APACHE))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def dq_silent_sources(spark, d):
    return analytics.silent_sources(table(spark, d, "events"), "user_id", "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 24)


@query("SELECT d.lang, count(*) AS rows, count(l.doc_id) AS covered, count(l.doc_id) / count(*) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def dq_embedding_coverage(spark, d):
    return analytics.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "lang")


@query("SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') / count(*) AS success_rate FROM orders")
def dq_success_rate(spark, d):
    return analytics.success(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status")))


@query("WITH l AS (SELECT CAST(event_id % 1800 AS DOUBLE) AS lag FROM events), o AS (SELECT lag, row_number() OVER (ORDER BY lag) AS r, count(*) OVER () AS n FROM l) SELECT (SELECT count(*) FILTER (lag <= 900) / count(*) FROM l) AS share_in_time, min(lag) FILTER (r >= 0.95 * n) AS p95_seconds FROM o")
def dq_freshness(spark, d):
    rows = table(spark, d, "events").select("ts", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") % 1800)).alias("ingested"))
    return analytics.freshness(rows, "ts", "ingested", 900)


_ENTRIES = "r AS (SELECT DISTINCT t, event_type, user_id, printf('%.2f', value) AS amount, k FROM (SELECT *, date_trunc('second', ts) AS t, " + _K + " AS k FROM events))"
_RUN = {
    "bronze landed": "SELECT count(*) FROM r",
    "bronze repeats": "SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM r)",
    "bronze files": "SELECT count(DISTINCT CAST(t AS DATE)) FROM r",
    "again unchanged": "SELECT count(DISTINCT CAST(t AS DATE)) FROM r",
    "again landed": "SELECT 0",
    "silver written": "SELECT count(*) FROM r",
    "silver again": "SELECT 0",
    "silver exceptions": "SELECT count(*) FROM r WHERE event_type = 'error'",
    "gold exceptions": "SELECT count(*) FROM r WHERE event_type = 'error'",
    "gold segments": "SELECT count(*) FROM r JOIN fam ON fam.f = r.k % 4 WHERE event_type = 'error'",
    "gold again": "SELECT 0",
    "embedded": "SELECT count(*) FROM r JOIN fam ON fam.f = r.k % 4 WHERE event_type = 'error'",
    "files completed": "SELECT count(DISTINCT CAST(t AS DATE)) FROM r",
    "archived": "SELECT count(*) FROM r",
    "left in landing": "SELECT 0",
    "runs completed": "SELECT 2",
}


@query(f"WITH fam(f, idx, sig) AS (VALUES {_FAM}), {_ENTRIES} " + " UNION ALL ".join(f"SELECT '{what}' AS measure, CAST(({sql}) AS BIGINT) AS n" for what, sql in _RUN.items()))
def layers_run(spark, d):
    """The layers over log files (one a day), twice: what each step counted, and what the tables hold."""
    root = new_dir(spark, "layers")
    by_day = windows(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "raw_entry"))).alias("e"))
    files = by_day.select(F.concat(F.lit("log-"), F.date_format("day", "MM-dd-yyyy"), F.lit(".log")).alias("file_name"), F.concat(F.array_join(F.transform("e", lambda x: x["raw_entry"]), "\n"), F.lit("\n")).alias("text"))
    synth.write_files(files, f"{root}/logs")
    store, config = Store(spark, f"{root}/tables"), SourceConfig("events", "windows_service", location=f"{root}/logs")
    first, silver, gold, vectors_made = ingest_to_bronze(store, config), transform_to_silver(store, config), transform_to_gold(store, config), embed_segments(store, config)
    again, silver_again, gold_again = ingest_to_bronze(store, config), transform_to_silver(store, config), transform_to_gold(store, config)
    known = {
        "bronze landed": first.entries_landed, "bronze repeats": first.entries_skipped_duplicate, "bronze files": first.files_processed,
        "again unchanged": again.files_skipped_unchanged, "again landed": again.entries_landed, "silver written": silver.entries_written,
        "silver again": silver_again.entries_read, "gold exceptions": gold.exceptions_processed, "gold segments": gold.segments_written,
        "gold again": gold_again.exceptions_processed, "embedded": vectors_made.segments_embedded, "archived": archive(store, "events"),
    }
    counted = {
        "silver exceptions": store.read("silver_log_entries", "events").filter("is_exception"), "left in landing": store.read("bronze_landing", "events"),
        "files completed": store.latest("bronze_processed_logs", FILE_KEY).filter("status = 'completed'"),
        "runs completed": store.latest("bronze_runs", ["id"]).filter("status = 'completed'"),
    }
    out = spark.createDataFrame(sorted(known.items()), "measure string, n long")
    for what, rows in counted.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("measure"), "n"))
    return out


@query(f"WITH {_SIGNED} SELECT sig AS segment_text, count(*) AS occurrences FROM s GROUP BY sig ORDER BY 2 DESC, 1 LIMIT 3")
def topk_signatures(spark, d):
    return segments(spark, d).groupBy("segment_text").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "segment_text").limit(3)


@query(f"WITH {_SIGNED} SELECT 'unit' || (user_id % 7) AS source_id, CASE idx WHEN 0 THEN 'signature' ELSE 'inner_signature' END AS segment_type, count(*) AS n FROM s GROUP BY 1, 2")
def segments_by_source_type(spark, d):
    rows = segments(spark, d).withColumn("source_id", F.concat(F.lit("unit"), (F.col("user_id") % 7).cast("string")))
    return rows.groupBy("source_id", "segment_type").agg(F.count("*").alias("n"))


@query(f"WITH {_SIGNED}, g AS (SELECT sig, count(*) AS n, min(t) AS a, max(t) AS b FROM s GROUP BY sig), r AS (SELECT *, row_number() OVER (ORDER BY sig) AS i FROM g) SELECT CAST(i AS INTEGER) AS rank, i || '. ' || sig || '  [' || n || ' occurrence(s), seen from ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') || ']' AS line FROM r")
def context_lines(spark, d):
    rows = segments(spark, d).withColumn("embedding", F.array(F.lit(1.0)))
    return rag.context_frame(retrieval.rank_distinct(rows, [1.0], 10, "segment_text", "event_time_utc"))


@query("SELECT source, count(DISTINCT doc_id) AS files, count(*) AS header_lines FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[A-Z]') GROUP BY 1")
def header_lines(spark, d):
    """Header predicate on the lines of texts."""
    rows = doc_lines(spark, d).filter(text.matches(F.col("raw_entry"), "^[A-Z]"))
    return rows.groupBy("source").agg(F.count_distinct("doc_id").alias("files"), F.count("*").alias("header_lines"))


@query(f"SELECT event_id, r AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'error') WHERE r <= 2")
def latest_errors_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, d, "events").filter("event_type = 'error'").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 2").select("event_id", "place")
