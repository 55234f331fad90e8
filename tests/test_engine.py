"""The layers end to end on files, retrieval, answers, orchestration, streaming, generators."""

import os
from datetime import date, datetime, timezone

import pytest
import yaml
from pyspark.sql import functions as F

from sparklog.operators import analytics, bronze, retrieval
from sparklog.operators.embed import HashingEmbedder, embed_segments
from sparklog.operators.gold import transform_to_gold
from sparklog.operators.silver import reset_silver, transform_to_silver
from sparklog.plans import pipeline, rag
from sparklog.schemas import TABLES
from sparklog.sources import synth
from sparklog.sources.config import ConfigError, SourceConfig, get_source_config, list_sources, load_config
from sparklog.sources.tables import Store, first_of
from sparklog.streaming import incremental

LOG = """5/1/2026 4:42:10 AM Error: Acme.Jobs.Task Failed
   User : svc_1
   Exception Type : Acme.DbException
Acme.DbException: deadlock ---> Acme.NetException: refused
   at X()
5/1/2026 4:43:10 AM Information: fine
   Status : OK
"""


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "log-1.log").write_text(LOG)
    (folder / "other.txt").write_text(LOG)
    return folder


def config(logs, **more):
    return SourceConfig("s1", "windows_service", location=str(logs), timezone="Australia/Brisbane", **more)


def run(store, c):
    return bronze.ingest_to_bronze(store, c), transform_to_silver(store, c), transform_to_gold(store, c), embed_segments(store, c, HashingEmbedder(64))


def test_layers_are_incremental(store, logs):
    c = config(logs)
    b, s, g, e = run(store, c)
    assert (b.files_seen, b.files_processed, b.entries_landed) == (1, 1, 2)
    assert (s.entries_read, s.entries_written, g.exceptions_processed, g.segments_written, e.segments_embedded) == (2, 2, 1, 2, 2)
    assert store.latest("bronze_processed_logs", bronze.FILE_KEY).first().status == "completed"
    b, s, g, e = run(store, c)
    assert (b.files_skipped_unchanged, b.entries_landed, s.entries_read, g.exceptions_processed, e.segments_embedded, e.segments_skipped_existing) == (1, 0, 0, 0, 0, 2)
    with open(logs / "log-1.log", "a") as f:
        f.write("5/2/2026 1:00:00 PM Error: Acme.Jobs.Task Again\n   Stack Trace :\nAcme.DbException: deadlock\n")
    (logs / "LOG-2.log").write_text(LOG)
    b, s, g, e = run(store, c)
    assert (b.files_seen, b.files_processed, b.entries_landed, b.entries_skipped_duplicate) == (2, 2, 3, 2)
    assert (s.entries_read, s.entries_written, s.entries_skipped_duplicate) == (3, 1, 2)  # equal entries of a source are stored once
    assert store.latest("bronze_processed_logs", bronze.FILE_KEY).filter("file_name = 'log-1.log'").first().reprocess_count == 1
    before = {r.id for r in store.read("silver_log_entries").collect()}
    reset_silver(store, "s1")
    assert transform_to_silver(store, c).entries_written == 3 and {r.id for r in store.read("silver_log_entries").collect()} == before
    assert transform_to_gold(store, c).exceptions_processed == 0  # same ids: gold stays attached
    assert bronze.archive(store, "s1") == 5 and store.read("bronze_landing").count() == 0 and store.read("bronze_archive").count() == 5
    runs = store.latest("bronze_runs", ["id"]).collect()
    assert len(runs) == 3 and all(r.status == "completed" and r.duration_seconds > 0 for r in runs)


def test_file_position_keeps_repeats(store, logs):
    (logs / "log-2.log").write_text(LOG)
    c = config(logs, dedup="file_position")
    bronze.ingest_to_bronze(store, c)
    assert transform_to_silver(store, c).entries_written == 4


def test_cutoff_and_discovery(store, logs, spark):
    old = datetime(2020, 1, 1, tzinfo=timezone.utc).timestamp()
    os.utime(logs / "log-1.log", (old, old))
    (logs / "log-9.log").write_text(LOG)
    c = config(logs, earliest_date=date(2024, 1, 1))
    assert bronze.ingest_to_bronze(store, c).files_seen == 1
    assert bronze.ingest_to_bronze(store, c).files_seen == 2  # bounds the first import only
    assert bronze.ingest_to_bronze(store, config(logs, earliest_date=date(2024, 1, 1), cutoff="always")).files_seen == 1


@pytest.mark.parametrize("split", [64, 200, 10_000])
def test_large_files_are_read_in_splits(store, spark, tmp_path, monkeypatch, split):
    """The same entries as of a file taken whole, wherever splits cut it."""
    from sparklog.sources import logfiles

    folder = tmp_path / "big"
    folder.mkdir()
    body = "before\nany header\r\n" + "".join(f"5/{1 + i % 28}/2026 4:{i % 60:02}:10 AM Error: Acme.Job no {i}\n   User : u{i}\r\n\n  é\x0bx : {'y' * (i % 90)}\n" for i in range(40))
    (folder / "log big+1%20.log").write_bytes(body.encode() + b"   bad \xff byte\n")
    (folder / "log-none.log").write_text("no header\nat all\n" * 30)
    c = SourceConfig("s1", "windows_service", location=str(folder))
    whole = Store(spark, str(tmp_path / "whole"))
    first = bronze.ingest_to_bronze(whole, c)
    monkeypatch.setattr(logfiles, "LARGE", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        again = bronze.ingest_to_bronze(store, c)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = ["id", "processed_log_id", "entry_hash", "raw_entry", "header_excerpt", "source_id"]
    rows = lambda s: sorted(map(tuple, s.read("bronze_landing").select(*key).collect()))
    assert rows(store) == rows(whole) and (again.entries_landed, again.preamble_lines) == (first.entries_landed, first.preamble_lines) == (40, 62)
    assert bronze.ingest_to_bronze(store, c).files_skipped_unchanged == 2


def test_failed_files_are_retried(store, logs, spark):
    c = config(logs)
    bronze.ingest_to_bronze(store, c)
    row = store.latest("bronze_processed_logs", bronze.FILE_KEY).withColumn("status", F.lit("failed")).withColumn("version", F.col("version") + 1)
    store.append("bronze_processed_logs", spark.createDataFrame(row.collect(), row.schema))
    assert bronze.ingest_to_bronze(store, c).files_processed == 1


def test_privacy_fails_closed(store, logs, monkeypatch):
    monkeypatch.delenv("SPARKLOG_PII_HMAC_KEY", raising=False)
    c = config(logs, pii_policy={"User": "hmac"})
    bronze.ingest_to_bronze(store, c)
    with pytest.raises(ValueError):
        transform_to_silver(store, c)
    assert not store.exists("silver_log_entries")
    monkeypatch.setenv("SPARKLOG_PII_HMAC_KEY", "k")
    transform_to_silver(store, c)
    shown = [r.extra_fields for r in store.read("silver_log_entries").collect()]
    assert not any("svc_1" in x for x in shown) and any('"User"' in x for x in shown)


def test_tables(store, spark):
    assert sorted(store.create_all()) == sorted(TABLES) and store.create_all() == []
    assert all(store.read(t).count() == 0 and store.read(t).schema == s for t, s in TABLES.items())
    with pytest.raises(KeyError):
        store.path("nope")
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "z"), (2, None, "a"), (1, 3, "c")], "k int, o int, v string")
    assert sorted(map(tuple, first_of(df, ["k"], ["o"]).collect())) == [(1, 3, "c"), (2, None, "a")]


def test_cascade(store, logs):
    bronze.ingest_to_bronze(store, config(logs))
    store.delete_cascade(store.read("bronze_processed_logs").filter("file_name = 'log-1.log'"), "s1")
    assert store.read("bronze_landing").count() == 0 and store.read("bronze_processed_logs").count() == 0


def test_delete_segments_with_vectors(store, logs):
    run(store, config(logs))
    one = store.read("gold_exception_segments").filter("segment_type = 'signature'").select("id")
    store.delete_segments(one, "s1")
    left = store.read("gold_exception_segments").collect()
    assert [r.segment_type for r in left] == ["inner_signature"]
    assert [r.segment_id for r in store.read("gold_embeddings").collect()] == [left[0].id]


class Stub:
    """Stands in for a sentence model: pinned, and called once per distinct text."""

    model, version, dim = "stub", "stub/1", 3

    def encode(self, texts):
        import numpy as np

        return np.array([[len(t), 1, 0] for t in texts], np.float32)


def test_vectors_of_two_models_live_side_by_side(store, logs):
    c = config(logs)
    run(store, c)
    assert embed_segments(store, c, Stub()).segments_embedded == 2 and embed_segments(store, c, Stub()).segments_embedded == 0
    stored = store.read("gold_embeddings").filter("embedding_model = 'stub'").collect()
    texts = {r.id: r.segment_text for r in store.read("gold_exception_segments").collect()}
    assert {r.segment_id: r.embedding for r in stored} == {i: [float(len(t)), 1.0, 0.0] for i, t in texts.items()}
    assert retrieval.retrieve(store, "x", embedder=Stub(), distinct=False).count() == 2


def test_approximate_retrieval_recalls(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(40, 16)), 25, axis=0) + 0.15 * r.normal(size=(1000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 1000, 200):
        want = set(np.argsort(-(unit @ unit[i]), kind="stable")[:10].tolist())
        hits += len(want & {q.vec_id for q in retrieval.approximate(rows, x[i].tolist(), 10, "vec_id").collect()})
    assert hits >= 0.9 * 50


@pytest.fixture
def filled(store, spark):
    """Three signatures over two sources and types, one without a time, one vector of another version, one zero vector."""
    e = HashingEmbedder(64)
    at = lambda d: datetime(2026, 5, d, tzinfo=timezone.utc)
    rows = [("a", "s1", "windows_service", "Acme.DbException: deadlock", at(1), "ERROR"), ("b", "s2", "windows_service", "Acme.DbException: deadlock", at(3), "FATAL"), ("c", "s1", "windows_service", "Acme.NetException: refused", None, "ERROR"), ("d", "s2", "apache_access", "HTTP 500 GET /api/orders", at(2), "ERROR"), ("z", "s1", "windows_service", "", at(2), "ERROR")]
    segments = spark.createDataFrame([(i, i, t, 0, "signature", x, w, v, "log", w, s) for i, s, t, x, w, v in rows], TABLES["gold_exception_segments"])
    store.append("gold_exception_segments", segments)
    vectors = [(i, i, e.model, e.version, [float(v) for v in e.encode([x])[0]], None, s) for i, s, _, x, _, _ in rows]
    vectors.append(("old", "a", e.model, "0", [1.0] * 64, None, "s1"))
    store.append("gold_embeddings", spark.createDataFrame(vectors, TABLES["gold_embeddings"]))
    return store, e


def test_retrieval(filled):
    store, e = filled
    found = retrieval.retrieve(store, "deadlock in Acme.DbException", embedder=e, top_k=3).collect()
    assert found[0].distance is None or found[0].segment_text == "Acme.DbException: deadlock"
    best = [r for r in found if r.distance is not None][0]
    assert (best.segment_text, best.occurrences, best.first_seen_utc.day, best.last_seen_utc.day) == ("Acme.DbException: deadlock", 2, 1, 3)
    each = lambda **f: {r.silver_entry_id for r in retrieval.retrieve(store, "x", embedder=e, distinct=False, **f).collect()}
    assert each() == {"a", "b", "c", "d", "z"}
    assert each(source_id="s2") == {"b", "d"} and each(severity="FATAL") == {"b"} and each(log_type="apache_access") == {"d"}
    assert each(from_utc="2026-05-01", to_utc="2026-05-02T00:00:00+00:00") == {"a", "d", "z"}  # both inclusive; no time, no match
    assert each(source_id="s2", severity="ERROR", log_type="apache_access", from_utc="2026-05-02", to_utc="2026-05-02") == {"d"}
    assert each(source_id="none") == set()


class Echo:
    def __init__(self):
        self.prompts = []

    def generate(self, prompt, model):
        self.prompts.append((prompt, model))
        if "break" in prompt.split("Question:")[-1]:
            raise RuntimeError("down")
        return f"answer {len(self.prompts)}"


def test_answers_and_chat(filled):
    store, e = filled
    echo = Echo()
    got = rag.ask(store, "what deadlock?", generator=echo, embedder=e, top_k=2, source_id="s2", log_type="windows_service")
    assert got["answer"] == "answer 1" and got["context"] == "1. Acme.DbException: deadlock  [1 occurrence(s), seen from 2026-05-03 to 2026-05-03]"
    assert got["context"] in echo.prompts[0][0] and "Question: what deadlock?" in echo.prompts[0][0] and echo.prompts[0][1] == "mistral"
    assert rag.ask(store, "x", generator=echo, embedder=e, source_id="none")["context"] == rag.NOTHING
    one = retrieval.retrieve(store, "refused", embedder=e, distinct=False, severity="ERROR", source_id="s1").collect()
    assert any(line.endswith("[ s1/ERROR]") for line in rag.format_context(one, False).split("\n")) and "-" in rag.format_results(one, False)
    said, script = [], iter(["", "first", "/context", "break it", "reset", "/context", *[f"q{i}" for i in range(7)], "quit", "never"])
    chat = rag.ChatSession(store, generator=echo, embedder=e)
    rag.talk(chat, read=lambda _: next(script), write=said.append)
    assert "/context" in said[0] and said[1].startswith("answer") and "occurrence(s)" in said[2] and said[3].endswith(": down")
    assert said[5] == rag.ChatSession(store).shown_context() and said[-2].startswith("answer") and next(script) == "never"
    assert [q for q, _ in chat.history] == ["q2", "q3", "q4", "q5", "q6"] and "User: q5" in echo.prompts[-1][0] and "User: q0" not in echo.prompts[-1][0]
    rag.talk(chat, read=lambda _: (_ for _ in ()).throw(EOFError), write=said.append)


def test_http_generator_reports_failure():
    with pytest.raises(RuntimeError):
        rag.HttpGenerator("http://127.0.0.1:9/none", timeout=2).generate("p", "m")


def test_config(tmp_path, monkeypatch):
    good = tmp_path / "c.yaml"
    good.write_text(yaml.safe_dump({"sources": {"b": {"log_type": "apache_access", "location": "x", "earliest_date": "2026-01-02"}, "a": {"location": "y"}}}))
    assert list_sources(str(good)) == ["a", "b"] and get_source_config("b", str(good)).earliest_date == date(2026, 1, 2)
    for bad in ("missing.yaml",):
        with pytest.raises(ConfigError):
            load_config(str(tmp_path / bad))
    with pytest.raises(ConfigError):
        get_source_config("a", str(good))
    with pytest.raises(ConfigError):
        get_source_config("zzz", str(good))
    for text in ("- a\n- b", "a: [", "sources:\n - x"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ConfigError):
            list_sources(str(tmp_path / "bad.yaml"))
    monkeypatch.setenv("SPARKLOG_CONFIG", str(good))
    assert list_sources() == ["a", "b"]
    with pytest.raises(ConfigError):
        SourceConfig.from_dict("s", {"log_type": "x", "timezone": "Mars/Base"})


def test_pipeline_isolates_sources(spark, tmp_path, logs):
    c = tmp_path / "c.yaml"
    c.write_text(yaml.safe_dump({"sources": {"good": {"log_type": "windows_service", "location": str(logs)}, "bad": {"log_type": "windows_service", "location": str(tmp_path / "nowhere")}, "worse": {"location": "x"}}}))
    records = pipeline.run_all(spark, str(tmp_path / "t"), str(c), HashingEmbedder(32), str(tmp_path / "errors.log"))
    assert {r.source_id: r.step for r in records if r.state == "failed"} == {"bad": "bronze", "worse": "config"}
    assert [r.state for r in records] == ["done", "failed", *["skipped"] * 3, *["done"] * 5, "failed", *["skipped"] * 4]
    assert pipeline.exit_code(records) == 1 and pipeline.exit_code([r for r in records if r.source_id == "good"]) == 0 and pipeline.exit_code([]) == 1
    assert "stopped early: bad, worse" in pipeline.report(records) and "step=bronze" in (tmp_path / "errors.log").read_text()
    store = Store(spark, str(tmp_path / "t"))
    assert store.read("pipeline_steps").count() == 15 and store.read("pipeline_steps").filter("state = 'done'").count() == 6
    assert store.read("pipeline_errors").count() == 2
    assert store.latest("bronze_runs", ["id"]).filter("source_id = 'bad'").first().status == "failed"


def test_stream_to_bronze(spark, store, logs, tmp_path):
    c = config(logs)
    incremental.stream_to_bronze(store, c, str(tmp_path / "ck")).awaitTermination()
    assert store.read("bronze_landing").count() == 2
    (logs / "log-3.log").write_text(LOG)
    incremental.stream_to_bronze(store, c, str(tmp_path / "ck")).awaitTermination()
    assert store.read("bronze_landing").count() == 4


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("error", datetime(2026, 5, 1, 10, m)) for m in (1, 2, 30)] + [("error", datetime(2026, 5, 1, 15))], "kind string, at timestamp").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("kind string, at timestamp").parquet(str(tmp_path / "e"))
    got = incremental.run_once(spark, incremental.windowed_counts(stream, "at", "10 minutes", "1 hour", ["kind"]), "counts", "complete").collect()
    assert sorted(r.n for r in got) == [1, 1, 2]
    got = incremental.run_once(spark, incremental.sessions(stream, "at", "5 minutes", "1 hour", ["kind"]), "bursts", "complete").collect()
    assert sorted(r.n for r in got) == [1, 1, 2]


def test_generators(spark, tmp_path, store):
    w = synth.windows_corpus(spark, date(2026, 5, 1), date(2026, 5, 4), per_day=40, burst=10)
    again = synth.windows_corpus(spark, date(2026, 5, 1), date(2026, 5, 4), per_day=40, burst=10)
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, again.collect()))
    assert synth.write_files(w, str(tmp_path / "w")) == 4 and sorted(os.listdir(tmp_path / "w"))[0] == "log-05-01-2026.log"
    c = SourceConfig("w", "windows_service", location=str(tmp_path / "w"))
    assert bronze.ingest_to_bronze(store, c).entries_landed >= 150 and transform_to_silver(store, c).entries_unparsed == 0 and transform_to_gold(store, c).segments_written > 0
    kinds = {r.segment_text.split(":")[0] for r in store.read("gold_exception_segments", "w").filter("segment_type = 'signature'").collect()}
    assert kinds == {f[0] for f in [*synth.FAMILIES, *synth.VARIED]}
    assert store.read("gold_exception_segments", "w").filter("segment_text like 'System.IO%'").select("segment_text").distinct().count() >= 2
    a = synth.apache_corpus(spark, date(2026, 5, 1), date(2026, 5, 3), per_day=30)
    assert synth.write_files(a, str(tmp_path / "a")) == 3
    c = SourceConfig("a", "apache_access", location=str(tmp_path / "a"), file_prefix="access")
    assert bronze.ingest_to_bronze(store, c).entries_landed > 80 and transform_to_silver(store, c).entries_unparsed == 0


def test_correlation_uses_an_equi_join(spark):
    a = spark.createDataFrame([(1, datetime(2026, 5, 1, 10, 0)), (2, None)], "i int, t timestamp")
    b = spark.createDataFrame([(i, datetime(2026, 5, 1, 9 + (i > 9), (55 + i) % 60)) for i in range(12)], "j int, u timestamp")
    df = analytics.correlate(a, b, "t", "u", 300)
    want = [(1, j) for j in range(12) if abs((b.collect()[j].u - datetime(2026, 5, 1, 10)).total_seconds()) <= 300]
    assert sorted((r.i, r.j) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quality_measures(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "source_id string, parsed boolean")
    assert {r.source_id: r.failure_rate for r in analytics.parse_failures(rows).collect()} == {"a": 0.5, "b": 0.0}
