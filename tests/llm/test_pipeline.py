"""The pipeline stage by stage against what each may drop and change."""

import numpy as np
import pytest

import corpus_pipeline
from sparklog.llm import pii, toxicity

from .test_jaccard import brute
from .test_search import norm
from .test_texts import check_pieces


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((d := stage(spark, docs, sf_dir)).collect(), d.schema)
        out.append(docs)
    return out


def test_stages_keep_columns_and_clean_documents(stages, spark, sf_dir):
    from tokenizers import Tokenizer

    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    rows = [{r.doc_id: r for r in df.collect()} for df in stages[:-1]]
    # Too few labels here to judge what the toxicity stage drops; test_toxicity_on_held_out_labels does, on a larger table.
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [d for d in rows[0] if labels.get(d) == 0]
    assert sum(d in rows[1] for d in clean) >= 0.97 * len(clean)
    found = brute([(d, r.text) for d, r in rows[1].items()], 5, 80, 100)
    assert set(rows[2]) == {c for _, _, c in found}
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, r in rows[2].items() if any(i in norm(r.text or '') for i in items)}
    assert gone.isdisjoint(rows[3]) and len(set(rows[2]) - set(rows[3]) - gone) <= 1 + len(gone) // 5
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[3].items():
        spans = pii.find_pii(r.text or "", pii.model())[1]
        assert rows[4][d].text == pii.redact(r.text, spans) and rows[4][d].n_chars == (len(rows[4][d].text) if spans else r.n_chars)
    tool = Tokenizer.from_file(corpus_pipeline.BYTE_VOCABULARY)
    want = {d: [np.array(tool.encode(r.text or "", add_special_tokens=False).ids + [1])] for d, r in rows[4].items()}
    check_pieces([tuple(r) for r in stages[5].collect()], want, 2048)


def test_run_equals_stages(stages, spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(got) == key(stages[-1])


def test_run_leaves_one_folder(spark, sf_dir, tmp_path, monkeypatch):
    """What stages wrote on the way is deleted; the last kept documents, which the result reads, stay."""
    import os

    from sparklog.llm import runtime

    monkeypatch.setattr(runtime, "new_dir", lambda spark, label: f"file://{tmp_path}/{label}-{len(os.listdir(tmp_path))}-{os.urandom(4).hex()}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [f.rsplit("-", 2)[0] for f in os.listdir(tmp_path)] == ["personal-data"]


def test_empty_documents(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
    assert toxicity.train([], np.zeros(0)).score(np.array([0, 0]), np.zeros(0, np.uint8)).tolist() == [0.5]


def test_nulls_in_every_column(spark):
    """Rows without an id have no result; the others keep theirs."""
    from sparklog.llm import decontam, idfiles, jaccard, packing, runtime, secrets, substring

    rows = [(None, "a b c d e f", None, None, None), (None, None, None, None, None), (1, None, None, None, None), (2, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").distinct().collect())
    bench = spark.createDataFrame([(None, None), (None, "a b c d e f g h"), (1, "a b c d e f")], "item_id long, text string")
    labels = spark.createDataFrame([(None, None), (2, None)], "doc_id long, toxic int")
    uri = runtime.new_dir(spark, "ids")
    manifest = idfiles.write_token_files(docs, uri, corpus_pipeline.BYTE_VOCABULARY)
    for df in (pii.pii(docs), secrets.secrets(docs), idfiles.read_token_files(spark, manifest, uri), packing.pack(docs, corpus_pipeline.BYTE_VOCABULARY), toxicity.scored(docs, toxicity.fit(docs, labels)), jaccard.groups(docs), substring.remove_repeats(docs)):
        assert ids(df) == [1, 2]
    assert ids(decontam.leaks(docs, bench)) == [2]
    assert pii.redact_documents(docs).count() == 4 and decontam.drop_leaks(docs, bench).filter("doc_id = 1").count() == 1
