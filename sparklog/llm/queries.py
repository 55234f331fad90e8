"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import ann, chat, decontam, idfiles, jaccard, packing, pii, runtime, secrets, substring, toxicity
from sparklog.llm.runtime import table

#: Where the vocabularies of the tokenizing queries are.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _joined(spans: str) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op2_bitpacked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = runtime.new_dir(spark, "token-files")
    manifest = idfiles.write_token_files(table(spark, sf_dir, "documents"), uri, WORD_VOCABULARY, end_id=2)
    return idfiles.read_token_files(spark, manifest, uri)


def op3_projected_kd_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_secrets_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layered")


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=1, length=2048)


def op6_toxicity_subword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), n_words=3, num=90, den=100)


def op9_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    made = (
        op1_pii_boosted_candidates, op2_bitpacked_token_files, op3_projected_kd_neighbours, op4_secrets_decoding_worklist,
        op5_cost_balanced_packing, op6_toxicity_subword_bags, op7_qgram_decontamination, op8_prefix_tree_jaccard,
        op9_fm_index_repeats, op10_quotation_linking,
    )
    return {f.__name__: f for f in made}


_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op8_prefix_tree_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_fm_index_repeats": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g FROM words),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(g, ' ') ORDER BY doc_id, p) AS turn FROM g WHERE len(g) = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM f WHERE turn > 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """Of the others, models, tokenizers and files are beyond SQL; tests compare them with plain versions."""
    return dict(SQL)
