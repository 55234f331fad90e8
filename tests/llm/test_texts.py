"""PII, secrets, token files, packing and toxicity against plain versions of their contracts."""

import base64
import gzip
import hashlib
import io
import os
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklog.llm import idfiles, packing, pii, queries, runtime, secrets, tokens, toxicity
from sparklog.llm.kernels import parts

from .conftest import nasty_texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in spans).encode()).hexdigest()


def test_pii_query_equals_plain_scan(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op1_pii_boosted_candidates(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = plain_pii(docs[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert {f"{k}:{b}:{e}" for k, b, e in want} <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize(
    "text",
    ["1.2.3.999 then 10.0.0.1", "99999.1.1.1", "+1 2 +123456789012", "a@b a@b.c x@y.z.w.", "4111 1111 1111 1111 7", "4111-1111-1111-1111", "٣.١.١.١ 1.2.3.4.5.6.7.8", "é a.b@c.de +49 (30) 123-4567-"],
)
def test_pii_base_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_model_adds_and_spares():
    trees = pii.model()
    for text, kind in [("write to jo.doe [at] mail [dot] com soon", "email"), ("call (212) 555-2368 now", "phone"), ("host 2001:db8:85a3:0:0:8a2e:370:7334 up", "ip")]:
        base, full = pii.find_pii(text, trees)
        assert not base and [s[0] for s in full] == [kind], text
    for text in ["meet at noon dot then", "at 10:20 and 11:30", "version 1.2.3", "plain words only", "std::vector and a::b"]:
        assert pii.find_pii(text, trees)[1] == [], text
    assert pii.redact("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"


def test_pii_odd_rows(odd_docs, no_docs):
    assert pii.pii(odd_docs).count() == odd_docs.count()
    assert pii.pii(no_docs).count() == 0
    kept = pii.redact_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert pii.redact_documents(no_docs).count() == 0


def test_secrets_query_equals_plain_scan(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op4_secrets_decoding_worklist(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = plain_secrets(docs[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secrets.KINDS]


def test_secrets_layers_map_back():
    key = "password=hunter2abc"
    for wrapped in [
        base64.b64encode(key.encode()).decode(),
        base64.b64encode(base64.b64encode(key.encode())).decode(),
        base64.b64encode(gzip.compress(key.encode())).decode(),
        base64.b64encode(zlib.compress(key.encode())).decode(),
        "".join(f"%{b:02X}" for b in key.encode()),
        "".join(f"%25{b:02X}" for b in key.encode()),
        "".join(f"\\u{ord(c):04x}" for c in key),
        "".join(f"&#{ord(c)};" for c in base64.b64encode(key.encode()).decode()),
    ]:
        text = f"né before {wrapped} after"
        base, full = secrets.find_secrets(text)
        assert base == [], wrapped
        inside = [s for s in full if s[0] == "assign"]
        assert inside and all(9 < b < e <= len(text) for _, b, e in inside), wrapped
        assert pa.compute.match_substring_regex(pa.array([text]), secrets.HAS_LAYER)[0].as_py(), wrapped


def test_secrets_layers_of_whole_texts():
    key = "password=hunter2abc"
    long = "x " * 40 + key + " y" * 40
    b64 = lambda b, n=76: "\n".join(base64.b64encode(b).decode()[i : i + n] for i in range(0, len(base64.b64encode(b)), n))
    noise = bytes(np.random.default_rng(3).integers(0, 256, 300, np.uint8)).hex(" ", 1).upper()
    for text in [
        "a password = %68%75nter2abc b",
        '{"password": "h\\u0075nter2abc"}',
        "password&#61; hunter2abc%",
        *(f"see {b64((' ' * i + long).encode(), n)} end" for i in range(20) for n in (64, 76)),
        f"see {b64(gzip.compress((noise + key).encode()))} end",
        f"yaml:\n  {b64((noise + key).encode()).replace(chr(10), chr(10) + '  ')}\n",
        *(f"{p}{b64(key.encode())}" for p in ("data/", "ab-", "k_", "x", "some/path/", "https://h/q/")),
        *(f"{p}{b64(gzip.compress(key.encode()))}" for p in ("data/", "ab-", "k_", "x")),
        b64(b"\xef\xbb\xbf\x1b[31m\x00" + key.encode()),
    ]:
        base, full = secrets.find_secrets(text)
        found = [text[b:e] for k, b, e in full if k == "assign"]
        assert base == [] and found, text
        assert pa.compute.match_substring_regex(pa.array([text]), secrets.HAS_LAYER)[0].as_py(), text
    for pad in range(60):  # wherever the line break falls, the span covers the whole secret
        text = b64(("z" * pad + " " + key + " end").encode(), 64)
        whole = [(b, e) for k, b, e in secrets.find_secrets(text)[1] if k == "assign"]
        assert max(e - b for b, e in whole) >= 25, pad
    assert secrets.find_secrets("%41 token = abcdefg %42")[1] == [("assign", 4, 19)]


def test_secrets_unpacks_to_the_end():
    import bz2

    import zstandard

    key = b"password=hunter2abc"
    zstd = zstandard.ZstdCompressor().compress
    nested = key
    for i in range(13):
        nested = (gzip.compress, zlib.compress, bz2.compress, zstd)[i % 4](nested)
    filler = b"some plain words, " * 64_000
    held = [pack(b"first") + pack(b" then ") + pack(key) for pack in (gzip.compress, zlib.compress, bz2.compress, zstd)]
    held += [pack(filler * 16 + key) for pack in (gzip.compress, bz2.compress, zstd)]  # beyond 2 ** 24
    held += [gzip.compress(b"x" * n + " é".encode() * 40_000 + key + filler) for n in (900_000, (1 << 20) - 80_008)]
    held += [gzip.compress(filler[: (1 << 20) - 12] + key + filler), gzip.compress(b"secret" + b" " * 3_000_000 + b"= hunter2abc")]
    held += [nested, gzip.compress(b"a") + key, gzip.compress(b"\xff\xfe\x00" + key), gzip.compress(filler + base64.b64encode(gzip.compress(filler * 2 + key)) + filler)]
    for i, raw in enumerate(held):
        text = f"né {base64.b64encode(raw).decode()} after"
        assert ("assign", 3, len(text) - 6) in secrets.find_secrets(text)[1], i
    assert secrets._unpacked(b"x^2 + y^2 = z^2") is None and secrets._unpacked(b"BZh9 plain") is None


def test_secrets_odd_rows(odd_docs, no_docs):
    assert secrets.secrets(odd_docs).count() == odd_docs.count()
    assert secrets.secrets(no_docs).count() == 0
    assert secrets.find_secrets("%41" * 5 + "%zz \\ud800 &#99999999; " + "A" * 40)[0] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder_equals_library(name, spark, sf_dir):
    tool = tokens.ChunkEncoder(public_tokenizers.path(name), keep=500)
    texts = [t or "" for t in nasty_texts()] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    want = [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = []
    for _, _, off, buf, rows in parts(pa.array(texts), 4000):
        ids, counts = tool.encode(rows, off, buf)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 31, 32, 33, 5000):
        ids = r.integers(0, 1 << bits, n).astype(np.uint32)
        assert (idfiles.unpack_ids(idfiles.pack_ids(ids, bits), bits, n) == ids).all()
    counts = np.array([0, 3, 0, 700, 1, 0])
    ids = r.integers(0, 1 << bits, counts.sum()).astype(np.uint32)
    held = idfiles.IdFile(idfiles.encode_file(np.arange(6), counts, ids, bits, block=64))
    for i, (n, start) in enumerate(zip(counts, np.cumsum(counts) - counts)):
        assert (held.document(i) == ids[start : start + n]).all()
    assert (held.ids(60, 140) == ids[60:140]).all()

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    ids = r.integers(0, 1 << bits, 100_000).astype(np.uint32)
    whole = idfiles.encode_file(np.arange(100), np.full(100, 1000), ids, bits, block=256)
    f = Counting(whole)
    assert (idfiles.IdFile(f).document(57) == ids[57_000:58_000]).all()
    assert f.taken < len(whole) // 10 + 16 * 500  # the tables and the document's blocks only


def test_token_query_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_VOCABULARY)
    want, start = [], 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = tool.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op2_bitpacked_token_files(spark, sf_dir).collect())) == want


def test_packing_query_on_the_table(spark, sf_dir):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    want = {r.doc_id: [np.array(tool.encode(r.text or "", add_special_tokens=False).ids + [1])] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces([tuple(r) for r in queries.op5_cost_balanced_packing(spark, sf_dir).collect()], want, 2048)


def test_token_files_equal_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_VOCABULARY)
    want, start = [], 0
    for r in sorted(odd_docs.collect(), key=lambda r: r.doc_id):
        ids = tool.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    uri = runtime.new_dir(spark, "ids")
    manifest = idfiles.write_token_files(odd_docs, uri, queries.WORD_VOCABULARY, end_id=2, shard_ids=500)
    assert sorted(map(tuple, idfiles.read_token_files(spark, manifest, uri).collect())) == sorted(want)
    empty = idfiles.write_token_files(no_docs, uri + "-none", queries.WORD_VOCABULARY, end_id=2)
    assert idfiles.read_token_files(spark, empty, uri + "-none").count() == 0


def test_token_files_of_many_small_partitions(spark, odd_docs):
    """The manifest is one file and documents are read by few tasks, however many tasks wrote: Spark starts commands for each file it makes."""
    rows = odd_docs.count()
    before, scans = (spark.conf.get(f"spark.sql.{x}") for x in ("shuffle.partitions", "parquet.columnarReaderBatchSize"))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        uri = runtime.new_dir(spark, "ids")
        manifest = idfiles.write_token_files(odd_docs, uri, queries.WORD_VOCABULARY, end_id=2)
        assert manifest.count() > 12 and len(manifest.inputFiles()) == 1
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == scans
        found = runtime.cut(idfiles.read_token_files(spark, manifest, uri), "documents")
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = found.orderBy("start").collect()
    assert len(got) == rows and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(rows)]


def check_pieces(pieces, documents, length):
    """pieces: (doc, start, n, crc, total, seq, offset); documents: doc -> list of id arrays."""
    by_seq = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        by_seq[p[5]].append((p[6], p[2]))
        by_doc[p[0]].append(p)
    for got in by_seq.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at and n > 0
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    assert set(by_doc) == set(documents)
    for d, arrays in documents.items():
        assert sum(p[2] for p in by_doc[d]) == sum(map(len, arrays))
        if len(arrays) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p[1]):
                assert p[1] == at and p[4] == len(arrays[0])
                assert p[3] == zlib.crc32(arrays[0][at : at + p[2]].astype("<u4").tobytes())
                at += p[2]


def test_packing_query(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    documents = defaultdict(list)
    for r in odd_docs.collect():
        documents[r.doc_id].append(np.array(tool.encode(r.text or "", add_special_tokens=False).ids + [1]))
    for length in (2048, 64):
        check_pieces([tuple(r) for r in packing.pack(odd_docs, queries.BYTE_VOCABULARY, 1, length).collect()], documents, length)
    assert packing.pack(no_docs, queries.BYTE_VOCABULARY).count() == 0


def test_packing_balances_cost():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 700, 900)
    cost, used = defaultdict(float), defaultdict(int)
    for d, start, n, seq, offset in packing.plan(lengths):
        cost[seq] += n + n * n / 2048
        used[seq] += n
    full = [c for s, c in cost.items() if used[s] == 2048]
    assert len(full) >= int(lengths.sum()) // 2048 - 1 and max(full) < 1.35 * (sum(full) / len(full))


def test_toxicity_learns_and_generalises():
    r = np.random.default_rng(1)
    clean = ["er", "thon", "whest", "anin", "lyou", "inged", "tion", "heat"]
    word = lambda: "".join(clean[int(i)] for i in r.integers(0, 8, 2))
    texts, y = [], []
    for i in range(600):
        w = [word() for _ in range(int(r.integers(3, 200)))]
        if i % 6 == 0:
            w[int(r.integers(len(w)))] = ["idiot", "moron", "pathetic"][i // 6 % 3]
        texts.append(" ".join(w))
        y.append(int(i % 6 == 0))
    model = toxicity.train(texts[:500], np.array(y[:500]))
    score = lambda t: np.concatenate([model.score(off, buf) for _, _, off, buf, _ in parts(pa.array(t))])
    assert ((score(texts[500:]) >= 0.5) == np.array(y[500:])).mean() > 0.95
    odd = score(["thon whest idiots anin", "thon whest patheticc", "thon anin whest", "", None, "\n"])
    assert odd[0] > 0.5 and odd[1] > 0.5 and (odd[2:] < 0.5).all()
    assert len(set(odd[3:])) == 1


def test_toxicity_on_held_out_labels(spark):
    """Trained on the labels whose crc32 mod 5 is not 0, judged on the others. Some toxic labels are noise: their texts hold no
    word that marks toxic texts (one of ten training texts or more, and never a clean one). The others must be caught."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: (r.text or "").lower() for r in docs.select("doc_id", "text").collect() if r.doc_id in y}
    score = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    held = {d for d in text if zlib.crc32(str(d).encode()) % 5 == 0}
    seen = [defaultdict(int), defaultdict(int)]
    for d in text.keys() - held:
        for w in set(re.findall(r"\w+", text[d])):
            seen[y[d]][w] += 1
    n = sum(y[d] for d in text.keys() - held)
    marks = {w for w, k in seen[1].items() if 10 * k >= n and not seen[0][w]}
    marked = [d for d in held if y[d] and marks & set(re.findall(r"\w+", text[d]))]
    clean = [d for d in held if not y[d]]
    assert len(marked) > 40 and len(clean) > 500
    assert sum(score[d] >= 0.5 for d in marked) >= 0.95 * len(marked)
    assert sum(score[d] >= 0.5 for d in clean) < 0.01 * len(clean)


def test_toxicity_odd_rows(spark):
    """Ties, repeated rows, long texts and clashing columns: equal texts score alike, whatever stands beside them."""
    model = toxicity.train(["fine words here"] * 60 + ["you idiot there"] * 60, np.array([0] * 60 + [1] * 60))
    long = "fine words here " * 100_000
    rows = [(1, "you idiot", 7), (1, "you idiot", 7), (2, "you idiot", 8), (3, long, 9), (4, long + "you idiot there", 9), (5, "x" * 500_000, 9), (None, "you idiot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.score) for r in toxicity.scored(df, model).collect())
    assert [d for d, _ in got] == [1, 1, 2, 3, 4, 5] and len({s for d, s in got if d < 3}) == 1
    assert got[3][1] < 0.5 < got[4][1] and got[0][1] > 0.5
    assert toxicity.scored(df, model, keep_below=0.5).columns == df.columns


def test_toxicity_query(spark, sf_dir, odd_docs, no_docs):
    got = queries.op6_toxicity_subword_bags(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    assert toxicity.scored(odd_docs, model).count() == odd_docs.count()
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, labels), keep_below=0.5).count() == 0


def test_toxicity_counts_beyond_the_sample(spark):
    """Both classes over the cap: the share and the cut are those of all labels, not of the sample."""
    r = np.random.default_rng(4)
    said = lambda t, n: [f"{t} {' '.join(r.choice(['one', 'two', 'red', 'blue', 'old'], 4))}" for _ in range(n)]
    texts = said("fine thing", 540) + said("maybe so", 360) + said("awful idiot", 20) + said("maybe so", 80)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9001, ""), (9002, None), (9003, " \n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 900)) for i in range(1000)] + [(i, 1) for i in range(20_000, 24_000)], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 9000"), labels.filter("doc_id < 20000"), sample=30)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    wrong = [(score[i] >= 0.5) != (i >= 900) for i in range(1000)]
    assert sum(wrong[:900]) < 120
    assert len({score[i] for i in (9001, 9002, 9003)}) == 1 and 0.05 < score[9001] < 0.2
    assert sorted(r.doc_id for r in toxicity.scored(docs.filter("doc_id > 9000"), model, keep_below=0.5).collect()) == [9001, 9002, 9003]
    # Labels without a document count for nothing; mostly toxic tables keep texts without words all the same.
    assert toxicity.fit(docs, labels, sample=5000).bias_empty == toxicity.fit(docs, labels.filter("doc_id < 20000"), sample=5000).bias_empty
    assert toxicity.train(["bad"] * 9 + ["good"], np.array([1] * 9 + [0])).bias_empty < 0


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, counts=None: seen.append((texts, labels, counts)))
    docs = spark.createDataFrame([(i, "w " * (2000 if i == 1 else 100)) for i in range(40)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    texts, labels, counts = seen[0]
    for k in (0, 1):
        own = [len(t) for t, y in zip(texts, labels) if y == k]
        assert len(own) >= 1 and (sum(own) <= 1000 or len(own) == 1)
    assert sum(counts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))


PIECES = ["a", "jo", "x_y", "@", "@@", ".", "..", "-", "+", "%", " ", "  ", "\n", "b.c", "d-e.org", "1", "22", "256", "1.2.3.4", "999.1", "+49", "(", ")", "[", "]", " at ", " AT ", " dot ", " DOT ", "[at]", "(dot)", "[.]", "[@]", " [at] ", "::", ":", "ab:", "fe80", "0049", "00", "1234", "/", "_", "555", "4111", "é", "Z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_addresses_are_those_of_the_plain_patterns(found):
    text = "".join(found)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert list(pii._addresses(text, *pii.EMAIL)) == [m.span() for m in plain.finditer(text)]
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_column_tests_hold_wherever_a_generator_matches(found):
    text = "".join(found)
    has, proposes = pii._tests(pa.array([text], pa.large_string()))
    assert proposes[0] or not pii.candidates(text)
    assert {k for k, _, _ in pii.base_spans(text)} <= {k for k in pii.KINDS if has[k][0]}


def test_pii_accepts_forms_that_no_template_made():
    good = ["write to jo.doe[@]mail.com today", "mail jane_roe2 (at) uni-bonn (dot) de please", "reach bob at example dot org now", "host 2001:db8:85a3::8a2e:370:7334 is up", "call (415) 555-2671 now", "tel 415-555-2671", "card 4111/1111/1111/1111 was charged"]
    bad = ["we met at noon dot dot dot", "page 12::34 of it", "order 123.456 7890 shipped", "look at this dot matrix printer", "std::vector::iterator", "see no 1234.5678.9012.3456 there"]
    assert sum(bool(pii.find_pii(t, pii.model())[1]) for t in good) >= 6
    assert sum(bool(pii.find_pii(t, pii.model())[1]) for t in bad) <= 1


def test_thresholds_keep_their_precision():
    trees = pii.model()
    x, y = pii._examples(2000)
    p = trees.predict(x)
    for i, kind in enumerate(pii.KINDS):
        took = (x[:, i] > 0) & (p >= trees.threshold[kind])
        assert took.sum() > 50 and y[took].mean() >= 0.97


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "a." * 500_000 + "@", "ab " * 300_000, "%41" * 300_000, "A1b2" * 250_000, "a" * 999_999 + "%41", "1:" * 400_000, "+1" * 500_000, "token" * 200_000])
def test_long_unbroken_texts_take_linear_time(text):
    began = time.process_time()
    pii.find_pii(text, pii.model())
    middle = time.process_time()
    secrets.find_secrets(text)
    assert middle - began < 4 and time.process_time() - middle < 12


def test_secrets_behind_percent_signs_that_are_no_utf8():
    text = "x %E9%70assword=%68unter2abc y"
    assert ("assign", 5, 28) in secrets.find_secrets(text)[1]


def test_secrets_under_twelve_layers_and_in_a_large_one():
    text = "secret=abcdef123456"
    for _ in range(12):
        text = base64.b64encode(gzip.compress(text.encode())).decode()
    assert any(k == "assign" for k, _, _ in secrets.find_secrets(f"x {text} y")[1])
    large = base64.b64encode(gzip.compress(b"filler words and more " * 830_000 + b"AKIA" + b"Q" * 20)).decode()
    assert any(k == "access" for k, _, _ in secrets.find_secrets(large)[1])


def test_secret_query_finds_what_the_function_finds(spark):
    texts = ["", "password = hunter22", base64.b64encode(b"token=abcdefgh").decode(), "abcdefghijklmnopA" * 2, "t%6fken=abcdef", "plain words only", None, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: secrets.digest_spans(secrets.find_secrets(t or "")[1]) for i, t in enumerate(texts)}
    assert {r.doc_id: r.spans for r in secrets.secrets(df).collect()} == want


def test_pii_query_finds_what_the_function_finds(spark):
    texts = ["", "jo.doe[@]mail.com", "jo. at mail dot com", "x00491234567 890", "a@b.co", None, "(415) 555-2671", "12::34", "fe80::1:2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: pii.find_pii(t or "", pii.model())[1] for i, t in enumerate(texts)}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in pii.pii(df).collect()} == want
