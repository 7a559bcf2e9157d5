"""SimHash links and the blob ledger against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from connlearn.llm import secrets, simhash
from connlearn.llm.common import connected_components


def brute_components(prints):
    """prints: list of (key, fp); smallest key reachable at most 2 bits a step."""
    out = {}
    fps = sorted({f for _, f in prints})
    left = set(fps)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if bin(a ^ b).count("1") <= 2}
            left -= near
            group |= near
            todo += near
        low = min((k for k, f in prints if f in group and k is not None), default=None)
        out.update(dict.fromkeys(group, low))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_definition():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        if not w:
            return 0
        sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", " \n", "One", "One Two", "a b c", "a b c d", "É A é a " * 9, "x y " * 5000):
        assert simhash.fingerprint(t) == brute(t)


def test_links_sparse_and_dense(spark):
    rng = random.Random(3)
    fps = [0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1]
    for _ in range(30):
        base = rng.getrandbits(64)
        fps += [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)] + [base ^ 7 ^ (1 << 40)]
    # a crowd that shares its low segment, and a chain inside it
    crowd = rng.getrandbits(32)
    fps += [crowd | (rng.getrandbits(32) << 32) for _ in range(150)] + [crowd | ((1 << i) - 1) << 32 for i in range(30)]
    prints = [(i, f) for i, f in enumerate(rng.sample(fps, len(fps)))] + [(None, fps[0]), (None, 12345 << 20), (0, fps[9])]
    want = brute_components(prints)
    df = spark.createDataFrame([(k, signed(f)) for k, f in prints], "key long, fp long")
    for dense in (2, 64, 10_000):
        got = simhash.components(df, dense).collect()
        assert len(got) == len(prints)
        assert all(r.component_id == want[r.fp % (1 << 64)] for r in got)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(
        spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_stage_keeps_one_of_each_group(spark, make_docs):
    text = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [(5, text), (2, text.upper()), (9, text), (9, text), (7, "something else entirely here"), (None, text),
            (2, "another text under the same id"), (4, None), (3, ""), (8, "solo"), (8, "solo")]
    df = make_docs(rows, clash=True)
    out = simhash.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([
        (2, text.upper()), (7, rows[4][1]), (2, rows[6][1]), (3, ""), (8, "solo")])
    assert simhash.near_duplicates(make_docs([])).count() == 0


BASE = (("assign", re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))


def brute_spans(t):
    got = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(t)
                 if len(m.group(g)) >= least)
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in got]


TEXTS = ["", "é PASSWORD = 'hunter2hunter2' x", "token:token:abcdefghij", "token=token=abcdefgh", "AKIA" + "A" * 12,
         "AKIA1", "xAKIAAKIA" + "B" * 10, "0" * 31, "0123456789abcdef" * 3 + "g" + "f" * 32, "api_key:short apikey: longenough",
         "secret\"  :  \"abcd.efgh/ijk=\"", "ſecret=abcdefghijk", "ghp_" + "a" * 36, "https://me:hunter22@host/"]


def test_spans_match_the_base_rules():
    for t in TEXTS:
        found = secrets.find(t)
        assert secrets.spans_text(found, base_only=True) == ",".join(brute_spans(t)), t
    assert secrets.spans_text(secrets.find(TEXTS[-1])) == "url:5:20"


def test_long_urls_and_encrypted_keys_are_redacted_whole():
    head = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0F\n\n"
    body, end = "MIIEabc+/=\n" * 30, "-----END RSA PRIVATE KEY-----"
    for text, want in ((f"a ://oauth2:{'eyJ.' * 500}@host", "a [url]host"), ("redis://:hunter22@host", "redis[url]host"),
                       (f"://{'u' * 100}:hunter22@host", "[url]host"), (f"a {head}{body}{end} z", "a [pem] z"),
                       (f"a {head}{body}", "a [pem]"), (f"{head}{body}{end} - {head}{body}{end}", "[pem] - [pem]")):
        assert secrets.redact(text, secrets.spans_text(secrets.find(text))) == want
    assert secrets.find("://" + "x" * 300_000 + ":" + "y" * 300_000) == []
    assert secrets.find("http://host:8080/path a@b") == []


def test_ledger_scans_only_unseen_blobs(spark, make_docs, tmp_path):
    first = make_docs([(1, TEXTS[1]), (2, TEXTS[1]), (3, None), (4, "")], clash=True)
    second = make_docs([(5, TEXTS[1]), (6, TEXTS[4]), (7, TEXTS[4])])
    ledger = secrets.BlobLedger(spark, str(tmp_path / "l")).update(first).update(second)
    sizes = [spark.read.parquet(b).count() for b in ledger.batches]
    assert sorted(sizes) == [1, 2]
    assert [r.n_access for r in ledger.paths(second, ["doc_id"]).orderBy("doc_id").collect()] == [0, 1, 1]
    assert ledger.paths(first, ["doc_id"]).count() == 4
    again = secrets.BlobLedger(spark, ledger.path, rule_version=2)
    assert len(again.batches) == 2
    again.update(second)
    assert spark.read.parquet(again.batches[-1]).count() == 2       # a new rule version scans again


def test_ledger_reopened_and_failed_updates(spark, make_docs, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    docs = make_docs([(1, TEXTS[1]), (2, TEXTS[4]), (3, None), (None, TEXTS[4])])
    assert secrets.BlobLedger(spark, path).rows().count() == 0
    with pytest.raises(Exception):
        secrets.BlobLedger(spark, path).update(docs.withColumn("text", F.raise_error(F.lit("lost")).cast("string")))
    assert secrets.BlobLedger(spark, path).batches == []
    secrets.BlobLedger(spark, path).update(docs)                     # the retry meets the same folder
    opened = secrets.BlobLedger(spark, path)
    assert opened.findings().count() == 3
    scanned = []
    monkeypatch.setattr(secrets, "scan", lambda blobs, scan=secrets.scan: scanned.append(blobs.count()) or scan(blobs))
    opened.update(docs.unionAll(make_docs([(9, "token=abcdefghij")])))
    assert scanned == [1]
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access) for r in opened.paths(docs, ["doc_id"]).collect()) == [
        (0, 0, 1), (1, 1, 0), (2, 0, 1), (3, 0, 0)]
    # two updates of one moment may both scan a blob; its findings count once
    with monkeypatch.context() as m:
        m.setattr(secrets.BlobLedger, "rows", lambda self: spark.createDataFrame([], secrets.FINDINGS + ", rule_version int"))
        opened.update(docs)
    assert opened.rows().count() == 7 and opened.paths(docs, ["doc_id"]).count() == 4


def test_secret_query_equals_brute_force_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in secrets.op4_secret_scan(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) == len({r.doc_id for r in docs})
    for r in docs:
        want = brute_spans(r.text or "")
        count = Counter(w.split(":")[0] for w in want)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == (count["assign"], count["access"], count["hex"])
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in g.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want


def test_near_dedup_query_equals_brute_force_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs]
    want = brute_components(prints)
    got = simhash.op6_simhash_near_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (k, f"{f:016x}", want[f]) for k, f in prints)


def test_redaction_stage(spark, make_docs):
    rows = list(enumerate(TEXTS)) + [(99, None), (1, TEXTS[1])]
    df = make_docs(rows, clash=True)
    out = secrets.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        if r.text is not None:
            assert r.n_chars == len(r.text) and not brute_spans(r.text)
    assert secrets.redact("a token=0123456789abcdef0123456789abcdef z", "assign:2:40,hex:8:40") == "a [assign] z"
    assert secrets.scan_all(spark, make_docs([]), ["doc_id"]).count() == 0
