"""URL filter and Merkle manifest: oracle, brute force and edge rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from connlearn.llm import merkle, urlfilter

from .test_native import oracle

URLS = ["http://A.Example.NET/en/x", "https://example.net", "http://example.net/en", "http://x.example.com/de/?q#f",
        "ftp://example.com/DE/", "http://b.org/fr/", "http://borg/fr/", "http://net/", "http://notnet/a", "net/",
        "http://net?x=http://a.net/", "http://a..net//", "http://.net/", "x://a.net:80/", "http://é.net/\n/en/", "://", "", None,
        "http://example.net/en/" + "s/" * 20_000, "http://" + "a." * 20_000 + "net/q"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_oracles(spark):
    for module in (urlfilter, merkle):
        for name in module.QUERIES:
            res = oracle(spark, module, name)
            assert res["ok"], res


def page_rows(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")


def test_url_query_edges(spark, tables):
    df = page_rows(spark, URLS + URLS[:3]).withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.op11_url_filter(spark, tables(pages=df)).collect()}
    assert got == {i: brute(u, urlfilter.RULES) for i, u in enumerate(URLS + URLS[:3])}
    assert urlfilter.op11_url_filter(spark, tables(pages=df.limit(0))).count() == 0


def test_many_rules_by_trie_and_by_join(spark):
    rng = random.Random(5)
    hosts = ["", "net", "a.net", "b.a.net", "org", "x.org", "a", "b.a"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "//", "/en//", "/é/"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in itertools.product(hosts, paths) if rng.random() < 0.5]
    rules += [(h, p, "block") for h, p, _ in rules[:10]]
    urls = ["http://" + ".".join(rng.choices(["a", "b", "x", "net", "org", ""], k=rng.randint(1, 4)))
            + "/".join(["", *rng.choices(["", "e", "en", "x", "enx", "é"], k=rng.randint(0, 4))]) for _ in range(400)]
    df, table = page_rows(spark, urls + URLS), spark.createDataFrame(rules, urlfilter.RULE_SCHEMA)
    want = sorted((i, *brute(u, rules, "block")) for i, u in enumerate(urls + URLS))
    for size in (urlfilter.TRIE_BYTES, 0):
        out = urlfilter.judge(df, table, default="block", trie_bytes=size)
        got = sorted(tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect())
        assert [(g[0], g[3] is None, g[3] or "", g[4]) for g in got] == [(w[0], w[3] is None, w[3] or "", w[4]) for w in want]
        assert urlfilter.judge(df, table.limit(0), trie_bytes=size).filter("verdict = 'allow'").count() == len(urls + URLS)


def test_wrong_rules_are_errors(spark):
    df = page_rows(spark, URLS[:2])
    for bad in [(None, "/", "allow"), ("a/b", "/", "allow"), ("a", None, "allow"), ("a", "/", "maybe"), ("a", "/", None)]:
        with pytest.raises(Exception, match="not a rule"):
            urlfilter.judge(df, spark.createDataFrame([bad], urlfilter.RULE_SCHEMA)).collect()
    with pytest.raises(ValueError, match="there already"):
        urlfilter.judge(df.withColumn("host", F.lit(1)), spark.createDataFrame([], urlfilter.RULE_SCHEMA))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_merkle(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded, verified) per row."""
    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i:i + fanout])) for i in range(0, len(now), fanout)])
        return levels

    def siblings(levels, pos):
        out = []
        for level in levels[:-1]:
            lo = pos // fanout * fanout
            run = level[lo:lo + fanout]
            out.append(("".join(run[:pos - lo]), "".join(run[pos - lo + 1:])))
            pos //= fanout
        return out
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0))
        trees[s] = tree([sha("".join(map(field, r))) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    res = []
    for k, s in enumerate(sources):
        for pos, r in enumerate(by[s]):
            path = siblings(trees[s], pos) + siblings(top, k)
            leaf = at = trees[s][0][pos]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                low = re.sub("[A-Z]", lambda m: m.group().lower(), r[4])
                at = sha("".join(map(field, (*r[:4], low))))
            for left, right in path:
                at = sha(left + at + right)
            res.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return res


def manifest_rows(n_hot, sources):
    rows = [(i * 3, "hot", "en", 4, f"Text {i} É") for i in range(n_hot)]
    rows += [(1000 + i, f"s{i:03}", None, None, "Lone") for i in range(sources)]
    rows += [(7, None, "de", 2, ""), (None, None, "de", None, None), (8, "", "fr", 9, "Aa" * 50_000), (9, "é", "x", 1, None),
             (10, "two", "x", 1, "B"), (11, "two", "x", 1, "lower")]
    return rows


@pytest.mark.parametrize("n_hot, sources", [(0, 0), (1, 1), (300, 20), (17, 260)])
def test_manifest_against_brute_force(spark, tables, n_hot, sources, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rows = manifest_rows(n_hot, sources)
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, pos string")
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, tables(documents=df)).collect()]
    assert sorted(got, key=str) == sorted(brute_merkle(rows, 16), key=str)
    assert not all(g[6] for g in got) or n_hot < 10


def test_manifest_other_fanout_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "ab"[i % 2], None, None, "T") for i in range(30)] + [(5, "b", None, None, "T")] * 40
    df = spark.createDataFrame([(r[0], r[1], sha("".join(map(field, r))), "y") for r in rows],
                               "doc_id long, source string, leaf string, g string")
    tree = merkle.manifest(df, "source", ["doc_id"], fanout=3)
    got = tree.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"),
                      merkle.fold(F.col("leaf"), F.col("path")).alias("f"), "g").collect()
    want = brute_merkle([(*r[:4], r[4]) for r in rows], 3)
    assert all(r.f == r.root and r.g == "y" for r in got)
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.p) for r in got) == sorted(w[:5] for w in want)


def test_manifest_empty(spark, make_docs, tables):
    assert merkle.op13_merkle_manifest(spark, tables(documents=make_docs([]))).count() == 0
