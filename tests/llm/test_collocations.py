"""Phrase collocations: oracle, brute force, sorting kernel and edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from connlearn.llm import collocations as co

from .test_native import oracle


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    dropped = {(lang, g[i:i + k]) for (lang, g), v in f.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
               if 100 * v >= 100 * f[lang, g[i:i + k]]}
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1 and (lang, g) not in dropped:
            s, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], s))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, res = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            res.append((r[0], seen[r[0]], *r[1:]))
    return sorted(res)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sample(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "New", "york", "é", "big-x", "#", "a\x1cb", "z y"] + [f"w{i}" for i in range(30)]
    out = []
    for _ in range(n):
        text = "".join(rng.choices(vocab, [30, 5, 20, 6, 6, 3, 3, 2, 2, 2] + [1] * 30)[0]
                       + rng.choices([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "], [60, 4, 2, 3, 2, 2, 1, 1])[0]
                       for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return out + [(out[0][0], "en")] * 20 + [(None, "en"), ("", None), (" \t.\n", "xx")]


@pytest.mark.parametrize("hot_least, held, chunk", [(2_000, 1 << 20, 4 << 20), (5, 300, 200), (60, 50, 64)])
def test_against_brute_force(spark, make_docs, monkeypatch, hot_least, held, chunk):
    rows = sample(3, 250)
    docs = make_docs([(i, t, None, lang) for i, (t, lang) in enumerate(rows)], clash=True)
    for name, v in (("HOT_LEAST", hot_least), ("HELD_SUFFIXES", held), ("CHUNK_BYTES", chunk), ("HELD_WORDS", held),
                    ("FEWEST_BUCKETS", 7)):
        monkeypatch.setattr(co, name, v)
    # the workers run the module as installed: the parameters travel by the driver's plan only where they are passed
    for least, top in ((4, 2000), (9, 5)):
        got = rows_of(co.collocations(docs, least=least, top=top))
        assert got == brute(rows, least, top) and got


def test_oracle(spark):
    res = oracle(spark, co, "op12_phrase_collocations")
    assert res["ok"], res


def test_buffers_and_cuts(monkeypatch):
    rows = sample(5, 120)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for _, lang in rows]), pa.array([t or "" for t, _ in rows])],
                                       names=["lang", "text"])

    def counts():
        out = Counter()
        for b in co.count_words([batch.slice(0, 40), batch.slice(40)]):
            for lang, w, n in zip(*[c.to_pylist() for c in b.columns]):
                out[lang, w] += n
        return out
    want = counts()
    monkeypatch.setattr(co, "CHUNK_BYTES", 16)
    monkeypatch.setattr(co, "HELD_WORDS", 10)
    assert counts() == want and sum(want.values()) > 2000


def test_quicksort_counts_and_hot_routes():
    rng = np.random.default_rng(2)
    ids = rng.choice(np.array([0, 11, 12, 13, 14, 15, 2**63 + 5], np.uint64), 4000, p=[.1, .4, .2, .1, .1, .05, .05])
    every = np.full(1 << (co.BITS_LEAST - 3), 255, np.uint8)
    rows = co.suffixes(ids, every, co.BITS_LEAST)
    want = Counter()
    for piece in re.findall(r"[^a]+", "".join("abcdefg"[[0, 11, 12, 13, 14, 15, 2**63 + 5].index(x)] for x in ids.tolist())):
        want.update(piece[i:i + m] for m in range(2, 6) for i in range(len(piece) - m + 1))
    name = dict(zip(np.array([11, 12, 13, 14, 15, 2**63 + 5], np.uint64).view(np.int64).tolist(), "bcdefg"))
    for hot in ([], [11], [11, 12], [11, 12, 13, 14, 15]):
        hot = np.array(hot, np.uint64)
        got = Counter()
        distinct, n = co.distinct_rows(rows)
        bucket, lead = co.routed(distinct, hot, 5)
        for b in range(5):
            one = bucket == b
            for p, c in co.mine(distinct[one], n[one], 30, False, lambda r, d: d < 5 and all(x in hot.tolist() for x in r[:d].tolist())):
                got["".join(name[x] for x in p)] += c
        counted, c = co.hot_phrases(distinct, n, lead)
        for p, k in co.mine(counted, c, 30, True):
            got["".join(name[x] for x in p)] += k
        assert got == {k: v for k, v in want.items() if v >= 30}, hot


def test_shared_hashes_are_salted(spark):
    words = spark.createDataFrame([("en", "a", 200), ("en", "b", 1)], "lang string, word string, f long")
    assert co.distinct_salt(words, 100) == 0
    twice = words.unionByName(words.filter("word = 'a'"))
    ids = {r.i for r in twice.select(co.word_key(0).alias("i")).collect()}
    assert co.WordIds("en", 0)[b"a"] in {i % 2**64 for i in ids}


def test_empty_and_infrequent(spark, make_docs, tables):
    assert co.op12_phrase_collocations(spark, tables(documents=make_docs([]))).count() == 0
    docs = make_docs([(1, "a b c"), (2, None), (None, "x" * 100_000)])
    assert co.collocations(docs).count() == 0


def test_one_long_text(spark, make_docs):
    rows = [("one two, three four five six\n" * 20_000 + "y" * 1_000_000, "en")]
    docs = make_docs([(1, rows[0][0], None, "en")])
    assert rows_of(co.collocations(docs)) == brute(rows, 100)
