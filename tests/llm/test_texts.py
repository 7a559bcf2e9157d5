"""BPE, WARC, language id, SpotSigs and toxicity: exact references, round
trips, held-out accuracy and edge rows."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from connlearn.llm import bpe, langid, spotsigs, toxicity, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, make_docs, reference):
    rng = random.Random(5)
    odd = "ab'st rev l d m\n\t \x1c\x85\xa0 09²½ªÀ×÷.,!-_'ſΩあ漢😀​٣Ⅷ<|endoftext|>"
    texts = ["".join(rng.choice(odd) for _ in range(60)) for _ in range(200)]
    texts += [None, "", " ", "a" * 5000, "xyz" * 300 + " we're", "été " * 50, "x", "x"]
    df = make_docs([(i if i % 9 else None, t) for i, t in enumerate(texts)], clash=True)
    ids = bpe.encode(df.drop("ids"))
    want = Counter(tuple(reference.encode_ordinary(t or "")) for t in texts)
    assert Counter(tuple(r.ids) for r in ids.collect()) == want
    back = Counter(bytes(r.data) for r in bpe.decode(ids).collect())
    assert back == Counter((t or "").encode() for t in texts)


def test_bpe_words_of_any_length(reference):
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(7)
    for n in (2, 40, 255, 256, 900, 1024, 1025, 3000):
        word = bytes(rng.choice(b"abetnisro\xc3\xa9") for _ in range(n)).decode("latin-1")
        got = next(codec.encode([word]))
        assert got == b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(word))


def test_bpe_caches_forget_and_memory_is_bounded(reference, monkeypatch):
    """Frequent words stay when the cache is full, and neither forgetting nor many
    distinct long words in one text change an id or need a folder to spill to."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}x" for i in range(200)], k=30)) + " the end" for _ in range(40)]
    for at in range(0, 40, 4):
        assert list(c.encode(iter(texts[at:at + 4]))) == [
            np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts[at:at + 4]]
    assert " the" in c.words and len(c.words) <= 50
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=900)) for _ in range(300))
    got = list(c.encode(iter([text])))[0]
    assert got == np.array(reference.encode_ordinary(text), "<u4").tobytes()
    assert c.db.sql("SELECT current_setting('temp_directory')").fetchall()[0][0] in ("", None)


def test_bpe_query_on_whole_tables(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op9_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_bpe_edges(spark, make_docs):
    assert bpe.encode(make_docs([])).count() == 0
    bad = spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().data) == b""


PAGE = "x" * 120
PAGES = [(1, "u1", PAGE), (2, "u2", PAGE), (3, None, PAGE), (4, "a\r\nb", "short"), (5, "u", "short"), (6, "u6", None),
         (7, "u7", "é\r\n\r\nWARC/1.0\r\n\r\n" + "y" * 100 + "\r\n"), (8, "u", "\r\r\n\r\n\r\r" * 50), (None, "n", PAGE),
         (9, "d", PAGE), (9, "d", PAGE), (10, "z", "q" * 100 + "\r\n\r\n"), (11, "z", "w" * 100 + "\r")]


def test_warc_round_trip(spark, tables):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit("x"))
    got = warc.op1_warc_transactions(spark, tables(pages=pages)).collect()
    want = Counter()
    for page, _, html in PAGES:
        body = (html or "").encode()
        again = html == PAGE and page != 1
        want[(page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
              1 if again else None)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_warc_query_on_whole_tables(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = warc.op1_warc_transactions(spark, SF).collect()
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id]
        again = len(body) >= 100 and first[body] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (
            len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
            first[body] if again else None)


def test_warc_assembly_directions_and_parts(spark, monkeypatch):
    rec = "warc_type string, record_id string, concurrent_to array<string>, note string"
    rows = [("response", "r1", [], "a"), ("request", "q1", ["r1"], "b"), ("metadata", "m1", ["q1"], "c"),
            ("response", "r2", ["q2"], "d"), ("request", "q2", [], "e"), ("metadata", "m2", ["r2"], "f"),
            ("revisit", "r3", [], "g"), ("metadata", "lost", ["nowhere"], "h"), ("response", "r1", [], "a")]
    df = spark.createDataFrame(rows, rec)
    got = {r.record_id: r for r in warc.assemble(df).collect()}
    shape = {k: (v.copies, [x.record_id for x in v.requests], [x.record_id for x in v.metadata]) for k, v in got.items()}
    assert shape == {"r1": (2, ["q1"], ["m1"]), "r2": (1, ["q2"], ["m2"]), "r3": (1, [], [])}
    monkeypatch.setattr(warc, "PART", 10)
    many = spark.createDataFrame(rows[:1] + [("metadata", f"x{i}", ["r1"], "") for i in range(95)], rec)
    parts = warc.assemble(many).collect()
    assert len(parts) > 5 and sorted(m.record_id for r in parts for m in r.metadata) == sorted(
        f"x{i}" for i in range(95))
    assert warc.assemble(df.limit(0)).count() == 0


def test_warc_truncated_archive_fails(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([("WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nabc",)],
                                              "value string"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="truncated record"):
        warc.read_archives(spark, str(tmp_path / "t")).collect()


def test_language_id_accuracy(spark):
    got = langid.op2_language_id(spark, "/root/testdata/sf0.1")
    lang = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    r = got.join(lang, "doc_id").filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("acc"), F.count("*").alias("n"),
        F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.n > 2000 and r.acc >= 0.98 and 0 <= r.lo and r.hi <= 1


def test_language_id_edges(spark, make_docs, tables):
    en, de = "the cat and the dog were with the man ", "der hund und die katze sind nicht in dem haus "
    rows = [(i, (en if i % 2 else de) * 4, "s", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "123 !?"), (103, "²½"), (104, en * 3), (None, de * 3), (105, en * 2000)]
    sf = tables(documents=make_docs(rows, clash=True))
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102, 103))
    assert (got[104].lang_pred, got[None].lang_pred, got[105].lang_pred) == ("en", "de", "en")
    assert not got[100].accepted and got[104].accepted
    empty = langid.op2_language_id(spark, tables(documents=make_docs([])))
    assert empty.count() == 0


def brute_jaccard(a, b):
    a, b = Counter(a), Counter(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_language_id_refuses_too_many_languages(spark):
    df = spark.createDataFrame([(i, f"some text {i}", f"l{i % 5}") for i in range(20)], "doc_id long, text string, lang string")
    assert len(langid.dictionaries(df, most_langs=5)) == 5
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.dictionaries(df, most_langs=4)


def test_spotsigs_edits(spark, make_docs):
    rng = random.Random(2)
    vocab = "the of and cat dog run sky sea red blue ist der haus".split()
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for i in rng.sample(range(500), 120)]
    rows += [(777, None), (778, ""), (779, "é" * 7)]
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(make_docs(rows, clash=True), rows_per_block=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = map(spotsigs.signatures, (t, edited, after))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.fingerprint(a), spotsigs.fingerprint(b))
        assert (r.near_edited, r.near_next) == (brute_jaccard(a, b), brute_jaccard(a, c))


def test_spotsigs_repeated_and_null_ids(spark, make_docs):
    rows = [(None, "the red cat sat")] * 30 + [(5, "of blue sky run %d" % i) for i in range(30)] + [(5, "of blue sky run 1")]
    out = spotsigs.fingerprint_edits(make_docs(rows), rows_per_block=4)
    assert Counter((r.doc_id, r.n_chars) for r in out.collect()) == Counter((d, len(t)) for d, t in rows)
    assert spotsigs.fingerprint_edits(make_docs([])).count() == 0
    assert spotsigs.fingerprint_edits(make_docs([(1, "the red cat sat")])).first().near_next == 1.0


def test_spotsigs_pairs_equal_brute_force(spark, make_docs):
    rng = random.Random(4)
    vocab = ["w%s" % chr(97 + i) * 2 for i in range(26)] + ["the", "of"] * 8
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.randrange(3)):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            rows.append((len(rows), " ".join(v)))
    rows += [(900, rows[0][1]), (901, None), (902, "")]
    pairs, member = spotsigs.similar_pairs(spotsigs.signature_sets(make_docs(rows), "doc_id"))
    sets = {d: spotsigs.signatures(t or "") for d, t in rows}
    reps = {}
    for d in sorted(sets):
        reps.setdefault(tuple(sets[d]), d)
    assert {r.key: r.rep for r in member.collect()} == {d: reps[tuple(s)] for d, s in sets.items()}
    want = {}
    named = [(r, list(s)) for s, r in reps.items() if s]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            if (j := brute_jaccard(x, y)) >= 0.8:
                want[tuple(sorted((a, b)))] = j
    assert want and {tuple(sorted((r.a, r.b))): r.likeness for r in pairs.collect()} == want


def test_likeness_pruning_keeps_exact_values():
    rng = random.Random(9)
    for _ in range(500):
        a, b = (sorted(rng.choices(range(12), k=rng.randrange(12))) for _ in range(2))
        j = brute_jaccard(a, b)
        assert spotsigs.likeness(a, b) == j
        assert spotsigs.likeness(a, b, 0.5) == (j if j >= 0.5 else spotsigs.likeness(a, b, 0.5)) and (
            j >= 0.5 or spotsigs.likeness(a, b, 0.5) < 0.5)


def test_likeness_keeps_pairs_at_exactly_the_threshold(spark):
    assert spotsigs.likeness(list(range(28)), list(range(35)), 0.8) == 0.8
    for least, p, q in ((0.8, 4, 5), (0.9, 9, 10), (0.7, 7, 10), (0.6, 3, 5)):
        for k in range(1, 60):
            assert spotsigs.likeness(list(range(p * k)), list(range(q * k)), least) == least, (least, k)
    sets = spark.createDataFrame([(1, list(range(28))), (2, list(range(35)))], "key long, sigs array<long>")
    pairs, _ = spotsigs.similar_pairs(sets, 0.8)
    assert [r.likeness for r in pairs.collect()] == [0.8]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    n = Counter((r.toxic, r.predicted) for r in got.filter("held_out").join(labels, "doc_id").collect())
    assert n[1, 1] / (n[1, 0] + n[1, 1]) >= 0.9 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.03


def test_toxicity_restores_and_handles_edges(spark, make_docs):
    rng = random.Random(1)
    clean = "lion river music stone garden window market yellow paper travel".split()
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) + rng.choice(["", "s", "ing", "ed"]) for _ in range(20)]
        bad = i % 4 == 0
        if bad:
            w[3] = w[9] = "blorgface"
        rows.append((i, " ".join(rng.sample(w, len(w)))))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (0, 1)]
    docs = make_docs(rows + [(1000, None), (1001, "")], clash=True)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    test = ["what a bl0rgf@ce river", "b l o r g f a c e music", "bloooorgface", "b.l.o.r.g.f.a.c.e stone", "quiet river",
            "", None, "x" * 50_000, "9dd3c80004c73dc9e548fee51b23b527780d4f20"]
    got = {r.doc_id: r for r in toxicity.score(make_docs(list(enumerate(test))), model).collect()}
    assert [got[i].predicted for i in range(len(test))] == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert got[6].score == 0 and got[5].score == 0
    none = toxicity.fit(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.strong == {} and toxicity.score(make_docs([(1, "anything")]), none).first().predicted == 0


def test_toxicity_word_boundaries_and_long_runs(spark, make_docs):
    rng = random.Random(3)
    clean = "the you are a big person lion river music stone garden window and was thing well they".split()
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            w[3] = w[9] = "stupid"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    run = "theyouareabigpersonandthethingwas"
    bad = ["you are a s t u p i d person", "b i g s t u p i d", "well,5tup1d", "x/y/stup1d/z", "the-$tupid.and",
           " ".join(run + "stupid" + run), "x/y/" * 40 + "stup1d" + "/abc" * 40, "stuppid", "2024/01/02/5tupid", "stup!d" + "," * 3 + "well", "s.t.u.p.i.d,the"]
    good = ["you are a b i g person", " ".join(run * 3), "x/y/" * 100, "a1" * 30_000, "xxyyzz" * 5000, "well!! the*** 2024/01/02"]
    m = toxicity.Model(model.lm, model.strong, model.stems)
    assert [t for t in bad if m.score(t) < toxicity.THRESHOLD] == []
    assert [t[:50] for t in good if m.score(t) >= toxicity.THRESHOLD] == []
    assert toxicity.written_oddly("great idio+ a$$ f4") == ["idio+", "a$$"]


def test_strongest_is_the_best_of_all_features():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcéя", k=rng.randint(1, 40))) for _ in range(300)] + ["", "a" * 70]
    strong = {g: 0.5 + rng.random() / 2 for w in words for g in toxicity.grams(w) if rng.random() < 0.3}
    for w in words + [w[:5] + "zz" for w in words]:
        assert toxicity.strongest(w, strong) == max(strong.get(g, 0.0) for g in toxicity.grams(w))


def trained(spark, make_docs, clean, toxic, n=400):
    rng = random.Random(5)
    rows = [(i, " ".join([rng.choice(clean) for _ in range(25)] + [toxic] * (i % 4 == 0))) for i in range(n)]
    return toxicity.fit(make_docs(rows + rows[:3]),
                        spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int"))


def test_toxicity_of_any_script_and_whole_words(spark, make_docs):
    m = trained(spark, make_docs, "мир дом река город книга время слово рука".split(), "мерзота")
    for t in ("мерзота", "м е р з о т а", "мер3ота", "мерз0та", "мерзот@", "меррррзота", "мepзoтa дом"):
        assert m.score(t) >= toxicity.THRESHOLD, t
    for t in ("мир дом река", "г о р о д", "вре.мя 300", "Ελλάδα слово"):
        assert m.score(t) < toxicity.THRESHOLD, t
    # two words that are equal in their first thirty letters are two features
    start = "pa" * 15
    m = trained(spark, make_docs, [start + "clean", "river", "stone", "market"], start + "blorg")
    assert m.score(start + "blorg") >= toxicity.THRESHOLD > m.score(start + "clean")
    assert m.strong.keys().isdisjoint({toxicity.zlib.crc32(f"^{start}"[:k].encode()) for k in (5, 6, 7, 8)})


def test_toxicity_of_dense_stems(spark, make_docs):
    """A stem that clean texts have once and toxic ones often counts where it is often."""
    rng = random.Random(6)
    ends = ["an", "er", "ing", "um", "est", "oly"]
    rows = [(i, " ".join([rng.choice(["lion", "river", "stone", "paper"]) for _ in range(60)]
                         + ["gromb" + rng.choice(ends) + rng.choice(ends) for _ in range(4 if i % 5 == 0 else 1)]))
            for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.fit(make_docs(rows), labels)
    got = [m.score(t) >= toxicity.THRESHOLD for _, t in rows]
    assert got == [i % 5 == 0 for i, _ in rows]
    assert m.score("gr0mbaner lion g r o m b i n g u m river") >= toxicity.THRESHOLD
    assert m.score("grombaner " + "lion " * 400 + "grombumum") < toxicity.THRESHOLD


def test_skeletons_lose_no_restored_word(spark, make_docs):
    """Without the gate, no written token restores to a word that counts."""
    toxic = ["stupid", "idiot", "loser", "clown", "blorgface", "гадость"]
    model = trained(spark, make_docs, "lion river music stone garden window paper книга город".split(), " ".join(toxic))
    m = toxicity.Model(model.lm, model.strong, model.stems)
    assert set(toxic) <= set(m.stems)
    rng = random.Random(8)
    back = {}
    for table in (toxicity.LATIN, toxicity.CYRILLIC):
        for c, v in table.items():
            for x in v:
                back.setdefault(x, []).append(c)
    passed = 0
    for _ in range(1500):
        w = rng.choice(toxic) if rng.random() < 0.6 else "".join(rng.choices("abcdefilostrу", k=rng.randint(3, 9)))
        sep = rng.choice(["", "", ".", "-", "|", "+", " ", "$", "("])
        seen = sep.join(rng.choice(back.get(c, [c])) if rng.random() < 0.3 else c * rng.choice([1, 1, 1, 2, 3]) for c in w)
        seen = rng.choice(["", "x/", "well,"]) + seen + rng.choice(["", "!", "/y", "s"])
        every = [x for x in toxicity.restored_words(seen, m.lm, m.known) if m.strength(x) >= toxicity.ONCE]
        gated = [x for x in toxicity.restored_words(seen, m.lm, m.known, m.skeletons.may_hold)
                 if m.strength(x) >= toxicity.ONCE]
        assert every == gated, seen
        passed += bool(every)
    assert passed > 300


def test_toxicity_of_megabytes_of_odd_tokens(spark, make_docs):
    m = trained(spark, make_docs, "lion river music stone garden window paper".split(), "stupid blorgface")
    for text in ("x y z q " * 250_000, "ab/cd3/" * 300_000, "qqwwzz" * 300_000, "a1" * 1_000_000):
        assert m.score(text) < toxicity.THRESHOLD
        assert m.score(text + " 5tup1d") >= toxicity.THRESHOLD


def plain_score(m, text):
    """The score from every word and token of the text, nothing remembered or told by how words begin."""
    def strength(w):
        likelier = m.likelier(w) if toxicity._TWICE.search(w) else []
        return max(toxicity.strongest(x, m.strong) for x in [w, *likelier])

    every = toxicity._WORD.findall(text.lower())
    odd = [x.group() for x in toxicity._SPACED.finditer(text)]
    for t in text.split():
        plain = t.isalpha() or t.strip(".,;:?").isalpha()
        if (toxicity._TRIPLE if plain else toxicity._ODD).search(t) or toxicity._MIXED.search(t):
            odd.append(toxicity._EDGE.sub("", t))
    odd = list(dict.fromkeys(t for t in odd if len(t) > 2))
    assert toxicity.written_oddly(text) == odd
    hidden = [[w for w in toxicity.restored_words(t, m.lm, m.known, m.skeletons.may_hold) if w not in every] for t in odd]
    plain = [strength(w) for w in set(every)]
    found = [s for s in [*plain, *(max(map(strength, got), default=0.0) for got in hidden)] if s >= toxicity.ONCE]
    often = Counter(toxicity.dense_feature(g) for w in [*every, *(w for got in hidden for w in got)] for g in toxicity.grams(w))
    dense = [m.strong[g] for g, k in often.items() if g in m.strong and k > 1 and k * toxicity.DENSE >= len(every)]
    found += [max(dense)] if dense else []
    return 1.0 - math.prod(1.0 - s for s in found) if found else 0.05 * max(plain, default=0.0)


@pytest.fixture
def toxic_model(spark, make_docs):
    rng = random.Random(7)
    ends = ["an", "er", "ing", "um", "est", "oly"]
    rows = [(i, " ".join([rng.choice("lion river stone paper gros город été".split()) for _ in range(60)]
                         + ["gromb" + rng.choice(ends) + rng.choice(ends) for _ in range(4 if i % 5 == 0 else 1)]
                         + "stupid assess loser гадость".split() * (i % 5 == 0) + ["weak"] * (i % 5 == 0 or i % 12 == 1)))
            for i in range(400)]
    return toxicity.fit(make_docs(rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))


def test_scores_equal_a_reading_of_every_word_and_token(toxic_model, monkeypatch):
    m = toxicity.Model(toxic_model.lm, toxic_model.strong, toxic_model.stems)
    assert m.dense_starts and any(0 < s < toxicity.ONCE for s in m.strong.values())
    rng = random.Random(10)
    words = ("lion river gross Stone letter, loser. (losser) STUPID stuppid stttupid asses assess weak weeak grombaner grombingum "
             "groommbanum gr0mban 5tup1d $tupid s.t.u.p.i.d s-t-u-p-i-d, idio+ гадость гадoсть гaадость été étété İİ Σας ΣΑΣ² x1 "
             "a$$e$$ 3rd a b c 2024/01/02 lion/stup1d/paper _a_b_c_ d... wеak").split() + ["s t u p i d", "g r o m b a n", "l.o s e.r", "Loooser" + "r" * 130]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", " ", ", ", "\x1f"]) for _ in range(rng.randint(0, 9)))
             + "lion river " * rng.choice([0, 0, 5, 200]) for _ in range(600)]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 12)
    got = [m.score(t) for t in texts]
    assert got == pytest.approx([plain_score(m, t) for t in texts], abs=1e-12)
    assert 100 < sum(s >= toxicity.THRESHOLD for s in got) < 500 and any(0 < s < 0.05 for s in got)
    assert [m.score(t) for t in texts] == got and len(m.nothing) <= 13


def test_tokens_that_tell_nothing_are_looked_at_once(toxic_model, monkeypatch):
    m = toxicity.Model(toxic_model.lm, toxic_model.strong, toxic_model.stems)
    hashed, looked = [], []
    strongest, search = toxicity.strongest, toxicity._WORD

    class Word:
        def findall(self, text):
            looked.append(text)
            return search.findall(text)

    monkeypatch.setattr(toxicity, "strongest", lambda w, strong: hashed.append(w) or strongest(w, strong))
    monkeypatch.setattr(toxicity, "_WORD", Word())
    text = " ".join(f"{a}{b}word, re{a}d{b}-été" for a in "bcdfg" for b in "bcdfg")
    assert m.score(text) == 0.0 and hashed == []
    looked.clear()
    assert m.score(text + " lion") == 0.0 and m.score(text + " stupid") >= toxicity.THRESHOLD
    assert hashed == ["stupid"] and "".join(looked) == "stupid"
