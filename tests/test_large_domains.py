"""Vocabularies and category domains that do not fit a literal."""

import random

import pytest
from pyspark.sql import functions as F

from connlearn import (category_dictionary, class_frequency, dictionary_index, dictionary_widths, encode_categories,
                       gram_index, hash_collisions, hashed_slots, label_vocabulary, multinomial_label, read_dictionary,
                       row_split, sparse_slots)
from connlearn.operators.encode import index_col


def vocabulary(spark, entries):
    return spark.createDataFrame(list(entries), "label string, class_id long")


def test_index_equals_literal(spark):
    rng = random.Random(1)
    letters = "abé\U0001F600."
    words = ["".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(150)]
    words = list(dict.fromkeys(words))
    labels = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "a"]
    df = spark.createDataFrame(list(enumerate(labels)) + [(900, labels[0])], "id int, label string")
    table = vocabulary(spark, [(w, i) for i, w in enumerate(words)])
    for vocab, tab in ((words, table), ([w for w in words if w], table.filter("label <> ''"))):
        literal = vocab if len(vocab) == len(words) else None
        got = {(r.id, r.label): r["class"] for r in multinomial_label(df, tab, drop_unknown=False).collect()}
        for (i, lab), c in got.items():
            hits = [k for k, w in enumerate(words) if w in vocab and lab is not None and w in lab]
            assert c == (max(hits) if hits else -1.0), (lab, c)
        if literal:
            want = {(r.id, r.label): r["class"] for r in multinomial_label(df, words, drop_unknown=False).collect()}
            assert {k: v for k, v in got.items() if k[1] is not None} == {k: v for k, v in want.items() if k[1] is not None}
        assert len(got) == 304 and got[(300, None)] == -1.0


def test_hundred_thousand_entries(spark):
    vocab = spark.range(100_000).select(F.concat(F.lit("k"), F.hex(F.col("id") * 7919)).alias("label"), F.col("id").alias("class_id"))
    rows = spark.range(2_000).select("id", F.concat(F.lit("x-k"), F.hex(F.col("id") * 50 * 7919), F.lit(".")).alias("label"))
    got = {r.id: r["class"] for r in multinomial_label(rows, vocab, drop_unknown=False).collect()}
    entries = {f"k{i * 7919:X}": i for i in range(100_000)}
    for i in range(0, 2_000, 40):
        label = f"x-k{i * 50 * 7919:X}."
        hits = [entries[label[a:b]] for a in range(len(label)) for b in range(a + 2, len(label) + 1) if label[a:b] in entries]
        assert got[i] == max(hits)
    assert len(got) == 2_000
    assert gram_index(vocab).count() == 100_000


def test_index_edges(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, label string")
    empty = vocabulary(spark, [])
    assert {r["class"] for r in multinomial_label(df, empty, drop_unknown=False).collect()} == {-1.0}
    assert multinomial_label(df, empty).count() == 0
    twice = vocabulary(spark, [("ab", 0), ("ab", 5), (None, 9), ("bcd", 7)])
    assert {r.id: r["class"] for r in multinomial_label(df, twice, drop_unknown=False).collect()} == {1: 5.0, 2: -1.0}
    assert multinomial_label(df.limit(0), twice).count() == 0
    names = class_frequency(multinomial_label(df, twice.filter("class_id <> 0"), drop_unknown=False), twice.filter("class_id = 5"))
    assert sorted((r.label or "", r.n) for r in names.collect()) == [("", 1), ("ab", 1)]
    with pytest.raises(ValueError, match="match must be"):
        multinomial_label(df, twice, match="near")


def test_dictionary_equals_indexer(spark, tmp_dir):
    rows = [(f"v{i % 7}", "x" if i % 3 else None, i % 2) for i in range(100)] + [("v0", "y", 5)] * 3
    df = spark.createDataFrame(rows, "a string, b string, c int")
    d = category_dictionary(df, ["a", "b", "c"], f"{tmp_dir}/d")
    model, enc = encode_categories(df.withColumn("c", F.col("c").cast("string")), ["a", "b", "c"])
    got = dictionary_index(df, read_dictionary(spark, f"{tmp_dir}/d"), ["a", "b", "c"]).select("a", "b", "c", "a_index", "b_index", "c_index")
    want = enc.select("a", "b", F.col("c").cast("int"), *[F.col(index_col(c)).cast("long") for c in "abc"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert dictionary_widths(d, ["a", "b", "c"]) == {"a": 8, "b": 3, "c": 4}
    unseen = dictionary_index(spark.createDataFrame([("new", None, 0)], df.schema), d, ["a", "b", "c"]).first()
    assert (unseen.a_index, unseen.b_index) == (7, 2)
    slots = {(r.a, r.b, r.c): r.s for r in sparse_slots(df, d, ["a", "b", "c"], out="s").collect()}
    ix = {(r.a, r.b, r.c): (r.a_index, 8 + r.b_index, 11 + r.c_index) for r in got.collect()}
    assert {k: tuple(v) for k, v in slots.items()} == ix


def test_many_categories_stay_on_the_executors(spark):
    df = spark.range(300_000).select(F.concat(F.lit("k"), (F.col("id") % 200_000).cast("string")).alias("a"))
    d = category_dictionary(df, ["a"])
    stats = d.agg(F.count("*"), F.max("index"), F.count_distinct("index"), F.sum("n")).first()
    assert tuple(stats) == (200_000, 199_999, 200_000, 300_000)
    assert d.filter("index < 100000").agg(F.min("n")).first()[0] == 2
    assert dictionary_index(df, d, ["a"]).agg(F.max("a_index")).first()[0] == 199_999


def test_dictionary_edges(spark):
    df = spark.createDataFrame([(None,), (None,)], "a string")
    d = category_dictionary(df, ["a"])
    assert d.count() == 0 and [r.a_index for r in dictionary_index(df, d, ["a"]).collect()] == [0, 0]
    with pytest.raises(ValueError):
        category_dictionary(df, [])
    assert hashed_slots(df, ["a"], 8).first().slots == []


def test_hash_collisions_counted(spark):
    df = spark.createDataFrame([(f"v{i}", f"w{i % 3}") for i in range(60)], "a string, b string")
    d = category_dictionary(df, ["a", "b"])
    slots = {}
    for r in hashed_slots(df, ["a"], 16).collect():
        slots.setdefault(r.slots[0], set()).add(("a", r.a))
    for r in hashed_slots(df, ["b"], 16).collect():
        slots.setdefault(r.slots[0], set()).add(("b", r.b))
    got = {r["column"]: r for r in hash_collisions(d, 16).collect()}
    for c in "ab":
        shared = [v for s in slots.values() if len(s) > 1 for v in s if v[0] == c]
        assert got[c].n_shared == len(shared) and got[c].n_values == (60 if c == "a" else 3)
        assert got[c].rows_shared == len(shared) * (1 if c == "a" else 20)
        assert got[c].n_slots == sum(any(v[0] == c for v in s) for s in slots.values())


def test_row_split_any_layout(spark):
    rows = [("a", 1)] * 25_000 + [("b", None)] * 3 + [(None, 2), ("c", 3)]
    df = spark.createDataFrame(rows, "k string, v int")
    seen = []
    for n in (1, 4, 8):
        parts = row_split(df.repartition(n), [7, 3], 10)
        seen.append([sorted(((r.k or "", r.v or 0, r["count"]) for r in p.groupBy("k", "v").count().collect())) for p in parts])
    assert seen[0] == seen[1] == seen[2]
    assert sum(c for part in seen[0] for *_, c in part) == len(rows)
    share = next(c for k, _, c in seen[0][0] if k == "a") / 25_000
    assert abs(share - 0.7) < 0.015
    assert [p.count() for p in row_split(df.limit(0), [1, 1], 1)] == [0, 0]
    other = row_split(df, [7, 3], 11)[0].groupBy("k", "v").count().collect()
    assert sorted((r.k or "", r.v or 0, r["count"]) for r in other) != seen[0][0]
    with pytest.raises(ValueError, match="positive integers"):
        row_split(df, [0.5, 0.5], 1)


def test_vocabulary_table_from_labels(spark):
    df = spark.createDataFrame([("dos.",), ("dos.",), ("dosx.",), (None,)], "label string")
    out = multinomial_label(df, label_vocabulary(df.filter("label is not null")), drop_unknown=False)
    assert sorted((r.label or "", r["class"]) for r in out.collect()) == [("", -1.0), ("dos.", 0.0), ("dos.", 0.0), ("dosx.", 1.0)]
