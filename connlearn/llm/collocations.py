"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Every word position is a suffix of up to five words, cut at the end of its
piece. Suffixes are routed by their leading words to buckets; in a bucket,
pointers to them are sorted word by word with three-way partitions, where the
size of a part of equal words is the count of the phrase it stands for, and a
part below the least count is abandoned unsorted.

Three passes over the texts, each a map task with bounded buffers:

1. Word counts per language. Phrases are made of frequent words only, so
   other words end a suffix from here on.
2. Adjacent pairs of frequent words, by hash; the pairs that reach the least
   count become a bitmap. A suffix ends before an infrequent pair.
3. The suffixes that are left, equal ones counted in the task first, packed
   per bucket.

Words are 64-bit hashes of (language, word); that no two words share one is
checked against all words, else the hash is salted anew. Both bitmaps are of
bounded size and only keep suffixes that later turn out infrequent; they never
lose one.

No bucket is hot: a suffix whose first two words are both hot (more
occurrences than a bucket holds) is routed by further words up to the first
that is not hot, or by all five. Phrases of hot words alone are counted
apart, one row per phrase, task and buffer. At most ``n / HOT_MOST + 256``
words are hot (8 bytes each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, read, staged

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN_LANG = "und"
#: Bytes of text turned into words at a time; suffixes and distinct words held before they are passed on.
CHUNK_BYTES, HELD_SUFFIXES, HELD_WORDS = 4 << 20, 1 << 20, 400_000
#: Occurrences that a bucket is meant for; buckets at least; words with more occurrences than
#: n / FEWEST_BUCKETS, though at least HOT_LEAST and at most HOT_MOST, are hot.
BUCKET_WORDS, FEWEST_BUCKETS, HOT_LEAST, HOT_MOST = 1_000_000, 256, 2_000, 4_000_000
#: Bits of a bitmap: 16 for each entry it can have, in this range (2^28 bits are 32 MB).
BITS_LEAST, BITS_MOST = 18, 28
SEED = 42
END = 0xFF                                        # no byte of UTF-8 text
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(END if c in _DELIMITERS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Lower-cased (A-Z) words of whole texts; a byte 255 ends each piece."""
    return b"\xff".join(texts).translate(_TABLE).replace(b"\xff", b" \xff ").split()


def chunks(batches):
    """(lang, tokens) of the (lang, text) rows in ``batches``, about
    CHUNK_BYTES of text at a time. A longer text is cut where a piece ends."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, at = text.encode(), 0
            while len(data) - at > CHUNK_BYTES:
                head = data[at:at + CHUNK_BYTES].translate(_TABLE).rfind(b"\xff") + 1
                if not head:
                    break                          # one piece: kept whole
                yield lang, tokens([data[at:at + head]])
                at += head
            held.setdefault(lang, []).append(data[at:])
            size += len(data) - at
            if size >= CHUNK_BYTES:
                for k, v in held.items():
                    yield k, tokens(v)
                held, size = {}, 0
    for k, v in held.items():
        yield k, tokens(v)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


# -- pass 1 ---------------------------------------------------------------

def count_words(batches):
    held = {}

    def rows():
        langs, words, counts = [], [], []
        for lang, known in held.items():
            known.pop(b"\xff", None)
            langs += [lang] * len(known)
            words += known.keys()
            counts += known.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                                           pa.array(counts, pa.int64())], names=["lang", "word", "f"])
    for lang, toks in chunks(batches):
        known = held.setdefault(lang, {})
        for w in toks:
            known[w] = known.get(w, 0) + 1
        if sum(map(len, held.values())) > HELD_WORDS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words, stored."""
    return staged(map_arrow(texts(docs), count_words, "lang string, word string, f long")
                  .groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")


def word_key(salt: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{salt}:"), F.octet_length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("word")))


def distinct_salt(words: DataFrame, least: int) -> int:
    """The first salt under which no frequent word shares its hash (0 ends a suffix)."""
    salt = 0
    while True:
        shared = words.groupBy(word_key(salt).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
        if shared.filter((F.col("f") >= least) & ((F.col("n") > 1) | (F.col("id") == 0))).isEmpty():
            return salt
        salt += 1


class WordIds(dict):
    """Word -> hash of one language, filled as words come; the piece end is 0."""

    def __init__(self, lang: str, salt: int):
        code = lang.encode()
        self.head = f"{salt}:{len(code)}:".encode() + code
        self[b"\xff"] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
            self[b"\xff"] = 0
        key = self[word] = xxhash.xxh64_intdigest(self.head + word, SEED)
        return key


def id_chunks(batches, salt: int, word_bits: np.ndarray, bits: int):
    """Word hashes (uint64) per chunk; 0 for piece ends and infrequent words."""
    known = {}
    for lang, toks in chunks(batches):
        if lang not in known:
            if len(known) > 256:
                known.clear()
            known[lang] = WordIds(lang, salt)
        ids = np.fromiter(map(known[lang].__getitem__, toks), np.uint64, len(toks))
        ids[~has_bit(word_bits, ids, bits)] = 0
        yield ids


# -- bitmaps and hashes ---------------------------------------------------

def bits_for(entries: int) -> int:
    return min(BITS_MOST, max(BITS_LEAST, (16 * entries).bit_length()))


def has_bit(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over the leading ``bits`` bits of ``id``: 4 KB per row pulled,
    2^(bits - 15) rows at most."""
    at = F.shiftrightunsigned("id", 64 - bits)
    parts = ids.groupBy(F.shiftright(at, 15).alias("part")).agg(
        F.bitmap_construct_agg(at.bitwiseAND(0x7FFF)).alias("b"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.collect():
        table[r.part << 12:(r.part + 1) << 12] = np.frombuffer(r.b, np.uint8)
    return table


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _K[0]) ^ ((b * _K[1]) >> np.uint64(31)) ^ (b * _K[2])
    h ^= h >> np.uint64(29)
    h *= _K[1]
    return h ^ (h >> np.uint64(32))


def packed(keys: np.ndarray, buckets: np.ndarray):
    """(bucket, rows) of ``keys`` dealt by ``buckets``."""
    order = np.argsort(buckets, kind="stable")
    dealt = buckets[order]
    cuts = np.flatnonzero(np.diff(dealt)) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(buckets[rows[0]]), keys[rows]


# -- pass 2 ---------------------------------------------------------------

#: Pairs are told apart by this many leading bits of their hash: the part, and 32 bits in it.
PART_BITS = 10


def pair_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each position's pair; 0 where there is none."""
    a, b = ids[:-1], ids[1:]
    h = mix(a, b)
    h[(a == 0) | (b == 0)] = 0
    return h


def count_pairs(batches, salt, word_bits, bits):
    held, size = [], 0

    def rows():
        keys, n = np.unique(np.concatenate(held) >> np.uint64(32 - PART_BITS), return_counts=True)
        parts, out = keys >> np.uint64(32), np.stack([keys & np.uint64(0xFFFFFFFF), n.astype(np.uint64)], 1).astype("<u4")
        dealt = list(packed(out, parts))
        return pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in dealt], pa.int64()),
            pa.array([np.ascontiguousarray(r.T).tobytes() for _, r in dealt], pa.binary())], names=["part", "data"])
    for ids in id_chunks(batches, salt, word_bits, bits):
        h = pair_hashes(ids) if len(ids) > 1 else ids[:0]
        held.append(h[h != 0])
        size += len(held[-1])
        if size >= HELD_SUFFIXES:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def frequent_pairs(table: pa.Table, least: int, bits: int) -> pa.Table:
    """Bitmap segment of one part of the pair hashes."""
    blobs = [np.frombuffer(b, "<u4").reshape(2, -1) for b in table.column("data").to_pylist()]
    both = np.concatenate(blobs, 1)
    order = np.argsort(both[0], kind="stable")
    keys, n = both[0][order], both[1][order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first][np.add.reduceat(n, first) >= least]
    own = bits - PART_BITS
    seg = np.zeros(1 << own, np.uint8)
    seg[keys >> np.uint32(32 - own)] = 1
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                     "data": pa.array([np.packbits(seg, bitorder="little").tobytes()], pa.binary())})


# -- pass 3 ---------------------------------------------------------------

def suffixes(ids: np.ndarray, pair_bits: np.ndarray, bits: int) -> np.ndarray:
    """(m, LONGEST) suffixes that start with a frequent pair, 0 from the end
    of the piece or the first infrequent pair on."""
    h = pair_hashes(ids)
    good = np.zeros(len(ids) + LONGEST, bool)
    good[:len(h)] = (h != 0) & has_bit(pair_bits, h, bits)
    at = np.flatnonzero(good)
    wide = np.concatenate([ids, np.zeros(LONGEST, np.uint64)])
    out = np.zeros((len(at), LONGEST), np.uint64)
    live = np.ones(len(at), bool)
    out[:, 0] = wide[at]
    for d in range(1, LONGEST):
        live &= good[at + d - 1]
        out[live, d] = wide[at[live] + d]
    return out


def distinct_rows(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, ordered by their words, and how often each occurs."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if weights is not None:
        return rows[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    return rows[first], np.diff(np.append(first, len(rows)))


def routed(rows: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, leading hot words) of each suffix."""
    h = mix(rows[:, 0], rows[:, 1])
    is_hot = np.isin(rows, hot)
    lead = np.cumprod(is_hot, 1).sum(1)            # leading words that are hot
    for d in range(2, LONGEST):
        more = lead >= d
        h[more] = mix(h[more], rows[more, d])
    return h % np.uint64(buckets), lead


def hot_phrases(rows: np.ndarray, n: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of 2 to LONGEST - 1 hot words that begin the suffixes, counted."""
    out, counts = [], []
    for d in range(2, LONGEST):
        some = rows[lead >= d].copy()
        some[:, d:] = 0
        some, c = distinct_rows(some, n[lead >= d])
        out.append(some)
        counts.append(c)
    return np.concatenate(out), np.concatenate(counts)


def route_suffixes(batches, salt, word_bits, wbits, pair_bits, pbits, hot, buckets):
    held, size = [], 0

    def rows():
        whole, n = distinct_rows(np.concatenate(held))
        bucket, lead = routed(whole, hot, buckets)
        counted, c = hot_phrases(whole, n, lead)
        own = counted[:, 0].copy()
        for d in range(1, LONGEST):
            own = mix(own, counted[:, d])
        words = (whole != 0).sum(1)
        keep = (lead < words) | (words == LONGEST)      # else the counted phrases say it all
        out = []
        for kind, r, k, b in ((0, whole[keep], n[keep], bucket[keep]), (1, counted, c, own % np.uint64(buckets))):
            both = np.concatenate([r, k.astype(np.uint64)[:, None]], 1)
            out += [(i, kind, np.ascontiguousarray(x.T).tobytes()) for i, x in packed(both, b)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                                           pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "data"])
    for ids in id_chunks(batches, salt, word_bits, wbits):
        if len(ids) > 1:
            held.append(suffixes(ids, pair_bits, pbits))
            size += len(held[-1])
        if size >= HELD_SUFFIXES:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def mine(rows: np.ndarray, weights: np.ndarray, least: int, whole_only: bool, skip=None) -> list[tuple[list[int], int]]:
    """(phrase, count) of the phrases of 2 and more words with at least
    ``least`` occurrences among the suffixes ``rows`` (occurring ``weights``
    times), by three-way quicksort of pointers to them.

    ``whole_only``: rows are phrases themselves, not suffixes.
    ``skip(row, words)``: phrases that are counted elsewhere.
    """
    found, todo = [], [(np.arange(len(rows)), 0)]
    while todo:
        at, d = todo.pop()
        if weights[at].sum() < least:
            continue                                   # nothing in it can be frequent
        keys = rows[at, d]
        pivot = keys[len(keys) // 2]
        todo.append((at[keys < pivot], d))
        todo.append((at[keys > pivot], d))
        same = at[keys == pivot]
        n = int(weights[same].sum())
        if n < least:
            continue
        row = rows[same[0]]
        if pivot == 0:
            if whole_only and d > 1:
                found.append((row[:d].view(np.int64).tolist(), n))
            continue
        if not whole_only and d > 0 and not (skip and skip(row, d + 1)):
            found.append((row[:d + 1].view(np.int64).tolist(), n))
        if d + 1 < rows.shape[1]:
            todo.append((same, d + 1))
    return found


def mine_bucket(table: pa.Table, least: int, hot: np.ndarray) -> pa.Table:
    """Frequent phrases of one bucket."""
    hot_set, found = set(hot.tolist()), []
    kinds = table.column("kind").to_pylist()
    blobs = table.column("data").to_pylist()
    for kind in (0, 1):
        parts = [np.frombuffer(b, np.uint64).reshape(LONGEST + 1, -1) for b, k in zip(blobs, kinds) if k == kind]
        if parts:
            both = np.concatenate(parts, 1)
            rows, weights = np.ascontiguousarray(both[:LONGEST].T), both[LONGEST].astype(np.int64)
            found += mine(rows, weights, least, kind == 1, lambda r, d: d < LONGEST and all(
                x in hot_set for x in r[:d].tolist()))
    return pa.table({"ids": pa.array([p for p, _ in found], pa.list_(pa.int64())), "f": pa.array([n for _, n in found], pa.int64())})


def frequent_phrases(docs: DataFrame, words: DataFrame, salt: int, least: int) -> DataFrame:
    """(ids, f) of all phrases of 2 to LONGEST words with ``f >= least``."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    slim = texts(docs)
    frequent = words.filter(F.col("f") >= least).select(word_key(salt).alias("id"), "f")
    entries, covered = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    if not entries:
        return spark.createDataFrame([], "ids array<long>, f long")
    limit = min(HOT_MOST, max(HOT_LEAST, covered // FEWEST_BUCKETS))
    hot = sc.broadcast(np.sort(np.array([r.id for r in frequent.filter(F.col("f") > limit).select("id").collect()],
                                        np.int64).view(np.uint64)))
    wbits, pbits = bits_for(entries), bits_for(covered // least)
    word_bits = sc.broadcast(word_bitmap(frequent, wbits))

    pairs = map_arrow(slim, lambda it: count_pairs(it, salt, word_bits.value, wbits), "part long, data binary")
    segments = pairs.groupBy("part").applyInArrow(lambda t: frequent_pairs(t, least, pbits), "part long, data binary")
    table, width = np.zeros(1 << (pbits - 3), np.uint8), 1 << (pbits - PART_BITS - 3)
    for r in segments.collect():
        table[r.part * width:(r.part + 1) * width] = np.frombuffer(r.data, np.uint8)
    pair_bits = sc.broadcast(table)

    buckets = max(FEWEST_BUCKETS, covered // BUCKET_WORDS)
    out = map_arrow(slim, lambda it: route_suffixes(it, salt, word_bits.value, wbits, pair_bits.value, pbits, hot.value, buckets),
                    "bucket long, kind int, data binary")
    return staged(out.groupBy("bucket").applyInArrow(lambda t: mine_bucket(t, least, hot.value), "ids array<long>, f long"),
                  "phrases")


# -- scores ---------------------------------------------------------------

def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of every language: ``lang, rank, phrase, a, l, r, n,
    score``.

    Null langs are ``und``, null texts empty; repeated rows count as often as
    they occur; no texts, or none with a frequent phrase, give no rows.
    """
    words = word_counts(docs.select("lang", "text"))
    salt = distinct_salt(words, least)
    phrases = frequent_phrases(docs.select("lang", "text"), words, salt, least)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = staged(words.filter(F.col("f") >= least).join(totals, "lang").select(word_key(salt).alias("id"), "lang", "word", "f", "n"),
                   "words")

    longer = phrases.filter(F.size("ids") > 2).select("f", F.explode(F.array(
        F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1))).alias("ids"))
    longer = longer.groupBy("ids").agg(F.max("f").alias("_within"))
    kept = phrases.join(longer, "ids", "left").filter("_within IS NULL OR 100 * _within < 100 * f").select(
        "ids", F.col("f").alias("a"))

    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(known.select("id", "lang", "word", "n"), "id")
    spelled = spelled.groupBy("ids").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.first("lang").alias("lang"), F.first("n").alias("n"))

    counts = phrases.unionByName(known.select(F.array("id").alias("ids"), "f"))
    cut = kept.join(spelled, "ids").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cut = cut.withColumn("head", F.slice("ids", 1, F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.size("ids")))
    cut = cut.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(
        counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    wide = "CAST({} AS DECIMAL(19,0))".format
    score = F.expr(f"CAST((CAST(1000 * {wide('a')} AS DECIMAL(24,0)) * {wide('n')}) DIV ({wide('l')} * {wide('r')}) AS BIGINT)")
    low = cut.groupBy("ids").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n", "lang", "phrase")).alias("m"))
    best = low.select("m.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all ``documents``, by language; see :func:`collocations`."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = {"op12_phrase_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS ({' UNION ALL '.join(
    f"SELECT lang, {m} AS m, w[i:i + {m - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM runs)"
    for m in range(1, LONGEST + 1))}),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
inner_ AS (
  SELECT lang, g[i:i + k - 1] AS g, max(f) AS within
  FROM (SELECT lang, g, f, m, k, unnest(range(1, m - k + 2)) AS i
        FROM (SELECT lang, g, f, m, unnest(range(2, m)) AS k FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (
  SELECT f.lang, f.m, f.g, f.f AS a FROM f LEFT JOIN inner_ USING (lang, g)
  WHERE f.m > 1 AND (within IS NULL OR 100 * within < 100 * f.f)),
cuts AS (SELECT lang, m, g, a, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, min(struct_pack(score := (1000::hugeint * a * n) // (x.f::hugeint * y.f), k := k, l := x.f, r := y.f)) AS s,
         any_value(a) AS a, any_value(n) AS n
  FROM cuts c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m] GROUP BY c.lang, c.g),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, s, n,
         row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM scored)
SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, n, s.score::bigint AS score FROM ranked WHERE rank <= {TOP}"""}

QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
