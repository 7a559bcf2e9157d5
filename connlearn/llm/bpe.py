"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Spark partitions the rows; inside a task, the distinct words of a run of
documents become token-position rows that a recursive DuckDB query joins to
the merge table, contracting each word's leftmost pair of least rank until no
pair is left. Decoding joins ids to the vocabulary and aggregates in order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words held back for one DuckDB call, characters held back, and cached words
#: per Python worker. They bound memory and speed only, never a result.
FLUSH_WORDS, FLUSH_CHARS, CACHE_WORDS = 60_000, 8_000_000, 500_000
#: Longer words (bytes) take the heap way: the same merges in n log n.
LONG_WORD = 1024
#: Squared bytes of the words of one recursive query. The recursion keeps every
#: step's ids, about the square of a word's length, so this bounds its memory.
FLUSH_SQUARES = 16_000_000
#: Longest run of ids that decoding looks up as one piece.
PIECE = 64
DUCKDB_MEMORY = "256MB"

# Letters, numbers and white space among the first 256 code points.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\x0b\f\r\x85\xa0"
#: The splitting pattern for texts of the first 256 code points only.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ANY = regex.compile(public_tokenizers.PATTERN)


def split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


ENCODE = """
WITH RECURSIVE r(w, step, ids) AS (
  SELECT w, 0, ids FROM seeds
  UNION ALL
  SELECT r.w, step + 1,
         ids[:(best & 65535) - 1] || [(best >> 16)::int] || ids[(best & 65535) + 2:]
  FROM r JOIN (
    SELECT w, min((m.id << 16) | i) AS best
    FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[:-2], 1) AS i
          FROM r WHERE len(ids) > 1) AS position
    JOIN merges m ON m.pair = a::bigint * 65536 + b
    GROUP BY w) AS lowest USING (w))
SELECT w, arg_max(ids, step) AS ids FROM r GROUP BY w ORDER BY w"""

DECODE = """
SELECT w, array_to_string(list(v.hex ORDER BY i), '') AS hex
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM seeds) AS position
JOIN vocabulary v USING (id) GROUP BY w ORDER BY w"""


def _lists(parts: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    width = np.dtype(dtype).itemsize
    offsets = np.fromiter(accumulate((len(p) // width for p in parts), initial=0), np.int32, len(parts) + 1)
    return offsets, np.frombuffer(b"".join(parts), dtype)


class Index(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Codec:
    """A worker's vocabulary, DuckDB connection and bounded word caches."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.starts = np.zeros(ids.max() + 1, bool)
        for token, i in self.ranks.items():
            self.starts[i] = token[:1] < b"0"
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, made = [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a * 65536 + b)
                    made.append(i)
        # no folder to spill to: a call's memory is bounded by its input
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "id": pa.array(made, pa.int64())})
        vocabulary = pa.table({"id": pa.array(ids), "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS FROM rows")
            self.db.unregister("rows")
        self.clear()

    @cached_property
    def merge(self) -> dict[int, int]:
        """The merge table as a dict, built when a first long word needs it."""
        return dict(self.db.sql("SELECT pair, id FROM merges").fetchall())

    def clear(self) -> None:
        self.words, self.ids, self.pieces = Index(), [], {}
        self.seen = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget the words met once since the last call, so that frequent
        words are not encoded again; at most half of the cache stays."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > CACHE_WORDS // 2:
            keep = keep[np.argsort(self.seen[keep], kind="stable")[-(CACHE_WORDS // 2):]]
        words, ids = list(self.words), self.ids
        self.words, self.ids = Index(), []
        for i in np.sort(keep).tolist():
            self.words[words[i]] = len(self.ids)
            self.ids.append(ids[i])
        self.seen = np.zeros(0, np.int64)

    def _run(self, sql: str, lists: tuple[np.ndarray, np.ndarray], column: str) -> pa.Array:
        offsets, values = lists
        seeds = pa.table({"w": np.arange(len(offsets) - 1, dtype=np.int32),
                          "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})
        self.db.register("seeds", seeds)
        try:
            return self.db.sql(sql).to_arrow_table().column(column).combine_chunks()
        finally:
            self.db.unregister("seeds")

    def long_word(self, word: bytes) -> list[int]:
        """The merges of one long word through a heap of (rank, position)."""
        ids = [int(self.byte[b]) for b in word]
        nxt, prv, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
        get = self.merge.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * 65536 + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := get(r * 65536 + ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            if prv[i] >= 0 and (q := get(ids[prv[i]] * 65536 + r)) is not None:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], r))
        return [x for x in ids if x >= 0]

    def _encode_new(self) -> None:
        """Ids (as bytes) of every word that has a number but no ids yet."""
        at = len(self.ids)
        if at == len(self.words):
            return
        new = [w.encode() for w in list(self.words)[at:]]
        out: list[bytes | None] = [None] * len(new)
        rest = []
        for i, w in enumerate(new):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                out[i] = np.array(self.long_word(w), "<u4").tobytes()
            else:
                rest.append(i)
        for lo, hi in _runs([len(new[i]) ** 2 for i in rest], FLUSH_SQUARES):
            part = rest[lo:hi]
            offsets, raw = _lists([new[i] for i in part], "u1")
            lists = self._run(ENCODE, (offsets, self.byte[raw]), "ids")
            data = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for i, a, b in zip(part, ends, ends[1:]):
                out[i] = data[4 * a:4 * b]
        self.ids += out

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers, in order."""
        held, chars = [], 0
        for text in texts:
            held.append(array("I", map(self.words.__getitem__, split(text))))
            chars += len(text)
            if chars >= FLUSH_CHARS or len(self.words) - len(self.ids) >= FLUSH_WORDS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[array]) -> Iterator[bytes]:
        self._encode_new()
        yield from [b"".join(map(self.ids.__getitem__, h)) for h in held]
        seen = np.bincount(np.frombuffer(b"".join(held), np.uintc), minlength=len(self.words))
        seen[:len(self.seen)] += self.seen
        self.seen = seen
        if len(self.words) > CACHE_WORDS:
            self._shrink()

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids. Ids are cut before tokens that start
        with a space or a mark (a run of more than 64, every 64 ids); distinct
        pieces are decoded once."""
        cuts, new = [], set()
        for t in texts:
            ids = np.frombuffer(t, "<u4")
            if not ids.size:
                cuts.append([])
                continue
            if ids.max() >= len(self.starts):
                raise ValueError("an id is not in the vocabulary")
            cut = np.concatenate(([0], np.flatnonzero(self.starts[ids[1:]]) + 1, [len(ids)]))
            if np.diff(cut).max(initial=0) > PIECE:
                cut = np.union1d(cut, np.arange(0, len(ids), PIECE))
            cut = (cut * 4).tolist()
            pieces = [t[a:b] for a, b in zip(cut, cut[1:])]
            new.update(pieces)
            cuts.append(pieces)
        new = [p for p in new if p not in self.pieces]
        for at in range(0, len(new), FLUSH_WORDS):
            part = new[at:at + FLUSH_WORDS]
            offsets, ids = _lists(part, "<u4")
            hexes = self._run(DECODE, (offsets, ids.astype(np.int32)), "hex").to_pylist()
            if len(hexes) < len(part):
                raise ValueError("an id is not in the vocabulary")
            self.pieces.update(zip(part, map(bytes.fromhex, hexes)))
        out = [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cuts]
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}
        return out


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``most``."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        total += s
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row; null and empty texts have no ids.
    Rows stay in their partitions; nothing is shuffled. ``path`` names the
    rank file on every executor."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in _runs(sizes, FLUSH_CHARS):
                part = b.slice(lo, hi - lo)
                offsets, ids = _lists(list(c.encode(t or "" for t in part.column(1).to_pylist())), "<u4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                    names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, ids array<int>")


def _id_bytes(column: pa.Array) -> list[bytes]:
    out = []
    for x in column:
        out.append(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if x.is_valid else b"")
    return out


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None,
           digest: bool = False) -> DataFrame:
    """(key, data binary) for every row, or with ``digest`` (key, n_tokens,
    ids_sha256, decoded_sha256) without sending the bytes back to the JVM.
    Null ids are an empty list; an unknown id is an error."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_pylist()
            for lo, hi in _runs(sizes, FLUSH_CHARS // 4):
                part = b.slice(lo, hi - lo)
                raw = _id_bytes(part.column(1))
                data = c.decode(raw)
                if digest:
                    cols = [pa.array([len(r) // 4 for r in raw], pa.int64()),
                            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                            pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())]
                else:
                    cols = [pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] if digest else [key, "data"]
    kind = df.schema[key].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "data binary"
    return map_arrow(df.select(key, ids), run, f"`{key}` {kind}, {out}")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of every whole text of ``documents``, as digests.

    A null or empty text has no tokens and the digest of nothing; repeated rows give a row
    each; an empty table gives no rows."""
    return decode(encode(read(spark, sf_dir, "documents")), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, ids, n_tokens) of every document."""
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
