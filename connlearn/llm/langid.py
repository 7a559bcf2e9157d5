"""Language identification by compression: the language whose zstandard
raw-content dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, read

#: Bounds of the model (documented parameters): bytes of a language's
#: dictionary, and the excerpts that it is cut from.
DICT_BYTES = 64 * 1024
EXCERPTS = 256
#: Most languages: their dictionaries (64 MB) travel with every task.
MOST_LANGS = 1000
LEVEL = 5
_LETTERS = re.compile(r"[^\W\d_]+")
#: Least relative lead of the best over the second language to accept.
MARGIN = 0.02
#: Bits of lead at which the score is about 0.73.
SCALE = 64.0


def letters_only(text: str) -> bytes:
    """What is compared: runs of letters in lower case, one space between
    them, in UTF-8. Punctuation, digits and case say little about a language."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def dictionaries(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
                 size: int = DICT_BYTES, most_langs: int = MOST_LANGS) -> dict[str, bytes]:
    """A raw-content dictionary of at most ``size`` bytes per language.

    Labelled rows are dealt into 256 hash cells per language; each cell keeps
    the text with the smallest hash, so at most 256 texts of a
    language reach the driver whatever the input. Every text gives an equal
    excerpt from its middle. Rows with a null language or an empty text teach
    nothing; no rows give no dictionaries. Languages come in descending order
    of their labelled rows. More than ``most_langs`` of them are an error, so
    that a column of other values is not taken for languages.
    """
    per = size // EXCERPTS * 2
    h = F.xxhash64(F.col(key), F.col(text))
    start = F.greatest(F.lit(1), F.floor((F.char_length(text) - per) / 2)).cast("int")
    rows = df.filter(F.col(lang).isNotNull() & (F.char_length(F.btrim(F.col(text))) > 0)).select(
        F.col(lang).alias("lang"), F.pmod(h, F.lit(EXCERPTS)).alias("cell"), h.alias("h"),
        F.substring(F.col(text), start, F.lit(per)).alias("x"))
    best = rows.groupBy("lang", "cell").agg(F.min(F.struct("h", "x")).alias("b"), F.count("*").alias("n"))
    out: dict[str, list[bytes]] = {}
    count: dict[str, int] = {}
    for r in best.orderBy("lang", "cell").select("lang", "b.x", "n").toLocalIterator():
        if r.lang not in out and len(out) >= most_langs:
            raise ValueError(f"more than {most_langs} languages in the labelled rows")
        out.setdefault(r.lang, []).append(letters_only(r.x))
        count[r.lang] = count.get(r.lang, 0) + r.n
    return {k: b" ".join(out[k])[:size] for k in sorted(out, key=lambda k: (-count[k], k))}


class Compressors:
    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dicts)
        self.by_lang = []
        for name in self.langs:
            d = zstd.ZstdCompressionDict(dicts[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.by_lang]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): ``und`` with 0 for a null text, one
        without a letter, or no languages; a tie goes to the language with
        more labelled rows (the dictionaries' order)."""
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0, 0.0
        data = letters_only(text)
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        share = sum(math.exp2(min(0.0, (best - s) * 8 / SCALE)) for s in sizes)
        second = sizes[order[1]] if len(order) > 1 else best * 2
        return self.langs[order[0]], 1.0 / share, (second - best) / max(1, second)


def predict(df: DataFrame, dicts: dict[str, bytes], key: str = "doc_id", text: str = "text",
            margin: float = MARGIN) -> DataFrame:
    """(key, lang_pred, score, margin, accepted) for every row, each text
    encoded whole. ``lang_pred`` is the language of the smallest encoding;
    ``accepted`` is false where its lead is narrower than ``margin`` (and for
    ``und``). Prepared dictionaries travel with the task closure (64 KB per
    language)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(dicts)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score, lead = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(lead, pa.float64()),
                 pa.array([x >= margin and n != "und" for n, x in zip(lang, lead)], pa.bool_())],
                names=[key, "lang_pred", "score", "margin", "accepted"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run,
                     f"`{key}` {kind}, lang_pred string, score double, margin double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, one row per row.

    Null texts and texts without a letter are ``und`` with score 0; rows without a lang
    teach nothing; repeated rows and null ids are judged each; an empty table gives no
    rows; lang, source and further columns are no inputs of a prediction."""
    docs = read(spark, sf_dir, "documents")
    dicts = dictionaries(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs, dicts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
