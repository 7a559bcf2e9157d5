"""Toxicity scores over texts restored by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, read, staged

#: Bounds of the classifier (documented parameters): labelled rows it is
#: fitted on (drawn by id hash), features of toxic rows that it weighs, and toxic
#: features it keeps.
MOST_LABELLED, MOST_CANDIDATES, MOST_FEATURES = 20_000, 400_000, 20_000
#: Toxic documents that a feature must occur in to be weighed.
LEAST_TOXIC = 5
#: A feature counts as toxic if the lower Wilson bound (at Z standard errors)
#: of its share of toxic documents is at least LEAST_SHARE.
Z, LEAST_SHARE = 2.3, 0.5
#: A feature is dense in a text that has it twice or more, and at least once in
#: so many words: a stem that clean texts have now and then, toxic ones often.
DENSE = 150
#: Strength from which a word counts where it is not dense: that of ten toxic
#: documents with it and no other.
ONCE = 0.65
THRESHOLD = 0.3
#: Words, and written tokens, that a worker remembers; bounds memory only.
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")

# ---- character language model

#: Symbols of the model: 0 is a word boundary, 1 to 26 are a to z, the rest
#: letters of any script by their code point.
SYMBOLS = 64


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else 0


_CLASS = bytes(symbol(chr(b)) for b in range(256))
#: Characters that a task counts at once; a longer text is one piece.
PIECE = 1 << 20


def classes(text: str) -> np.ndarray:
    low = text.lower()
    try:
        return np.frombuffer(low.encode("latin-1").translate(_CLASS), np.uint8)
    except UnicodeEncodeError:
        points, at = np.unique(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        return np.array([symbol(chr(p)) for p in points], np.uint8)[at]


def language_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log2 probabilities P(c | a, b) of a character trigram model, from the
    counts of every text of ``df``. A task sends at most 64^3 counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)

        def count(texts: list[str]) -> None:
            if texts:
                x = classes("  ".join(["", *texts, ""])).astype(np.int32)
                np.add(total, np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS ** 3), total)

        texts, held = [], 0
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    texts.append(t.as_py())
                    held += len(texts[-1])
                    if held >= PIECE:
                        count(texts)
                        texts, held = [], 0
        count(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = map_arrow(df.select(text), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = np.full(SYMBOLS ** 3, 0.1)
    for r in counts.toLocalIterator():
        total[r.gram] += r.n
    total = total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log2(total / total.sum(axis=2, keepdims=True))


# ---- noisy channel

#: What an intended letter may be written as, by script.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
CYRILLIC = {"0": "о", "3": "з", "4": "ч", "6": "б", "8": "в", "@": "а", "(": "с", "€": "е", "*": "аеиоуыя",
            "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "k": "к", "m": "м", "t": "т",
            "b": "в", "h": "н", "i": "і", "s": "ѕ", "j": "ј"}
GREEK = {"0": "ο", "3": "ε", "4": "α", "@": "α", "€": "ε", "*": "αεηιουω",
         "a": "α", "o": "ο", "v": "ν", "p": "ρ", "i": "ι", "k": "κ", "t": "τ", "x": "χ", "u": "υ", "n": "η"}
#: Letters of other scripts that stand for Latin ones.
LATIN = LOOKS_LIKE | {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
                      "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
                      "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "υ": "u"}
_OF_CYRILLIC, _OF_GREEK = re.compile("[\u0400-\u04ff]"), re.compile("[\u0370-\u03ff]")
_OF_LATIN = re.compile("[a-z]", re.I)


def alphabets(seen: str) -> list[dict[str, str]]:
    """The look-alikes of every script that ``seen`` has letters of."""
    if seen.isascii():
        return [LOOKS_LIKE]
    of = [table for letters, table in ((_OF_LATIN, LATIN), (_OF_CYRILLIC, CYRILLIC), (_OF_GREEK, GREEK))
          if letters.search(seen)]
    return of or [LOOKS_LIKE]


#: Log2 channel probabilities: a letter as itself, a look-alike, a repeated
#: letter written for one, a separator put between letters, a separator put
#: between letters that are all set apart.
SAME, ALIKE, REPEAT, SEPARATOR, SPREAD = -0.1, -2.0, -1.0, -1.0, -0.1
#: What a word that the classifier knows is more probable than its letters alone.
KNOWN = 8.0
#: Paths kept per state, and readings of a token; more where words may end inside.
BEST, BEST_CUT = 4, 32


def decode(seen: str, lm: np.ndarray | list, best: int = BEST, known: Callable[[str], bool] = lambda word: False,
           looks_like: dict[str, str] = LOOKS_LIKE) -> list[str]:
    """The most probable intended readings of one written token or spaced run
    (Viterbi over the letter lattice; states are the last two symbols; the
    ``best`` best paths survive per state). Separators may be dropped or end a
    word (then the reading has a space), a run of one letter may stand for one
    or two, look-alikes for their letters. Words that are ``known`` count more,
    so that a reading with one outlives other cuts of a long run."""
    between = SPREAD if _SPACED.fullmatch(seen) else SEPARATOR
    paths = {(0, 0): [(0.0, "")]}
    before = ""
    for c in seen.lower():
        options = [(x, symbol(x), ALIKE) for x in looks_like.get(c, "")]
        if c.isalpha():
            options.append((c, symbol(c), SAME))
        drop = None if options and c.isalnum() else between if before.isalnum() else SEPARATOR
        step: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), ends in paths.items():
            then = lm[a][b]
            for score, word in ends:
                if drop is not None:
                    step.setdefault((a, b), []).append((score + (SAME if word[-1:] == " " else drop), word))
                    if b:
                        more = KNOWN if known(word[word.rfind(" ") + 1:]) else 0.0
                        step.setdefault((b, 0), []).append((score + SAME + then[0] + more, word + " "))
                elif c == before:
                    step.setdefault((a, b), []).append((score + REPEAT, word))
                for x, k, p in options:
                    if word[-2:] != x + x:
                        step.setdefault((b, k), []).append((score + p + then[k], word + x))
        paths = {s: v if len(v) == 1 else sorted(set(v), key=lambda e: (-e[0], e[1]))[:best] for s, v in step.items()}
        before = c
    ends = {}
    for (a, b), v in paths.items():
        for score, word in v:
            if b:
                score += lm[a][b][0] + (KNOWN if known(word[word.rfind(" ") + 1:]) else 0.0)
            word = word.rstrip(" ")
            ends[word] = max(ends.get(word, -math.inf), score)
    return [w for w, _ in sorted(ends.items(), key=lambda e: (-e[1], e[0])) if w][:best]


_SEP = r"[ .\-_*/\\,]"
_ONE = r"[^\W_]|[@$!|+(€]"
_SPACED = re.compile(rf"(?<![^\W_])(?:(?:{_ONE}){_SEP}{{1,2}}){{3,}}(?:{_ONE})(?![^\W_])")
#: What every spaced run has inside, found in a quicker scan.
_MAYBE_SPACED = re.compile(rf"{_SEP}[\w@$!|+(€]{_SEP}{{1,2}}[\w@$!|+(€]{_SEP}")
_ODD = re.compile(r"[^\W\d_][@$!|+(€*.\-_/\\,]+[^\W_]|[^\W\d_][0-9]+[^\W\d_]"
                  r"|(?<![^\W_])[0-9@$!|+(€]+[^\W\d_]{2}|[^\W\d_](?:[0-9@$!|+(€]+|\*{1,2}(?!\*))(?![^\W_])|([^\W\d_])\1\1")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile("[a-zA-Z][\u0370-\u04ff]|[\u0370-\u04ff][a-zA-Z]")
_EDGE = re.compile(r"^[\W_]*(?<![@$!|+(€])|(?![@$!|+(€*])[\W_]+$")
_CUT = re.compile(rf"[^\W_]{_SEP}+[^\W_]")
_REPEATS = re.compile(r"([^\W\d_])\1{3,}")
_TWICE = re.compile(r"([^\W\d_])\1")
#: Written characters that are decoded at once, and how far such windows
#: overlap: a word of up to 58 characters, separators included, is whole and
#: away from the cuts in at least one window.
WINDOW, OVERLAP = 120, 60


def spaced_runs(text: str) -> list[str]:
    """Runs of single letters set apart."""
    return [m.group() for m in _SPACED.finditer(text)] if _MAYBE_SPACED.search(text) else []


def odd_part(token: str) -> str:
    """A token, of any length, without its marks at both ends if it looks
    disguised: look-alikes or separators among or after letters (three stars
    after a word are a mark), a letter three times over, or letters of two
    scripts side by side; else nothing."""
    # of plain words, the cheap and common case, only repeated letters count
    plain = token.isalpha() or token.strip(".,;:?").isalpha()
    if (_TRIPLE if plain else _ODD).search(token) or not token.isascii() and _MIXED.search(token):
        return _EDGE.sub("", token)
    return ""


def written_oddly(text: str, tokens: Iterable[str] | None = None) -> list[str]:
    """All that looks disguised in a text: its :func:`spaced_runs`, and the
    :func:`odd_part` of its tokens, or of those given."""
    found = [*spaced_runs(text), *map(odd_part, dict.fromkeys(text.split()) if tokens is None else tokens)]
    return list(dict.fromkeys(t for t in found if len(t) > 2))


def worded(seen: str) -> bool:
    """False if neither the whole nor a part between separators has letters
    enough to be a word: mostly digits are identifiers."""
    return any(len(p) > 2 and sum(c.isdigit() for c in p) * 3 <= len(p) * 2
               for p in (re.sub(_SEP, "", seen), *re.split(_SEP, seen)))


#: Look-alikes that may as well be separators, and the letter they stand for.
_EITHER = {"$": "s", "+": "t", "(": "c"}
_RUN = re.compile(r"(.)\1+")


class Bare(dict):
    """Translation table to skeletons: code point -> its letter, or nothing.
    Entries are made as they are met. ``either`` are the look-alikes of the
    token that may as well be separators: their letters go."""

    def __init__(self, looks_like: dict[str, str], either: str):
        super().__init__()
        self.letter = {c: v for c, v in looks_like.items() if len(v) == 1}
        self.gone = {x for c, v in looks_like.items() for x in v if len(v) > 1 or not (c.isalnum() or c in _EITHER)}
        for c in either:
            self.gone |= {_EITHER[c], looks_like.get(_EITHER[c], ""), looks_like.get(c, "")}

    def __missing__(self, point: int) -> str:
        c = self.letter.get(chr(point), chr(point))
        self[point] = c if c.isalpha() and c not in self.gone else ""
        return self[point]

    def skeleton(self, text: str) -> str:
        return _RUN.sub(r"\1", text.lower().translate(self))


class Skeletons:
    """What is left of words whatever their disguise: separators, vowels and
    the letters that look-alikes of several meanings may stand for go, other
    look-alikes become their letter, repeats one letter. A written token can
    be restored to a word only if its skeleton holds the word's, so that most
    tokens need no lattice. Words are told by the first four characters of
    their skeletons."""

    def __init__(self, words: Iterable[str]):
        self.words, self.made = list(words), {}

    def may_hold(self, seen: str, looks_like: dict[str, str] = LOOKS_LIKE) -> bool:
        either = "".join(c for c in _EITHER if c in seen)
        got = self.made.get((id(looks_like), either))
        if got is None:
            bare = Bare(looks_like, either)
            starts = {bare.skeleton(w)[:4] for w in self.words}
            got = self.made[id(looks_like), either] = bare, starts, sorted({len(x) for x in starts})
        bare, starts, sizes = got
        if "" in starts:
            return True
        left = bare.skeleton(seen)
        return any(left[i:i + n] in starts for n in sizes for i in range(len(left) - n + 1))


def restored_words(seen: str, lm: np.ndarray | list, known: Callable[[str], bool],
                   may_hold: Callable[[str, dict], bool] = lambda piece, looks_like: True) -> list[str]:
    """The distinct words of all readings of a written token, in every script
    that it has letters of; none where no reading ``may_hold`` a toxic one. A
    token longer than a window is decoded in overlapping windows; words at a
    cut may be fragments and are taken from the neighbouring window."""
    seen = _REPEATS.sub(r"\1\1\1", seen)
    words: dict[str, None] = {}
    for at in range(0, max(1, len(seen) - OVERLAP), WINDOW - OVERLAP):
        piece = seen[at:at + WINDOW]
        if worded(piece):
            for looks_like in alphabets(piece):
                if not may_hold(piece, looks_like):
                    continue
                for reading in decode(piece, lm, BEST_CUT if _CUT.search(piece) else BEST, known, looks_like):
                    got = reading.split()
                    words.update(dict.fromkeys(got[at > 0:len(got) - (at + WINDOW < len(seen))]))
    return list(words)


# ---- classifier over restored words

def grams(word: str, stem_from: int = 5) -> list[int]:
    """32-bit hashes of a word's features: the whole word and, from
    ``stem_from`` letters on, its beginnings of 4 to 7 letters (stems; shorter
    ones, and pieces from inside a word, occur by chance in too many clean
    words). Training takes stems from 6 letters on, so that a short word is
    not the only support of its own beginnings."""
    w = f"^{word}$"
    parts = {w, w[:5], w[:6], w[:7], w[:8]} if len(word) >= stem_from else {w}
    return [zlib.crc32(p.encode()) for p in parts]


def strongest(word: str, strong: dict[int, float]) -> float:
    """The largest strength of :func:`grams` of a word. Each beginning's hash
    goes on from the one before where letters are bytes."""
    b = f"^{word}$".encode()
    n, get, crc = len(word), strong.get, zlib.crc32
    if n < 5:
        return get(crc(b), 0.0)
    if not b.isascii():
        return max([get(g, 0.0) for g in grams(word)])
    h = crc(b[:5])
    best = get(h, 0.0)
    for at in (5, 6, 7):
        h = crc(b[at:at + 1], h)
        if (s := get(h, 0.0)) > best:
            best = s
    return max(best, get(crc(b[8:], h), 0.0))


def dense_feature(gram: int) -> int:
    """The feature that ``gram`` is dense in a text."""
    return zlib.crc32(b"+", gram)


def features(text: str) -> set[int]:
    """All features of a text, for training: the grams of its words, and those
    of them that are dense."""
    n = Counter(_WORD.findall(text.lower()))
    total, often = sum(n.values()), Counter()
    for w, k in n.items():
        for g in grams(w, 6):
            often[g] += k
    return set(often) | {dense_feature(g) for g, k in often.items() if k > 1 and k * DENSE >= total}


def undoubled(word: str) -> set[str] | None:
    """Every word that ``word`` may stand for if doubled letters are one
    letter each or stay; None if those are too many to list."""
    runs = [m.group() for m in re.finditer(r"(.)\1*", word)]
    if sum(len(r) > 1 for r in runs) > 6:
        return None
    out = {""}
    for r in runs:
        out = {w + part for w in out for part in {r[0], r[:2]}}
    return out - {word}


@dataclass
class Model:
    """Language model, strengths of toxic features by hash, and the letters of
    those features, without which no word has a strength; the caches stay in
    the worker."""
    lm: np.ndarray
    strong: dict[int, float]
    stems: tuple[str, ...] = ()
    cache: dict = field(default_factory=dict)
    restored: dict = field(default_factory=dict)
    #: Word -> its grams that count where they are dense; few words have any.
    dense: dict = field(default_factory=dict)
    #: Written tokens that add nothing to the score of any text: nearly all are such.
    nothing: set = field(default_factory=set)

    def __post_init__(self):
        self.log2 = self.lm.tolist()
        self.skeletons = Skeletons(self.stems)
        self.starts = {w[:4] for w in self.stems}
        self.single_starts = {_RUN.sub(r"\1", w) for w in self.starts}
        self.dense_starts = {w[:4] for w in self.stems if any(dense_feature(g) in self.strong for g in
                             (zlib.crc32(f"^{w}".encode()), zlib.crc32(f"^{w}$".encode())))}

    def known(self, word: str) -> bool:
        return zlib.crc32(f"^{word}$".encode()) in self.strong

    def restore(self, token: str) -> list[str]:
        got = self.restored.get(token)
        if got is None:
            got = restored_words(token, self.log2, self.known, self.skeletons.may_hold)
            if len(token) <= WINDOW:
                if len(self.restored) > CACHE_WORDS // 4:
                    self.restored.clear()
                self.restored[token] = got
        return got

    def strength(self, word: str) -> float:
        """Strength of a word as written or, if it has a doubled letter, of
        the readings that are more probable than what is written. Words that
        begin like no feature have none."""
        begins, twice = word[:4] in self.starts, _TWICE.search(word)
        if not (begins or twice):
            return 0.0
        s = self.cache.get(word)
        if s is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            s = strongest(word, self.strong) if begins else 0.0
            if twice and self.may_begin(word):
                may = undoubled(word)
                if (self.skeletons.may_hold(word) if may is None else any(strongest(w, self.strong) for w in may)):
                    s = max([s, *[strongest(w, self.strong) for w in self.likelier(word)]])
            if word[:4] in self.dense_starts:
                if got := [g for g in grams(word) if dense_feature(g) in self.strong]:
                    self.dense[word] = got
            self.cache[word] = s
        return s

    def may_begin(self, word: str) -> bool:
        """Whether a reading of a word with doubled letters can begin like a
        feature: then the two begin alike with single letters."""
        single = _RUN.sub(r"\1", word)
        return any(single[:n] in self.single_starts for n in range(1, 5))

    def tells(self, token: str) -> bool:
        """Whether a written token can add to the score of a text."""
        plain = token.strip(".,;:?")
        if plain.isascii() and plain.isalpha() and not _RUN.search(word := plain.lower()):
            # most tokens: one word, as written
            return word[:4] in self.starts and (self.strength(word) > 0 or word in self.dense)
        if any(self.strength(w) or w in self.dense for w in _WORD.findall(token.lower())):
            return True
        odd = odd_part(token)
        return len(odd) > 2 and any(self.strength(w) >= ONCE or w in self.dense for w in self.restore(odd))

    def telling(self, text: str) -> list[str]:
        """The distinct tokens of a text that can add to its score. Those that
        cannot, nearly all, are looked at once; tokens beyond a window are not
        remembered, and left to the caller."""
        found = []
        for token in set(text.split()).difference(self.nothing):
            if len(token) > WINDOW or self.tells(token):
                found.append(token)
            else:
                if len(self.nothing) > CACHE_WORDS:
                    self.nothing.clear()
                self.nothing.add(token)
        return found

    def likelier(self, word: str) -> list[str]:
        """Readings more probable than a plain word itself. A word beyond a
        window is read window by window, each at its best."""
        if len(word) > WINDOW:
            cuts = [word[at:at + WINDOW] for at in range(0, len(word), WINDOW)]
            return ["".join((decode(c, self.log2) or [c])[0] for c in cuts)]
        likely = decode(word, self.log2)
        return likely[:likely.index(word)] if word in likely else likely

    def dense_strength(self, n: Counter, total: int) -> float:
        """The largest strength of the grams that are dense among words."""
        often = Counter()
        for w in n.keys() & self.dense.keys():
            for g in self.dense[w]:
                often[g] += n[w]
        return max((self.strong[dense_feature(g)] for g, k in often.items() if k > 1 and k * DENSE >= total),
                   default=0.0)

    def score(self, text: str | None) -> float:
        """1 - the product of (1 - strength) over the distinct toxic words of
        the text as written and as restored, and the strongest of those that
        are dense; below 0.05 without any."""
        if not text:
            return 0.0
        # white space ends words and tokens: what a text's other tokens hold counts for nothing
        tokens = self.telling(text)
        words = {w for t in tokens for w in _WORD.findall(t.lower())}
        plain = [self.strength(w) for w in words]
        found = [s for s in plain if s >= ONCE]
        hidden = []
        for token in written_oddly(text, tokens):
            got = [w for w in self.restore(token) if w not in words]
            s = max((self.strength(w) for w in got), default=0.0)
            if s >= ONCE:
                found.append(s)
            hidden += [w for w in got if w in self.dense]
        if hidden or not self.dense.keys().isdisjoint(words):
            every = _WORD.findall(text.lower())
            n = Counter(w for w in [*every, *hidden] if w in self.dense)
            if (s := self.dense_strength(n, len(every))) >= LEAST_SHARE:
                found.append(s)
        if not found:
            return 0.05 * max(plain, default=0.0)
        return 1.0 - math.prod(1.0 - s for s in sorted(found))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, toxic) of about ``most`` labelled, not held-out rows,
    chosen by id hash. Repeated labels of an id count once (the larger);
    null labels and ids teach nothing."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    share = int((1 << 20) * min(1.0, most / max(1, n)))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    # bounded by ``most``: about 16 bytes a row
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")


#: Multipliers of the four hashes that copies are recognised by (any odd numbers).
_HASHES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def group_keys(text: str) -> list[int]:
    """Four keys: the least value of each of four hashes over all shingles of
    five words. Texts that share four fifths of their shingles share one of
    the keys almost surely."""
    w = text.lower().split()
    h = np.array([zlib.crc32(" ".join(w[i:i + 5]).encode()) for i in range(max(1, len(w) - 4))], np.uint32)
    return (h[None, :] * _HASHES[:, None]).min(axis=1).tolist()


def without_copies(sample: DataFrame) -> DataFrame:
    """The rows of (doc_id, text, toxic) that come first, by id, under every
    key that they have: of texts with one label that copy each other, one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [[k * 4 + i for i, k in enumerate(group_keys(t.as_py()))] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["doc_id", "toxic", "keys"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    keys = map_arrow(sample.select("doc_id", "text", "toxic"), run,
                     f"doc_id {kind}, toxic int, keys array<long>").select("doc_id", "toxic", F.explode("keys").alias("k"))
    first = keys.groupBy("k", "toxic").agg(F.min("doc_id").alias("first"))
    later = keys.join(first, ["k", "toxic"]).filter("first <> doc_id").select("doc_id").distinct()
    return sample.join(later, "doc_id", "left_anti")


def toxic_features(sample: DataFrame, most: int = MOST_FEATURES) -> tuple[dict[int, float], tuple[str, ...]]:
    """Feature hash -> strength of the toxic features among the words of
    (doc_id, text, toxic), and the letters of those features. Of a group of toxic near copies one document
    counts, so that copies do not make their words toxic; all others count.
    Features of toxic texts are counted first, the other texts count those
    alone."""
    toxic = staged(without_copies(sample.filter("toxic > 0")), "without-copies")

    def counter(wanted: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    found = []
                    for t in b.column(0).slice(at, 500):
                        got = features(t.as_py())
                        got = np.fromiter(got, np.int64, len(got))
                        found.append(got if wanted is None else np.intersect1d(got, wanted, assume_unique=True))
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])
        return run

    def counts(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        found = map_arrow(texts.select("text"), counter(wanted), "gram long, n long")
        return found.groupBy("gram").agg(F.sum("n").alias("n"))

    top = counts(toxic, None).filter(F.col("n") >= LEAST_TOXIC).orderBy(F.desc("n"), "gram").limit(MOST_CANDIDATES)
    top = staged(top.withColumnRenamed("n", "pos"), "toxic-features")
    wanted = np.sort(np.array([r.gram for r in top.select("gram").collect()], np.int64))
    clean = counts(sample.filter("toxic = 0"), wanted).withColumnRenamed("n", "neg")
    both = top.join(clean, "gram", "left").fillna(0, ["neg"]).filter("pos > neg")
    n, z2 = F.col("pos") + F.col("neg"), Z * Z
    p = F.col("pos") / n
    low = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    best = both.select("gram", low.alias("s")).filter(F.col("s") >= LEAST_SHARE).orderBy(F.desc("s"), "gram").limit(most)
    strong = {r.gram: r.s for r in best.collect()}

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = set()
                for w in {w for t in b.column(0).slice(at, 500) for w in _WORD.findall(t.as_py().lower())}:
                    for part, g in ((w, zlib.crc32(f"^{w}$".encode())),
                                    *[(w[:k], zlib.crc32(f"^{w[:k]}".encode())) for k in range(4, min(8, len(w) + 1))]):
                        if g in strong or dense_feature(g) in strong:
                            found.add(part)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["part"])

    # two features at most share their letters, as a word and as a beginning
    parts = map_arrow(toxic.select("text"), letters, "part string").distinct().collect() if strong else []
    return strong, tuple(sorted(r.part for r in parts))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = staged(labelled_sample(docs, labels), "labelled")
    return Model(language_model(docs), *toxic_features(sample))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row, each text read whole. Null and
    empty texts score 0; rows and repeats stay; the model (about 3 MB) travels
    with the task."""
    lm, strong, stems = model.lm, model.strong, model.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(lm, strong, stems)
        for b in batches:
            got = np.array([m.score(t.as_py()) for t in b.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))],
                names=[key, "score", "predicted"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, one row per row.

    Null and empty texts score 0; repeated rows and null ids are scored each; without
    labels, or without toxic ones, nothing scores 0.3; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
