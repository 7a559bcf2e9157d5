"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import (bpe, collocations, langid, merkle, mixing, quality, secrets, sharding, simhash, spotsigs, toxicity,
               urlfilter, warc)

MODULES = (warc, langid, sharding, secrets, quality, simhash, spotsigs, mixing, bpe, toxicity,
           urlfilter, collocations, merkle)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
