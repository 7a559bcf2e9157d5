"""URL filter: a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits a URL whose host is the rule's or below it
and whose path starts with the rule's path. Of the rules that fit, the one
with the most host labels wins, then the one with the longest path; of equal
rules the block. So an allow entry opens a part of what a shorter block entry
closes, and the other way round.

The trie is a flat table of edges, built once and broadcast. A URL walks its
host labels from the right and, at the deepest host with rules, its path
segments from the left: the work grows with the URL, not with the rules. The
rules' size is checked before they are pulled; beyond the bound the same
precedence comes from a join on (host, path directory) keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, read

ALLOW, BLOCK = "allow", "block"
RULE_SCHEMA = "host string, path string, verdict string"
#: UTF-8 bytes of hosts and paths up to which the rules are broadcast.
TRIE_BYTES = 32 << 20

# The rules of the query.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased; the path goes on to ``?``, ``#``
    or the end. Both are empty for a null URL and one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, big, big.lower()), path


def split_path(path: str) -> tuple[list[str], str]:
    """Segments that a ``/`` ends, and what follows the last ``/``."""
    *whole, tail = path.split("/")
    return whole, tail


class Trie:
    """Rules by host labels from the right, then path segments from the left.

    Nodes are numbers. ``hosts`` and ``paths`` hold the edges, ``roots`` the
    path tree of a host node, ``ends`` per path node the rules that end there:
    by their unfinished last segment, which any start of the URL's next
    segment may equal.
    """

    def __init__(self, rules: Iterable[Sequence[str]]):
        self.hosts, self.paths, self.roots, self.ends = {}, {}, {}, {}
        nodes = 1
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                nodes += (node, label) not in self.hosts
                node = self.hosts.setdefault((node, label), nodes - 1)
            nodes += node not in self.roots
            node = self.roots.setdefault(node, nodes - 1)
            whole, tail = split_path(path)
            for segment in whole:
                nodes += (node, segment) not in self.paths
                node = self.paths.setdefault((node, segment), nodes - 1)
            end = self.ends.setdefault(node, {})
            if end.get(tail, (None, ALLOW))[1] != BLOCK:
                end[tail] = (host + path, verdict)
        self.lengths = {node: sorted({len(t) for t in end}, reverse=True) for node, end in self.ends.items()}

    def longest_path(self, root: int, whole: list[str], tail: str):
        """The rule with the longest path below ``root``, or None."""
        node, walked = root, [root]
        for segment in whole:
            node = self.paths.get((node, segment))
            if node is None:
                break
            walked.append(node)
        for depth in reversed(range(len(walked))):
            node, rest = walked[depth], whole[depth] if depth < len(whole) else tail
            for n in self.lengths.get(node, ()):
                if n <= len(rest) and rest[:n] in self.ends[node]:
                    return self.ends[node][rest[:n]]
        return None

    def match(self, host: str, path: str):
        """(rule, verdict) of the winning rule, or None."""
        node, walked = 0, [0] if 0 in self.roots else []
        for label in reversed(host.split(".")):
            node = self.hosts.get((node, label))
            if node is None:
                break
            if node in self.roots:
                walked.append(node)
        if not walked:
            return None
        whole, tail = split_path(path)
        for node in reversed(walked):
            hit = self.longest_path(self.roots[node], whole, tail)
            if hit:
                return hit
        return None


def checked_rules(rules: DataFrame) -> DataFrame:
    """Rules with lower-case hosts; a null or slashed host, a null path or an
    unknown verdict is an error, not a rule that never fits."""
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wrong = (F.col("host").isNull() | F.col("host").rlike("[/?#]") | F.col("path").isNull()
             | F.coalesce(~F.col("verdict").isin(ALLOW, BLOCK), F.lit(True)))
    text = F.concat_ws(", ", F.coalesce("host", F.lit("null")), F.coalesce("path", F.lit("null")), "verdict")
    verdict = F.when(wrong, F.raise_error(F.concat(F.lit("not a rule: "), text)).cast("string")).otherwise(F.col("verdict"))
    return rules.select(F.translate("host", big, big.lower()).alias("host"), "path", verdict.alias("verdict"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW,
          trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``urls`` plus ``host, path, rule, verdict``: the rule as ``host+path``
    (null if none fits), and its verdict or ``default``.

    A null URL or one without ``://`` has an empty host and path, which only a
    rule with an empty host fits (it fits every URL whose path it starts).
    Repeated rows are judged each; no URLs or no rules are fine. The columns
    that are added must not be there already.
    """
    clash = {"host", "path", "rule", "verdict"} & set(urls.columns)
    if clash:
        raise ValueError(f"columns that judge adds are there already: {sorted(clash)}")
    host, path = url_parts(F.col(url))
    split = urls.select("*", host.alias("host"), path.alias("path"))
    rules = checked_rules(rules)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)),
                     F.count(F.when(F.length("verdict") > 0, 1))).first()[0]
    if size <= trie_bytes:
        return _by_trie(split, rules, default)
    return _by_join(split, rules, default)


def _by_trie(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    spark = split.sparkSession
    trie = spark.sparkContext.broadcast(Trie([(r.host, r.path, r.verdict) for r in rules.collect()]))
    at, to = split.columns.index("host"), split.columns.index("path")

    def run(batches):
        known = trie.value
        for batch in batches:
            hits = [known.match(h, p) for h, p in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([h and h[0] for h in hits], pa.string()),
                 pa.array([h[1] if h else default for h in hits], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])
    return map_arrow(split, run, schema)


def _by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rules too large to broadcast: distinct (host, path) pairs are
    spread into (host suffix, path directory) keys, as deep as any rule goes,
    and joined with the rules by key; the largest by precedence stays."""
    def labels(c):
        return F.size(F.split(c, "\\.")) * (F.length(c) > 0).cast("int")
    deep = rules.agg(F.max(labels(F.col("host"))), F.max(F.size(F.split("path", "/")) - 1)).first()
    hosts, dirs = int(deep[0] or 0), int(deep[1] or 0)
    pairs = split.select("host", "path").distinct()
    host_at = F.split("host", "\\.")
    host_keys = F.transform(F.sequence(F.lit(0), F.least(F.size(host_at), F.lit(hosts))), lambda k: F.when(
        k == 0, F.lit("")).otherwise(F.array_join(F.slice(host_at, F.size(host_at) - k + 1, k), ".")))
    seg = F.split("path", "/")
    keyed = pairs.withColumn("hk", F.explode(F.array_distinct(host_keys))).withColumn("seg", seg).withColumn(
        "depth", F.explode(F.sequence(F.lit(0), F.least(F.size(seg) - 1, F.lit(dirs)))))
    keyed = keyed.select("host", "path", "hk", F.array_join(F.slice("seg", 1, F.col("depth")), "/").alias("dk"), "depth")
    cut = F.split("path", "/")
    ruled = rules.select(F.col("host").alias("hk"), F.col("path").alias("rp"), "verdict", (F.size(cut) - 1).alias("depth"),
                         F.array_join(F.slice(cut, 1, F.size(cut) - 1), "/").alias("dk"), labels(F.col("host")).alias("n"))
    hit = keyed.join(ruled, ["hk", "dk", "depth"]).filter(F.col("path").startswith(F.col("rp")))
    rank = F.struct("n", F.length("rp").alias("len"), (F.col("verdict") == BLOCK).alias("block"),
                    F.concat("hk", "rp").alias("rule"), "verdict")
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"),
        F.col("best.verdict").alias("verdict"))
    return split.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop(
        "_h", "_p").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` URL judged by the fixed rules; what no rule fits is
    allowed. Null URLs have an empty host and path; repeated rows give a row
    each; an empty table gives none."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, spark.createDataFrame(list(RULES), RULE_SCHEMA))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE = {"op11_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (
  SELECT page_id, row_number() OVER () AS row,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
split AS (
  SELECT page_id, row, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fits AS (
  SELECT row, max(struct_pack(n := length(rh), m := length(rp), rule := rh || rp, verdict := rv)) AS best
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{ALLOW}') AS verdict
FROM split LEFT JOIN fits ON split.row = fits.row"""}

QUERIES = {"op11_url_filter": op11_url_filter}
