"""Operator 11: URL filters by a trie over reversed host labels and path segments.

A rule names a host and the beginning of a path. It fits that host and all of its subdomains, where the URL's path
begins with the rule's. Of the rules that fit, the one with the most host labels holds, and of those the one with the longest path; where the
same host and path are both allowed and blocked, they are blocked.

Rules go to the tasks as a trie of at most ``MOST_RULES`` rules and ``MOST_BYTES`` of text, which is built once and broadcast.
Larger rule sets are dealt by hash to several tries; URLs then pass one after another, and the best rule so far is kept, so no task ever
holds more than one trie and pages are never shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut

#: Bounds of one broadcast trie: about 100 MB in a Python worker.
MOST_RULES, MOST_BYTES = 100_000, 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "n_labels int, n_path int, rule string, verdict string"


class Trie:
    """Rules (host, path, verdict) as edges (node, label or segment) -> node.

    A host label holds no slash, and a whole path segment ends in one, so both kinds of edges share one table. What
    a rule's path has after its last slash is the beginning of a segment, and is kept at the node before.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, dict[str, tuple[int, int, str, str]]] = {}
        for host, path, verdict in rules:
            labels = host.split(".")[::-1] if host else []
            *whole, part = re.split(r"(?<=/)", path)
            node = 0
            for step in [*labels, *whole]:
                node = self.edges.setdefault((node, step), len(self.edges) + 1)
            self.ends.setdefault(node, {})[part] = (len(labels), len(path), host + path, verdict)
        self.sizes = {node: sorted({len(part) for part in parts}, reverse=True) for node, parts in self.ends.items()}

    def _at(self, node: int, segment: str) -> tuple[int, int, str, str] | None:
        """The longest rule that ends at ``node`` or within the segment after it."""
        parts = self.ends.get(node)
        if parts:
            for size in self.sizes[node]:
                if segment[:size] in parts:
                    return parts[segment[:size]]
        return None

    def find(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """The rule that holds for a host and path."""
        nodes = [0]
        for label in host.split(".")[::-1] if host else []:
            node = self.edges.get((nodes[-1], label))
            if node is None:
                break
            nodes.append(node)
        segments = re.split(r"(?<=/)", path)
        for node in nodes[::-1]:
            best = None
            for segment in segments:
                best = self._at(node, segment) or best
                node = self.edges.get((node, segment))
                if node is None:
                    break
            if best:
                return best
        return None


def url_host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tries(rules: DataFrame, most_rules: int = MOST_RULES, most_bytes: int = MOST_BYTES) -> list[Trie]:
    """The tries of ``rules`` (host, path, verdict), each within the bounds: they are collected one part at a time."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.lit("a rule allows or blocks")))
    # no URL has a host with these marks
    one = rules.select(host.alias("host"), path.alias("path"), known.alias("verdict")).where(~F.col("host").rlike("[/?#]")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = one.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    # parts are dealt by hash, and half full on average
    parts = 1 if size.n <= most_rules and size.bytes <= most_bytes else max(-(-2 * size.n // most_rules), -(-2 * size.bytes // most_bytes))
    for part in range(parts):
        mine = one if parts == 1 else one.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        yield Trie([tuple(r) for r in mine.select("host", "path", "verdict").collect()])


def _finder(shared: Broadcast):
    """The rule that holds by a shared trie, as a function of host and path columns."""

    @F.pandas_udf(FOUND)
    def found(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [shared.value.find(h, p) or (None, None, None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(rows, columns=["n_labels", "n_path", "rule", "verdict"]).astype({"n_labels": "Int32", "n_path": "Int32"})

    return found


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: id, host, path, rule (host and path of the one that holds, else null), verdict (its, else ``default``).

    A null URL or one without ``://`` has an empty host and path, which only rules without a host fit. Null hosts or paths of
    rules count as empty and fit everything; a verdict other than allow or block is an error. Repeated rows stay, ids may be null, URLs may be of any length.
    No pages give no rows, no rules give ``default``; other columns are ignored.
    """
    sc = pages.sparkSession.sparkContext
    url = F.col(url_col).cast("string")
    out = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), F.lit(None).cast(f"struct<{FOUND.replace(' int', ':int').replace(' string', ':string')}>").alias("_best"))
    for at, trie in enumerate(tries(rules, most_rules, most_bytes)):
        shared = sc.broadcast(trie)

        if at:
            out = cut(out)
        out = out.withColumn("_found", _finder(shared)("host", "path")).withColumn("_best", F.greatest("_best", F.when(F.col("_found.rule").isNotNull(), F.col("_found")))).drop("_found")
    return out.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: Fixed rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


URL_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(map(str, RULES))}),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT n, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (n)
"""
