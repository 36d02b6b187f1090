"""Operator 5: quality rules with an isolation forest on the rule statistics.

One pass measures every whole text. Fixed rules reject what is far too short or mostly repeats.
An isolation forest, grown on a bounded sample of the measured rows, gives each document the mean
length of its path over random splits; short paths are anomalies. Trees see few rows each, so
that rows of one odd kind do not hide one another. The threshold comes from
labelled rows: it is the highest that rejects at most a given share of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .workspace import cut, spread

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks"]
#: What the forest splits on: shares, and the mean length of a word. A text's length alone is no fault, and lines that repeat are
#: among the repeated words if they are long and often numbers or names if they are not.
FEATURES = ["word_length", "symbols", "repeats", "upper", "marks", "letters"]
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:()[]{}|/\\\"'"


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(chars)] = True
    return found


KINDS = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(bytes(range(65, 91))),
    "n_letters": _table(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])),
    "n_marks": _table(MARKS),
}
#: First bytes of characters.
LEADS = np.array([not 0x80 <= b < 0xC0 for b in range(256)]) & ~W.SPACE


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """The counts of ``COUNTS`` for each whole text; all are 0 for a null or empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slices(batch.column("text")):
                hashes, first = W.words(data, offsets)
                found = {"n_words": np.diff(first), "word_chars": _per_text(LEADS[data], offsets)}
                found |= {k: _per_text(flags[data], offsets) for k, flags in KINDS.items()}
                seen, begin = W.windows(hashes, first, window)
                owner = np.searchsorted(first, begin, "right") - 1
                _, where, times = np.unique(W.mix(seen ^ W.mix(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
                gone = W.covered(begin[times[where] > 1], window, len(hashes))
                found["n_repeat_words"] = _per_text(gone, first)
                found["n_dup_lines"] = [_repeated_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch({"id": batch.column("id").slice(at, len(offsets) - 1)} | {k: pa.array(found[k], pa.int64()) for k in COUNTS})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


def features(pdf: pd.DataFrame) -> np.ndarray:
    words, chars = np.maximum(pdf.n_words, 1), np.maximum(pdf.word_chars, 1)
    return np.column_stack([
        pdf.word_chars / words, pdf.n_symbols / words, pdf.n_repeat_words / words,
        pdf.n_upper / np.maximum(pdf.n_letters, 1), pdf.n_marks / words, pdf.n_letters / chars,
    ]).astype(np.float64)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: the split feature (-1: a leaf), its value, the left child (the right one follows), the path length of a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    norm: float

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        most = 2 * sample + 1
        feature, value = np.full((trees, most), -1), np.zeros((trees, most))
        left, length = np.zeros((trees, most), dtype=np.int64), np.zeros((trees, most))
        for t in range(trees):
            todo, made = [(0, rows[rng.choice(len(rows), sample, replace=False)], 0)], 1
            while todo:
                node, own, level = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(open_):
                    length[t, node] = level + _expected(len(own))
                    continue
                f = int(rng.choice(open_))
                at = rng.uniform(low[f], high[f])
                feature[t, node], value[t, node], left[t, node] = f, at, made
                below = own[:, f] < at
                todo += [(made, own[below], level + 1), (made + 1, own[~below], level + 1)]
                made += 2
        return cls(feature, value, left, length, depth, float(_expected(sample)) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected one): near 1 for anomalies."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[index, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = 200,
    sample: int = 32,
    good_lost: float = 0.005,
    seed: int = 5,
) -> DataFrame:
    """One row per input row: id, the counts, base_failed, anomaly (0 to 1), kept.

    The forest grows on up to ``trees * sample`` rows that pass the fixed rules, those with the lowest hashes of their
    ids, whatever the size of the corpus. The threshold comes from all labelled rows that pass them (``labels``: id,
    quality 1 or 0). Of thresholds that reject at most ``good_lost`` of the good
    ones, that with most bad ones rejected is taken, the highest of equals. With no labelled row of both kinds
    nothing is rejected as an anomaly.

    Texts may be of any length. A null or empty text has 0 words and fails the fixed rules. Repeated rows get equal results; a null id is never
    labelled; labels that repeat for an id count each time. Empty tables give empty results; other columns are ignored.
    """
    counts = cut(measure(docs, id_col, text_col).withColumn("base_failed", base_failed()))
    passed = counts.where(~F.col("base_failed"))
    grown = lowest(passed, trees * sample, id_col, seed)
    marked = labels.select(F.col(id_col), F.col("quality")).where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    forest = Forest.grow(features(grown), trees, sample, seed) if len(grown) else None

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # scores are positive, so their bits are in the same order
            yield pd.DataFrame({"bits": forest.score(features(pdf)).view(np.int64), "good": pdf.quality > 0})

    limit = threshold(cut(passed.join(marked, id_col).mapInPandas(rate, "bits long, good boolean")), good_lost) if forest else np.inf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["anomaly"] = forest.score(features(pdf)) if forest else 0.0
            pdf["kept"] = ~pdf["base_failed"] & (pdf["anomaly"] < limit)
            yield pdf

    schema = f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return counts.mapInPandas(run, schema)


def lowest(df: DataFrame, n: int, id_col: str, seed: int, slack: int = 4) -> pd.DataFrame:
    """The ``n`` rows with the lowest hashes of their ids (ties by id). Only rows under a bound that about ``slack * n``
    rows meet take part, so tasks send few rows however many they are."""
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
    for bound in (min(1 << 40, (slack * n << 40) // max(1, df.count())), 1 << 40):
        found = df.where(place < bound).orderBy(place, *df.columns).limit(n).toPandas()
        if len(found) == n or bound == 1 << 40:
            break
    return found


def threshold(scored: DataFrame, good_lost: float) -> float:
    """The anomaly score from which rows are rejected, from the bits of all labelled rows' scores. The first good score
    that may not be lost is told by its rank, twelve bits at a time."""
    told = scored.groupBy("good").count().collect()
    n = {r.good: r["count"] for r in told}
    if len(n) < 2:
        return np.inf
    left, floor, own = int(good_lost * n[True]), 0, scored.where("good")
    for shift in (52, 40, 28, 16, 4, 0):
        for part, count in sorted(own.groupBy(F.shiftright("bits", shift)).count().collect(), reverse=True):
            if left < count:
                break
            left -= count
        floor, own = part, own.where(F.shiftright("bits", shift) == part)
    # just above it
    least = scored.where(~F.col("good") & (F.col("bits") > floor)).agg(F.min("bits")).first()[0]
    return np.inf if least is None else float(np.array([least], dtype=np.int64).view(np.float64)[0])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the rules without the forest, which SQL can express."""
    found = measure(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *COUNTS[:5], failed.alias("base_failed"))


RULE_COUNTS_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS gram FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, gram HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM twice, unnest(range(i, i + 8)) AS t(j) GROUP BY r),
c AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""
