"""Operator 10: substring dedup by Rabin-Karp hashes of every fixed-length token window.

Every window of ``width`` words of every text is hashed; the hashes are counted over the whole
corpus (``multiplicity``), those that occur again once more by other hashes, and words in a window that occurs again by
both merge into maximal intervals to remove. Windows are judged on the input. Of n windows, about n * n / 2**65 pairs of different
ones agree in the first hash by chance, which the second one tells. Both are made of the same 64-bit hashes of words: two words that agree
in theirs are one word to both, and w different words have about w * w / 2**65 such pairs.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .multiplicity import Grades, Once, chunked, with_grades

SCHEMA = "id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, keep_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (words joined by one space; null
    with ``keep_text=False``), kept_sha256 and ``removed``, the maximal [start, end) word intervals.

    A null or empty text has no words. Repeated rows are separate documents, so each of them is
    all repeats if it has ``width`` words. An empty table gives an empty result; other columns are
    ignored. A text with fewer words than ``width`` is kept whole. Ids are whole numbers.
    """

    def hashed(texts: pa.ChunkedArray) -> list[tuple]:
        """Bytes, offsets, word hashes, first words, window hashes and places of runs of texts."""
        out = []
        for _, data, offsets in W.slices(texts):
            own = W.words(data, offsets)
            out.append((data, offsets, *own, *W.windows(*own, width)))
        return out

    once = Once(hashed)

    def keys(texts: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(x[4] for x in once(texts))])

    def others(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return W.windows(W.mix(hashes ^ W.K1), first, width)[0]

    def again(texts: pa.ChunkedArray, grades: Grades) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(others(x[2], x[3])[grades.of(x[4]) > 0] for x in once(texts))])

    def work(table: pa.Table, texts: pa.ChunkedArray, grades: Grades, checked: Grades) -> pa.Table:
        n_words, removed, kept, digests, cuts = [], [], [], [], []
        ids = table.column("id")
        for data, offsets, hashes, first, found, at in once(texts):
            twice = np.flatnonzero(grades.of(found) > 0)
            twice = twice[checked.of(others(hashes, first)[twice]) > 0]
            gone = W.covered(at[twice], width, len(hashes))
            for k in range(len(offsets) - 1):
                own = gone[first[k] : first[k + 1]]
                here = data[offsets[k] : offsets[k + 1]].tobytes().split()
                lost = int(own.sum())
                if lost:
                    here = compress(here, (~own).tolist())
                rest = b" ".join(here)
                n_words.append(len(own))
                removed.append(lost)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if keep_text else None)
                a, b = W.runs(own) if lost else ((), ())
                cuts.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
        return pa.table({
            "id": ids.cast(pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
            "kept_sha256": pa.array(digests, pa.string()),
            "removed": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return with_grades(chunked(docs, id_col, text_col), keys, work, SCHEMA, again=again).withColumnRenamed("id", id_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, width=35, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").alias("n_intervals"))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SUBSTRING_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS words FROM documents),
g AS (SELECT r, i, array_to_string(words[i : i + 34], ' ') AS gram FROM w, unnest(range(1, len(words) - 33)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
gone AS (SELECT r, list(DISTINCT j) AS js FROM again, unnest(range(i, i + 35)) AS t(j) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(coalesce(js, [])) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(js, []), i)), ' ')) AS kept_sha256,
  len(list_filter(coalesce(js, []), lambda j: NOT list_contains(js, j - 1))) AS n_intervals
FROM w LEFT JOIN gone USING (r)
"""
