"""How often each of many 64-bit keys occurs in a whole corpus, told back to where it occurs.

Texts are dealt to chunks by a hash of id and text, so a chunk holds about as much of a hot
source or group of copies as any other (rows with equal ids and equal texts lie in one chunk). Each chunk sends
its distinct keys with their counts, sorted and packed, to key ranges ("buckets"); a bucket adds the counts up and
answers every chunk with one byte a key. So a key crosses the network once a chunk however hot it is, and
neither a chunk nor a bucket grows with the number of copies of anything. There are as many
chunks and buckets as spark.sql.shuffle.partitions, so it also sets what a task holds at once.

With more than ``FAN`` chunks, keys go up in levels: a node merges the runs that up to ``FAN`` nodes below have of one
key range and sends them on in ``FAN`` narrower ranges; answers come down the same way. So each chunk or node
sends ``FAN`` packed rows at most, and their number grows in proportion to the number of chunks. A node holds about
as many keys as a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import shuffle_partitions

#: Most nodes that a chunk or node sends keys to.
FAN = 256
#: Keys of one chunk's texts: takes the texts, gives all keys (with repeats).
Keys = Callable[[pa.ChunkedArray], np.ndarray]


class Once:
    """``make`` of texts, computed once while the same texts are asked for."""

    def __init__(self, make: Callable[[pa.ChunkedArray], object]):
        self.make, self.texts, self.value = make, None, None

    def __call__(self, texts: pa.ChunkedArray) -> object:
        if texts is not self.texts:
            self.texts, self.value = texts, self.make(texts)
        return self.value


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys with the bytes of equal weight together: the high ones compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in ascending order, by a sort: ``np.unique`` without counts goes by a hash table from numpy 2.3 on, which takes
    40 times as long for millions of keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def grade(counts: np.ndarray) -> np.ndarray:
    """0 for 1, 4 for 2, and so on: four steps for each doubling, in one byte."""
    return np.minimum(255, np.floor(4 * np.log2(counts.astype(np.float64)))).astype(np.uint8)


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, id, text); null texts stay and have no keys."""
    n = shuffle_partitions(docs.sparkSession)
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).alias("chunk"),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )


def shape(n: int, fan: int) -> tuple[int, int]:
    """Levels, and the fan of each, for n chunks: the fewest levels with at most ``fan``."""
    levels = 1
    while fan**levels < n:
        levels += 1
    even = max(2, round(n ** (1 / levels)))
    return levels, even if even**levels >= n else even + 1


def replies(chunks: DataFrame, keys: Callable[..., np.ndarray], fan: int = FAN, before: DataFrame | None = None) -> DataFrame:
    """(child, part, grades): for a chunk's distinct keys in ascending order, in parts. With ``before``, replies to other keys, ``keys`` takes
    the texts and the chunk's part of them.

    A node of a level is numbered ``group * fan ** level + range``: it has the keys of one of ``fan ** level`` ranges of
    ``fan ** level`` chunks, a group. Chunks are the nodes of level 0.
    """
    levels, fan = shape(shuffle_partitions(chunks.sparkSession), fan)

    def sent(child: int, level: int, own: np.ndarray, counts: np.ndarray) -> pa.Table:
        """What a node sends to the level: its keys in ``fan`` ranges."""
        group, place = divmod(child, fan ** (level - 1))
        bounds = np.array([((place * fan + d) << 64) // fan**level for d in range(1, fan)], dtype=np.uint64)
        cut = np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])
        full = np.flatnonzero(np.diff(cut))
        counts = np.minimum(counts, 255).astype(np.uint8)
        return pa.table({
            "node": pa.array(group // fan * fan**level + place * fan + full, pa.int64()),
            "child": pa.array([child] * len(full), pa.int64()),
            "part": pa.array(full, pa.int32()),
            "keys": pa.array([packed(own[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
            "counts": pa.array([counts[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys and their counts, the place of each key received, and where each run of them begins."""
        parts = [np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in table.column("keys"))]
        counts = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), dtype=np.uint8) for x in table.column("counts"))])
        own, where = np.unique(np.concatenate(parts), return_inverse=True)
        return own, np.bincount(where, weights=counts, minlength=len(own)), where, np.cumsum([0, *map(len, parts[1:])])

    def answers(table: pa.Table, grades: np.ndarray, where: np.ndarray, cut: np.ndarray) -> pa.Table:
        grades = grades[where]
        return pa.table({"child": table.column("child"), "part": table.column("part"), "grades": pa.array([grades[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def first(key: tuple, table: pa.Table, *answer: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), 1, *np.unique(keys(table.column("text"), *answer), return_counts=True))

    def first_after(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        return first(key, table, answer)

    def on(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
        return lambda key, table: sent(key[0].as_py(), level, *merged(table)[:2])

    def top(table: pa.Table) -> pa.Table:
        _, counts, where, cut = merged(table)
        return answers(table, grade(counts), where, cut)

    def down(table: pa.Table, answer: pa.Table) -> pa.Table:
        own, _, where, cut = merged(table)
        return answers(table, joined(answer, len(own)), where, cut)

    runs, reply = "node long, child long, part int, keys binary, counts binary", "child long, part int, grades binary"
    own = chunks.groupBy("chunk")
    up = [own.applyInArrow(lambda key, table: first(key, table), runs) if before is None else own.cogroup(before.groupBy("child")).applyInArrow(first_after, runs)]
    for level in range(2, levels + 1):
        up.append(up[-1].groupBy("node").applyInArrow(on(level), runs))
    out = up[-1].groupBy("node").applyInArrow(top, reply)
    for rows in up[-2::-1]:
        out = rows.groupBy("node").cogroup(out.groupBy("child")).applyInArrow(down, reply)
    return out


def joined(answer: pa.Table, n: int) -> np.ndarray:
    """The grades of n keys in ascending order, from their parts."""
    order = np.argsort(answer.column("part").to_numpy())
    parts = answer.column("grades").to_pylist()
    grades = np.frombuffer(b"".join(parts[i] for i in order), dtype=np.uint8)
    if len(grades) != n:
        raise ValueError(f"{n} keys, {len(grades)} grades")
    return grades


class Grades:
    """The grades of a chunk's keys."""

    def __init__(self, keys: np.ndarray, answer: pa.Table):
        self.keys = distinct(keys)
        self.grades = joined(answer, len(self.keys))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Sought in ascending order, so that each search begins where the last one was, in memory that is at hand."""
        order = np.argsort(keys)
        found = np.empty(len(keys), dtype=np.uint8)
        found[order] = self.grades[np.searchsorted(self.keys, keys[order])]
        return found


def with_grades(chunks: DataFrame, keys: Keys, work: Callable[..., Iterator[pa.Table] | pa.Table], schema: str, fan: int = FAN, again: Callable[[pa.ChunkedArray, Grades], np.ndarray] | None = None) -> DataFrame:
    """``work`` on each chunk (id, text) with the corpus-wide grades of its keys. With ``again``, which gives other keys of what is repeated by
    the first ones, ``work`` takes the texts as they were given to both, and the grades of those keys too, so that it can tell chance collisions."""
    answer = replies(chunks, keys, fan)
    if again is None:

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(left, Grades(keys(left.column("text")), right))

        return chunks.groupBy("chunk").cogroup(answer.groupBy("child")).applyInArrow(run, schema)

    def others(texts: pa.ChunkedArray, own: pa.Table) -> np.ndarray:
        return again(texts, Grades(keys(texts), own))

    def run_again(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text")
        turns = [right.filter(pc.equal(right.column("turn"), k)) for k in (0, 1)]
        grades = Grades(keys(texts), turns[0])
        return work(left, texts, grades, Grades(again(texts, grades), turns[1]))

    checked = replies(chunks, others, fan, answer)
    both = answer.withColumn("turn", F.lit(0)).union(checked.withColumn("turn", F.lit(1)))
    return chunks.groupBy("chunk").cogroup(both.groupBy("child")).applyInArrow(run_again, schema)
