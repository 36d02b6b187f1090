"""Operator 2: substring dedup with sparse suffix arrays.

Only suffixes that begin at content-selected positions are kept: those where the hash of the next
``seed`` words is the least among ``span`` neighbours (a minimiser). A passage of
``seed + span - 1`` words or more holds such a position at the same place in each of its copies.
Positions whose seed occurs once in the corpus (``multiplicity``) are dropped. The others are
sorted by the words that follow (by those before them for equal ones), a range of the order to a
task; each is compared with its neighbours and the match is extended to both sides. As the next
kept position is at most ``span`` words away, it is enough that a row carries ``span`` words
before and ``least`` words after its position: the union of the matches is the whole repeat.
Rows of one context (equal words on both sides) lie together, so neighbours tell all where a seed
has one or two contexts. They do not where it has three or more: the partner may not be next to the
position. There, the runs of ``least`` words that hold the position are counted by hash, once a
context, as far as a neighbour in the order shares the words after; no other row shares more of them.
A seed's contexts are mostly in one task, which counts them by itself; where they are very many or lie in
several tasks, they are counted by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .multiplicity import Grades, chunked, with_grades
from .substring_dedup import WORDS_SQL
from .workspace import cut, shuffle_partitions

ROW = "id long, text long, pos int, seed binary, after binary, before binary"
SPAN = "id long, text long, start long, end long"
BACK = 0xD1342543DE82EF95


def minimisers(hashes: np.ndarray, first: np.ndarray, seed: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and the hashes of their seeds: the least of each run of ``span`` seeds in a text (the last of
    equal ones), or of all seeds of a text with fewer."""
    found, at = W.windows(hashes, first, seed)
    if not len(found):
        return at, found
    owner = np.searchsorted(first, at, "right") - 1
    begin = np.searchsorted(owner, np.arange(len(first) - 1))
    count = np.diff(np.append(begin, len(at)))
    # the least of found[i : i + width] by doubling, on pairs (hash, -place)
    kept = np.zeros(len(found), dtype=bool)
    best = np.arange(len(found))
    width = 1

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(found[y] <= found[x], y, x)

    steps = []
    while width * 2 <= span:
        steps.append((width, best))
        ahead = np.minimum(np.arange(len(best)) + width, len(best) - 1)
        best = lower(best, best[ahead])
        width *= 2
    ahead = np.minimum(np.arange(len(best)) + span - width, len(best) - 1)
    best = lower(best, best[ahead])
    last = np.repeat(begin + count, count)
    full = np.arange(len(found)) + span <= last
    kept[best[full]] = True
    for k in np.flatnonzero((count > 0) & (count < span)):
        own = found[begin[k] : begin[k] + count[k]]
        kept[begin[k] + count[k] - 1 - int(np.argmin(own[::-1]))] = True
    return at[kept], found[kept]


def suffixes(docs: DataFrame, id_col: str, text_col: str, seed: int, span: int, least: int) -> DataFrame:
    """The kept suffixes whose seed occurs again, with hashes of the words after and (nearest first) before them."""

    def keys(texts: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(minimisers(*W.words(data, offsets), seed, span)[1] for _, data, offsets in W.slices(texts))])

    def work(table: pa.Table, grades: Grades) -> Iterator[pa.Table]:
        ids, texts = table.column("id").cast(pa.int64()).to_numpy(zero_copy_only=False), table.column("text")
        null = table.column("id").is_null().to_numpy(zero_copy_only=False)
        out = []
        for at, data, offsets in W.slices(texts):
            hashes, first = W.words(data, offsets)
            pos, found = minimisers(hashes, first, seed, span)
            again = grades.of(found) > 0
            pos, found = pos[again], found[again]
            owner = np.searchsorted(first, pos, "right") - 1
            short = (hashes >> np.uint64(32)).astype(">u4")
            after = _context(short, pos[:, None] + np.arange(least), np.zeros(len(pos), np.int64), first[owner + 1])
            before = _context(short, pos[:, None] - 1 - np.arange(span), first[owner], first[owner + 1])
            whole = np.array([_text_key(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)
            out.append(pa.table({
                "id": pa.array(ids[at + owner], pa.int64(), mask=null[at + owner]),
                "text": pa.array(whole[owner], pa.int64()),
                "pos": pa.array(pos - first[owner], pa.int32()),
                "seed": pa.array([x.tobytes() for x in found.astype(">u8")], pa.binary()),
                "after": pa.array(after, pa.binary()),
                "before": pa.array(before, pa.binary()),
            }))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("seed", "after", "before")}})

    return with_grades(chunked(docs, id_col, text_col), keys, work, ROW)


def _text_key(data: np.ndarray) -> int:
    """Tells texts of one id apart."""
    return int(W.hash_spans(data, np.array([0]), np.array([len(data)])).view(np.int64)[0]) if len(data) else 0


def _context(short: np.ndarray, index: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    inside = (index >= low[:, None]) & (index < high[:, None])
    size = inside.sum(axis=1) * 4
    rows = short[np.clip(index, 0, max(0, len(short) - 1))].view(np.uint8).reshape(len(index), 4 * index.shape[1])
    return [row[:n].tobytes() for row, n in zip(rows, size, strict=True)]


def _shared(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Number of equal leading words of padded rows, at most ``size``."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), size)


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    size = np.array([len(x) // 4 for x in parts], dtype=np.int64)
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in parts), dtype=">u4").reshape(len(parts), width), size


def _matches(rows: pa.Table, span: int, least: int) -> pa.Table:
    """Both ends of every match of at least ``least`` words between one row and the next."""
    after, after_n = _padded(rows.column("after"), least)
    before, before_n = _padded(rows.column("before"), span)
    seeds = np.frombuffer(b"".join(rows.column("seed").to_pylist()), dtype=">u8")
    right = _shared(after[:-1], after[1:], np.minimum(after_n[:-1], after_n[1:]))
    left = _shared(before[:-1], before[1:], np.minimum(before_n[:-1], before_n[1:]))
    found = np.flatnonzero((seeds[:-1] == seeds[1:]) & (left + right >= least))
    pos = rows.column("pos").to_numpy().astype(np.int64)
    pair = np.concatenate([found, found + 1])
    starts, ends = np.concatenate([pos[found] - left[found], pos[found + 1] - left[found]]), np.concatenate([pos[found] + right[found], pos[found + 1] + right[found]])
    return pa.table({"id": rows.column("id").take(pa.array(pair)), "text": rows.column("text").take(pa.array(pair)), "start": starts, "end": ends})


def _runs(reps: pa.Table, reach: np.ndarray, span: int, least: int) -> pa.Table:
    """The runs of ``least`` words around each position, with at most ``reach`` of the words after it, and a hash of what they hold
    and where the position lies in them."""
    after, _ = _padded(reps.column("after"), least)
    before, before_n = _padded(reps.column("before"), span)
    seeds = np.frombuffer(b"".join(reps.column("seed").to_pylist()), dtype=">u8").astype(np.uint64)

    def sums(words: np.ndarray, base: int) -> np.ndarray:
        powers = np.full(words.shape[1], base, dtype=np.uint64)
        powers[:1] = 1
        total = np.zeros((len(words), words.shape[1] + 1), dtype=np.uint64)
        np.cumsum(W.mix(words.astype(np.uint64)) * np.cumprod(powers), axis=1, out=total[:, 1:])
        return total

    back = np.arange(span)
    row, back = np.nonzero((back >= least - reach[:, None]) & (back <= before_n[:, None]))
    here = W.mix(seeds[row] + back.astype(np.uint64) * W.K1)
    hashes = W.mix(sums(after, W.BASE)[row, least - back] + W.mix(sums(before, BACK)[row, back] ^ here))
    start = reps.column("pos").to_numpy().astype(np.int64)[row] - back
    row = pa.array(row, pa.int64())
    return pa.table({"id": reps.column("id").take(row), "text": reps.column("text").take(row), "start": start, "end": start + least, "run": hashes.view(np.int64), "row": row})


def _whole(runs: pa.Table) -> pa.Table:
    """What the repeated ones among ``runs`` cover, when no other run can be equal to one of them: an interval for each position, as its
    runs all hold it."""
    _, at, n = np.unique(runs.column("run").to_numpy(), return_inverse=True, return_counts=True)
    again = runs.filter(pa.array(n[at] > 1)).group_by("row").aggregate([("id", "min"), ("text", "min"), ("start", "min"), ("end", "max")])
    return pa.table({"id": again.column("id_min"), "text": again.column("text_min"), "start": again.column("start_min"), "end": again.column("end_max"), "run": pa.nulls(len(again), pa.int64())})


class Contexts:
    """One row of each context (seed, after, before) of a task's rows in that order. A seed's contexts are held until the next seed
    begins and are compared here. Where they are more than ``most``, or may go on in another task (at both ends of this one), their runs are
    given to be counted with those of other tasks."""

    def __init__(self, span: int, least: int, most: int):
        self.span, self.least, self.most = span, least, most
        #: Rows of the seed that goes on, how many of them are done, whether it has others (here or in the task before), whether its first is the task's.
        self.held, self.done, self.cut, self.first = None, 0, True, True

    def add(self, rows: pa.Table, follows: bool) -> pa.Table:
        """What can be told after ``rows``, the first of which is known already if it ``follows``."""
        cols = [rows.column(c).to_pylist() for c in ("seed", "after", "before")]
        own = list(zip(*cols, strict=True))
        new = np.array([i for i in range(len(own)) if (own[i] != own[i - 1] if i else not follows)], dtype=np.int64)
        reps = rows.take(pa.array(new))
        return self.settle(reps if self.held is None else pa.concat_tables([self.held, reps]), False)

    def end(self) -> pa.Table:
        return self.settle(self.held, True)

    def settle(self, reps: pa.Table, final: bool) -> pa.Table:
        """Intervals (``run`` is null) and runs to be counted."""
        n = len(reps)
        seeds = np.frombuffer(b"".join(reps.column("seed").to_pylist()), dtype=">u8")
        same = seeds[:-1] == seeds[1:]
        group = np.concatenate([[0], np.cumsum(~same)])
        after, size = _padded(reps.column("after"), self.least)
        right = np.where(same, _shared(after[:-1], after[1:], np.minimum(size[:-1], size[1:])), 0)
        reach = np.minimum(size, np.maximum(np.concatenate([[self.least if self.first else 0], right]), np.concatenate([right, [self.least]])))
        last, apart = group == group[-1], (group == 0) & self.cut
        whole = ~apart & ~last & (np.bincount(group)[group] > 2)
        if final:
            apart |= last
        else:
            large = bool(last.sum() > self.most or apart[-1])
            if large:
                apart |= last
                apart[-1] = False
            rest = int(np.searchsorted(group, group[-1]))
            rest = max(rest, n - 2) if large else rest
            self.held, self.cut, self.first = reps.slice(rest), large, self.first and rest == 0
        apart[: self.done] = False
        if not final:
            self.done = n - 1 - rest if large else 0

        def runs(which: np.ndarray) -> pa.Table:
            at = np.flatnonzero(which)
            return _runs(reps.take(pa.array(at)), reach[at], self.span, self.least)

        return pa.concat_tables([_whole(runs(whole)), runs(apart).drop_columns("row")])


def neighbour_matches(rows: DataFrame, span: int, least: int, most: int) -> DataFrame:
    """Matches of neighbours in the order of the seeds and the words after and before them, and the repeated runs of seeds that
    have three contexts or more. A range of the order is a task's; the first and last rows of the ranges are compared once
    more among themselves, two a range, in one task."""
    keys = ["seed", "after", "before", "id", "text", "pos"]
    ordered = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text", "start", "end", "edge", "run"]
        held, first, count = None, None, 0
        contexts = Contexts(span, least, most)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = pa.Table.from_batches([batch.slice(at, 4096)])
                if first is None:
                    first = rows.slice(0, 1)
                count += len(rows)
                follows = held is not None
                rows = pa.concat_tables([held, rows]) if follows else rows
                held = rows.slice(len(rows) - 1)
                found = _matches(rows, span, least)
                yield from found.append_column("edge", pa.nulls(len(found), pa.binary())).append_column("run", pa.nulls(len(found), pa.int64())).select(names).to_batches()
                found = contexts.add(rows, follows)
                yield from found.append_column("edge", pa.nulls(len(found), pa.binary())).select(names).to_batches()
        if held is not None:
            found = contexts.end()
            yield from found.append_column("edge", pa.nulls(len(found), pa.binary())).select(names).to_batches()
            # a range of one row has one edge
            edges = pa.concat_tables([first, held]) if count > 1 else held
            n = len(edges)
            yield pa.record_batch({
                "id": edges.column("id").combine_chunks(), "text": edges.column("text").combine_chunks(), "start": edges.column("pos").combine_chunks().cast(pa.int64()),
                "end": pa.array([-1] * n, pa.int64()), "edge": pa.array([_sealed(edges.slice(i, 1)) for i in range(n)], pa.binary()), "run": pa.nulls(n, pa.int64()),
            })

    found = cut(ordered.mapInArrow(run, SPAN + ", edge binary, run long"))

    def again(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([_unsealed(x) for x in table.column("edge").to_pylist()])
        return _matches(rows.sort_by([(c, "ascending") for c in keys]), span, least)

    # at most two rows a task
    edges = found.where("edge is not null").select("edge", F.lit(0).alias("all")).groupBy("all").applyInArrow(again, SPAN)
    matches = found.where("edge is null and run is null").select("id", "text", "start", "end").union(edges)
    told = found.where("run is not null")
    again = told.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    return matches.union(told.join(again, "run", "left_semi").select("id", "text", "start", "end"))


def _sealed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unsealed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, seed: int = 10, most_contexts: int = 8192) -> DataFrame:
    """One row per maximal passage made of runs of at least ``least`` words that occur again, in the same text or another:
    id, start and end (word numbers, end excluded).

    Whole texts are searched; equal texts are repeats of each other. A null or empty text and one of fewer words than
    ``least`` have no passage. Repeated rows (equal id and text) are separate texts that repeat each other; their
    passages are given once. An empty table gives an empty result; other columns are ignored. A task holds ``most_contexts``
    contexts of a seed at most; the result does not depend on it. Ids are whole numbers.
    """
    span = least - seed + 1
    rows = cut(suffixes(docs, id_col, text_col, seed, span, least))
    found = neighbour_matches(rows, span, least, most_contexts)
    # a text's matches in order: one that begins after all before it have ended opens a new passage
    so_far = Window.partitionBy("id", "text").orderBy("start", "end")
    opened = F.coalesce(F.col("start") > F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    placed = found.distinct().withColumn("new", opened).withColumn("passage", F.sum(F.col("new").cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    passages = placed.groupBy("id", "text", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return passages.select(F.col("id").alias(id_col), "start", "end")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


SUFFIX_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, text, {WORDS_SQL} AS words FROM documents),
g AS (SELECT r, i, array_to_string(words[i : i + 49], ' ') AS gram FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
held AS (SELECT DISTINCT doc_id, text, j - 1 AS j FROM again JOIN w USING (r), unnest(range(i, i + 50)) AS t(j)),
islands AS (SELECT doc_id, text, j, j - row_number() OVER (PARTITION BY doc_id, text ORDER BY j) AS island FROM held)
SELECT doc_id, min(j) AS start_word, max(j) + 1 AS end_word FROM islands GROUP BY doc_id, text, island
"""
