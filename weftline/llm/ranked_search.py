"""Operator 13: ranked lexical search in K2-treaps over the term-document grid.

Documents are cut into ranges of bounded size where they lie, in the tasks that read them; nothing is shuffled. A range is a grid of its
terms (rows, the frequent last) and documents (columns), kept as a compressed quadtree: a cell knows which of its four quarters have
points and the greatest impact in it, and a cell with one point is that point. Cells lie level by level, so children are found by
counting bits. The ranges are a table of their own: searches read no texts.

A search takes all items in blocks of bounded size. In each range, the rows of an item's terms descend together: the greatest impacts of
their cells, times the terms' weights, bound what a document of the cells' columns can score. The best bounds go first,
and what can't reach the item's k-th best score in this task so far is left. Every task gives its best k documents of each item, from which the
best k of all are taken. Scores are exact integers. Terms are 64-bit hashes: one that is searched meets another one by chance about once
in 2**64 / (terms searched * different terms).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .hard_negatives import NO_ID, Best
from .workspace import cut, new_dir, spread

#: Documents and bytes of text in a range (a longer text is one by itself).
DOCS, BYTES = 4096, 3 << 20
#: Bytes of ranges that are written and read together, about.
GROUP = 8 << 20
#: Terms searched at once, on average.
ASKED = 1 << 18
#: Cells of an item's frontier that are opened at once.
BEAM = 128
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bits that are set in four, and in those below each of them.
ONES = np.array([bin(m).count("1") for m in range(16)], dtype=np.int32)
BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int32)
HAS = np.array([[m >> q & 1 == 1 for q in range(4)] for m in range(16)])
RANGE = "n_docs int, levels int, n_all long, terms_all long, ids binary, sizes binary, terms binary, rows binary, dfs binary, masks binary, maxima binary, point_rows binary, point_cols binary, point_tfs binary"


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every term, and the byte after the last."""
    term = TERM[data]
    begin, final = term.copy(), term.copy()
    begin[1:] &= ~term[:-1]
    final[:-1] &= ~term[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = term[inner]
    final[inner - 1] = term[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(final) + 1


def term_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, A-Z lower-cased, and the index of each one's text."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, data, offsets in W.slices(texts):
        if len(data):
            starts, ends = _spans(data, offsets)
            hashes.append(W.hash_spans(W.LOWER[data], starts, ends))
            owners.append(np.searchsorted(offsets, starts, "right") - 1 + at)
    return np.concatenate(hashes), np.concatenate(owners)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them need; the first byte says how many."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * s)
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**32 with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def length_terms(sizes: np.ndarray, n_all: int, terms_all: int) -> np.ndarray:
    """m of each document: 75 + 25 * its terms / mean terms, rounded down."""
    return np.array([75 + 25 * int(n) * n_all // terms_all for n in sizes], dtype=np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs tf times in a document adds to its score, without the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def treap(ids: pa.Array, texts: pa.Array, n_all: int, terms_all: int) -> dict | None:
    """The ``RANGE`` of some documents; None if they have no terms."""
    hashes, owners = term_hashes(texts)
    if not len(hashes):
        return None
    n_docs = len(texts)
    sizes = np.bincount(owners, minlength=n_docs)
    terms, which = np.unique(hashes, return_inverse=True)
    pairs, tf = np.unique(which * n_docs + owners, return_counts=True)
    term, col = np.divmod(pairs, n_docs)
    dfs = np.bincount(term, minlength=len(terms))
    # terms of like frequency are neighbours: the rare ones' cells stay nearly empty
    rows = np.empty(len(terms), dtype=np.int64)
    rows[np.argsort(dfs, kind="stable")] = np.arange(len(terms))
    levels = max(1, (max(len(terms), n_docs) - 1).bit_length())
    row = rows[term]
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, tf, row, col = code[order], tf[order], row[order], col[order]
    value = impact(tf, length_terms(sizes, n_all, terms_all)[col])
    masks, maxima, points = [], [], []
    live, starts = np.arange(len(code)), np.zeros(1, dtype=np.int64)
    for level in range(levels + 1):
        counts = np.diff(np.append(starts, len(live)))
        inner = counts > 1
        points.append(live[starts[~inner]])
        maxima.append(np.maximum.reduceat(value[live], starts)[inner])
        mask = np.zeros(len(starts), dtype=np.uint8)
        if inner.any():
            live = live[np.repeat(inner, counts)]
            prefix = code[live] >> np.uint64(2 * (levels - level - 1))
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            starts = np.flatnonzero(new)
            parent = prefix[starts] >> np.uint64(2)
            quarter = (1 << (prefix[starts] & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            mask[inner] = np.bitwise_or.reduceat(quarter, np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])))
        masks.append(mask)
        if not inner.any():
            break
    points = np.concatenate(points)
    known = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return {
        "n_docs": n_docs, "levels": levels, "n_all": n_all, "terms_all": terms_all, "ids": known.astype("<i8").tobytes(), "sizes": _pack(sizes), "terms": terms.astype("<u8").tobytes(), "rows": _pack(rows), "dfs": _pack(dfs),
        "masks": np.concatenate(masks).tobytes(), "maxima": _pack(np.concatenate(maxima)), "point_rows": _pack(row[points]), "point_cols": _pack(col[points]), "point_tfs": _pack(tf[points]),
    }


class Treap:
    """A range that is searched."""

    def __init__(self, r: dict):
        self.levels = r["levels"]
        self.ids = np.frombuffer(r["ids"], dtype="<i8")
        self.terms, self.rows = np.frombuffer(r["terms"], dtype="<u8"), _unpack(r["rows"])
        masks = np.frombuffer(r["masks"], dtype=np.uint8)
        single = masks == 0
        # one more cell, of no points, for what isn't there
        self.none = np.int32(len(masks))
        self.mask = np.append(masks, np.uint8(0))
        self.first = np.ones(len(masks) + 1, dtype=np.int32)
        np.cumsum(ONES[masks], out=self.first[1:])
        self.first[1:] += 1
        self.value, self.row, self.col = (np.full(len(masks) + 1, x, dtype=np.int32) for x in (0, -1, -1))
        cols = _unpack(r["point_cols"])
        at = np.flatnonzero(single)
        self.row[at], self.col[at] = _unpack(r["point_rows"]), cols
        self.value[np.flatnonzero(~single)] = _unpack(r["maxima"])
        self.value[at] = impact(_unpack(r["point_tfs"]).astype(np.int64), length_terms(_unpack(r["sizes"]), r["n_all"], r["terms_all"])[cols])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The row of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.rows[at].astype(np.int32), -1)

    def children(self, cells: np.ndarray, level: np.ndarray, rows: np.ndarray, half: int) -> np.ndarray:
        """For each row (columns) of each frontier cell (lines), the cell of its quarter in one half of the documents."""
        shift = (self.levels - 1 - level)[:, None].astype(np.int32)
        quarter = ((rows >> shift) & 1) * 2 + half
        mask = self.mask[cells]
        down = np.where(HAS[mask, quarter], self.first[cells] + BELOW[mask, quarter], self.none)
        out = np.where(mask > 0, down, np.where((self.col[cells] >> shift) & 1 == half, cells, self.none))
        # a lone point of another row
        return np.where((self.row[out] >= 0) & (self.row[out] != rows), self.none, out)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the documents that may be among the best into ``best``, the best bounds first; returns the number of cells opened."""
        cells, level = np.zeros((1, len(rows)), dtype=np.int32), np.zeros(1, dtype=np.int64)
        if self.mask[0] == 0:
            cells[0, self.row[0] != rows] = self.none
        bound = self.value[cells].astype(np.int64) @ weights
        opened = 0
        while True:
            alive = bound >= max(1, best.floor[0])
            cells, level, bound = cells[alive], level[alive], bound[alive]
            # where only points are left, the scores are known
            done = (self.mask[cells] == 0).all(axis=1)
            if done.any():
                self._score(cells[done], weights, best)
                cells, level, bound = cells[~done], level[~done], bound[~done]
            if not len(cells):
                return opened
            if len(cells) > BEAM:
                order = np.argpartition(-bound, BEAM)
                now, later = order[:BEAM], order[BEAM:]
            else:
                now, later = np.arange(len(cells)), np.zeros(0, dtype=np.int64)
            opened += len(now)
            new = np.concatenate([self.children(cells[now], level[now], rows, half) for half in (0, 1)])
            cells, level, bound = np.concatenate([cells[later], new]), np.concatenate([level[later], level[now] + 1, level[now] + 1]), np.concatenate([bound[later], self.value[new].astype(np.int64) @ weights])

    def _score(self, cells: np.ndarray, weights: np.ndarray, best: Best) -> None:
        line, k = np.nonzero(cells != self.none)
        points = cells[line, k]
        col, part = self.col[points], self.value[points] * weights[k]
        order = np.argsort(col, kind="stable")
        col, part = col[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, np.int64)
        if len(starts):
            score, ids = np.add.reduceat(part, starts), self.ids[col[starts]]
            near = (score > 0) & (score >= best.floor[0])
            best.add(np.zeros(near.sum(), dtype=np.int64), score[near], ids[near])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_docs: int = DOCS, most_bytes: int = BYTES) -> DataFrame:
    """Write the ranges of all documents to ``path`` and return them. Texts are read twice: impacts need the corpus's mean length."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for _, data, offsets in W.slices(batch.column("text")):
                if len(data):
                    per = np.diff(np.searchsorted(_spans(data, offsets)[0], offsets))
                    docs, terms = docs + int((per > 0).sum()), terms + int(per.sum())
        yield pa.record_batch({"n": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})

    counted = rows.select("text").mapInArrow(count, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    n_all, terms_all = counted.n or 0, counted.terms or 0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        held, n, size = [], 0, 0
        for batch in batches:
            ends = np.cumsum(np.array([x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()], dtype=np.int64))
            at = 0
            while at < len(batch):
                gone = ends[at - 1] if at else 0
                to = min(len(batch), at + most_docs - n, max(at + (not n), int(np.searchsorted(ends, gone + most_bytes - size, "right"))))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    n, size, at = n + to - at, size + ends[to - 1] - gone, to
                if at < len(batch):
                    yield held
                    held, n, size = [], 0, 0
        if held:
            yield held

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ranges(batches):
            table = pa.Table.from_batches(held)
            made = treap(table.column("id").combine_chunks(), table.column("text"), n_all, terms_all)
            if made:
                yield pa.RecordBatch.from_pylist([made], schema=ARROW)

    # a range weighs megabytes: the writer looks at its size after each, so that neither it nor a reader holds many at once
    rows.mapInArrow(build, RANGE).write.options(**{"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}).parquet(path)
    return docs.sparkSession.read.schema(RANGE).parquet(path)


ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in RANGE.split(", "))])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, repeats: the terms of each item's texts; rows equal in id and text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = term_hashes(batch.column("text"))
            yield pa.record_batch({"item": batch.column("item").take(pa.array(owners)), "term": pa.array(hashes.view(np.int64))})

    texts = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return texts.mapInArrow(run, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("repeats"))


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", asked: int = ASKED) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item with a score above 0; equal scores by id.

    Ids are whole numbers; a null one loses ties, and items without one are one item. Rows are documents of their own also where ids or texts repeat; items
    equal in id and text count once, and different texts under one id are one item. Documents and items without terms (null, empty) are in no result;
    texts may be of any length. An empty index or table of items gives no rows; other columns are ignored.
    """
    spark = index.sparkSession
    terms = cut(item_terms(items, id_col, text_col))
    n_terms, one = terms.count(), index.select("n_all").first()
    n_all = one.n_all if one else 0
    blocks = max(1, -(-n_terms // asked))
    out = []
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        sought = np.sort(mine.select("term").distinct().toArrow().column("term").to_numpy().view(np.uint64))
        shared = spark.sparkContext.broadcast(sought)

        def frequencies(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sought = shared.value
            total = np.zeros(len(sought), dtype=np.int64)
            for batch in batches:
                for own, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
                    own = np.frombuffer(own, dtype="<u8")
                    at = np.minimum(np.searchsorted(own, sought), len(own) - 1)
                    total += np.where(own[at] == sought, _unpack(dfs)[at].astype(np.int64), 0)
            at = np.flatnonzero(total)
            yield pa.record_batch({"term": pa.array(sought[at].view(np.int64)), "df": pa.array(total[at])})

        dfs = index.select("terms", "dfs").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        held = mine.join(dfs, "term").toArrow()
        item, term, repeats, df = (held.column(c).to_numpy() for c in ("item", "term", "repeats", "df"))
        weight = repeats * np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        order = np.lexsort((term, item))
        item, term, weight = item[order], term[order].view(np.uint64), weight[order].astype(np.int64)
        starts = np.flatnonzero(np.append([True], item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        lists = spark.sparkContext.broadcast((item[starts], np.append(starts, len(item)), term, weight))

        def find(batches: Iterator[pa.RecordBatch], lists=lists) -> Iterator[pa.RecordBatch]:
            items, cuts, term, weight = lists.value
            best = [Best(1, k) for _ in items]
            for batch in batches:
                for i in range(len(batch)):
                    r = Treap(batch.slice(i, 1).to_pylist()[0])
                    rows = r.places(term)
                    for q, found in enumerate(best):
                        mine = slice(cuts[q], cuts[q + 1])
                        there = rows[mine] >= 0
                        if there.any():
                            r.search(rows[mine][there], weight[mine][there], found)
            sizes = [len(found.id) for found in best]
            flat = lambda name: np.concatenate([np.zeros(0, np.int64), *(getattr(found, name) for found in best)])
            yield pa.record_batch({"item": pa.array(np.repeat(items, sizes), pa.int64()), "doc": pa.array(flat("id"), pa.int64()), "score": pa.array(flat("score"), pa.int64())})

        out.append(index.mapInArrow(find, "item long, doc long, score long"))
    hits = out[0]
    for more in out[1:]:
        hits = hits.union(more)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select(real("item").alias("item_id"), "rank", real("doc").alias("doc_id"), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), new_dir(spark, "ranked-search"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: A term's characters, fixed.
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_terms = lambda column: f"unnest(regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_SQL}'))"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n_doc, doc_id, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT n_doc, doc_id, {_terms('text')} AS term FROM d),
tf AS (SELECT n_doc, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT n_doc, sum(tf) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS terms_all FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, n_all),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_terms('text')} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, n_doc, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * CAST(n AS BIGINT) * n_all) // terms_all)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (n_doc), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
