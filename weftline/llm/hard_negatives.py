"""Operator 12: hard negatives by angular triangle filtering.

For directions u, v and r, the angle between u and v lies between the difference and the sum of their angles to r. So stored
angles of all rows to a few reference directions give an interval for each cosine, and with the norms an interval for each integer
score, widened by more than rounding can do. Reference directions come from a bounded sample; each row belongs to the cell
of its nearest one. Rows and anchors meet in units of bounded size: in a unit, rows lie in tiles ordered by the angle to their reference, a tile's
least and greatest angles and norms bound its scores, and only tiles whose interval meets an anchor's window are scored, as exact integers.

First, positives: units are rows of one label, and a window reaches down to the best scores found so far. Then, negatives: an anchor
visits the cells whose interval meets its positives' windows. Both keep the best few of each group in each unit and
merge those. Nothing is capped: what the bounds can't rule out is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import cut

#: References, and the rows (by lowest hash) that they are fitted on.
REFERENCES, SAMPLE = 16, 2048
#: Rows, anchors and rows of a tile in one unit (on average, as they are dealt by hash).
ROWS, ANCHORS, TILE = 4096, 4096, 128
#: What angles may be off by: they are stored in 32 bits.
SLACK = 1e-5
#: Stands for a null id: it loses all ties.
NO_ID = (1 << 63) - 1
PREPARED = "row long, id long, label long, cell int, near float, norm double, angles array<float>, vec binary"


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of floor(256 * x)) for the vectors of each length, at most 16 MB at a time."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, (1 << 21) // max(1, int(size)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.floor(256 * values[starts[part][:, None] + np.arange(size)])


def _lengths(m: np.ndarray) -> np.ndarray:
    """Norms of the rows, also where squares are out of range."""
    top = np.abs(m).max(axis=1, initial=0)
    scale = np.where(top > 0, top, 1.0)
    return np.sqrt(((m / scale[:, None]) ** 2).sum(axis=1)) * scale


def _angles(m: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of the rows to the references; shorter vectors count as filled up with zeros. A zero row has a right angle to all."""
    n = min(m.shape[1], references.shape[1])
    unit = m[:, :n] / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(unit @ references[:, :n].T, -1, 1))


def fit_references(sample: list[np.ndarray], k: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit vectors amid the sample's directions: the farthest from those before, then moved to the means of their cells."""
    width = max(map(len, sample), default=0)
    m = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        m[i, : len(v)] = v
    norms = _lengths(m)
    m = m[norms > 0] / norms[norms > 0, None]
    if not len(m):
        return np.eye(1, max(1, width))
    found = [m[0]]
    while len(found) < min(k, len(m)):
        nearest = (m @ np.array(found).T).max(axis=1)
        if nearest.min() > 1 - 1e-9:
            break
        found.append(m[nearest.argmin()])
    out = np.array(found)
    for _ in range(rounds):
        cell = (m @ out.T).argmax(axis=1)
        for c in range(len(out)):
            mean = m[cell == c].sum(axis=0)
            if (size := np.linalg.norm(mean)) > 1e-9:
                out[c] = mean / size
    return out


def bounds(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer scores of each anchor (angles, norms) with rows of each tile: their angles to the references lie
    between ``low`` and ``high``, their norms between ``least`` and ``most``."""
    near, far = np.zeros((len(norms), len(least))), np.full((len(norms), len(least)), np.pi)
    for r in range(low.shape[1]):
        a = angles[:, r, None].astype(np.float64)
        np.maximum(near, np.maximum(low[:, r] - a, a - high[:, r]), out=near)
        np.minimum(far, np.minimum(a + high[:, r], 2 * np.pi - a - low[:, r]), out=far)
    cos_high, cos_low = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, np.pi))
    small, large = norms[:, None] * least, norms[:, None] * most
    room = 2 + 1e-9 * large
    return np.floor(np.minimum(cos_low * small, cos_low * large) - room), np.ceil(np.maximum(cos_high * small, cos_high * large) + room)


def scores(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; ``most`` is the greatest product of norms. Exact in doubles while all sums are; else in whole numbers
    of any size, which end at the bounds of 64 bits."""
    n = min(left.shape[1], right.shape[1])
    if most < 1 << 52:
        return (left[:, :n] @ right[:, :n].T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m[:, :n]], dtype=object).reshape(len(m), n)
    product = whole(left) @ whole(right).T if n else np.zeros((len(left), len(right)), dtype=object)
    return np.vectorize(lambda x: max(-NO_ID, min(NO_ID, x)), otypes=[np.int64])(product)


class Best:
    """The ``keep`` best (highest score, then smallest id) of each group."""

    def __init__(self, groups: int, keep: int):
        self.keep = keep
        self.floor = np.full(groups, -NO_ID - 1, dtype=np.int64)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.keep
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        full = place[kept] == self.keep - 1
        self.floor[self.group[full]] = self.score[full]


class Unit:
    """Rows of one unit in tiles: of vectors of one length and one cell, by the angle to their reference."""

    def __init__(self, table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        vecs = table.column("vec").to_pylist()
        size = np.array([len(v) // 8 for v in vecs], dtype=np.int64)
        order = np.lexsort((column("near"), column("cell"), size))
        self.row, self.id, self.label, self.norm = (column(c)[order] for c in ("row", "id", "label", "norm"))
        size, cell = size[order], column("cell")[order]
        self.angles = np.array(table.column("angles").to_pylist(), dtype=np.float32)[order].reshape(len(order), -1)
        self.vecs = [np.frombuffer(vecs[i], dtype="<f8") for i in order]
        new = np.concatenate([[True], (np.diff(size) != 0) | (np.diff(cell) != 0)])
        run = np.flatnonzero(new)
        within = np.arange(len(order)) - run[np.cumsum(new) - 1]
        self.starts = np.flatnonzero(new | (within % TILE == 0))
        self.ends = np.append(self.starts[1:], len(order))
        self.low, self.high = (f.reduceat(self.angles, self.starts, axis=0).astype(np.float64) for f in (np.minimum, np.maximum))
        self.least, self.most = (f.reduceat(self.norm, self.starts) for f in (np.minimum, np.maximum))

    def tile(self, t: int) -> tuple[slice, np.ndarray]:
        where = slice(self.starts[t], self.ends[t])
        return where, np.array(self.vecs[where])


def _by_length(vecs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(v) for v in vecs])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.array([vecs[i] for i in at]).reshape(len(at), n)


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    column = lambda name: table.column(name).to_numpy()
    angles = np.array(table.column("angles").to_pylist(), dtype=np.float32).reshape(len(table), -1)
    return column("row"), column("id"), column("label"), column("norm"), angles, [np.frombuffer(v, dtype="<f8") for v in table.column("vec").to_pylist()]


def _positives(rows: pa.Table, anchors: pa.Table, keep: int) -> pa.Table:
    """The best other rows of each anchor in one unit of its label."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "positive_id", "positive_score")})
    if not len(rows) or not len(anchors):
        return empty
    unit, (row, _, _, norm, angles, vecs) = Unit(rows), _anchors(anchors)
    best = Best(len(row), keep)
    for at, m in _by_length(vecs):
        _, high = bounds(unit.low, unit.high, unit.least, unit.most, angles[at], norm[at])
        for t in np.argsort(-high.max(axis=0)):
            near = np.flatnonzero(high[:, t] >= best.floor[at])
            if len(near):
                where, tile = unit.tile(t)
                s = scores(m[near], tile, norm[at][near].max() * unit.most[t])
                a, r = np.nonzero((s >= best.floor[at[near]][:, None]) & (row[at[near]][:, None] != unit.row[where]))
                best.add(at[near[a]], s[a, r], unit.id[where][r])
    return pa.table({"anchor": row[best.group], "positive_id": best.id, "positive_score": best.score})


def _negatives(rows: pa.Table, anchors: pa.Table, keep: int) -> pa.Table:
    """The best rows of other labels in each positive's window, in one unit. ``anchors`` has an anchor's positive scores."""
    names = ("anchor", "place", "negative_id", "negative_score")
    if not len(rows) or not len(anchors):
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    unit, (row, _, label, norm, angles, vecs) = Unit(rows), _anchors(anchors)
    held = anchors.column("positives").to_pylist()
    n = max(map(len, held))
    # windows that nothing meets fill the lines up
    top = np.array([[*p, *[-NO_ID] * (n - len(p))] for p in held], dtype=np.int64)
    bottom = np.where(top >= 0, top - top // 5, NO_ID)
    best = Best(len(row) * n, keep)
    for at, m in _by_length(vecs):
        low, high = bounds(unit.low, unit.high, unit.least, unit.most, angles[at], norm[at])
        group = at[:, None] * n + np.arange(n)
        for t in np.argsort(-high.max(axis=0)):
            floor = np.maximum(bottom[at], best.floor[group])
            near = np.flatnonzero(((high[:, t, None] >= floor) & (low[:, t, None] <= top[at])).any(axis=1))
            if len(near):
                where, tile = unit.tile(t)
                s = scores(m[near], tile, norm[at][near].max() * unit.most[t])
                other = label[at[near]][:, None] != unit.label[where]
                for p in range(n):
                    a, r = np.nonzero(other & (s >= floor[near, p, None]) & (s <= top[at[near], p, None]))
                    if len(a):
                        best.add(group[near[a], p], s[a, r], unit.id[where][r])
    return pa.table({"anchor": row[best.group // n], "place": best.group % n, "negative_id": best.id, "negative_score": best.score})


def _top(rows: DataFrame, group: list[str], score: str, ids: str, keep: int, name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(ids)))
    return rows.withColumn(name, place).where(F.col(name) <= keep)


def _deal(row: str, parts: Column) -> Column:
    """Which of ``parts`` a row goes to."""
    return F.pmod(F.xxhash64(row), parts.cast("long"))


def _anew(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, to meet rows of the same table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _all(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))


def prepared(vectors: DataFrame, id_col: str, label: Column, vector_col: str, references: int = REFERENCES, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """``PREPARED`` rows of all that take part, kept, and the references."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(256 * v.cast("double")) < float("inf")))
    rows = vectors.where(x.isNotNull() & finite & label.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), x.cast("array<double>").alias("vec")
    )
    lowest = rows.select("id", "row", "vec").orderBy(F.xxhash64("id"), "row").limit(sample).toArrow()
    fitted = fit_references([v for column in lowest.column("vec").chunks for at, m in _matrices(column) for v in m], references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _matrices(batch.column("vec")):
                norm = _lengths(m)
                angle = _angles(m, norm, fitted).astype(np.float32)
                cell = angle.argmin(axis=1)
                take = lambda name, at=at: batch.column(name).take(pa.array(at))  # noqa: B023, E731
                yield pa.record_batch({
                    "row": take("row"), "id": take("id"), "label": take("label"), "cell": pa.array(cell, pa.int32()), "near": angle[np.arange(len(at)), cell], "norm": norm,
                    "angles": pa.array(list(angle), pa.list_(pa.float32())), "vec": pa.array([v.astype("<f8").tobytes() for v in m], pa.binary()),
                })

    return cut(rows.mapInArrow(run, PREPARED)), fitted


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5,
    references: int = REFERENCES, sample: int = SAMPLE, rows_of: int = ROWS, anchors_of: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; a score is the inner product of floor(256 * x). An anchor's positives are its best other
    rows of the same label, its negatives for each of them the best rows of other labels that score at most as high as the positive and at least
    four fifths of that; higher scores come first, then smaller ids. A negative positive score has no negatives.

    Ids are whole numbers. Rows with a null label or vector, or any component that is null or not finite times 256, take no part. Rows stand for
    themselves, also where ids or vectors repeat: another row with an anchor's id is another row, and each anchor row has its own results. A null
    id is no anchor and loses ties. A shorter vector counts as filled up with zeros; an empty one scores 0. Scores end at the bounds
    of 64 bits. No rows, anchors or other labels give no rows; other columns are ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows, fitted = prepared(vectors, id_col, label, vector_col, references, sample)
    anchor = (F.col("id") != NO_ID) & (F.col("id") % every == 0)
    parts = lambda n, of: F.greatest(F.lit(1), F.ceil(n / of)).cast("long")
    # positives: one row a label that has anchors; at most one in rows_of rows has more than one part
    labels = rows.groupBy("label").agg(F.count("*").alias("_n"), F.count_if(anchor).alias("_a")).where("_a > 0").select("label", parts(F.col("_n"), rows_of).alias("_parts"), parts(F.col("_a"), anchors_of).alias("_blocks"))
    known = rows.join(labels, "label")
    keys = ["label", "part", "block"]
    left = known.select("*", _deal("row", F.col("_parts")).alias("part"), _all(F.col("_blocks")).alias("block")).drop("_parts", "_blocks")
    right = known.where(anchor).select("*", _deal("row", F.col("_blocks")).alias("block"), _all(F.col("_parts")).alias("part")).drop("_parts", "_blocks")
    found = left.groupBy(*keys).cogroup(_anew(right).groupBy(*keys)).applyInArrow(lambda a, b: _positives(a, b, positives), "anchor long, positive_id long, positive_score long")
    found = cut(_top(found, ["anchor"], "positive_score", "positive_id", positives, "n"))
    # negatives: the cells are as many as the references
    spread = [f(F.col("angles")[r]).alias(f"{name}{r}") for r in range(len(fitted)) for name, f in (("low", F.min), ("high", F.max))]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(anchor).alias("a"), F.min("norm").alias("least"), F.max("norm").alias("most"), *spread).collect()
    low, high = (np.array([[c[f"{name}{r}"] for r in range(len(fitted))] for c in cells]).reshape(len(cells), len(fitted)) for name in ("low", "high"))
    least, most, cell_of = (np.array([c[name] for c in cells]) for name in ("least", "most", "cell"))
    subs = {c["cell"]: max(1, -(-c["n"] // rows_of)) for c in cells}
    scored = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    asked = rows.where(anchor).join(scored, F.col("row") == F.col("anchor")).drop("anchor")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors, once for each cell whose scores may meet their windows."""
        for batch in batches:
            angles = np.array(batch.column("angles").to_pylist(), dtype=np.float32).reshape(len(batch), -1)
            under, over = bounds(low, high, least, most, angles, batch.column("norm").to_numpy())
            best = [max(p) for p in batch.column("positives").to_pylist()]
            worst = [min((x - x // 5 for x in p if x >= 0), default=NO_ID) for p in batch.column("positives").to_pylist()]
            at, cell = np.nonzero((over >= np.array(worst)[:, None]) & (under <= np.array(best)[:, None]))
            batch = batch.take(pa.array(at))
            yield pa.record_batch([*batch.columns, pa.array(cell_of[cell] if len(cell) else [], pa.int32())], names=[*batch.schema.names, "visited"])

    blocks = F.lit(max(1, -(-sum(c["a"] for c in cells) // anchors_of))).cast("long")
    share = F.create_map(*[F.lit(x).cast("long") for kv in subs.items() for x in kv]) if subs else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    of_cell = lambda cell: F.element_at(share, F.col(cell).cast("long"))
    keys = ["at", "part", "block"]
    left = rows.select("*", F.col("cell").alias("at"), _deal("row", of_cell("cell")).alias("part"), _all(blocks).alias("block"))
    right = asked.mapInArrow(visits, f"{PREPARED}, positives array<long>, visited int")
    right = right.select("*", F.col("visited").alias("at"), _deal("row", blocks).alias("block"), _all(of_cell("visited")).alias("part")).drop("visited")
    hits = left.groupBy(*keys).cogroup(_anew(right).groupBy(*keys)).applyInArrow(lambda a, b: _negatives(a, b, negatives), "anchor long, place long, negative_id long, negative_score long")
    hits = _top(hits.withColumn("n", (F.col("place") + 1).cast("int")).drop("place"), ["anchor", "n"], "negative_score", "negative_id", negatives, "rank")
    ids = rows.where(anchor).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return hits.join(found, ["anchor", "n"]).join(ids, "anchor").select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")


#: Fixed change of labels: where the id is divisible by 7, the next of ten labels.
CHANGED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=F.expr(CHANGED))


NEGATIVES_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, {CHANGED} AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
p AS (SELECT n, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, other_id) AS place FROM s WHERE same),
h AS (SELECT p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.n = s.n AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""
