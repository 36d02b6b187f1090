"""Operator 8: n-gram Jaccard join as a grouped prefix join.

A document is its set of distinct shingles. Two sets can reach the threshold only if they share one of
the first few shingles in an order common to all; the rarest come first. Counts of all shingles
come from ``multiplicity``, and a document too few of whose shingles occur elsewhere is alone.
Equal sets are one class; classes with equal size and prefix are one group. Groups that share
prefix shingles make up families. A family, or each two parts of a large one, is a unit of bounded
size: there group pairs are filtered, expanded to members and verified on the whole sets, and
what comes out is each member with the smallest one it is joined to, not all pairs. So a family of
near copies costs rows in proportion to its size. Links are exact, up to chance collisions of
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .multiplicity import Grades, chunked, with_grades
from .workspace import cut, shuffle_partitions

#: Tasks among which the rows of one family and size are dealt.
SALTS = 32
SETS = "id long, n_shingles long, node long, lone int, keys binary"


def shingle_sets(texts: pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, A-Z lower-cased; of fewer words than ``width``, all as one."""
    for _, data, offsets in W.slices(texts):
        hashes, first = W.words(data, offsets, lower=True)
        found, at = W.windows(hashes, first, width)
        cut_ = np.searchsorted(at, first)
        for k in range(len(offsets) - 1):
            n = first[k + 1] - first[k]
            if 0 < n < width:
                whole = np.full(1, n, dtype=np.uint64)
                for h in hashes[first[k] : first[k + 1]]:
                    whole = W.mix(whole ^ h)
                yield whole
            else:
                yield np.unique(found[cut_[k] : cut_[k + 1]])


def least_shared(n: np.ndarray | F.Column, percent: int):
    """ceil(percent * n / 100): the least size of an intersection with a set of n at the threshold."""
    return (percent * n + 99) // 100


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, n_shingles and, where the set may have a partner: node (hash of the set), lone (number of shingles found
    nowhere else), keys (the others, the rarest first)."""

    def keys(texts: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts, width)])

    def work(table: pa.Table, grades: Grades) -> pa.Table:
        size, node, lone, kept = [], [], [], []
        for own in shingle_sets(table.column("text"), width):
            n = len(own)
            grade = grades.of(own)
            shared = grade > 0
            size.append(n)
            if n and shared.sum() >= least_shared(n, percent):
                node.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                lone.append(n - int(shared.sum()))
                kept.append(own[shared][np.argsort(grade[shared], kind="stable")].tobytes())
            else:
                node.append(None)
                lone.append(None)
                kept.append(None)
        return pa.table({"id": table.column("id").cast(pa.int64()), "n_shingles": pa.array(size, pa.int64()), "node": pa.array(node, pa.int64()), "lone": pa.array(lone, pa.int32()), "keys": pa.array(kept, pa.binary())})

    return with_grades(chunked(docs, id_col, text_col), keys, work, SETS)


def prefix_size(n: int, lone: int, percent: int) -> int:
    """How many of the shared shingles belong to the prefix: those found nowhere else come before them."""
    return max(0, n - least_shared(n, percent) + 1 - lone)


def _groups(nodes: DataFrame, percent: int) -> DataFrame:
    """id, place, node, n, bytes, group (hash of size and prefix), tokens (the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, tokens, sizes = [], [], []
            for n, lone, keys in zip(*(batch.column(c).to_pylist() for c in ("n", "lone", "keys")), strict=True):
                head = np.frombuffer(keys, dtype=np.int64)[: prefix_size(n, lone, percent)]
                groups.append(int.from_bytes(hashlib.blake2b(b"%d %d " % (n, lone) + head.tobytes(), digest_size=8).digest(), "little", signed=True))
                tokens.append(head)
                sizes.append(len(keys))
            yield pa.record_batch({
                "id": batch.column("id"), "place": batch.column("place"), "node": batch.column("node"), "n": batch.column("n"), "bytes": pa.array(sizes, pa.int64()),
                "group": pa.array(groups, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64())),
            })

    return nodes.select("id", "place", "node", "n", "lone", "keys").mapInArrow(run, "id long, place long, node long, n long, bytes long, group long, tokens array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], dense: float = 0.02) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right. Shingles that many of both sides have
    are counted by matrix products, the others pair by pair."""
    shape = len(left), len(right)
    _, tokens = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut_ = sum(map(len, left))
    rows, cols = np.repeat(np.arange(shape[0]), list(map(len, left))), np.repeat(np.arange(shape[1]), list(map(len, right)))
    n = int(tokens.max()) + 1 if len(tokens) else 0
    a, b = tokens[:cut_], tokens[cut_:]
    in_a, in_b = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
    pairs = in_a * in_b
    heavy = np.flatnonzero(pairs > dense * shape[0] * shape[1])
    out = np.zeros(shape, dtype=np.int64)
    place = np.full(n, -1)
    place[heavy] = np.arange(len(heavy))
    for low in range(0, len(heavy), 4096):
        width = min(4096, len(heavy) - low)
        sides = []
        for t, r, size in ((place[a], rows, shape[0]), (place[b], cols, shape[1])):
            here = (t >= low) & (t < low + width)
            m = np.zeros((size, width), dtype=np.float32)
            m[r[here], t[here] - low] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    light = (pairs > 0) & (place < 0)
    keep_a, keep_b = light[a], light[b]
    a, rows, b, cols = a[keep_a], rows[keep_a], b[keep_b], cols[keep_b]
    order = np.argsort(b, kind="stable")
    b, cols = b[order], cols[order]
    first = np.searchsorted(b, np.arange(n))
    # about a million pairs at a time
    steps = np.searchsorted(np.cumsum(in_b[a]), np.arange(0, int(in_b[a].sum()) + 1, 1 << 20))
    for low, high in zip(steps, [*steps[1:], len(a)], strict=True):
        t, r = a[low:high], rows[low:high]
        times = in_b[t]
        end = np.cumsum(times)
        at = np.arange(end[-1] if len(end) else 0) - np.repeat(end - times, times) + np.repeat(first[t], times)
        out += np.bincount(np.repeat(r, times) * shape[1] + cols[at], minlength=shape[0] * shape[1]).reshape(shape)
    return out


def linked(n: np.ndarray, m: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n[:, None] + m[None, :] - shared)


def verified_links(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join the members (node, group, n, lone, keys, side) just as all links between the sides do.

    Group pairs that differ too much in size, share no prefix shingle or can't share enough are left out; the members
    of the others are verified on their whole sets.
    """
    sides = [[x for x in members if x[5] in (k, None)] for k in (0, 1)]
    groups = [{x[1]: x for x in side} for side in sides]
    heads = [[x[4][: prefix_size(x[2], x[3], percent)] for x in g.values()] for g in groups]
    size = [np.array([x[2] for x in g.values()]) for g in groups]
    shared = overlaps(*heads)
    n, m = size[0][:, None], size[1][None, :]
    # what both share up to where the first prefix ends is in both prefixes; beyond it lies the rest of that set
    rest = [size[k] - np.array([len(h) + x[3] for h, x in zip(heads[k], groups[k].values(), strict=True)]) for k in (0, 1)]
    rest = np.maximum(rest[0][:, None], rest[1][None, :])
    ok = (shared > 0) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * (shared + rest) >= percent * (n + m))
    place = [{g: i for i, g in enumerate(x)} for x in groups]
    at = [np.array([place[k][x[1]] for x in side]) for k, side in enumerate(sides)]
    keys = [[x[4] for x in side] for side in sides]
    own = [np.array([x[2] for x in side]) for side in sides]
    use = [ok.any(axis=1 - k)[at[k]] for k in (0, 1)]
    picked = [np.flatnonzero(u) for u in use]
    if not len(picked[0]) or not len(picked[1]):
        return []
    real = overlaps(*([keys[k][i] for i in picked[k]] for k in (0, 1)))
    links = linked(own[0][picked[0]], own[1][picked[1]], real, percent) & ok[at[0][picked[0]][:, None], at[1][picked[1]][None, :]]
    nodes = [np.array([sides[k][i][0] for i in picked[k]]) for k in (0, 1)]
    return spanning(nodes[0], nodes[1], links)


def spanning(left: np.ndarray, right: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """A few of the links' consequences: each node with the smallest one that the links join it to."""
    most = np.iinfo(np.int64).max
    low, high = left.copy(), right.copy()
    while True:
        was = low, high
        high = np.minimum(high, np.where(links, low[:, None], most).min(axis=0))
        low = np.minimum(low, np.where(links, high[None, :], most).min(axis=1))
        if (low == was[0]).all() and (high == was[1]).all():
            break
    pairs = zip(np.concatenate([left, right]).tolist(), np.concatenate([low, high]).tolist(), strict=True)
    return sorted({(a, b) for a, b in pairs if a != b})


def linked_sets(nodes: DataFrame, percent: int = 75, most_tokens: int = 1 << 20, most_members: int = 1024) -> DataFrame:
    """(node, low, comp) of sets (id, place, node, n, lone, keys), of which equal ones share a node: the smallest id of a node, and
    the components of nodes at a Jaccard similarity of ``percent`` or more. No two sets have one ``place``.

    Groups that share prefix shingles, directly or through others, are a family; links never leave one. A family is one
    unit of work up to ``most_tokens`` shingles and ``most_members`` members. A larger one is split by sizes (of steps in which
    the threshold spans one) and by hash, and each two parts near in size are a unit.
    """
    first = lambda c: F.first(c).alias(c)
    by_node = cut(_groups(nodes, percent).groupBy("node").agg(F.min(F.struct("id", "place")).alias("lowest"), *map(first, ("n", "bytes", "group", "tokens"))).withColumns({"low": F.col("lowest.id"), "place": F.col("lowest.place")}).drop("lowest"))
    postings = by_node.groupBy("group").agg(first("tokens")).select("group", F.explode("tokens").alias("token"))
    leads = postings.groupBy("token").agg(F.min("group").alias("lead"), F.max("group").alias("last")).where("lead < last").select("token", "lead")
    edges = postings.join(leads, "token").where("group != lead").select("group", "lead").distinct()
    families = components(edges, "group", "lead").select(F.col("node").alias("group"), F.col("component").alias("family"))
    several = by_node.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").select("group", F.lit(True).alias("several"))
    placed = by_node.select("node", "place", "group", "n", "bytes").join(families, "group", "left").join(several, "group", "left")
    placed = placed.where(F.col("family").isNotNull() | F.col("several"))

    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    # a large family's rows meet its sizes in several tasks
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int")
    sized = cut(placed.select("node", "place", "group", F.coalesce("family", "group").alias("family"), "bytes", step.alias("step"), salt.alias("salt")))
    parts_of = lambda: F.greatest(F.ceil(F.sum("bytes") / (8 * most_tokens)), F.ceil(F.count("*") / most_members)).cast("int")
    whole = sized.groupBy("family").agg(parts_of().alias("all_parts"))
    steps = cut(sized.groupBy("family", "step").agg(parts_of().alias("parts")).join(whole, "family"))
    near = steps.where("all_parts > 1").select("family", "step", "parts")
    for name, shift in (("above", 1), ("below", -1)):
        near = near.join(steps.select("family", (F.col("step") - shift).alias("step"), F.col("parts").alias(name)), ["family", "step"], "left")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = lambda low, low_part, high, high_part, side: F.struct(F.concat_ws(":", "family", low, low_part, high, high_part).alias("unit"), side.alias("side"))
    none = F.lit(None).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    step_, up, down = F.col("step"), F.col("step") + 1, F.col("step") - 1
    mine = F.transform(upto(F.col("parts")), lambda k: units(step_, F.least(part, k), step_, F.greatest(part, k), F.when(part < k, 0).when(part > k, 1).otherwise(none)))
    higher = F.transform(upto(F.coalesce("above", F.lit(0))), lambda k: units(step_, part, up, k, F.lit(0)))
    lower = F.transform(upto(F.coalesce("below", F.lit(0))), lambda k: units(down, k, step_, part, F.lit(1)))
    alone = F.array(F.struct(F.col("family").cast("string").alias("unit"), none.alias("side")))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sent = sized.join(near, ["family", "step", "salt"], "left").select("node", "place", "group", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(F.concat(mine, higher, lower))).alias("to"))
    # one row of each node brings its keys, also where an id repeats
    full = nodes.select("node", "place", "n", "lone", "keys").join(sent, ["node", "place"]).select("to.unit", "node", "group", "n", "lone", "keys", "to.side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        unit, members = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "group", "n", "lone", "keys", "side")), strict=True):
                if row[0] != unit:
                    made += verified_links(members, percent) if len(members) > 1 else []
                    unit, members = row[0], []
                members.append((*row[1:5], np.frombuffer(row[5], dtype=np.int64), row[6]))
            if len(made) > 10_000:
                yield _links(made)
                made = []
        made += verified_links(members, percent) if len(members) > 1 else []
        yield _links(made)

    # a unit's rows lie together
    together = full.repartition(shuffle_partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit")
    found = components(together.mapInArrow(run, "a long, b long"))
    return cut(by_node.select("node", "low").join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("comp")))


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id that
    links reach; the row's own id if it has none).

    Documents link when 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles. A null
    or empty text has an empty set and no link; texts may be of any length. Rows that share an id get the smallest classes and components of any of
    them; rows with a null id link nothing and get nulls. Ids are whole numbers. An empty table gives an empty result, other columns are ignored.
    """
    sets = cut(_sets(docs, id_col, text_col, width, percent).withColumn("place", F.monotonically_increasing_id()))
    nodes = sets.where("node is not null and id is not null")
    lows = linked_sets(nodes.select("id", "place", "node", F.col("n_shingles").alias("n"), "lone", "keys"), percent)
    lowest = lows.groupBy("comp").agg(F.min("low").alias("component"))
    by_node = lows.join(lowest, "comp").select("node", "low", "component")
    by_id = nodes.select("id", "node").join(by_node, "node").groupBy("id").agg(F.min("low").alias("class"), F.min("component").alias("component"))
    return sets.select("id", "n_shingles").join(by_id, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("class", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id")
    )


def op8_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS own FROM w),
u AS (SELECT doc_id, len(own) AS n, unnest(own) AS gram FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 75 * (n + m - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(own) AS n_shingles, CASE WHEN len(own) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(own)) END AS class_id, component_id FROM s JOIN c USING (doc_id)
"""
