"""Operators 2, 8 and 10 against brute force."""

import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.components import components
from weftline.llm.multiplicity import Grades, chunked, grade, replies, shape, with_grades
from weftline.llm.near_dup import linked_sets, near_duplicates, overlaps, spanning
from weftline.llm.substring_dedup import remove_repeats
from weftline.llm.suffix_dedup import minimisers, repeated_passages

from .conftest import WORD, shared


def windows(rows, n):
    return Counter(tuple(w[i : i + n]) for w in rows for i in range(len(w) - n + 1))


def covered(words, seen, n):
    out = [False] * len(words)
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            out[i : i + n] = [True] * n
    return out


@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t\x0b\x1c z"), max_size=20), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = []
    for _, data, offsets in W.slices(pa.array(texts, pa.string()), most=16):
        starts, ends, first = W.spans(data, offsets)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        found += [words[first[k] : first[k + 1]] for k in range(len(offsets) - 1)]
    assert found == [WORD.findall(t) for t in texts]


def test_equal_words_have_equal_hashes_and_others_not():
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 3000, "a" * 3001, "é"]
    data = np.frombuffer(" ".join(words + words).encode(), dtype=np.uint8)
    hashes, _ = W.words(data, np.array([0, len(data)]))
    assert (hashes[: len(words)] == hashes[len(words) :]).all() and len(set(hashes.tolist())) == len(words)


@pytest.mark.parametrize("width", [2, 35])
def test_repeated_windows_are_removed(docs, texts, width):
    split = [WORD.findall(t or "") for _, t in texts]
    seen = windows(split, width)
    want = Counter()
    for (i, _), w in zip(texts, split):
        gone = covered(w, seen, width)
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), rest, hashlib.sha256(rest.encode()).hexdigest()] += 1
    out = remove_repeats(docs, width=width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in out) == want
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in out)


@pytest.mark.parametrize(("partitions", "fan"), [(4, 256), (4, 2), (9, 3), (12, 3), (7, 2)])
def test_keys_are_counted_in_levels(spark, partitions, fan):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 30)))) for k in range(300)]
    want = Counter(w for _, t in rows for w in t.split())
    keys = lambda texts: np.concatenate([np.zeros(0, np.uint64), *(W.words(data, offsets)[0] for _, data, offsets in W.slices(texts))])

    def work(table, grades):
        words = sorted({w for t in table.column("text").to_pylist() for w in t.split()})
        found = grades.of(keys(pa.chunked_array([pa.array([" ".join(words)])]))) if words else []
        return pa.table({"word": pa.array(words, pa.string()), "grade": pa.array([int(x) for x in found], pa.int64())})

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        chunks = chunked(spark.createDataFrame(rows, "id long, text string"), "id", "text")
        got = with_grades(chunks, keys, work, "word string, grade long", fan).collect()
        assert {(r.word, r.grade) for r in got} == {(w, int(grade(np.array([n]))[0])) for w, n in want.items()}
        # packed rows of the first level: at most the fan for each chunk
        assert replies(chunks, keys, fan).count() <= partitions * shape(partitions, fan)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chance_collisions_are_told_by_other_keys(spark):
    """First keys of three bits collide all the time; with other keys only what is repeated counts."""
    rows = [(k, f"word{k if k % 5 else 1}") for k in range(1, 120)]
    exact = lambda texts: np.concatenate([np.zeros(0, np.uint64), *(W.words(data, offsets)[0] for _, data, offsets in W.slices(texts))])

    def work(table, texts, grades, checked):
        own = exact(texts)
        first = grades.of(own & np.uint64(7)) > 0
        first[first] = checked.of(own[first]) > 0
        return pa.table({"id": table.column("id"), "again": pa.array(first.tolist())})

    out = with_grades(chunked(spark.createDataFrame(rows, "id long, text string"), "id", "text"), lambda texts: exact(texts) & np.uint64(7), work, "id long, again boolean", again=lambda texts, grades: exact(texts)[grades.of(exact(texts) & np.uint64(7)) > 0])
    assert {r.id for r in out.collect() if r.again} == {k for k, t in rows if t == "word1"}


def test_grades_of_a_large_chunk_take_no_longer_than_a_few_sorts():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**64, 1 << 20, dtype=np.uint64)
    keys[::7] = keys[0]
    own, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    answer = pa.table({"part": pa.array([0], pa.int32()), "grades": pa.array([grade(counts).tobytes()], pa.binary())})

    def least(make):
        took = []
        for _ in range(3):
            began = time.process_time()
            out = make()
            took.append(time.process_time() - began)
        return min(took), out

    sorts, _ = least(lambda: np.unique(keys, return_inverse=True))
    took, found = least(lambda: Grades(keys, answer).of(keys))
    assert (found == grade(counts)[where]).all()
    assert (Grades(keys, answer).keys == own).all()
    assert took < 6 * sorts
    none = Grades(keys[:0], pa.table({"part": pa.array([], pa.int32()), "grades": pa.array([], pa.binary())}))
    assert len(none.keys) == len(none.of(keys[:0])) == 0


def test_packed_rows_grow_with_the_chunks():
    for n in (200, 1000, 10_000, 1_000_000, 5_000_000):
        levels, fan = shape(n, 256)
        assert fan <= 256 and fan**levels >= n and levels <= 3


def test_empty_tables(docs):
    none = docs.limit(0)
    assert remove_repeats(none).count() == 0 and near_duplicates(none).count() == 0 and repeated_passages(none).count() == 0


def test_repeated_passages_are_found_whole(docs, texts):
    split = [WORD.findall(t or "") for _, t in texts]
    seen = windows(split, 50)
    want = defaultdict(set)
    for (i, _), w in zip(texts, split):
        want[i] |= {k for k, g in enumerate(covered(w, seen, 50)) if g}
    got = defaultdict(set)
    for r in repeated_passages(docs).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    assert {k: v for k, v in want.items() if v} == got


def test_partner_may_be_next_to_it_in_neither_order(spark):
    seed, left, right = shared(10, 200), shared(40, 201), shared(40, 202)

    def text(k, n_left, n_right):
        return shared(60, 300 + k) + left[40 - n_left :] + seed + right[:n_right] + shared(60, 400 + k)

    rows = [(0, text(0, 25, 25)), (1, text(1, 25, 25))]
    rows += [(2 + k, text(2 + k, 2, 35)) for k in range(12)] + [(20 + k, text(20 + k, 35, 2)) for k in range(12)]
    assert_brute_force(spark, rows)
    # partners of one seed differ from offset to offset
    rng = np.random.default_rng(3)
    rows = [(k, text(k, int(rng.integers(0, 41)), int(rng.integers(0, 41)))) for k in range(60)]
    assert_brute_force(spark, rows)
    assert_brute_force(spark, rows, most_contexts=5)


def test_one_row_is_no_repeat_of_itself(spark):
    seed = shared(10, 200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert_brute_force(spark, [(k, shared(60, 300 + k) + seed + shared(60, 400 + k)) for k in range(2)])
        assert_brute_force(spark, [(k, shared(60, 300 + k) + shared(55, 200) + shared(60, 400 + k)) for k in range(2)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("most", [2, 8192])
def test_partners_are_found_among_others_that_share_parts(spark, most):
    rows = []
    for k in range(18):
        passage = shared(50, 500 + k)
        rows += [(100 * k + j, shared(30, 3000 + 100 * k + j) + passage + shared(30, 5000 + 100 * k + j)) for j in range(2)]
        for j in range(6):
            at = 8 + 5 * j
            rows.append((100 * k + 10 + j, shared(20, 7000 + 100 * k + j) + passage[at:] + shared(4, 600 + k) + shared(20, 8000 + 100 * k + j)))
            rows.append((100 * k + 20 + j, shared(20, 9000 + 100 * k + j) + shared(4, 700 + k) + passage[: at + 10] + shared(20, 9500 + 100 * k + j)))
    assert_brute_force(spark, rows, most_contexts=most)


def assert_brute_force(spark, rows, **how):
    seen = windows([w for _, w in rows], 50)
    want = {(i, k) for i, w in rows for k, g in enumerate(covered(w, seen, 50)) if g}
    out = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), **how).collect()
    assert {(r.doc_id, k) for r in out for k in range(r.start, r.end)} == want


def test_minimisers_are_kept_in_every_long_run():
    hashes = W.mix(np.arange(400, dtype=np.uint64))
    at, _ = minimisers(hashes, np.array([0, 300, 305, 400]), 10, 41)
    for low, high in ((0, 300), (305, 400)):
        own = at[(at >= low) & (at < high)]
        assert all(((own >= i) & (own < i + 41)).any() for i in range(low, high - 50 + 1))


def brute_components(texts, width=5, percent=75):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    ids = [i for i, _ in texts]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (ids[a], ids[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets))


def test_components_equal_those_of_all_pairs(docs, texts):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == brute_components(texts)


def test_large_families_are_split_and_stay_whole(spark, monkeypatch):
    rows = []
    for k in range(40):
        w = [f"b{i}" for i in range(100)]
        for j in range(k % 7):
            w[(k * 13 + j * 17) % 100] = f"e{k}_{j}"
        rows.append((k, " ".join(w[: 100 - k % 9])))
    rows += [(100 + k, " ".join(f"c{k}_{i}" for i in range(30))) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linked_sets, "__defaults__", (75, 700, 3))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute_components(rows)


def test_links_that_fit_a_task_are_joined_in_one_step(spark):
    """Steps over few links, each of several joins, took the driver's memory."""
    rng = np.random.default_rng(5)
    rows = [(k, k + 1) for k in range(-300, 300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 3000, (900, 2))] + [(7, None), (None, 8), (5000, 5000), (9001, 9000)]
    links = spark.createDataFrame(rows, "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-links", "")
    got = components(links).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("few-links"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    assert {r.component for r in got if r.node < 1000} == {-300} and {(r.node, r.component) for r in got if r.node > 4000} == {(9000, 9000), (9001, 9000)}
    assert sorted(got) == sorted(components(links, whole=0).collect())
    assert components(links.where("a > 10000")).collect() == []


def test_overlaps_count_dense_and_sparse_shingles_alike():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, 80)) for k in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:12]])
    for dense in (0.0, 0.02, 2.0):
        assert (overlaps(sets[:12], sets[10:], dense) == want).all()


def test_spanning_links_join_what_links_join():
    links = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0]], dtype=bool)
    assert spanning(np.array([5, 6, 7]), np.array([1, 2, 3]), links) == [(2, 1), (5, 1), (6, 1)]


def test_rows_repeated_under_one_id_are_one_node(spark):
    """20,000 equal rows are compared once."""
    base = shared(60, 11)
    near = " ".join([*base[:30], "other", *base[31:]])
    rows = spark.range(20_000, numPartitions=4).select(F.lit(5).cast("long").alias("doc_id"), F.lit(" ".join(base)).alias("text")).union(spark.createDataFrame([(3, near), (9, " ".join(base))], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in near_duplicates(rows).collect())
    assert got == {(5, 56, 5, 3): 20_000, (9, 56, 5, 3): 1, (3, 56, 3, 3): 1}
