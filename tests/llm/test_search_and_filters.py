"""Operators 11, 12 and 13 against brute force, and the registered queries against their SQL."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as H
from weftline.llm import ranked_search as R
from weftline.llm import registry
from weftline.llm import url_filters as U
from weftline.llm.workspace import new_dir

DATA = "/root/testdata/sf0.001"
RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/e", "block"), ("a.example.net", "", "allow"), ("com", "", "block"), ("shop.com", "/x/y", "allow"), ("shop.com", "/x/", "block"), ("shop.com", "/x/", "allow"),
    ("ORG", "/Fr/", "block"), ("", "/private/", "block"), (None, "/p", "allow"), ("de", None, "block"), ("bad/host", "/", "block"), ("..", "/", "block"), ("a.b.c.d.de", "/q", "allow"),
]


def hosts_and_paths():
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "notexample.net", "shop.com", "www.SHOP.com", "com", "x.org", "org", "de", "b.c.d.de", "z.a.b.c.d.de", "", ".net", "net.", "..", "a..", "example.net:80"]
    return [(h, p) for h in hosts for p in ["", "/", "/en", "/en/", "/en/1", "/eng/", "/e", "/x/y", "/x/yz/", "/x/", "/x", "/private/a", "/pr", "/Fr/", "/fr/", "//en/", "/q"]]


def judged(url, rules, default="allow"):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for h, p, verdict in rules:
        h, p = (h or "").translate({c: c + 32 for c in range(65, 91)}), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p) and "/" not in h:
            key = (len(h.split(".")) if h else 0, len(p), verdict == "block")
            if best is None or key > best[0]:
                best = key, h + p, verdict
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("bounds", [(1000, 1 << 20), (4, 1 << 20), (1000, 40)])
def test_the_most_specific_rule_holds(spark, bounds):
    urls = [f"http://{h}{p}{end}" for h, p in hosts_and_paths() for end in ("", "?a=/en/", "#x://y")] + [None, "", "no-scheme", "://", "a://b://net/", "http://net\n/en/", "ftp://user@example.net/en/" + "x" * 50000, "http://net/"]
    pages = spark.createDataFrame([(i if i % 7 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in U.judge(pages, rules, most_rules=bounds[0], most_bytes=bounds[1]).collect())
    assert got == Counter((i if i % 7 else None, *judged(u, RULES)) for i, u in enumerate(urls))


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(pages, rules, default="block").collect()] == [(1, "a.net", "/x", None, "block")]
    assert U.judge(pages.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0
    with pytest.raises(Exception, match="allows or blocks"):
        U.judge(pages, spark.createDataFrame([("a", "/", "maybe")], rules.schema)).collect()


def mined(rows, every, positives, negatives):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    none = 1 << 63
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), none if j is None else j, j, other) for k, (j, other, w) in enumerate(rows) if k != n]
        scored.sort(key=lambda x: x[:2])
        for s, _, p, other in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and -80 * s <= -100 * x[0] <= -100 * s]
            out += [(i, p, rank + 1, x[2], -s, -x[0]) for rank, x in enumerate(fits[:negatives])]
    return Counter(out)


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 12))
    rows = []
    for i in range(n):
        v = [float(np.float32(x)) for x in centers[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.6])]
        rows.append((i, int(rng.integers(0, 3)) if i % 5 else int(i % 6), v))
    rows += [(500 + i, i % 3, rows[3][2]) for i in range(90)] + [(100, 1, rows[5][2]), (100, 1, rows[5][2]), (None, 1, rows[6][2]), (None, None, rows[6][2])]
    rows += [(700, 1, None), (701, None, [1.0] * 12), (702, 1, [1.0, None]), (703, 1, [float("nan")] * 12), (704, 1, [float("inf")]), (800, 1, []), (801, 2, [0.0] * 12), (900, 1, [2.0, -1.0]), (910, 2, [1.5] * 20), (920, 2, [-1.0] * 12), (930, 77, [1.0] * 12)]
    return rows


SHAPE = "vec_id long, label int, embedding array<float>, row long, cell string"


@pytest.mark.parametrize("sizes", [{}, {"rows_of": 16, "anchors_of": 4, "references": 3, "sample": 40}, {"rows_of": 64, "references": 1, "sample": 1}])
def test_hard_negatives_are_those_of_all_pairs(spark, sizes):
    rows = vectors(7)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE)
    got = Counter(tuple(r) for r in H.hard_negatives(frame, every=10, positives=4, negatives=3, **sizes).collect())
    assert got == mined(rows, 10, 4, 3) and len(got) > 100


def test_scores_of_any_size_are_whole_numbers(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 3e6 for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in H.hard_negatives(frame, every=5).collect()) == mined(rows, 5, 5, 5)
    assert H.scores(np.array([[2.0**62, 1.0]]), np.array([[4.0, 1.0]]), 2.0**65).tolist() == [[H.NO_ID]]


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(100, 1, [1.0, 2.0])], [(100, 1, [1.0]), (200, 1, [1.0])], [(100, 1, []), (101, 1, []), (102, 2, [])]])
def test_few_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in H.hard_negatives(frame).collect()) == mined(rows, 100, 5, 5)


def test_bounds_hold_for_all_scores():
    rng = np.random.default_rng(1)
    m = np.floor(256 * rng.normal(size=(300, 8)) * rng.choice([0, 0.1, 1, 50], size=(300, 1)))
    norms = H._lengths(m)
    angles = H._angles(m, norms, H.fit_references(list(m), 5)).astype(np.float32)
    tiles = np.arange(0, 300, 10)
    low, high = (f.reduceat(angles, tiles, axis=0).astype(float) for f in (np.minimum, np.maximum))
    least, most = (f.reduceat(norms, tiles) for f in (np.minimum, np.maximum))
    under, over = H.bounds(low, high, least, most, angles, norms)
    s = m @ m.T
    assert (np.minimum.reduceat(s, tiles, axis=1) >= under).all() and (np.maximum.reduceat(s, tiles, axis=1) <= over).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [x for x in held if x[1]]
    n_all, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_all // all_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in wanted.items() if c[t])
            scored += [(-s, 1 << 63 if i is None else i, i)] if s > 0 else []
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return Counter(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "日本語", "x"]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary[: rng.choice([5, 60, 403])]).upper() if rng.random() < 0.2 else rng.choice(vocabulary[: rng.choice([5, 60, 403])]) for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(n)]
    rows += [(1000 + i, rows[4][1]) for i in range(60)] + [(7, rows[7][1]), (None, rows[8][1]), (None, "w1 w1"), (2000, ""), (2001, None), (2002, " .,;!"), (2003, " ".join(f"w{k % 400}" for k in range(40000)))]
    return rows


@pytest.mark.parametrize("bounds", [(4096, 16 << 20, 1 << 18), (16, 1 << 20, 1 << 18), (4096, 900, 40), (1, 1, 400)])
def test_ranks_are_those_of_all_scores(spark, bounds):
    docs = corpus(5)
    items = [(i, docs[i * 9][1]) for i in range(20)] + [(3, docs[27][1]), (4, "w1 w1 nowhere"), (5, ""), (6, None), (None, "w3 W2"), (7, "nowhere at-all"), (8, "日本語 Ünï ünï"), (9, "w1 " * 500)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, rank int, terms string").repartition(3)
    asked = spark.createDataFrame([(*r, "d") for r in items], "item_id long, text string, doc string")
    index = R.build_index(frame, new_dir(spark, "index"), most_docs=bounds[0], most_bytes=bounds[1])
    got = Counter(tuple(r) for r in R.search(index, asked, asked=bounds[2]).collect())
    assert got == ranked(docs, items)


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.search(R.build_index(docs, new_dir(spark, "index")), items).count() == 0
    assert R.search(R.build_index(docs.limit(0), new_dir(spark, "index")), items).count() == 0
    index = R.build_index(docs.union(spark.createDataFrame([(3, "a b")], docs.schema)), new_dir(spark, "index"))
    assert R.search(index, items.limit(0)).count() == 0
    assert [tuple(r) for r in R.search(index, items).collect()] == [(1, 1, 3, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]


def test_few_cells_are_opened(spark):
    """What can't be among the best is left: a document like the item is found without looking at most others."""
    rng = random.Random(1)
    docs = [" ".join(f"t{rng.randrange(20000)}" for _ in range(60)) for _ in range(1000)]
    import pyarrow as pa

    docs = docs[:500] + docs[:1] * 20 + docs[500:]
    made = R.Treap(R.treap(pa.array(range(1020)), pa.array(docs), 1020, 61200))
    hashes = np.unique(R.term_hashes(pa.array(docs[:1]))[0])
    best = H.Best(1, 20)
    rows = made.places(hashes)
    opened = made.search(rows, np.full(len(rows), 1000), best)
    assert sorted(best.id) == [0, *range(500, 519)] and opened < 1500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLE_SQL if n.startswith("op")))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    frame = registry.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    out = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert set(names) <= set(frame.columns)
    assert Counter(tuple(r) for r in frame.select(*(F.col(c) for c in names)).collect()) == Counter(out.fetchall())


def test_ranges_are_written_in_groups_of_bounded_size(spark, tmp_path, monkeypatch):
    """All ranges of a task were one group of rows, which a search read at once."""
    import pyarrow.parquet as pq

    from weftline.llm import ranked_search

    monkeypatch.setattr(ranked_search, "GROUP", 1)
    docs = spark.createDataFrame([(i, f"w{i} w{i % 5} common") for i in range(24)], "doc_id long, text string").coalesce(1)
    index = ranked_search.build_index(docs, f"file://{tmp_path}/index", most_docs=2)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(groups) >= 12 and index.count() == 12
