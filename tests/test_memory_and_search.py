"""Search, the memory ledger, retention, streams, and all queries against SQL."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline.operators import memory as M
from weftline.operators import retention as C
from weftline.operators import search as R

from .test_sessions import TALK, entries

ITEMS = "session_id string, ord long, id string, kind string, relevance string, content string, sources array<string>, at_ms long, supersedes array<string>, dropped boolean, superseded_by string, unclassified boolean"
DATA = "/root/testdata/sf0.001"


def items(spark, *rows):
    full = [("s", i, r["id"], r.get("kind", "fact"), r.get("relevance", "medium"), r.get("content", r["id"]), r.get("sources", []), r.get("at_ms", i), r.get("supersedes", []), r.get("dropped", False), r.get("by"), r.get("open", False)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ITEMS)


def queries(spark, *raw):
    return R.routed(spark.createDataFrame([(i, "s", x) for i, x in enumerate(raw)], "query_id long, session_id string, raw string"))


@pytest.mark.parametrize(("raw", "want"), [
    ("retry page:2 scope:memory", ("text", 2, "memory", "retry", None, None)), ("#12", ("index", 1, "all", None, 12, None)), ("#3: a b ", ("index", 1, "all", None, 3, "a b")),
    ("/x+y/", ("regex", 1, "all", "(?i)x+y", None, None)), ("/x/s", ("regex", 1, "all", "(?s)x", None, None)), ("mode:regex a|b", ("regex", 1, "all", "(?i)a|b", None, None)),
    ("mode:file /w/a.ts", ("file", 1, "all", "/w/a.ts", None, None)), ("0123456789ab", ("id", 1, "all", "0123456789ab", None, None)), (" page:3 ", ("error", 3, "all", "", None, None)), ("page:0 x", ("text", 1, "all", "x", None, None)),
])
def test_queries_are_routed(spark, raw, want):
    assert tuple(queries(spark, raw).select("kind", "page", "scope", "term", "entry", "drill").first()) == want


def test_search_finds_words_pairs_and_patterns(spark):
    rows = entries(spark, *TALK)
    docs = R.documents(rows, items(spark, {"id": "m1", "content": "pnpm is the rule"}, {"id": "m2", "content": "pnpm was", "dropped": True}))
    asked = queries(spark, "pnpm", "バグ", "/PASSED/", "mode:file LOAD.ts", "scope:history /pnpm/")
    hits = R.page_of(R.bm25(docs, asked.where("kind = 'text'"), ["session_id", "ref", "doc_ord"], ["session_id"]), [F.desc("score"), F.col("doc_ord")])
    found = {q: [r.doc_ord for r in hits.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 1)}
    assert len(found[0]) == 2 and found[1] == [0]
    regex = R.regex_hits(docs, asked).orderBy("query_id", "doc_ord").collect()
    assert [(r.query_id, r.doc_ord) for r in regex] == [(2, 3), (4, 4)] and "passed" in regex[0].snippet
    assert [r["index"] for r in R.file_hits(rows, asked).orderBy(F.desc("index")).collect()] == [2, 1]


def test_entries_open_by_number_line_and_id(spark):
    rows = entries(spark, *TALK)
    ids = {r["index"]: r.entry_id for r in rows.collect()}
    memory = items(spark, {"id": "aaaaaaaaaaaa", "sources": [ids[0]]}, {"id": "bbbbbbbbbbbb", "sources": [ids[0], "gone"], "supersedes": ["aaaaaaaaaaaa"], "dropped": True, "by": "cccccccccccc"})
    asked = queries(spark, "#0", "#2:FAILED", "bbbbbbbbbbbb", ids[1], "#99", "dddddddddddd")
    full = R.expanded(rows, memory, asked).collect()
    assert [(r.query_id, r.related) for r in full] == [(0, ["aaaaaaaaaaaa"])] and full[0].text == f"#0 [{ids[0]}] user\nローダーのバグを直して"
    assert [(r.line_no, r.line) for r in R.drilled(rows, asked).collect()] == [(7, "Error: 1 failed")]
    found = {r.query_id: r for r in R.by_id(rows, memory, asked).collect()}
    assert set(found) == {2, 3} and found[2].status == "superseded by cccccccccccc" and found[2].replaces == ["aaaaaaaaaaaa"] and found[2].source_entries == [ids[0]] and found[3].found == "entry"


def test_pages(spark):
    hits = spark.range(20).select(F.lit(1).alias("query_id"), F.col("id").alias("n"))
    assert [r.n for r in R.page_of(hits, [F.desc("n")], 3).orderBy("rank").collect()] == [3, 2, 1, 0] and R.page_of(hits, [F.desc("n")], 3).first().n_pages == 3


@pytest.mark.parametrize("pool", [60, 100, 200, 1000])
def test_budgets_are_met_by_dropping_the_least(spark, pool):
    rows = [{"id": f"i{k}", "kind": list(M.TITLES)[k % 5], "relevance": ["low", "medium", "high", "critical"][k * 7 % 4], "content": "x" * (k * 5 % 60), "at_ms": k * 13 % 17, "open": k % 6 == 0, "dropped": k % 11 == 0} for k in range(60)]
    out = {r.id: r for r in M.fit_budgets(items(spark, *rows), pool).collect()}
    tokens = lambda r: -(-len(r["content"]) // 4) + 8
    for kind, share in (("constraint", 0.2), ("lesson", 0.3), ("decision", 0.25), ("state", 0.1), ("fact", 0.15)):
        own = [r for r in rows if r["kind"] == kind and not r["dropped"]]
        over = sum(map(tokens, own)) - int(pool * share + 1e-9)
        gone = set()
        for r in sorted((r for r in own if not r["open"]), key=lambda r: (["low", "medium", "high", "critical"].index(r["relevance"]), r["at_ms"], rows.index(r))):
            if over <= 0:
                break
            gone.add(r["id"])
            over -= tokens(r)
        assert {r["id"] for r in own if out[r["id"]].dropped} == gone


def test_replies_become_items(spark):
    chunk = M.chunks(M.pending(entries(spark, *TALK), entries(spark, *TALK).where("index = 4")), 10_000)
    ids = [r.entry_id for r in chunk.orderBy("index").collect()]
    assert len(ids) == 4
    good = f'Sure:\n```json\n{{"observations":[{{"kind":"odd","content":" Lesson:  do x ","relevance":"?","sourceEntryIds":["{ids[1]}","zz"]}},{{"content":"uncited","sourceEntryIds":["zz"]}},{{"kind":"state","content":"later","relevance":"high","sources":["{ids[0]}","{ids[2]}"],"supersedes":["old"]}}]}}\n``` done {{'
    replies = spark.createDataFrame([("s", 0, good, 9), ("t", 0, "no json", 9)], "session_id string, chunk_no long, reply string, now_ms long")
    new = M.observations(replies, chunk)
    rows = new.orderBy("place").collect()
    assert [(r.kind, r.relevance, r.content, r.sources, r.at_ms) for r in rows] == [("lesson", "medium", "Lesson: do x", [ids[1]], 9), ("state", "high", "later", [ids[0], ids[2]], 9)]
    ledger = items(spark, {"id": "old"}, {"id": "dup", "content": "LATER", "dropped": True}, {"id": "x", "content": "lesson: DO X"})
    out = {r.id: r for r in M.add_observations(ledger, new).collect()}
    assert set(out) == {"old", "dup", "x", rows[1].id} and out["old"].superseded_by == rows[1].id and out[rows[1].id].ord == 3 and out[rows[1].id].supersedes == ["old"]


def test_greedy_chunks():
    assert M.chunk_numbers([5, 6, 50, 1, 1, 9, 10], 11) == [0, 0, 1, 2, 2, 2, 3] and M.chunk_numbers([], 5) == []


@pytest.mark.parametrize(("reply", "want"), [("x {\"a\": 1} y } z", '{"a": 1}'), ("[1, 2] tail ]", "[1, 2]"), ("none", None), ("{bad", None), (None, None), ("```json\n{\"a\": [1]}\n```", '{"a": [1]}')])
def test_json_in_replies(spark, reply, want):
    assert M.first_json(reply) == want
    got = spark.createDataFrame([(reply,)], "r string").select(M.reply_json(F.col("r")).alias("j")).first().j
    assert (got or "").replace(" ", "") == (want or "").replace(" ", "")


def test_consolidation_claims_first_come(spark):
    rows = [{"id": f"c{k}", "kind": "constraint", "content": "y" * 80, "sources": [f"e{k}", "e"], "at_ms": 10 + k, "relevance": "high" if k == 1 else "low"} for k in range(4)] + [{"id": "f", "content": "z" * 400}]
    reply = '{"merged":[{"content":"all  one","replaces":["c0","c1","f"]},{"content":"again","relevance":"critical","replaces":["c1","c2"]},{"content":"","replaces":["c3"]}],"retire":["c3","c0"]}'
    out = {r.id: r for r in M.consolidate(items(spark, *rows), spark.createDataFrame([("s", reply)], "session_id string, reply string"), 100).collect()}
    new = [r for r in out.values() if r.content in ("all one", "again")]
    first, second = sorted(new, key=lambda r: r.content, reverse=False)[1], sorted(new, key=lambda r: r.content)[0]
    first, second = (first, second) if first.content == "all one" else (second, first)
    assert first.supersedes == ["c0", "c1"] and first.sources == ["e0", "e", "e1"] and first.relevance == "high" and first.at_ms == 11 and second.supersedes == ["c2"] and second.relevance == "critical"
    assert out["c0"].superseded_by == first.id and out["c2"].superseded_by == second.id and out["c3"].dropped and out["c3"].superseded_by is None and not out["f"].dropped


def test_old_ledgers_become_one_layer(spark):
    old = items(spark, {"id": "a", "kind": None, "content": "Lesson one", "relevance": "critical", "sources": ["e1"]}, {"id": "b", "kind": "state", "sources": ["e2", "e1"]})
    reflections = spark.createDataFrame([("s", 0, "r1", "first", ["a", "b"], 5, False), ("s", 1, "r2", "second", ["b", "zz"], 6, False), ("s", 2, "r3", "third", ["a"], 7, True)], "session_id string, ord int, id string, content string, sources array<string>, at_ms long, dropped boolean")
    out = {r.id: r for r in M.migrate(old, reflections).collect()}
    assert (out["a"].kind, out["a"].unclassified, out["a"].superseded_by) == ("lesson", True, "r1") and (out["b"].kind, out["b"].unclassified, out["b"].superseded_by) == ("state", False, "r2")
    assert (out["r1"].relevance, out["r1"].sources, out["r2"].relevance, out["r3"].dropped) == ("critical", ["e1", "e2"], "high", True)


def test_memory_is_rendered_by_kind(spark):
    rows = items(spark, {"id": "f1", "content": "a fact"}, {"id": "c1", "kind": "constraint", "content": "a rule", "relevance": "critical"}, {"id": "x", "dropped": True})
    assert M.memory_text(rows).first().memory == "## Constraints\n- [c1] 1970-01-01 00:00 [critical] a rule\n\n## Facts\n- [f1] 1970-01-01 00:00 [medium] a fact"


def test_stale_sessions(spark):
    names = [f"{k:08x}-0000-0000-0000-000000000000" for k in range(4)] + ["not-a-session"]
    sessions = spark.createDataFrame([(n,) for n in names], "session_id string")
    files = spark.createDataFrame([(names[0], 1000), (names[1], 40 * C.DAY_MS), (names[3], 5)], "session_id string, mtime_ms long")
    stale = C.stale_sessions(sessions, files, 31 * C.DAY_MS, current=names[3])
    assert [(r.session_id, r.newest_ms) for r in stale.collect()] == [(names[2], 0), (names[0], 1000)]
    assert C.stale_sessions(sessions, files, 30 * C.DAY_MS + 1000, current=names[3]).count() == 1
    assert C.retained(files, stale).count() == 2
    days = spark.createDataFrame([("7",), ("-1",), ("x",), (None,), ("Infinity",)], "d string").select(C.retention_days(F.col("d").try_cast("double")).alias("d"))
    assert [r.d for r in days.collect()] == [7.0, 30.0, 30.0, 30.0, 30.0]


def test_worker_usage(spark):
    log = spark.createDataFrame([("s", 1, False, 5, 1, 10), ("s", 2, True, 0, 0, 20)], "session_id string, cycle int, failed boolean, tokens_in int, tokens_out int, ms int")
    assert tuple(M.worker_usage(log).first()) == ("s", 2, 1, 5, 1, 30, 2, 15.0)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_chunks_in_blocks_are_those_of_one_pass(spark, block):
    rng = random.Random(block)
    lengths = {"a": 60, "b": 1, "c": 25, "d": 200}
    rows = [(s, i * 10 // (n + 1) // 5, i, rng.choice([0, 1, 5, 30, 99, 150])) for s, n in lengths.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "session_id string, window_id int, ord long, tokens long")
    got = {}
    for r in M.chunks(frame, 100, block).collect():
        got.setdefault(r.session_id, []).append((r.window_id, r.ord, r.chunk_no))
    for s in lengths:
        own = sorted((w, o, t) for x, w, o, t in rows if x == s)
        assert [c for *_, c in sorted(got[s])] == M.chunk_numbers([t for *_, t in own], 100)


def test_replies_are_read_as_by_the_longest_span(spark):
    replies = ['{"a": 1} and {"b": 2}', 'Sure:\n```json\n{"a": [1, 2]}\n``` done', '[{"a": "x}"}] }', "none", "", None, '{"a": 1', '{x} {"a": 1}', '{"a": NaN}', '{"a": 1, "a": 2}', "say [1", '{"k": {"a": "b"}}}', "{'a': 1}", '{"é": "ü\\n"} ]']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string").select("i", M.reply_json(F.col("reply")).alias("json"), "reply").collect()
    for r in got:
        want = M.first_json(r.reply)
        assert (r.json and json.loads(r.json)) == (want and json.loads(want)), r.reply


QUERIES = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    frame = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(flat(r[c]) for c in columns) for r in frame.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(flat(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
