"""Entries, sections, transcript, state and summary of small sessions."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import brief as B
from weftline.operators import entries as E
from weftline.operators import sections as X
from weftline.operators import summary as Y
from weftline.sources import archive as A

MESSAGES = "session_id string, window_id int, ord int, role string, text string, tool_uses array<struct<tool_use_id: string, tool: string, input: map<string,string>, text: string, is_error: boolean>>, at timestamp"


def call(key, tool, result="", error=False, **arguments):
    return (key, tool, arguments, result, error)


def messages(spark, *turns, session="s", window=0):
    return spark.createDataFrame([(session, window, i, role, text, list(calls), None) for i, (role, text, *calls) in enumerate(turns)], MESSAGES)


def entries(spark, *turns, **how):
    return E.indexed(E.to_entries(messages(spark, *turns, **how)))


TALK = [
    ("user", "ローダーのバグを直して"),
    ("assistant", "見てみます", call("t1", "Read", "code", file_path="/w/src/load.ts")),
    ("assistant", "", call("t2", "Edit", "ok", file_path="/w/src/load.ts"), call("t3", "Bash", "Exit code 1\nError: 1 failed", True, command="cargo test load")),
    ("assistant", "", call("t4", "Bash", "all passed", command="cargo test"), call("t5", "Bash", "[main abc1234] fix: loader", command='git commit -qm "fix: loader"')),
    ("user", "いつも pnpm を使って"),
]


def test_entries_have_ids_by_content(spark):
    rows = entries(spark, ("user", "[session summary] old"), *TALK, ("user", "<system-reminder>x</system-reminder>"), ("assistant", " \n"), ("user", "same"), ("user", "same")).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(7)) and [r.role for r in rows][:2] == ["user", "assistant"]
    assert rows[1].key == "a:t1" and rows[2].key == "a:t2,t3" and len({r.entry_id for r in rows}) == 7
    again = entries(spark, *TALK).orderBy("index").collect()
    assert [r.entry_id for r in again] == [r.entry_id for r in rows[:5]]
    assert [r.entry_id for r in entries(spark, *TALK[:1], window=3).collect()] == [again[0].entry_id]
    apart = E.to_entries(messages(spark, *TALK[:1], window=3), ids_per_window=True).first()
    assert apart.entry_id != again[0].entry_id


def test_archiving_twice_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    first = E.to_entries(messages(spark, *TALK[:3]))
    whole = E.to_entries(messages(spark, *TALK)).unionByName(E.to_entries(messages(spark, *TALK[:2], session="other")))
    A.append_entries(first, path)
    for _ in range(2):
        A.append_entries(whole, path)
        rows = spark.read.parquet(path).collect()
        assert sorted((r.session_id, r["index"]) for r in rows) == [("other", 0), ("other", 1), *(("s", i) for i in range(5))]
    assert all(r.at for r in rows)


def test_json_layout_is_read(spark, tmp_path):
    folder = tmp_path / "abc"
    folder.mkdir()
    (folder / "seg-0001.json").write_text('[{"id":"e1","key":"u:1","role":"user","text":"hi","tools":[],"index":0,"at":1700000000000},\n{"id":"e2","key":"a:t","role":"assistant","text":"","tools":[{"name":"Bash","input":{"command":"ls","n":3},"text":"ok","isError":false}],"index":1}]')
    rows = A.read_segments(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r.session_id, r.entry_id, r["index"]) for r in rows] == [("abc", "e1", 0), ("abc", "e2", 1)] and rows[1].tools[0].input == {"command": "ls", "n": "3"}
    (folder / "ledger.json").write_text('{"version":2,"observed":["e1"],"observations":[{"id":"o1","kind":"fact","content":"c","relevance":"low","sources":["e1"],"at":5,"supersededBy":"o2","dropped":true}]}')
    items, seen, reflections = A.read_ledgers(spark, str(tmp_path))
    assert items.first().superseded_by == "o2" and seen.first().entry_id == "e1" and reflections.count() == 0


def test_large_entries_are_cut(spark):
    rows = E.bounded(entries(spark, ("user", "x" * 500), ("user", "short")), most=400, field=50).orderBy("index").collect()
    assert [len(r.text) for r in rows] == [50, 5]


def test_noise_goes(spark):
    rows = E.without_noise(entries(spark, ("user", "a"), ("assistant", "", call("t", "TodoWrite")), ("assistant", "", call("u", "mcp__x__recall"), call("v", "Bash", command="ls")))).orderBy("index").collect()
    assert [[t.name for t in r.tools] for r in rows] == [[], ["Bash"]]


def test_sections_of_a_session(spark):
    row = Y.build_sections(entries(spark, *TALK), "/w").first()
    assert row.goals == ["ローダーのバグを直して (#0)"] and row.preferences == ["いつも pnpm を使って (#4)"] and row.commits == ["abc1234 fix: loader"]
    assert row.files == {"Modified": ["src/load.ts"]} and row.outstanding == []
    assert row.brief == ["[user #0] ローダーのバグを直して", "[assistant #1] 見てみます", "  (5 tool calls #1–#3: Read, Edit, Bash ×3; 1 failed)", "[user #4] いつも pnpm を使って"]
    assert row.current_state[0] == "Last user request (#4): いつも pnpm を使って" and row.current_state[1] == "It answers the assistant's message (#1): 見てみます"


@pytest.mark.parametrize(("turns", "want"), [
    ([call("1", "Bash", "error: bad pattern", True, command="grep -n x a"), call("2", "Bash", "ok", command="make")], []),
    ([call("1", "Bash", "error: bad", True, command="make all"), call("2", "Bash", "ok", command="make test")], ["[Bash] error: bad"]),
    ([call("1", "Bash", "error: bad", True, command="make all"), call("2", "Bash", "ok", command="make all -j")], []),
    ([call("1", "Bash", "ok", command="make all"), call("2", "Bash", "error: bad", True, command="make all")], ["[Bash] error: bad"]),
    ([call("1", "Edit", "error: a/b.ts not found", True), call("2", "Edit", "ok c/d.ts")], ["[Edit] error: a/b.ts not found"]),
    ([call("1", "Edit", "error: a/b.ts not found", True), call("2", "Edit", "ok A/b.ts")], []),
    ([call("1", "Task", "error: broke", True), call("2", "Task", "fine")], []),
    ([call("1", "Bash", "Exit code 1", True, command="make")], []),
    ([call("1", "Bash", "The user doesn't want to proceed: error", True, command="make")], []),
])
def test_errors_are_settled_by_later_successes(spark, turns, want):
    rows = entries(spark, *(("assistant", "", c) for c in turns))
    assert [r.line for r in X.open_errors(E.tool_calls(rows)).collect()] == want


def test_reports_and_preferences_count_once(spark):
    rows = entries(spark, ("user", "The build is still failing here"), ("user", "the build is still failing here"), ("user", "- broken list item stays out"), ("user", "テストが動かない"), ("user", "エラー処理 is fine"), ("user", "always use tabs"), ("user", "Always use tabs\nnever push to main"), ("user", "why do you always use tabs?"))
    assert [r.line for r in X.user_reports(rows).orderBy("at").collect()] == ["[user] The build is still failing here", "[user] テストが動かない"]
    assert X.preferences(rows).first().preferences == ["always use tabs (#5)", "never push to main (#6)"]


def test_goals_follow_the_scope(spark):
    rows = entries(spark, ("user", "- Speed up the loader\nok"), ("user", "go"), ("user", "Please add a retry to it"), ("user", "Do NOT implement yet"), ("user", "Instead write the docs first"))
    assert X.goals(rows).first().goals == ["Speed up the loader (#0)", "[Scope change] Instead write the docs first (#4)"]


def test_commit_messages_are_read(spark):
    rows = entries(spark, ("assistant", "", call("1", "Bash", "", command="git commit -m 'one'"), call("2", "Bash", "", command="git commit -F - <<'EOF'\ntwo\n\nbody\nEOF"), call("3", "Bash", "", command="git commit --amend --no-edit"), call("4", "Bash", "[x 1234567] one", command="git commit -am \"one\"")))
    assert X.commits(E.tool_calls(rows)).first().commits == ["one", "two", "1234567 one"]


def test_files_keep_one_status(spark):
    rows = entries(spark, ("assistant", "", call("1", "Read", file_path="/w/a.ts"), call("2", "Write", "File created successfully at", file_path="/w/b.ts"), call("3", "Bash", "", command="echo x > c.txt"), call("4", "Edit", file_path="/w/a.ts"), call("5", "Read", file_path="/tmp/tasks/x.output"), call("6", "Edit", "error: no", True, file_path="/w/z.ts"), call("7", "Read", file_path="/w/b.ts")))
    status = X.file_status(E.tool_calls(rows), "/w")
    assert {(r.path, r.status) for r in status.collect()} == {("a.ts", "Modified"), ("b.ts", "Created"), ("c.txt", "Modified")}
    lines = X.files(status).select(X.file_lines(F.col("files")).alias("l")).first().l
    assert lines == ["Modified: c.txt, a.ts", "Created: b.ts"]


def test_long_transcripts_start_at_a_turn(spark):
    lines = ["[user #0] a", "  (1 tool call #1: Bash)", "[assistant #2] b", "[user #3] c"]
    got = spark.range(1).select(B.capped(F.array(*map(F.lit, lines)), 3).alias("a"), B.capped(F.array(*map(F.lit, lines)), 4).alias("b"), B.capped(F.array(*map(F.lit, lines)), 2).alias("c")).first()
    assert got.a == ["...(2 earlier lines omitted)", *lines[2:]] and got.b == lines and got.c == ["...(2 earlier lines omitted)", *lines[2:]]


def test_steps_merge(spark, tmp_path):
    first = Y.build_sections(entries(spark, *TALK), "/w")
    second = Y.build_sections(entries(spark, ("user", "Instead update the manual"), ("assistant", "", call("9", "Write", "File created successfully", file_path="/w/m.md"), call("10", "Read", file_path="/w/src/load.ts"))), "/w")
    new = Y.build_sections(entries(spark, ("user", "Build a new thing"), session="t"), "/w")
    rows = {r.session_id: r for r in Y.merge_sections(first, second.unionByName(new)).collect()}
    assert rows["s"].goals == ["ローダーのバグを直して (#0)"] and rows["s"].files == {"Modified": ["src/load.ts"], "Created": ["m.md"]} and rows["t"].goals == ["Build a new thing (#0)"]
    assert rows["s"].commits == ["abc1234 fix: loader"] and len(rows["s"].brief) == 6
    text = Y.format_summary(first, instructions="brief").first().summary
    assert text.startswith("[session summary]\n") and "[Session Goal]\n- ローダー" in text and "[Compaction Instructions]\nbrief" in text and text.endswith(Y.RECALL_NOTE)
    stored = A.save_sections(first, Y.format_summary(first), None)
    path = f"{tmp_path}/sections"
    stored.write.parquet(path)
    assert A.load_sections(spark, path, Y.format_summary(first)).count() == stored.count()
    assert A.load_sections(spark, path, Y.format_summary(first, instructions="other")).count() == 0
    found = Y.with_previous(second, stored, Y.format_summary(first)).first()
    lost = Y.with_previous(second, stored.withColumn("summary_hash", F.lit("x")), Y.format_summary(first)).first()
    assert found.commits == ["abc1234 fix: loader"] and lost.commits == [] and lost.brief[0].startswith("[session summary]")


def test_merged_lists_keep_first_spelling_and_last_items(spark):
    a, b = F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d"))
    assert spark.range(1).select(Y.merge_list(a, b, 3).alias("v")).first().v == ["b", "c", "d"]


def test_thin_replies_bring_the_proposal(spark):
    rows = entries(spark, ("user", "Please look at how the loader treats broken files today"), ("assistant", "Plan A or plan B?"), ("user", "案Aで"), ("assistant", "Done."), ("assistant", "", call("1", "Bash", "built\nmore", command="make"), call("2", "Bash", "x", command="ls")))
    assert B.current_state(rows).first().current_state == [
        "Last user request (#2): 案Aで", "It answers the assistant's message (#1): Plan A or plan B?", "Last substantive request (#0): Please look at how the loader treats broken files today", "Last assistant reply (#3): Done.", "Then: Bash: make → built", "Then: Bash: ls",
    ]


def test_results_do_not_depend_on_partitions(spark):
    rows = entries(spark, *TALK, *[("user", f"always use tool {i}") for i in range(15)])
    few = Y.build_sections(rows, "/w").first()
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert Y.build_sections(rows.repartition(5, "index"), "/w").first() == few and len(few.preferences) == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
