import pytest
from pyspark.sql import functions as F

from weftline.functions import patterns as P
from weftline.functions import text as T
from weftline.functions.shell import features


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(("function", "text", "want"), [
    (T.trim_u, "　 a \n", "a"),
    (T.sanitize, "\x1b[31mred\x1b[0m\x07\tx\r\n", "red\tx\r\n"),
    (T.strip_wrappers, "go <system-reminder a='1'>x\ny</system-reminder> on", "go  on"),
    (T.strip_wrappers, "<command-name>a</command-args>", "<command-name>a</command-args>"),
    (lambda c: T.clip(c, 4), "abcde", "abc…"),
    (lambda c: T.clip(c, 5), "abcde", "abcde"),
    (T.non_empty_lines, " a \n\n\t\n b", ["a", "b"]),
    (lambda c: T.first_line(c, 3), "\n abcd\n", "ab…"),
    (T.estimate_tokens, "abcdefghi", 3),
    (T.estimate_tokens, "日本語ab", 4),
    (lambda c: T.clip_sentence(c, 20), "One two three. Four five six seven.", "One two three."),
    (lambda c: T.clip_sentence(c, 20), "A. bbbbbbbbbbbbbbbbbbbbbbbbb", "A. bbbbbbbbbbbbbbbb…"),
    (lambda c: T.clip_sentence(c, 7), "これは文。そして次です", "これは文。"),
    (lambda c: T.clip_tokens(c, 2), "abcdefghij", "abcdefgh…"),
    (lambda c: T.clip_tokens(c, 2), "日本語", "日本…"),
    (lambda c: T.clip_tokens(c, 2), "a日bcde", "a日bcd…"),
    (T.search_tokens, "Open src/app.ts: retry_loader", ["open", "src/app.ts", "src", "app", "ts", "retry_loader", "retry", "loader"]),
    (T.search_tokens, "検索語 x", ["検索", "索語"]),
    (T.search_tokens, "語", ["語"]),
    (T.one_line, " a\n　 b ", "a b"),
    (T.path_tokens, "see /w/A.ts and b.py, A.ts. v1", ["/w/a.ts", "b.py", "a.ts"]),
    (T.error_line_of, "Exit code 1\n0 failed, 3 passed\nTypeError: x is not a function", "TypeError: x is not a function"),
    (T.error_line_of, "Exit code 1\n", None),
    (T.error_line, "Exit code 1\nplain", "plain"),
    (T.short_tool_name, "mcp__graph__query_tool", "query_tool"),
    (T.compress_command, "cd /w && A=1 B=2 make  all | tail -5", "make all"),
    (T.notification_text, "<task-notification><summary> done </summary></task-notification>", "task notification: done"),
    (T.notification_text, "<task-notification>", "task notification: a background task finished"),
    (T.is_goal, "はい", False), (T.is_goal, "直して", True), (T.is_goal, "ok then", False), (T.is_goal, "https://example.com/x", False), (T.is_goal, "Speed up the loader", True),
    (T.without_bullet, " - fix it", "fix it"),
    (lambda c: c.rlike(P.TASK), "あfixする", True),
    (lambda c: c.rlike(P.TASK), "prefixes", False),
])
def test_text_functions(spark, function, text, want):
    assert value(spark, text, function) == want


def test_snippets_are_cut_on_both_sides(spark):
    text = "a" * 500 + " hit " + "b" * 500
    got = value(spark, text, lambda c: T.snippet(c, F.lit(501)))
    assert got.startswith("…a") and got.endswith("b…") and " hit " in got
    assert value(spark, "short  text", lambda c: T.snippet(c, F.lit(3))) == "short text"


@pytest.mark.parametrize(("command", "want"), [
    ("cd /w/app && cat > src/a.ts <<'EOF'\nx > y\nEOF\nls", ("cat", False, ["/w/app/src/a.ts"])),
    ("X=1 cargo test 2>&1 | tail -5", ("cargo test", False, [])),
    ("sed -i 's/a/b/' x/y.txt", ("sed", False, ["x/y.txt"])),
    ("sed -n 1,5p x/y.txt", ("sed", True, [])),
    ("echo \"a;b\" >> log.txt; git commit -m 'x y'", ("echo", False, ["log.txt"])),
    ("/usr/bin/grep x a && ls > /dev/null", ("grep x", True, [])),
    ("tee -a out.log", ("tee", False, ["out.log"])),
    (f"echo x > /home/u/{P.HOST_FOLDERS[0]}/m.md", ("echo x", False, [])),
    ("echo x > /home/u/.config/m.md", ("echo x", False, ["/home/u/.config/m.md"])),
    ("python -c \"open('a/b.txt','w')\"", ("python", False, ["a/b.txt"])),
    ("echo $(date) > \"$F\"", ("echo", False, [])),
    ("cat 'open quote", ("cat", True, [])), (None, ("", True, [])), ("", ("", True, [])),
])
def test_shell_features(command, want):
    assert features(command) == want


def test_first_lines_are_those_of_all_lines(spark):
    texts = ["", None, " \n\t", "a", " \n  b c 　\nd", "\r\nx y z \r\n", " \n﻿ q", "é" * 300, "one\n\ntwo", "x \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.first_line(F.col("t"), 50).alias("one"), F.coalesce(F.get(T.non_empty_lines(F.col("t")), F.lit(0)), F.lit("")).alias("all")).collect()
    assert all(r.one == (r["all"] if len(r["all"]) <= 50 else r["all"][:49] + "…") for r in rows)
