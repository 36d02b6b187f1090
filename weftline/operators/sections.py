"""Sections of a session: goals, preferences, files, commits, open trouble."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.shell import with_shell_features
from ..sources.checkpoints import cut
from .entries import ORDER, tool_calls


def _at() -> Column:
    """An entry's place in its session."""
    return F.struct(*ORDER)


def goals(entries: DataFrame) -> DataFrame:
    """session_id, goals: the lines of the first request, and the latest change of scope or task after it."""
    raw = T.non_empty_lines(F.col("text"))
    users = entries.where(F.col("role") == "user").select("session_id", _at().alias("at"), "text", "index", raw.alias("raw"))
    signal = F.array_position(F.transform("raw", lambda x: x.rlike(P.TEMPLATE_SIGNAL)), True)
    users = users.withColumn("raw", F.when(signal > 0, F.slice("raw", F.lit(1), (signal - 1).cast("int"))).otherwise(F.col("raw")))
    lines = F.filter(F.transform(F.filter("raw", T.is_goal), T.without_bullet), lambda x: F.length(x) >= F.when(T.has_cjk(x), 3).otherwise(6))
    users = users.withColumn("lines", lines).where(F.size("lines") > 0)
    users = users.withColumn("first_at", F.min("at").over(Window.partitionBy("session_id")))
    head, first = F.substring("text", 1, P.LEADING_CHARS), F.get("lines", F.lit(0))
    scope = head.rlike(P.SCOPE_CHANGE)
    task = head.rlike(P.TASK) & (F.length(first) > F.when(T.has_cjk(first), 6).otherwise(15))
    marked = lambda n, label: F.transform(F.slice("lines", F.lit(1), n), lambda x: F.concat(F.lit(label), T.clip(x, P.GOAL_CHARS), T.index_mark(F.col("index"))))
    later = F.col("at") > F.col("first_at")
    picked = users.select(
        "session_id", "at",
        F.when(~later, marked(F.lit(6), "")).alias("start"),
        F.when(later & scope, marked(F.lit(3), "[Scope change] ")).when(later & task, marked(F.lit(2), "[Scope change] ")).alias("change"),
    )
    found = picked.groupBy("session_id").agg(F.min_by("start", F.when(F.col("start").isNotNull(), F.col("at"))).alias("start"), F.max_by("change", F.when(F.col("change").isNotNull(), F.col("at"))).alias("change"))
    return found.select("session_id", F.slice(F.concat("start", F.coalesce("change", F.expr(T.EMPTY))), 1, P.GOALS_MAX).alias("goals"))


def first_unseen(candidates: DataFrame) -> DataFrame:
    """From candidate lines (session_id, window_id, ord, line_no, line) each entry's first one that no earlier entry of
    the session took, without regard to case. Sequential by nature: a session's candidates pass one task in order, which holds its lines taken."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, entry, seen = None, None, set()
        for batch in batches:
            kept = []
            for s, *place, line in zip(*(batch.column(c).to_pylist() for c in ("session_id", *ORDER, "line")), strict=True):
                if s != session:
                    session, entry, seen = s, None, set()
                fresh = place != entry and line.lower() not in seen
                if fresh:
                    entry = place
                    seen.add(line.lower())
                kept.append(fresh)
            yield batch.filter(pa.array(kept, pa.bool_()))

    ordered = candidates.repartition("session_id").sortWithinPartitions("session_id", *ORDER, "line_no")
    return ordered.mapInArrow(take, candidates.schema)


def _lines(entries: DataFrame) -> DataFrame:
    rows = entries.where(F.col("role") == "user").select("session_id", *ORDER, "index", F.posexplode(T.non_empty_lines(F.col("text"))).alias("line_no", "line"))
    return rows


def preferences(entries: DataFrame) -> DataFrame:
    """session_id, preferences: the last standing instructions and corrections of the user."""
    line = F.col("line")
    bare = F.regexp_replace(F.regexp_replace(line, P.QUOTES_BEFORE, ""), P.QUOTES_AFTER, "")
    question = (bare.endswith("?") | bare.endswith("？")) & bare.rlike(P.INTERROGATIVE)
    rows = _lines(entries).where((F.length(line) >= F.when(T.has_cjk(line), 2).otherwise(5)) & (F.length(line) <= 200) & line.rlike(P.PREFERENCE) & ~question)
    told = first_unseen(rows).select("session_id", _at().alias("at"), F.concat(T.clip(line, 200), T.index_mark(F.col("index"))).alias("line"))
    return _last(told, P.PREFS_MAX, "preferences")


def _last(rows: DataFrame, most: int, name: str) -> DataFrame:
    """The last lines (session_id, at, line) of each session, in order."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("line")))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias(name))


def without_goals(preferences_: DataFrame, goals_: DataFrame) -> DataFrame:
    joined = preferences_.join(goals_, "session_id", "left")
    lower = F.transform(F.coalesce("goals", F.expr(T.EMPTY)), F.lower)
    return joined.select("session_id", F.filter("preferences", lambda p: ~F.array_contains(lower, F.lower(p))).alias("preferences"))


def file_status(calls: DataFrame, cwd: str | None = None) -> DataFrame:
    """session_id, path, status (Modified, Created or Read), at (when it first got it), of calls without error."""
    good = with_shell_features(calls.where(~F.col("is_error")))
    path = T.path_of(F.col("input"))
    created = (F.col("name") == "Write") & F.col("result").rlike("(?i)created successfully")
    status = F.when(created, "Created").when(F.col("name").isin(P.WRITE_TOOLS), "Modified").when(F.col("name").isin(P.READ_TOOLS), "Read")
    touch = lambda p, s: F.struct(p.alias("path"), s.alias("status"))
    written = F.transform("writes", lambda p: touch(p, F.lit("Modified")))
    touched = F.when((F.col("name") == "Bash") & F.col("command").isNotNull(), written).when((path != "") & T.is_work_path(path), F.array(touch(path, status)))
    seen = good.select("session_id", F.struct(*ORDER, "pos").alias("at"), F.explode(touched).alias("t")).select("session_id", "at", "t.status", T.relativize(F.col("t.path"), cwd).alias("path")).where(F.col("status").isNotNull())
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("at")))
    found = seen.groupBy("session_id", "path").agg(first("Modified").alias("m"), first("Created").alias("c"), first("Read").alias("r"))
    return found.select("session_id", "path", F.when(F.col("m").isNotNull(), "Modified").when(F.col("c").isNotNull(), "Created").otherwise("Read").alias("status"), F.coalesce("m", "c", "r").alias("at"))


def files(status: DataFrame) -> DataFrame:
    """session_id, files: an array of (status, paths) in order of first touch."""
    by_kind = status.groupBy("session_id", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("paths"))
    return by_kind.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "paths"))).alias("files"))


def file_lines(files_: Column, last: bool = False) -> Column:
    """One line a status, with the first (or last) paths and how many more there are."""
    lines = []
    for status, most in P.FILES_MAX.items():
        paths = files_[status]
        shown = F.when(F.size(paths) > most, F.slice(paths, -most, most)).otherwise(paths) if last else F.slice(paths, 1, most)
        more = F.when(F.size(paths) > most, F.concat(F.lit(" (+"), (F.size(paths) - most).cast("string"), F.lit(" more)"))).otherwise("")
        lines.append(F.when(F.size(paths) > 0, F.concat(F.lit(f"{status}: "), F.array_join(shown, ", "), more)))
    return F.array_compact(F.array(*lines))


def commits(calls: DataFrame) -> DataFrame:
    """session_id, commits: the last commits by message, with the hash where it was printed."""
    good = calls.where((F.col("name") == "Bash") & ~F.col("is_error") & F.col("command").rlike(P.GIT_COMMIT))
    first = lambda p: F.nullif(T.trim_u(F.split(T.trim_u(F.regexp_extract("command", p, 1)), "\n")[0]), F.lit(""))
    message = F.coalesce(*map(first, P.COMMIT_MESSAGES))
    digest = F.nullif(F.regexp_extract("result", P.COMMIT_HASH, 1), F.lit(""))
    rows = good.withColumn("line", F.concat_ws(" ", digest, T.clip(message, 120))).where(message.isNotNull())
    return _last(rows.groupBy("session_id", "line").agg(F.min(F.struct(*ORDER, "pos")).alias("at")), P.COMMITS_MAX, "commits")


def open_errors(calls: DataFrame) -> DataFrame:
    """session_id, at, line: errors that no later call of the session has settled.

    A success settles an earlier error of the same tool: of a command if it is the same or has the same program and
    subcommand, of another tool if both name a path in common or neither names any. A command that only reads is
    settled by any later command. Calls are read once, to narrow rows; successes are reduced to the last one of each kind, so this is a
    handful of equi-joins of those.
    """
    line = F.when(F.col("is_error") & ~F.col("result").rlike(P.DECLINED), T.error_line_of(F.col("result")))
    calls = with_shell_features(calls).select("session_id", F.struct(*ORDER, "pos").alias("at"), "name", "command", "command_key", "read_only", "is_error", T.path_tokens(F.col("result")).alias("paths"), line.alias("line"))
    calls = cut(calls.where(~F.col("is_error") | F.col("line").isNotNull()))
    good, bad = calls.where(~F.col("is_error")), calls.where("is_error").drop("is_error")
    shell, others = good.where((F.col("name") == "Bash") & F.col("command").isNotNull()), good.where(F.col("name") != "Bash")
    last = lambda df, keys, name: df.groupBy("session_id", *keys).agg(F.max("at").alias(name))
    bad = bad.join(last(good.where(F.col("name") == "Bash"), [], "any_shell"), "session_id", "left")
    bad = bad.join(last(shell, ["command"], "same"), ["session_id", "command"], "left")
    bad = bad.join(last(shell.where("command_key != ''"), ["command_key"], "like"), ["session_id", "command_key"], "left")
    bad = bad.join(last(others.where(F.size("paths") == 0), ["name"], "plain"), ["session_id", "name"], "left")
    touched = last(others.select("session_id", "at", "name", F.explode("paths").alias("path")), ["name", "path"], "touched")
    by_path = bad.where(F.size("paths") > 0).select("session_id", "name", F.col("at").alias("error_at"), F.explode("paths").alias("path")).join(touched, ["session_id", "name", "path"])
    bad = bad.join(by_path.groupBy("session_id", F.col("error_at").alias("at")).agg(F.max("touched").alias("touched")), ["session_id", "at"], "left")
    later = lambda c: F.coalesce(F.col(c) > F.col("at"), F.lit(False))
    is_shell = F.col("name") == "Bash"
    settled = (
        (is_shell & F.coalesce("read_only", F.lit(False)) & later("any_shell"))
        | (is_shell & (later("same") | later("like")))
        | (~is_shell & (F.size("paths") > 0) & later("touched"))
        | (~is_shell & (F.size("paths") == 0) & later("plain"))
    )
    return bad.where(~settled).select("session_id", "at", F.concat(F.lit("["), "name", F.lit("] "), "line").alias("line"))


def user_reports(entries: DataFrame) -> DataFrame:
    """session_id, at, line: trouble that the user reported."""
    line = F.col("line")
    scanned = F.regexp_replace(line, P.BENIGN_CJK, "")
    rows = _lines(entries).where((scanned.rlike(P.BLOCKER) | scanned.rlike(P.BLOCKER_CJK)) & (F.length(line) >= F.when(T.has_cjk(line), 3).otherwise(15)) & ~line.rlike(P.LIST_START) & line.rlike(P.SENTENCE_START))
    told = rows.withColumn("line", F.concat(F.lit("[user] "), T.clip_sentence(line, 200)))
    # an entry's own place is after its calls
    return first_unseen(told).select("session_id", F.struct(*ORDER, F.lit(1 << 30).alias("pos")).alias("at"), "line")


def outstanding(entries: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """session_id, outstanding: open errors and reports of the last entries, at most five, in order. ``calls`` are those of
    all entries, where they are at hand."""
    recent = F.row_number().over(Window.partitionBy("session_id").orderBy(*(F.desc(c) for c in ORDER)))
    tail = entries.withColumn("_back", recent).where(F.col("_back") <= P.OUTSTANDING_WINDOW).drop("_back")
    if calls is None:
        tail = cut(tail)
    recent_calls = tool_calls(tail) if calls is None else calls.join(tail.select("session_id", *ORDER), ["session_id", *ORDER], "left_semi")
    both = open_errors(recent_calls).unionByName(user_reports(tail))
    once = both.groupBy("session_id", F.lower("line").alias("_key")).agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at"))
    return _last(once, P.OUTSTANDING_MAX, "outstanding")
