"""Sections of sessions, their merging from step to step, and the summary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.shell import with_shell_features
from ..sources.checkpoints import cut
from . import brief as B
from . import sections as S
from .entries import tool_calls, without_noise

LISTS = ["goals", "commits", "outstanding", "preferences", "current_state", "brief"]
FILES = "cast(map() as map<string,array<string>>)"
RECALL_NOTE = "What came before has been condensed into the summary above. Exact code, messages and paths can be looked up in the session history by text, pattern, entry number or id. Work that is done need not be done again."


def build_sections(entries: DataFrame, cwd: str | None = None) -> DataFrame:
    """One row a session: goals, files, commits, outstanding, preferences, current_state, brief."""
    # read by every section
    clean = cut(without_noise(entries))
    calls = cut(with_shell_features(tool_calls(clean)))
    goals = cut(S.goals(clean))
    parts = [goals, S.files(S.file_status(calls, cwd)), S.commits(calls), S.outstanding(clean, calls), S.without_goals(S.preferences(clean), goals), B.current_state(clean, cwd, calls), B.brief(clean)]
    out = clean.select("session_id").distinct()
    for part in parts:
        out = out.join(part, "session_id", "left")
    return cut(out).select("session_id", F.coalesce("files", F.expr(FILES)).alias("files"), *(F.coalesce(c, F.expr(T.EMPTY)).alias(c) for c in LISTS))


def merge_list(before: Column, after: Column, most: int) -> Column:
    """The last ``most`` of both, each once without regard to case, in its first spelling and place."""
    both = F.concat(before, after)
    lower = F.transform(both, F.lower)
    kept = F.transform(F.filter(F.transform(both, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.array_position(lower, F.lower(s["x"])) == s["i"] + 1), lambda s: s["x"])
    return F.when(F.size(kept) > most, F.slice(kept, -most, most)).otherwise(kept)


def merge_files(before: Column, after: Column) -> Column:
    """Paths by status; modified comes before created, created before read. The last of each are kept."""
    none = F.expr(T.EMPTY)
    both = {s: F.array_union(F.coalesce(before[s], none), F.coalesce(after[s], none)) for s in P.FILES_MAX}
    both["Created"] = F.array_except(both["Created"], both["Modified"])
    both["Read"] = F.array_except(F.array_except(both["Read"], both["Modified"]), both["Created"])
    cut = {s: F.when(F.size(x) > P.FILES_MAX[s], F.slice(x, -P.FILES_MAX[s], P.FILES_MAX[s])).otherwise(x) for s, x in both.items()}
    return F.map_filter(F.create_map(*(y for s, x in cut.items() for y in (F.lit(s), x))), lambda _, v: F.size(v) > 0)


def merge_sections(before: DataFrame, after: DataFrame) -> DataFrame:
    """The sections of a session's previous steps with those of the next one."""
    a = before.select("session_id", F.struct("files", *LISTS).alias("a"))
    b = after.select("session_id", F.struct("files", *LISTS).alias("b"))
    none = F.expr(T.EMPTY)
    old, new = (lambda c: F.coalesce(F.col(f"a.{c}"), none)), (lambda c: F.coalesce(F.col(f"b.{c}"), none))
    is_scope = lambda g: g.startswith("[Scope change]")
    original = F.when(F.exists(old("goals"), lambda g: ~is_scope(g)), old("goals")).otherwise(new("goals"))
    goals = F.when(F.exists(new("goals"), is_scope), merge_list(F.slice(F.filter(original, lambda g: ~is_scope(g)), 1, 6), F.filter(new("goals"), is_scope), 10)).otherwise(original)
    latest = lambda c: F.when(F.size(new(c)) > 0, new(c)).otherwise(old(c))
    merged = {
        "goals": goals,
        "files": merge_files(F.col("a.files"), F.col("b.files")),
        "commits": merge_list(old("commits"), new("commits"), P.COMMITS_MAX),
        "outstanding": latest("outstanding"),
        "preferences": merge_list(old("preferences"), new("preferences"), P.PREFS_MERGED_MAX),
        "current_state": latest("current_state"),
        "brief": B.capped(F.concat(old("brief"), new("brief")), P.BRIEF_MERGED_LINES),
    }
    only_new = F.col("a").isNull()
    return a.join(b, "session_id", "full").select("session_id", *(F.when(only_new, F.col(f"b.{c}")).otherwise(x).alias(c) for c, x in merged.items()))


def is_empty() -> Column:
    """No section says anything; the current state alone does not count."""
    told = [F.size(c) > 0 for c in ("goals", "commits", "outstanding", "preferences")]
    some = (F.size(F.map_keys("files")) > 0) | F.exists("brief", lambda x: T.trim_u(x) != "")
    for x in told:
        some = some | x
    return ~some


def _block(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")))


def format_summary(sections: DataFrame, memory: DataFrame | None = None, instructions: str = "") -> DataFrame:
    """session_id, summary: the text that takes the place of what came before."""
    rows = sections if memory is None else sections.join(memory.select("session_id", "memory"), "session_id", "left")
    kept = F.col("memory") if memory is not None else F.lit(None).cast("string")
    blocks = [_block("Session Goal", F.col("goals")), _block("Files And Changes", S.file_lines(F.col("files"))), _block("Commits", F.col("commits")), _block("Outstanding Context", F.col("outstanding")), _block("User Preferences", F.col("preferences"))]
    brief = F.when(F.exists("brief", lambda x: T.trim_u(x) != ""), F.concat(F.lit("[Brief Transcript]\n"), F.array_join(B.capped(F.col("brief")), "\n")))
    head = F.lit(P.SENTINEL + "\nThis session goes on from an earlier conversation, condensed below; entries are numbered #N.")
    parts = [head, F.lit(f"[Compaction Instructions]\n{instructions.strip()}" if instructions.strip() else None).cast("string"), F.nullif(F.concat_ws("\n\n", *blocks), F.lit("")), brief, _block("Current State", F.col("current_state")), F.nullif(T.trim_u(kept), F.lit("")), F.lit(RECALL_NOTE)]
    return rows.where(~is_empty() | F.coalesce(T.trim_u(kept) != "", F.lit(False))).select("session_id", F.concat_ws("\n\n---\n\n", *parts).alias("summary"))


def handed_back(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id of the sessions whose sections say nothing and that have no memory: they are left to the host."""
    return sessions.select("session_id").distinct().join(summaries.select("session_id"), "session_id", "left_anti")


def with_previous(sections: DataFrame, stored: DataFrame, summaries: DataFrame) -> DataFrame:
    """``sections`` merged under the stored ones whose hash is that of the session's last summary (session_id, summary).
    Where it isn't, the beginning of the last summary goes before the transcript."""
    hashed = summaries.select("session_id", F.md5("summary").alias("summary_hash"), F.substring("summary", 1, 3000).alias("gist"))
    known = stored.join(hashed.select("session_id", "summary_hash"), ["session_id", "summary_hash"], "left_semi").drop("summary_hash")
    merged = merge_sections(known, sections)
    lost = hashed.join(known.select("session_id"), "session_id", "left_anti").select("session_id", "gist")
    return merged.join(lost, "session_id", "left").withColumn("brief", F.when(F.col("gist").isNotNull(), F.concat(F.array("gist"), "brief")).otherwise(F.col("brief"))).drop("gist")


def compaction_report(tokens: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, tokens_before, tokens_after."""
    return tokens.join(summaries, "session_id").select("session_id", F.col("tokens").alias("tokens_before"), T.estimate_tokens(F.col("summary")).alias("tokens_after"))
