"""The folded transcript and the current state of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.shell import with_shell_features
from .entries import ORDER, tool_calls


def tool_folds(entries: DataFrame) -> DataFrame:
    """session_id, island, line: runs of calls between texts as one line of counts and entry numbers."""
    so_far = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    speaks = (F.col("role") == "user") | (F.col("text") != "")
    placed = entries.select("session_id", *ORDER, "index", "tools", F.sum(speaks.cast("int")).over(so_far).alias("island"))
    calls = placed.select("session_id", "island", *ORDER, "index", F.posexplode("tools").alias("pos", "t"))
    named = calls.groupBy("session_id", "island", T.short_tool_name(F.col("t.name")).alias("name")).agg(
        F.count("*").alias("n"), F.sum(F.col("t.is_error").cast("int")).alias("failed"), F.min(F.struct(*ORDER, "pos")).alias("at"), F.min("index").alias("low"), F.max("index").alias("high")
    )
    folded = named.groupBy("session_id", "island").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("at", "name", "n"))).alias("names")
    )
    names = F.array_join(F.transform("names", lambda x: F.when(x["n"] > 1, F.concat(x["name"], F.lit(" ×"), x["n"].cast("string"))).otherwise(x["name"])), ", ")
    text = lambda c: F.col(c).cast("string")
    range_ = F.when(F.col("low").isNull(), "").when(F.col("low") == F.col("high"), F.concat(F.lit(" #"), text("low"))).otherwise(F.concat(F.lit(" #"), text("low"), F.lit("–#"), text("high")))
    line = F.concat(F.lit("  ("), text("n"), F.when(F.col("n") > 1, " tool calls").otherwise(" tool call"), range_, F.lit(": "), names, F.when(F.col("failed") > 0, F.concat(F.lit("; "), text("failed"), F.lit(" failed"))).otherwise(""), F.lit(")"))
    return folded.select("session_id", "island", line.alias("line"), "n", "failed")


def brief_lines(entries: DataFrame) -> DataFrame:
    """session_id, island, part, line: what was said, a line a turn (part 0), with folded calls between (part 1)."""
    so_far = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    speaks = (F.col("role") == "user") | (F.col("text") != "")
    user = T.one_turn(F.regexp_replace("text", P.SKILL_BLOCK, "[skill: $1]"), P.BRIEF_USER_TOKENS)
    said = F.when(T.is_notification(F.col("role"), F.col("text")), T.notification_text(F.col("text"))).when(F.col("role") == "user", user).otherwise(T.one_turn(F.col("text"), P.BRIEF_ASSISTANT_TOKENS))
    mark = F.when(F.col("index").isNotNull(), F.concat(F.lit(" #"), F.col("index").cast("string"))).otherwise("")
    turns = entries.withColumn("island", F.sum(speaks.cast("int")).over(so_far)).where(speaks)
    turns = turns.select("session_id", "island", F.lit(0).alias("part"), F.concat(F.lit("["), "role", mark, F.lit("] "), said).alias("line"))
    return turns.union(tool_folds(entries).select("session_id", "island", F.lit(1), "line"))


def _in_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("island", "part", "line"))), lambda x: x["line"]).alias("brief"))


def brief(entries: DataFrame) -> DataFrame:
    """session_id, brief: the whole transcript."""
    return _in_order(brief_lines(entries))


def brief_tail(entries: DataFrame, most: int = P.BRIEF_LINES) -> DataFrame:
    """``capped`` transcripts of sessions of any length: lines are ranked from the end, and no task gathers more of a session than ``most``."""
    lines = brief_lines(entries)
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("island"), F.desc("part")))
    tails = _in_order(lines.withColumn("_back", back).where(F.col("_back") <= most))
    counts = lines.groupBy("session_id").agg(F.count("*").alias("_n"))
    return tails.join(counts, "session_id").select("session_id", capped(F.col("brief"), most, F.col("_n")).alias("brief"))


def capped(lines: Column, most: int = P.BRIEF_LINES, n: Column | None = None) -> Column:
    """The last lines, from the first turn among them on, after a note of how many are left out. With ``n``, the number of all
    lines, ``lines`` are only the last ``most``."""
    tail = F.slice(lines, -most, most) if n is None else lines
    n = F.size(lines) if n is None else n
    turn = F.array_position(F.transform(tail, lambda x: x.rlike(r"^\[(user|assistant)")), True).cast("int")
    kept = F.when(turn > 1, F.slice(tail, turn, F.lit(most))).otherwise(tail)
    note = F.concat(F.lit("...("), (n - F.size(kept)).cast("string"), F.lit(" earlier lines omitted)"))
    return F.when(n <= most, lines).otherwise(F.concat(F.array(note), kept))


def _thin(text: Column) -> Column:
    return F.length(T.trim_u(text)) <= F.when(T.has_cjk(text), 20).otherwise(40)


def last_state(entries: DataFrame) -> DataFrame:
    """session_id and what the next turn goes on from, each with its index: the last user entry, the message it answers and
    the last request with substance if it says little itself, the last reply after it, and where the calls begin."""
    rows = entries.select("session_id", F.struct(*ORDER).alias("at"), "role", "text", "index", (F.col("role") == "user").alias("user"))
    rows = rows.withColumn("notified", T.is_notification(F.col("role"), F.col("text"))).withColumn("last_user", F.max(F.when(F.col("user"), F.col("at"))).over(Window.partitionBy("session_id")))
    said = F.struct("at", "text", "index", "notified")
    before, after = F.col("at") < F.col("last_user"), F.col("last_user").isNull() | (F.col("at") > F.col("last_user"))
    speaks = ~F.col("user") & (T.trim_u(F.col("text")) != "")
    newest = lambda cond: F.max(F.when(cond, said))
    return rows.groupBy("session_id").agg(
        newest(F.col("user")).alias("user"),
        newest(speaks & before).alias("proposal"),
        newest(F.col("user") & before & ~F.col("notified") & ~_thin(F.col("text"))).alias("request"),
        newest(speaks & after).alias("reply"),
    )


def current_state(entries: DataFrame, cwd: str | None = None, calls: DataFrame | None = None) -> DataFrame:
    """session_id, current_state: the end of the session, line by line."""
    state = last_state(entries)
    weak = F.col("user.notified") | _thin(F.col("user.text"))
    head = lambda label, who: F.concat(F.lit(label), T.index_mark(F.col(f"{who}.index")), F.lit(": "))
    opening = F.array_compact(F.array(
        F.when(F.col("user.notified"), F.concat(head("Last event", "user"), T.notification_text(F.col("user.text")))).otherwise(F.concat(head("Last user request", "user"), T.one_turn(F.col("user.text"), P.STATE_USER_TOKENS))),
        F.when(weak, F.concat(head("It answers the assistant's message", "proposal"), T.one_turn(F.col("proposal.text"), P.STATE_PROPOSAL_TOKENS))),
        F.when(weak, F.concat(head("Last substantive request", "request"), T.one_turn(F.col("request.text"), P.STATE_USER_TOKENS))),
        F.concat(head("Last assistant reply", "reply"), T.one_turn(F.col("reply.text"), P.STATE_ASSISTANT_TOKENS)),
    ))
    bounds = state.select("session_id", F.col("reply.at").alias("reply_at"), F.col("user.at").alias("user_at"))
    calls = (tool_calls(entries) if calls is None else calls).withColumn("entry", F.struct(*ORDER)).join(bounds, "session_id")
    after = F.when(F.col("reply_at").isNotNull(), F.col("entry") >= F.col("reply_at")).otherwise(F.col("user_at").isNull() | (F.col("entry") > F.col("user_at")))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("entry"), F.desc("pos")))
    last = with_shell_features(calls.where(after).withColumn("back", back).where(F.col("back") <= P.STATE_TOOLS))
    tells = (F.col("name") == "Bash") & F.col("command").isNotNull() & ~F.coalesce("read_only", F.lit(False)) & (T.trim_u(F.col("result")) != "")
    outcome = F.when(F.col("is_error"), F.concat(F.lit(" → [tool_error] "), T.error_line(F.col("result")))).when((F.col("back") <= P.STATE_RESULTS) & tells, F.concat(F.lit(" → "), T.first_line(F.col("result"), 160))).otherwise("")
    line = F.concat(F.lit("Then: "), T.tool_line(F.col("name"), F.col("input"), cwd), outcome)
    then = last.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))), lambda x: x["line"]).alias("then"))
    return state.select("session_id", opening.alias("opening")).join(then, "session_id", "left").select("session_id", F.concat("opening", F.coalesce("then", F.expr(T.EMPTY))).alias("current_state"))
