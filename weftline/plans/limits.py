"""Queries on tables that reach the limits: long and empty sessions, long texts, host paths, prompts of all workers; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import brief as B
from ..operators import entries as E
from ..operators import memory as M
from ..operators import retention as C
from ..operators import search as R
from ..operators import sections as X
from ..operators import summary as Y
from ..sources import archive as A
from ..sources import tables as S
from ..sources.checkpoints import new_folder
from .history import A2, BRIEF_SQL, CWD, ENTRIES_SQL, talk, work
from .memory import _BUDGET, _TOK, A3, MARKDOWN_SQL

#: The tool log in five long sessions.
LONG_SQL = f"SELECT * REPLACE ('g' || CAST(CAST(session_id AS INT) % 5 AS STRING) AS session_id, row_number() OVER (PARTITION BY CAST(session_id AS INT) % 5 ORDER BY at_ts, session_id, ord) - 1 AS ord) FROM ({A2})"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.tool_messages(spark, sf_dir)
    group = F.col("session_id").cast("int") % 5
    number = F.row_number().over(Window.partitionBy(group).orderBy("at", "session_id", "ord")) - 1
    return rows.withColumns({"ord": number.cast("long"), "_group": group}).withColumn("session_id", F.concat(F.lit("g"), F.col("_group").cast("string"))).drop("_group")


def long_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of transcripts that are longer than the cap."""
    return B.brief_tail(E.indexed(E.cleaned(_long(spark, sf_dir)))).select("session_id", F.size("brief").alias("n_lines"), F.array_join("brief", "\n").alias("brief"))


_lines = BRIEF_SQL[: BRIEF_SQL.index("SELECT session_id, string_agg")].replace(A2, LONG_SQL)
LONG_TRANSCRIPT_SQL = f"""
{_lines}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY island DESC, part DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM l),
s AS (SELECT session_id, max(back) AS start FROM x WHERE back <= {P.BRIEF_LINES} AND part = 0 GROUP BY session_id),
k AS (SELECT x.* FROM x LEFT JOIN s USING (session_id) WHERE n <= {P.BRIEF_LINES} OR back <= coalesce(start, {P.BRIEF_LINES}))
SELECT session_id, CAST(count(*) + CASE WHEN max(n) > {P.BRIEF_LINES} THEN 1 ELSE 0 END AS INTEGER) AS n_lines,
  CASE WHEN max(n) > {P.BRIEF_LINES} THEN '...(' || (max(n) - count(*)) || ' earlier lines omitted)' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY island, part) AS brief FROM k GROUP BY session_id
"""


def _quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool log, of which every fourth session has nothing but bookkeeping."""
    name = F.when(F.col("session_id").cast("int") % 4 == 0, F.lit("TodoWrite"))
    rows = S.tool_messages(spark, sf_dir)
    quiet = rows.withColumn("tool_uses", F.transform("tool_uses", lambda u: u.withField("tool", F.coalesce(name, u["tool"])))).withColumn("text", F.when(name.isNotNull(), "").otherwise(F.col("text")))
    return quiet


def empty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that get no summary."""
    rows = _quiet(spark, sf_dir)
    return Y.handed_back(rows, Y.format_summary(Y.build_sections(E.indexed(E.cleaned(rows)), CWD)))


EMPTY_SQL = f"SELECT session_id FROM ({A2}) GROUP BY session_id HAVING CAST(session_id AS INT) % 4 = 0 OR count(*) FILTER (text <> '' OR tool IS NOT NULL) = 0"


def _elsewhere(path: Column, n: Column) -> Column:
    """Every third path is the host's own, every fifth a background task's output."""
    return F.when(n % 3 == 0, F.concat(F.lit("/home/dev/.claude/"), path)).when(n % 5 == 0, F.concat(F.lit("/tmp/x/tasks/"), n.cast("string"), F.lit(".output"))).otherwise(path)


def host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that calls touched, where many paths are not of the work."""
    moved = lambda u: F.transform_values(u["input"], lambda k, v: F.when(k == "file_path", _elsewhere(v, F.col("ord"))).otherwise(v))
    rows = S.tool_messages(spark, sf_dir).withColumn("tool_uses", F.transform("tool_uses", lambda u: u.withField("input", moved(u))))
    status = X.file_status(E.tool_calls(E.indexed(E.cleaned(rows))), CWD)
    return status.select("session_id", "path", "status", F.col("at.ord").alias("first_ord"))


HOST_SQL = f"""
WITH c AS (SELECT session_id, replace(file_path, '/work/app/', '') AS path, ord, CASE WHEN tool = 'Read' THEN 'Read' WHEN tool = 'Write' AND result LIKE '%created successfully%' THEN 'Created' ELSE 'Modified' END AS s
  FROM ({A2}) WHERE file_path IS NOT NULL AND NOT is_error AND ord % 3 <> 0 AND ord % 5 <> 0),
g AS (SELECT session_id, path, min(ord) FILTER (s = 'Modified') AS m, min(ord) FILTER (s = 'Created') AS c, min(ord) FILTER (s = 'Read') AS r FROM c GROUP BY ALL)
SELECT session_id, path, CASE WHEN m IS NOT NULL THEN 'Modified' WHEN c IS NOT NULL THEN 'Created' ELSE 'Read' END AS status, coalesce(m, c, r) AS first_ord FROM g
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of their sources."""
    return S.table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("session_id"), F.col("doc_id").alias("index"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12).alias("entry_id"), F.lit("k").alias("key"), F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.expr("cast(array() as array<struct<name: string, input: map<string,string>, text: string, is_error: boolean>>)").alias("tools"), F.lit(None).cast("timestamp").alias("at"),
    )


def capped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by number, many of them longer than what an answer may have."""
    rows = _texts(spark, sf_dir)
    queries = R.routed(rows.select(F.col("index").alias("query_id"), "session_id", F.concat(F.lit("#"), F.col("index").cast("string")).alias("raw")))
    items = S.items(spark, sf_dir).limit(0)
    found = R.expanded(rows, items, queries)
    return found.select("query_id", "entry_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


CAPPED_SQL = f"""
WITH d AS (SELECT doc_id, substr(md5(CAST(doc_id AS STRING)), 1, 12) AS entry_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, entry_id, '#' || doc_id || ' [' || entry_id || '] user' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END AS whole FROM d),
c AS (SELECT doc_id, entry_id, CASE WHEN length(whole) > {P.OUTPUT_MAX} THEN substr(whole, 1, {P.OUTPUT_MAX}) || chr(10) || '…(cut at {P.OUTPUT_MAX} characters; narrow the query)' ELSE whole END AS text FROM t)
SELECT doc_id AS query_id, entry_id, length(text) AS n_chars, md5(text) AS digest FROM c
"""


def cut_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first letter e after the thousandth character of each document, or around its beginning."""
    text = F.col("text")
    at = F.greatest(F.lit(0), F.locate("e", text, 1000) - 1)
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.snippet(text, at).alias("snippet"))


CUT_SQL = rf"""
WITH d AS (SELECT doc_id, text, strpos(substr(text, 1000), 'e') AS e FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, text, greatest(0, CASE WHEN e > 0 THEN 998 + e ELSE 0 END - {P.SNIPPET // 2}) AS start FROM d)
SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, CAST(start + 1 AS BIGINT), {P.SNIPPET}), '\s+', ' ', 'g')) || CASE WHEN start + {P.SNIPPET} < length(text) THEN '…' ELSE '' END AS snippet FROM a
"""


def large_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of more than 20,000 bytes have their texts cut."""
    return E.bounded(_texts(spark, sf_dir), 20_000, 300).select(F.col("index").alias("doc_id"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


LARGE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(CAST(to_json({'session_id': coalesce(source, ''), 'entry_id': '0123456789ab', 'key': 'k', 'role': 'user', 'text': coalesce(text, ''), 'tools': []}) AS VARCHAR))) AS size FROM documents),
c AS (SELECT doc_id, CASE WHEN size > 20000 AND length(text) > 300 THEN substr(text, 1, 299) || '…' ELSE text END AS text FROM d)
SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM c
"""


def consolidator_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consolidator_prompts(S.items(spark, sf_dir), 1500).select("session_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


_title = "CASE kind WHEN 'constraint' THEN 'Constraints' WHEN 'lesson' THEN 'Lessons' WHEN 'decision' THEN 'Decisions' WHEN 'state' THEN 'State' ELSE 'Facts' END"
_line = "'- [' || id || '] ' || strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M') || ' [' || relevance || '] ' || content"
CONSOLIDATOR_SQL = f"""
WITH k AS (SELECT session_id, kind, CAST(sum({_TOK}) AS BIGINT) AS tokens, CAST({_BUDGET} AS BIGINT) AS budget, string_agg({_line}, chr(10) ORDER BY ord) AS lines FROM ({A3}) WHERE NOT dropped AND kind IN ('constraint', 'lesson', 'decision') GROUP BY session_id, kind),
b AS (SELECT session_id, kind, '## ' || {_title} || ' (about ' || (tokens - budget) || ' tokens over its ' || budget || '-token budget)' || chr(10) || lines AS block FROM k WHERE tokens > budget),
p AS (SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY CASE kind WHEN 'constraint' THEN 0 WHEN 'lesson' THEN 1 ELSE 2 END) AS prompt FROM b GROUP BY session_id)
SELECT session_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p
"""


def classifier_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classifier_prompts(S.items(spark, sf_dir)).select("session_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


CLASSIFIER_SQL = f"""
WITH p AS (SELECT session_id, string_agg({_line}, chr(10) ORDER BY ord) AS prompt FROM ({A3}) WHERE NOT dropped AND unclassified GROUP BY session_id)
SELECT session_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p
"""


def observed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns are on the list, the others come as a chunk."""
    rows = talk(spark, sf_dir)
    seen = rows.where("ord <= 1").select("session_id", F.col("index").alias("ord"), "entry_id")
    return M.add_observed(seen, rows.where("ord > 1")).select("session_id", F.col("ord").cast("long").alias("ord"), "entry_id")


OBSERVED_SQL = f"""
WITH e AS ({ENTRIES_SQL}), o AS (SELECT *, max(CASE WHEN ord <= 1 THEN index END) OVER (PARTITION BY session_id) AS last FROM e)
SELECT session_id, CASE WHEN ord <= 1 THEN index ELSE coalesce(last, -1) + row_number() OVER (PARTITION BY session_id, ord <= 1 ORDER BY ord) END AS ord, entry_id FROM o
"""


def memory_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported memory, read again: active items only."""
    path = new_folder(spark, "export")
    A.export_memory(S.items(spark, sf_dir), path)
    return spark.read.parquet(path).select("session_id", F.length("memory").alias("n_chars"), F.md5("memory").alias("digest"))


EXPORTED_SQL = f"SELECT session_id, length(memory) AS n_chars, md5(memory) AS digest FROM ({MARKDOWN_SQL.replace('FROM (' + A3 + ')', 'FROM (' + A3 + ') WHERE NOT dropped')})"


def sections_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that are stored under their summaries' hashes; the summaries of odd sessions are others by now."""
    sections = Y.build_sections(work(spark, sf_dir), CWD)
    summaries = Y.format_summary(sections)
    path = new_folder(spark, "sections")
    A.save_sections(sections, summaries, None).write.parquet(path)
    asked = summaries.withColumn("summary", F.when(F.col("session_id").cast("int") % 2 == 1, F.concat("summary", F.lit("!"))).otherwise(F.col("summary")))
    return A.load_sections(spark, path, asked).select("session_id", F.size("brief").alias("n_brief"))


STORED_SQL = f"SELECT session_id, CAST(len(string_split(brief, chr(10))) AS INTEGER) AS n_brief FROM ({BRIEF_SQL}) WHERE CAST(session_id AS INT) % 2 = 0"


def retention_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of retention from settings that are numbers or not."""
    n = F.col("event_id")
    setting = F.when(n % 5 == 0, "soon").when(n % 5 == 1, F.concat(F.lit("-"), n.cast("string"))).when(n % 5 == 2, "Infinity").when(n % 5 == 3, F.concat((n % 90).cast("string"), F.lit(".5")))
    return S.table(spark, sf_dir, "events").select("event_id", C.retention_days(setting.try_cast("double")).alias("days"))


RETENTION_SQL = f"SELECT event_id, CASE WHEN event_id % 5 = 3 THEN CAST(event_id % 90 AS DOUBLE) + 0.5 ELSE CAST({C.DEFAULT_DAYS} AS DOUBLE) END AS days FROM events"

QUERIES = {f.__name__: f for f in (
    long_transcript, empty_sessions, host_paths, capped_entries, cut_snippets, large_entries, consolidator_prompts, classifier_prompts, observed_list, memory_exported, sections_stored, retention_settings,
)}
ORACLE_SQL = {
    "long_transcript": LONG_TRANSCRIPT_SQL, "empty_sessions": EMPTY_SQL, "host_paths": HOST_SQL, "capped_entries": CAPPED_SQL, "cut_snippets": CUT_SQL, "large_entries": LARGE_SQL, "consolidator_prompts": CONSOLIDATOR_SQL,
    "classifier_prompts": CLASSIFIER_SQL, "observed_list": OBSERVED_SQL, "memory_exported": EXPORTED_SQL, "sections_stored": STORED_SQL, "retention_settings": RETENTION_SQL,
}
