"""Queries over the memory ledger and retention, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..operators import retention as C
from ..operators import search as R
from ..sources import archive as A
from ..sources import tables as S
from ..sources.checkpoints import shared_dir
from .history import A1, ENTRIES_SQL, talk

POOL = 1500
A3 = S.ITEMS_SQL.strip()
_TOK = "CAST(ceil(length(content) / 4.0) AS BIGINT) + 8"
_BUDGET = "CASE kind WHEN 'constraint' THEN 300 WHEN 'lesson' THEN 450 WHEN 'decision' THEN 375 WHEN 'state' THEN 150 WHEN 'fact' THEN 225 ELSE 1500 END"
_RANK = "CASE relevance WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.budget_status(S.items(spark, sf_dir), POOL)


STATUS_SQL = f"""
WITH t AS (SELECT session_id, kind, count(*) AS n_items, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM ({A3}) WHERE NOT dropped GROUP BY ROLLUP (session_id, kind))
SELECT session_id, kind, n_items, tokens, {_BUDGET} AS budget, coalesce(kind IN ('constraint', 'lesson', 'decision'), false) AND tokens > {_BUDGET} AS over FROM t WHERE session_id IS NOT NULL
"""


def budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fit_budgets(S.items(spark, sf_dir), POOL).select("session_id", "id", "ord", "dropped")


TRIM_SQL = f"""
WITH i AS (SELECT *, {_TOK} AS tok, {_RANK} AS r, sum(CASE WHEN dropped THEN 0 ELSE {_TOK} END) OVER (PARTITION BY session_id, kind) - {_BUDGET} AS excess FROM ({A3})),
b AS (SELECT *, coalesce(sum(CASE WHEN dropped OR unclassified THEN 0 ELSE tok END) OVER (PARTITION BY session_id, kind ORDER BY r, at_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)
SELECT session_id, id, ord, dropped OR (NOT unclassified AND before < excess) AS dropped FROM b
"""


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with fifty items each as their memory; their second turns are observed."""
    rows = talk(spark, sf_dir)
    items = S.items(spark, sf_dir).withColumn("session_id", F.floor(F.col("ord") / 50).cast("string"))
    return M.status_report(items, rows, rows.where("ord = 1"))


REPORT_SQL = f"""
WITH e AS (SELECT session_id, count(*) AS n_entries, count(*) FILTER (ord <> 1) AS n_pending, CAST(coalesce(sum(ceil(length(t) / 4.0)) FILTER (ord <> 1), 0) AS BIGINT) AS pending_tokens
  FROM (SELECT session_id, ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM ({A1})) WHERE t <> '' GROUP BY session_id),
m AS (SELECT CAST(CAST(floor(ord / 50) AS BIGINT) AS STRING) AS session_id, count(*) FILTER (NOT dropped) AS n_active, count(*) AS n_items, CAST(coalesce(sum({_TOK}) FILTER (NOT dropped), 0) AS BIGINT) AS pool_tokens FROM ({A3}) GROUP BY ALL)
SELECT session_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_active", "n_items", "pool_tokens", "n_entries", "n_pending", "pending_tokens"))} FROM e FULL JOIN m USING (session_id)
"""


def ledger_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers trimmed to their budgets, stored and read again."""
    path = f"{shared_dir(spark)}/ledgers-{uuid.uuid4().hex}"
    stored = A.save_items(M.fit_budgets(S.items(spark, sf_dir), POOL), path)
    return stored.select("session_id", "ord", "id", "kind", "relevance", F.md5("content").alias("digest"), F.array_join("sources", ",").alias("sources"), "dropped", "unclassified")


SAVED_SQL = f"""
SELECT session_id, ord, id, kind, relevance, md5(content) AS digest, source_entry AS sources, t.dropped, unclassified FROM ({A3}) i JOIN ({TRIM_SQL}) t USING (session_id, ord, id)
"""


def memory_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.memory_text(S.items(spark, sf_dir), marks=True)


MARKDOWN_SQL = f"""
WITH l AS (SELECT session_id, ord, kind, '- [' || id || '] ' || strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M') || ' [' || relevance || '] ' || content || CASE WHEN dropped THEN ' (dropped)' ELSE '' END AS line FROM ({A3})),
k AS (SELECT session_id, kind, string_agg(line, chr(10) ORDER BY ord) AS lines FROM l GROUP BY ALL),
b AS (SELECT session_id, CASE kind WHEN 'constraint' THEN 0 WHEN 'lesson' THEN 1 WHEN 'decision' THEN 2 WHEN 'state' THEN 3 ELSE 4 END AS at_,
  '## ' || CASE kind WHEN 'constraint' THEN 'Constraints' WHEN 'lesson' THEN 'Lessons' WHEN 'decision' THEN 'Decisions' WHEN 'state' THEN 'State' ELSE 'Facts' END || chr(10) || lines AS block FROM k)
SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY at_) AS memory FROM b GROUP BY session_id
"""


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of which each replaces the one before it, and a query for each item's id."""
    items = S.items(spark, sf_dir).withColumn("supersedes", F.when(F.col("ord") >= 20, F.array(F.substring(F.md5((F.col("ord") - 20).cast("string")), 1, 12))).otherwise(F.expr(T.EMPTY)))
    queries = items.select(F.col("ord").alias("query_id"), "session_id", F.col("id").alias("raw"))
    return items, R.routed(queries)


def item_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, queries = _lookups(spark, sf_dir)
    entries = items.select("session_id", F.explode("sources").alias("entry_id")).where("substring(entry_id, 1, 1) < '8'")
    found = R.by_id(entries, items, queries)
    return found.select("query_id", "found", "status", F.array_join("replaces", ",").alias("replaces"), F.array_join("source_entries", ",").alias("source_entries"))


LINEAGE_SQL = f"""
WITH i AS (SELECT * FROM ({A3}))
SELECT a.ord AS query_id, 'memory' AS found, CASE WHEN a.dropped THEN 'dropped' ELSE 'active' END AS status, coalesce(b.id, '') AS replaces, CASE WHEN substr(a.source_entry, 1, 1) < '8' THEN a.source_entry ELSE '' END AS source_entries
FROM i a LEFT JOIN i b ON a.ord >= 20 AND b.session_id = a.session_id AND b.id = substr(md5(CAST(a.ord - 20 AS STRING)), 1, 12)
"""


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of even hundreds as the ledger; the others as new ones that supersede the item 100 before."""
    whole = S.items(spark, sf_dir)
    odd = F.floor(F.col("ord") / 100) % 2 == 1
    new = whole.where(odd).select("session_id", F.lit(0).alias("chunk_no"), F.col("ord").alias("place"), "id", "kind", "relevance", "content", "sources", "at_ms", F.array(F.substring(F.md5((F.col("ord") - 100).cast("string")), 1, 12), F.lit("unknown")).alias("supersedes"))
    return whole.where(~odd), new


def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.add_observations(*_old_and_new(spark, sf_dir)).select("session_id", "id", "dropped", "superseded_by", F.array_join("supersedes", ",").alias("supersedes"))


UPSERT_SQL = f"""
WITH i AS (SELECT * FROM ({A3})), o AS (SELECT * FROM i WHERE CAST(floor(ord / 100) AS INT) % 2 = 0),
n AS (SELECT * FROM i x WHERE CAST(floor(ord / 100) AS INT) % 2 = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = x.session_id AND ((NOT o.dropped AND lower(o.content) = lower(x.content)) OR o.id = x.id))),
l AS (SELECT n.session_id, n.id AS new_id, o.id AS id FROM n JOIN o ON o.session_id = n.session_id AND o.id = substr(md5(CAST(n.ord - 100 AS STRING)), 1, 12) WHERE NOT o.dropped)
SELECT o.session_id, o.id, o.dropped OR l.id IS NOT NULL AS dropped, l.new_id AS superseded_by, '' AS supersedes FROM o LEFT JOIN l ON l.session_id = o.session_id AND l.id = o.id
UNION ALL SELECT n.session_id, n.id, false, NULL, coalesce(l.id, '') FROM n LEFT JOIN l ON l.session_id = n.session_id AND l.new_id = n.id
"""


def ledger_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of even hundreds as observations without kinds, the others as reflections on the item 100 before."""
    whole = S.items(spark, sf_dir)
    odd = F.floor(F.col("ord") / 100) % 2 == 1
    old = whole.where(~odd).withColumn("kind", F.lit(None).cast("string"))
    reflections = whole.where(odd).select("session_id", "ord", F.concat(F.lit("r"), "id").alias("id"), "content", F.array(F.substring(F.md5((F.col("ord") - 100).cast("string")), 1, 12)).alias("sources"), "at_ms", "dropped")
    return M.migrate(old, reflections).select("session_id", "id", "kind", "relevance", F.array_join("sources", ",").alias("sources"), "dropped", "superseded_by", "unclassified")


MIGRATE_SQL = f"""
WITH i AS (SELECT * FROM ({A3})), o AS (SELECT * FROM i WHERE CAST(floor(ord / 100) AS INT) % 2 = 0), r AS (SELECT *, substr(md5(CAST(ord - 100 AS STRING)), 1, 12) AS cites FROM i WHERE CAST(floor(ord / 100) AS INT) % 2 = 1)
SELECT o.session_id, o.id, 'fact' AS kind, o.relevance, o.source_entry AS sources, o.dropped OR r.id IS NOT NULL AS dropped, CASE WHEN NOT o.dropped AND r.id IS NOT NULL THEN 'r' || r.id END AS superseded_by, true AS unclassified
  FROM o LEFT JOIN r ON r.session_id = o.session_id AND r.cites = o.id AND NOT r.dropped
UNION ALL SELECT r.session_id, 'r' || r.id, 'fact', CASE WHEN o.relevance = 'critical' THEN 'critical' ELSE 'high' END, coalesce(o.source_entry, ''), r.dropped, NULL, true FROM r LEFT JOIN o ON o.session_id = r.session_id AND o.id = r.cites
"""


def ledger_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's reply makes the first half of its open items lessons."""
    items = S.items(spark, sf_dir)
    named = items.where("unclassified and ord % 2 = 0").groupBy("session_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("id", F.lit("lesson")))).alias("kinds"))).alias("json"))
    replies = named.select("session_id", F.concat(F.lit("Here it is:\n```json\n"), "json", F.lit("\n```")).alias("reply"))
    return M.classify(items, replies).select("session_id", "id", "kind", "unclassified")


CLASSIFY_SQL = f"""
WITH i AS (SELECT * FROM ({A3})), s AS (SELECT DISTINCT session_id FROM i WHERE unclassified AND ord % 2 = 0)
SELECT session_id, id, CASE WHEN unclassified AND ord % 2 = 0 THEN 'lesson' ELSE kind END AS kind, unclassified AND session_id NOT IN (SELECT session_id FROM s) AS unclassified FROM i
"""


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir)
    return M.pending(rows, rows.where("ord = 1"))


def observe_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.backlog(_pending(spark, sf_dir), 100)


_RENDERED = "CAST(ceil((length(CASE WHEN role = 'user' THEN '[User]: ' ELSE '[Assistant]: ' END) + least(length(t), 3000) + 1 + length('[Source entry id: 0123456789ab]')) / 4.0) AS BIGINT)"
_PENDING = rf"(SELECT *, {_RENDERED} AS tok FROM (SELECT session_id, ord, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM ({A1})) WHERE ord <> 1)"
BACKLOG_SQL = f"SELECT session_id, count(*) AS n_entries, CAST(sum(tok) AS BIGINT) AS tokens FROM {_PENDING} GROUP BY session_id HAVING sum(tok) >= 100"


def observe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chunks(_pending(spark, sf_dir), 200).select("session_id", "ord", "tokens", "chunk_no")


CHUNKS_SQL = f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM {_PENDING}),
r AS (SELECT session_id, ord, tok, n, CAST(0 AS BIGINT) AS chunk_no, tok AS held FROM p WHERE n = 1
  UNION ALL SELECT p.session_id, p.ord, p.tok, p.n, CASE WHEN r.held + p.tok > 200 THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.held + p.tok > 200 THEN p.tok ELSE r.held + p.tok END
  FROM r JOIN p ON p.session_id = r.session_id AND p.n = r.n + 1)
SELECT session_id, ord, tok AS tokens, chunk_no FROM r
"""


def observer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with fifty items each as their memory."""
    items = S.items(spark, sf_dir).withColumn("session_id", F.floor(F.col("ord") / 50).cast("string"))
    prompts = M.observer_prompts(M.chunks(_pending(spark, sf_dir), 200), items)
    return prompts.select("session_id", "chunk_no", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


PROMPTS_SQL = rf"""
WITH e AS (SELECT session_id, ord, chunk_no, '[Source entry id: ' || entry_id || ']' || chr(10) || CASE WHEN role = 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || CASE WHEN length(text) <= 3000 THEN text ELSE substr(text, 1, 2999) || '…' END AS line
  FROM ({ENTRIES_SQL}) JOIN ({CHUNKS_SQL}) USING (session_id, ord)),
c AS (SELECT session_id, chunk_no, string_agg(line, chr(10) || chr(10) ORDER BY ord) AS chunk FROM e GROUP BY ALL),
m AS ({MARKDOWN_SQL.replace("FROM (" + A3 + ")", "FROM (SELECT * REPLACE (CAST(CAST(floor(ord / 50) AS BIGINT) AS STRING) AS session_id) FROM (" + A3 + ") WHERE NOT dropped)").replace("'## '", "'### '")}),
p AS (SELECT session_id, chunk_no, '## Current memory' || chr(10) || chr(10) || coalesce(memory, '(none)') || chr(10) || chr(10) || '## New conversation chunk' || chr(10) || chr(10) || chunk AS prompt FROM c LEFT JOIN m USING (session_id))
SELECT session_id, chunk_no, length(prompt) AS n_chars, md5(prompt) AS digest FROM p
"""


def observer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's reply cites its entries and one that is not in it."""
    chunks = M.chunks(_pending(spark, sf_dir), 200)
    cited = chunks.groupBy("session_id", "chunk_no").agg(F.sort_array(F.collect_list("entry_id")).alias("ids"))
    one = F.struct(F.lit("lesson").alias("kind"), F.concat(F.lit("what session "), "session_id", F.lit(" said")).alias("content"), F.lit("unheard of").alias("relevance"), F.concat("ids", F.array(F.lit("000000000000"))).alias("sourceEntryIds"))
    none = F.struct(F.lit("fact").alias("kind"), F.lit("uncited").alias("content"), F.lit("high").alias("relevance"), F.array(F.lit("000000000000")).alias("sourceEntryIds"))
    replies = cited.select("session_id", "chunk_no", F.to_json(F.struct(F.array(one, none).alias("observations"))).alias("reply"), F.lit(7).cast("long").alias("now_ms"))
    return M.observations(replies, chunks).select("session_id", "chunk_no", "kind", "relevance", "content", F.size("sources").alias("n_sources"), "at_ms")


REPLIES_SQL = f"SELECT session_id, chunk_no, 'lesson' AS kind, 'medium' AS relevance, 'what session ' || session_id || ' said' AS content, count(*) AS n_sources, CAST(7 AS BIGINT) AS at_ms FROM ({CHUNKS_SQL}) GROUP BY session_id, chunk_no"


def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's reply merges its first three constraints, named from the last to the first, and retires its first lesson."""
    items = S.items(spark, sf_dir)
    live = M.active(items).where("kind in ('constraint', 'lesson')").groupBy("session_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    both = live.groupBy("session_id").pivot("kind", ["constraint", "lesson"]).agg(F.first("ids"))
    merge = F.struct(F.lit("one rule for all").alias("content"), F.reverse(F.slice("constraint", 1, 3)).alias("replaces"))
    replies = both.select("session_id", F.to_json(F.struct(F.array(merge).alias("merged"), F.slice("lesson", 1, 1).alias("retire"))).alias("reply"))
    out = M.consolidate(items, replies, 300)
    return out.select("session_id", "id", "kind", "relevance", "dropped", "superseded_by", F.size("sources").alias("n_sources"))


CONSOLIDATE_SQL = f"""
WITH i AS (SELECT *, {_TOK} AS tok FROM ({A3})), t AS (SELECT session_id, kind, sum(tok) AS tokens FROM i WHERE NOT dropped GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY ord) AS n FROM i WHERE NOT dropped),
m AS (SELECT r.* FROM r JOIN t USING (session_id, kind) WHERE (kind = 'constraint' AND tokens > 60 AND n <= 3) OR (kind = 'lesson' AND tokens > 90 AND n = 1)),
a AS (SELECT session_id, list(source_entry ORDER BY ord DESC) AS s, max({_RANK}) AS top FROM m WHERE kind = 'constraint' GROUP BY session_id),
b AS (SELECT session_id, list_filter(s, lambda x, k: list_position(s, x) = k) AS sources, top FROM a),
c AS (SELECT *, substr(md5('o:one rule for all:' || array_to_string(sources, ',')), 1, 12) AS id FROM b)
SELECT i.session_id, i.id, i.kind, i.relevance, i.dropped OR m.id IS NOT NULL AS dropped, CASE WHEN m.kind = 'constraint' THEN c.id END AS superseded_by, 1 AS n_sources
  FROM i LEFT JOIN m ON m.session_id = i.session_id AND m.id = i.id LEFT JOIN c ON c.session_id = i.session_id
UNION ALL SELECT session_id, id, 'constraint', CASE top WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END, false, NULL, len(sources) FROM c
"""


def worker_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("cycle"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"), (F.col("event_id") % 50).alias("ms"))
    return M.worker_usage(log)


USAGE_SQL = """
SELECT CAST(user_id AS STRING) AS session_id, count(*) AS n_calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(event_id % 1000) AS BIGINT) AS tokens_in,
  CAST(sum(event_id % 100) AS BIGINT) AS tokens_out, CAST(sum(event_id % 50) AS BIGINT) AS ms, max(event_id) AS last_cycle, round(sum(event_id % 50) / greatest(1, count(*)), 6) AS ms_per_call FROM events GROUP BY user_id
"""
#: Retention is asked about at this time, in milliseconds.
NOW = 1_706_616_000_000


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (1000 * F.unix_seconds(F.col("ts").cast("timestamp"))).alias("mtime_ms"))
    return C.stale_sessions(files.select("session_id"), files, NOW, days=0.5, name=None)


def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir)


STALE_SQL = f"SELECT CAST(user_id AS STRING) AS session_id, 1000 * CAST(floor(epoch(max(ts))) AS BIGINT) AS newest_ms FROM events GROUP BY user_id HAVING 1000 * CAST(floor(epoch(max(ts))) AS BIGINT) < {NOW} - 43200000"


def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"))
    return C.retained(rows, _stale(spark, sf_dir))


RETAINED_SQL = f"SELECT event_id, CAST(user_id AS STRING) AS session_id FROM events WHERE CAST(user_id AS STRING) NOT IN (SELECT session_id FROM ({STALE_SQL}))"

QUERIES = {f.__name__: f for f in (
    budget_status, budget_trim, status_report, ledger_saved, memory_markdown, item_lineage, ledger_upsert, ledger_migrate, ledger_classify, observe_backlog, observe_chunks, observer_prompts, observer_replies, consolidate, worker_usage, stale_sessions, retained_rows,
)}
ORACLE_SQL = {
    "budget_status": STATUS_SQL, "budget_trim": TRIM_SQL, "status_report": REPORT_SQL, "ledger_saved": SAVED_SQL, "memory_markdown": MARKDOWN_SQL, "item_lineage": LINEAGE_SQL, "ledger_upsert": UPSERT_SQL, "ledger_migrate": MIGRATE_SQL, "ledger_classify": CLASSIFY_SQL, "observe_backlog": BACKLOG_SQL,
    "observe_chunks": CHUNKS_SQL, "observer_prompts": PROMPTS_SQL, "observer_replies": REPLIES_SQL, "consolidate": CONSOLIDATE_SQL, "worker_usage": USAGE_SQL, "stale_sessions": STALE_SQL, "retained_rows": RETAINED_SQL,
}
