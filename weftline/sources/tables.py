"""Reading tables of a data folder, and adapters that make session tables from them.

The adapters are SQL that other engines run as well, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session messages from conversations: text only.
MESSAGES_SQL = """
SELECT CAST(conv_id AS STRING) AS session_id, turn AS ord, role, text
FROM conversations WHERE role IN ('user','assistant')
"""

#: A tool log from events: one message an event, with one call in each assistant message.
TOOL_LOG_SQL = """
WITH e AS (
  SELECT CAST(user_id AS STRING) AS session_id, event_id, event_type, ts AS at_ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
         CAST(event_id % 7 AS STRING) AS n,
         '/work/app/src/m' || CAST(event_id % 37 AS STRING) || '.ts' AS path
  FROM events)
SELECT session_id, ord, at_ts,
  CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 3 = 1 THEN 'Working on module ' || n || '.' ELSE '' END
       WHEN event_id % 24 = 0  THEN 'Please add retry support to the loader of module ' || n
       WHEN event_id % 24 = 4  THEN 'always use the staging bucket for module ' || n
       WHEN event_id % 24 = 8  THEN 'The nightly build is still failing on module ' || n
       WHEN event_id % 24 = 12 THEN 'go'
       WHEN event_id % 24 = 16 THEN 'Instead switch to the batch loader for module ' || n
       ELSE '<task-notification><summary>job ' || n || ' finished</summary></task-notification>' END AS text,
  CASE WHEN event_id % 4 = 0 THEN NULL
       WHEN event_type = 'click' THEN 'Read' WHEN event_type = 'purchase' THEN 'Edit'
       WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN 'Write' ELSE 'Bash' END AS tool,
  CASE WHEN event_id % 4 <> 0 THEN 't' || CAST(event_id AS STRING) END AS tool_use_id,
  CASE WHEN event_id % 4 <> 0 AND (event_type IN ('click','purchase') OR (event_type = 'signup' AND event_id % 5 <> 0)) THEN path END AS file_path,
  CASE WHEN event_id % 4 = 0 THEN NULL
       WHEN event_type = 'view' THEN 'grep -n TODO src/m' || n || '.ts'
       WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'git commit -m "feat: step ' || n || '"'
       WHEN event_type = 'error' THEN 'pnpm test m' || n END AS command,
  CASE WHEN event_id % 4 = 0 THEN NULL
       WHEN event_type = 'view' AND event_id % 5 = 1 THEN 'Exit code 2' || chr(10) || 'error: regex parse error'
       WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'Exit code 1' || chr(10) || 'error: case ' || n || ' failed'
       WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'error: ' || path || ' not found'
       WHEN event_type = 'signup' AND event_id % 5 <> 0 AND event_id % 2 = 0 THEN 'File created successfully at ' || path
       WHEN event_type = 'signup' AND event_id % 5 = 0 AND event_id % 2 = 0 THEN '[main ' || substr(md5(CAST(event_id AS STRING)),1,7) || '] feat: step ' || n
       ELSE 'ok ' || path END AS result,
  CASE WHEN event_id % 4 = 0 THEN NULL
       ELSE (event_type = 'view' AND event_id % 5 = 1) OR (event_type = 'error' AND event_id % 3 <> 0)
         OR (event_type = 'purchase' AND event_id % 11 = 0) END AS is_error
FROM e
"""

#: Memory items from documents: whole texts, in sessions of at most 1,000.
ITEMS_SQL = """
SELECT source || '-' || CAST(CAST(floor(doc_id / 1000) AS INT) AS STRING) AS session_id, doc_id AS ord, substr(md5(CAST(doc_id AS STRING)),1,12) AS id,
  CASE CAST(floor(doc_id / 20) AS INT) % 5 WHEN 0 THEN 'constraint' WHEN 1 THEN 'lesson' WHEN 2 THEN 'decision' WHEN 3 THEN 'state' ELSE 'fact' END AS kind,
  CASE (doc_id % 7) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS relevance,
  replace(text, chr(10), ' ') AS content, doc_id * 1000 AS at_ms,
  doc_id % 13 = 0 AS dropped, doc_id % 17 = 0 AS unclassified,
  substr(md5('e' || CAST(doc_id % 50 AS STRING)),1,12) AS source_entry
FROM documents
"""

CALL = "struct<tool_use_id: string, tool: string, input: map<string,string>, text: string, is_error: boolean>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in no fewer partitions than there are cores: a small file has few row groups, and texts are dear to take apart. Large tables
    stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def adapted(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The result of ``sql`` over the named tables, which stay out of the catalog."""
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, window_id, ord, role, text, tool_uses, at from conversations."""
    rows = adapted(spark, sf_dir, MESSAGES_SQL, "conversations")
    return rows.select("session_id", F.lit(0).alias("window_id"), "ord", "role", "text", F.expr(f"cast(array() as array<{CALL}>)").alias("tool_uses"), F.lit(None).cast("timestamp").alias("at"))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, TOOL_LOG_SQL, "events")


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool log as messages with nested calls."""
    arguments = F.map_filter(F.create_map(F.lit("file_path"), F.col("file_path"), F.lit("command"), F.col("command")), lambda k, v: v.isNotNull())
    call = F.struct("tool_use_id", "tool", arguments.alias("input"), F.col("result").alias("text"), "is_error")
    nested = F.when(F.col("tool").isNotNull(), F.array(call)).otherwise(F.expr(f"cast(array() as array<{CALL}>)"))
    return tool_log(spark, sf_dir).select("session_id", F.lit(0).alias("window_id"), F.col("ord").cast("long"), "role", "text", nested.alias("tool_uses"), F.col("at_ts").cast("timestamp").alias("at"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory items: session_id, ord, id, kind, relevance, content, sources, at_ms, supersedes, dropped, superseded_by, unclassified."""
    rows = adapted(spark, sf_dir, ITEMS_SQL, "documents")
    return rows.select(
        "session_id", "ord", "id", "kind", "relevance", "content", F.array("source_entry").alias("sources"), "at_ms",
        F.expr("cast(array() as array<string>)").alias("supersedes"), "dropped", F.lit(None).cast("string").alias("superseded_by"), "unclassified",
    )
