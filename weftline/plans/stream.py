"""Streaming jobs run over the events table as micro-batches of files, against SQL over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import tables as S
from ..sources.checkpoints import new_folder
from ..streaming import jobs as J
from .history import A2, merged_sql, sections_sql


def _feed(rows: DataFrame, order: str, cuts: list, folder: str, begin: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Append ``rows`` to the stream's input in parts that end before each of ``cuts`` of a column; after each part the stream is begun anew on
    its old state and takes the part as one micro-batch."""
    spark = rows.sparkSession
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col(order) >= low)
        part = part if high is None else part.where(F.col(order) < high)
        part.write.mode("append").parquet(f"{folder}/in")
        begin(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).trigger(availableNow=True).start().awaitTermination()


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool log as message lists that begin anew at the fortieth message; the second one begins with the last calls of the first."""
    rows = S.tool_messages(spark, sf_dir)
    again = rows.where("ord between 36 and 39 and role = 'assistant'").withColumns({"window_id": F.lit(1), "ord": F.col("ord") - 36})
    return rows.withColumns({"window_id": (F.col("ord") >= 40).cast("int"), "ord": F.when(F.col("ord") >= 40, F.col("ord") - 36).otherwise(F.col("ord"))}).union(again.select(rows.columns)).withColumn("at_ord", F.col("window_id") * 36 + F.col("ord"))


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the stream has archived, in batches that begin and end within lists."""
    folder = new_folder(spark, "stream-archive")
    _feed(_lists(spark, sf_dir), "at_ord", [17, 50], folder, lambda stream: J.archive_stream(stream, f"{folder}/archive", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/archive").select("session_id", "window_id", "entry_id", "role", "index")


#: Over all of the input: keys by recursion, each entry in the first list that has it.
LISTS_SQL = f"""
WITH RECURSIVE l AS (SELECT * REPLACE (CASE WHEN ord >= 40 THEN ord - 36 ELSE ord END AS ord), CASE WHEN ord >= 40 THEN 1 ELSE 0 END AS window_id FROM ({A2})
  UNION ALL SELECT * REPLACE (ord - 36 AS ord), 1 AS window_id FROM ({A2}) WHERE ord BETWEEN 36 AND 39 AND role = 'assistant'),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id, window_id ORDER BY ord) - 1 AS n FROM l),
k AS (SELECT *, CASE WHEN role = 'assistant' THEN 'a:' || tool_use_id ELSE 'u:' || md5(chr(10) || md5(text)) END AS key FROM m WHERE n = 0
  UNION ALL SELECT m.*, CASE WHEN m.role = 'assistant' THEN 'a:' || m.tool_use_id ELSE 'u:' || md5(k.key || chr(10) || md5(m.text)) END FROM k JOIN m ON m.session_id = k.session_id AND m.window_id = k.window_id AND m.n = k.n + 1),
f AS (SELECT *, substr(md5(key), 1, 12) AS entry_id, min(window_id) OVER (PARTITION BY session_id, key) = window_id AS fresh FROM k),
i AS (SELECT *, row_number() OVER (PARTITION BY session_id, fresh ORDER BY window_id, ord) - 1 AS place FROM f)
SELECT * EXCLUDE (place), CASE WHEN fresh THEN place ELSE min(CASE WHEN fresh THEN place END) OVER (PARTITION BY session_id, key) END AS index FROM i
"""
ARCHIVE_SQL = f"SELECT session_id, CAST(window_id AS INTEGER) AS window_id, entry_id, role, index FROM ({LISTS_SQL}) WHERE fresh"


def _stored(stream: DataFrame, folder: str) -> DataStreamWriter:
    return stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")


def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 50 tokens or more of each session's entries, not within six hours of a failed command; state is kept from batch to batch."""
    folder = new_folder(spark, "stream-threshold")
    tokens = F.ceil((F.length("text") + F.length(F.coalesce("result", F.lit("")))) / 4)
    failed = F.coalesce(F.col("is_error") & (F.col("tool") == "Bash"), F.lit(False))
    rows = S.tool_log(spark, sf_dir).select("session_id", F.col("ord").cast("long").alias("ord"), tokens.alias("tokens"), F.unix_seconds(F.col("at_ts").cast("timestamp")).alias("at_s"), failed.alias("failed"))
    _feed(rows, "ord", [20, 40], folder, lambda stream: _stored(J.threshold_stream(stream, 50, 21600), folder))
    return spark.read.parquet(f"{folder}/out")


THRESHOLD_SQL = f"""
WITH RECURSIVE p AS (SELECT session_id, CAST(ord AS BIGINT) AS ord, CAST(ceil((length(text) + length(coalesce(result, ''))) / 4.0) AS BIGINT) AS tok, CAST(floor(epoch(at_ts)) AS BIGINT) AS at_s, coalesce(is_error AND tool = 'Bash', false) AS failed FROM ({A2})),
r AS (SELECT session_id, ord, ord AS from_ord, tok AS held, at_s, CASE WHEN failed THEN at_s ELSE -1000000 END AS failed_at FROM p WHERE ord = 0
  UNION ALL SELECT p.session_id, p.ord, CASE WHEN r.held >= 50 AND r.at_s - r.failed_at >= 21600 THEN p.ord ELSE r.from_ord END, CASE WHEN r.held >= 50 AND r.at_s - r.failed_at >= 21600 THEN p.tok ELSE r.held + p.tok END, p.at_s,
    CASE WHEN p.failed THEN p.at_s ELSE r.failed_at END FROM r JOIN p ON p.session_id = r.session_id AND p.ord = r.ord + 1)
SELECT session_id, from_ord, ord AS to_ord, held AS tokens FROM r WHERE held >= 50 AND at_s - failed_at >= 21600
"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that an idle gap of a day has closed by the end of the stream."""
    folder = new_folder(spark, "stream-sessions")
    rows = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("at"))
    closing = rows.agg(F.lit("end").alias("session_id"), (F.max("at") + F.expr("interval 40 days")).alias("at"))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)] if first else []
    _feed(rows.union(closing), "at", cuts, folder, lambda stream: _stored(J.idle_sessions(stream, days=1, lateness="1 hour"), folder))
    return spark.read.parquet(f"{folder}/out").where("session_id != 'end'").select("session_id", F.unix_seconds("last_at").alias("last_s"), "n_messages")


SESSIONS_SQL = """
WITH e AS (SELECT CAST(user_id AS STRING) AS session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT session_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, count(*) AS n_messages FROM s GROUP BY session_id, k
"""


def stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each session up to its last list, fed in batches that begin and end within lists."""
    folder = new_folder(spark, "stream-sections")
    _feed(_lists(spark, sf_dir), "at_ord", [45], folder, lambda stream: J.section_stream(stream, folder, f"{folder}/state"))
    rows = J.latest_sections(spark, folder)
    return rows.select("session_id", F.array_join("commits", "\n").alias("commits"), F.array_join("preferences", "\n").alias("preferences"), F.array_join("goals", "\n").alias("goals"), F.array_join("outstanding", "\n").alias("outstanding"), F.size("brief").alias("n_brief"))


#: Over all of the input: the sections of both lists, whose entries have the numbers of the archive.
_list = lambda n: f"SELECT * EXCLUDE (ord, index, key, entry_id, n, fresh, window_id), index AS ord FROM ({LISTS_SQL}) WHERE window_id = {n}"
_steps = merged_sql(sections_sql(_list(0)), sections_sql(_list(1)))
SECTIONS_SQL = f"SELECT session_id, {', '.join(f'array_to_string({c}, chr(10)) AS {c}' for c in ('commits', 'preferences', 'goals', 'outstanding'))}, len(brief) AS n_brief FROM ({_steps})"

QUERIES = {"stream_archive": stream_archive, "stream_threshold": stream_threshold, "stream_sessions": stream_sessions, "stream_sections": stream_sections}
ORACLE_SQL = {"stream_archive": ARCHIVE_SQL, "stream_threshold": THRESHOLD_SQL, "stream_sessions": SESSIONS_SQL, "stream_sections": SECTIONS_SQL}
