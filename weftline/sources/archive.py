"""The archive of entries, the ledger and stored sections: reading, appending, exporting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries as E
from ..operators import memory as M
from .checkpoints import cut

#: Segment files of one session each, as JSON arrays.
SEGMENT = "id string, key string, role string, text string, index long, at long, tools array<struct<name: string, input: map<string,string>, text: string, isError: boolean>>"
LEDGER = (
    "version int, observed array<string>, observations array<struct<id: string, kind: string, content: string, relevance: string, sources: array<string>, at: long,"
    " supersedes: array<string>, dropped: boolean, supersededBy: string, unclassified: boolean>>,"
    " reflections array<struct<id: string, content: string, sources: array<string>, at: long, dropped: boolean>>"
)
COLUMNS = ["session_id", "entry_id", "key", "role", "text", "tools", "index", "at"]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Entries from ``path``/<session>/seg-*.json; the session is the folder's name."""
    rows = spark.read.schema(SEGMENT).option("multiLine", True).json(f"{path}/*/seg-*.json").select("*", "_metadata.file_path")
    tools = F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["input"].alias("input"), t["text"].alias("text"), t["isError"].alias("is_error")))
    return rows.select(F.regexp_extract("file_path", r"([^/]+)/seg-[^/]*$", 1).alias("session_id"), F.col("id").alias("entry_id"), "key", "role", "text", tools.alias("tools"), "index", F.timestamp_millis("at").alias("at"))


def read_ledgers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, observed ids and reflections from ``path``/<session>/ledger.json."""
    rows = spark.read.schema(LEDGER).option("multiLine", True).json(f"{path}/*/ledger.json").select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/ledger\.json$", 1).alias("session_id"))
    o = rows.select("session_id", F.posexplode("observations").alias("ord", "o"))
    none = F.expr("cast(array() as array<string>)")
    items = o.select(
        "session_id", F.col("ord").cast("long"), "o.id", "o.kind", "o.relevance", "o.content", F.coalesce("o.sources", none).alias("sources"), F.col("o.at").alias("at_ms"), F.coalesce("o.supersedes", none).alias("supersedes"),
        F.coalesce("o.dropped", F.lit(False)).alias("dropped"), F.col("o.supersededBy").alias("superseded_by"), F.coalesce("o.unclassified", F.lit(False)).alias("unclassified"),
    )
    seen = rows.select("session_id", F.posexplode("observed").alias("ord", "entry_id"))
    r = rows.select("session_id", F.posexplode("reflections").alias("ord", "r")).select("session_id", "ord", "r.id", "r.content", F.coalesce("r.sources", none).alias("sources"), F.col("r.at").alias("at_ms"), F.coalesce("r.dropped", F.lit(False)).alias("dropped"))
    return items, seen, r


def read_archive(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_entries(entries: DataFrame, path: str, buckets: int = 64, at: Column | None = None) -> DataFrame:
    """Append the entries that the archive at ``path`` lacks, numbered on, in folders by a hash of the session; returns them.
    Only the folders of the batch's sessions are read. Appending the same again adds nothing."""
    spark = entries.sparkSession
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    rows = E.bounded(entries).withColumn("bucket", bucket)
    archive = read_archive(spark, path)
    if archive is not None:
        near = archive.join(F.broadcast(rows.select("bucket").distinct()), "bucket", "left_semi").join(rows.select("session_id").distinct(), "session_id", "left_semi")
        counts = near.groupBy("session_id").agg((F.max("index") + 1).alias("count"))
        rows = E.indexed(E.new_entries(rows, near), counts)
    else:
        rows = E.indexed(rows)
    rows = rows.withColumn("at", F.coalesce("at", at if at is not None else F.current_timestamp()))
    # what is returned is what was written, whoever reads it
    rows = cut(rows.select(*COLUMNS, "bucket"))
    rows.write.mode("append").partitionBy("bucket").parquet(path)
    return rows


def export_memory(items: DataFrame, path: str) -> None:
    """One row of Markdown a session."""
    M.memory_text(items).write.mode("overwrite").parquet(path)


def save_items(items: DataFrame, path: str) -> DataFrame:
    """Write ledgers as one row an item, in place of what is at ``path``, which ``items`` must not be read from; returns what is stored."""
    items.select(*M.ITEM).write.mode("overwrite").parquet(path)
    return items.sparkSession.read.parquet(path)


def load_sections(spark: SparkSession, path: str, summaries: DataFrame) -> DataFrame:
    """The sections stored at ``path`` that belong to the last summaries (session_id, summary): those with their hash."""
    return spark.read.parquet(path).join(summaries.select("session_id", F.md5("summary").alias("summary_hash")), ["session_id", "summary_hash"], "left_semi")


def save_sections(sections: DataFrame, summaries: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Stored sections with those of ``sections`` in place of their sessions' old ones, each with its summary's hash."""
    new = sections.join(summaries.select("session_id", F.md5("summary").alias("summary_hash")), "session_id")
    if stored is None:
        return new
    return stored.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)
