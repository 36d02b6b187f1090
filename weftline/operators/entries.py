"""Messages to clean entries with content-addressed ids, and what follows from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import patterns as P
from ..functions import text as T

#: Order within a session.
ORDER = ["window_id", "ord"]


def cleaned(messages: DataFrame) -> DataFrame:
    """session_id, window_id, ord, role, text, tools, at, called: what is left of messages, without ids.

    Summaries, user messages without own text and assistant messages with neither text nor calls go. ``called`` is the ids of an
    assistant message's calls, null without any.
    """
    plain = T.sanitize(F.col("text"))
    text = F.when(F.col("role") == "user", T.strip_wrappers(plain)).otherwise(T.trim_u(plain))
    tools = F.transform(
        "tool_uses",
        lambda u: F.struct(
            u["tool"].alias("name"),
            F.transform_values(u["input"], lambda _, v: T.clip(v, P.FIELD_MAX)).alias("input"),
            T.clip(T.sanitize(F.coalesce(u["text"], F.lit(""))), P.FIELD_MAX).alias("text"),
            F.coalesce(u["is_error"], F.lit(False)).alias("is_error"),
        ),
    )
    calls = (F.col("role") == "assistant") & (F.size("tool_uses") > 0)
    called = F.when(calls, F.array_join(F.transform("tool_uses", lambda u: u["tool_use_id"]), ","))
    rows = messages.where(~F.col("text").startswith(P.SENTINEL)).select("session_id", "window_id", "ord", "role", text.alias("text"), tools.alias("tools"), "at", called.alias("called"))
    rows = rows.where((F.col("text") != "") | F.col("called").isNotNull())
    return rows.withColumn("tools", F.when(F.col("role") == "assistant", F.col("tools")).otherwise(F.slice("tools", 1, 0)))


def first_key(window: int, ids_per_window: bool = False) -> str:
    """What the chain of keys of a message list begins with."""
    return f"{window}|" if ids_per_window else ""


def next_key(before: str, role: str, called: str | None, own: str) -> str:
    """A message's key: the ids of its calls, or else a hash of the key before it and its own text's hash."""
    if called is not None:
        return "a:" + called
    return role[:1] + ":" + hashlib.md5(f"{before}\n{own}".encode(), usedforsecurity=False).hexdigest()


def entry_id_of(key: str) -> str:
    """The same id as in ``with_keys``."""
    return hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()[:12]


def with_keys(rows: DataFrame, ids_per_window: bool = False) -> DataFrame:
    """``cleaned`` rows with key and entry_id. A session's rows pass one task in order, which holds nothing but the key before."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key = None, ""
        for batch in batches:
            keys = []
            for session, window, role, called, own in zip(*(batch.column(c).to_pylist() for c in ("session_id", "window_id", "role", "called", "_own")), strict=True):
                if (session, window) != place:
                    place, key = (session, window), first_key(window, ids_per_window)
                key = next_key(key, role, called, own)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, "key"])

    own = rows.withColumn("_own", F.md5("text")).repartition("session_id").sortWithinPartitions("session_id", *ORDER)
    keyed = own.mapInArrow(chained, StructType([*own.schema.fields, StructField("key", StringType())]))
    return keyed.drop("called", "_own").withColumn("entry_id", T.hash_id(F.col("key")))


def to_entries(messages: DataFrame, ids_per_window: bool = False) -> DataFrame:
    """session_id, window_id, ord, role, text, tools, at, key, entry_id.

    A message with calls is keyed by their ids. Any other is keyed by a chain of hashes: of the key before and its own text. So the same list
    of messages gets the same ids again, and equal texts after different ones get different ids; ``ids_per_window`` tells equal beginnings of
    different lists apart.
    """
    return with_keys(cleaned(messages), ids_per_window)


def indexed(entries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """With ``index``: dense within a session, from 0 or on from ``counts`` (session_id, count)."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER)) - 1
    if counts is None:
        return entries.withColumn("index", number.cast("long"))
    joined = entries.join(counts.select("session_id", F.col("count").alias("_base")), "session_id", "left")
    return joined.withColumn("index", (number + F.coalesce("_base", F.lit(0))).cast("long")).drop("_base")


def without_noise(entries: DataFrame, tools: list[str] = P.NOISE_TOOLS) -> DataFrame:
    """Without bookkeeping calls, and without entries that they leave empty."""
    kept = F.filter("tools", lambda t: ~t["name"].isin(tools) & ~t["name"].endswith("__recall"))
    return entries.withColumn("tools", kept).where((F.col("text") != "") | (F.size("tools") > 0))


def bounded(entries: DataFrame, most: int = P.OVERSIZED_BYTES, field: int = P.OVERSIZED_FIELD) -> DataFrame:
    """Entries of more than ``most`` bytes as JSON have every text cut to ``field`` characters."""
    large = F.octet_length(F.to_json(F.struct("session_id", "entry_id", "key", "role", "text", "tools"))) > most
    tools = F.transform(
        "tools",
        lambda t: F.struct(t["name"].alias("name"), F.transform_values(t["input"], lambda _, v: T.clip(v, field)).alias("input"), T.clip(t["text"], field).alias("text"), t["is_error"].alias("is_error")),
    )
    return entries.withColumn("_large", large).withColumns({"text": F.when(F.col("_large"), T.clip(F.col("text"), field)).otherwise(F.col("text")), "tools": F.when(F.col("_large"), tools).otherwise(F.col("tools"))}).drop("_large")


def new_entries(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Entries whose id is not in the archive; repeats within ``entries`` stay."""
    return entries.join(archive.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_anti")


def in_window(corpus: DataFrame, window: DataFrame) -> DataFrame:
    """The corpus rows whose key is in the live window."""
    return corpus.join(window.select("session_id", "key").distinct(), ["session_id", "key"], "left_semi")


def corpus(archive: DataFrame, live: DataFrame) -> DataFrame:
    """The archive and the live entries that it lacks, indexed on."""
    counts = archive.groupBy("session_id").agg(F.max("index").alias("_last")).select("session_id", (F.col("_last") + 1).alias("count"))
    return archive.unionByName(indexed(new_entries(live, archive), counts).select(archive.columns))


def message_tokens(messages: DataFrame) -> DataFrame:
    """session_id, tokens: estimated tokens of the texts and results of a session's messages."""
    results = F.aggregate("tool_uses", F.lit(0).cast("long"), lambda a, u: a + T.estimate_tokens(F.coalesce(u["text"], F.lit(""))))
    return messages.groupBy("session_id").agg(F.sum(T.estimate_tokens(F.col("text")) + results).alias("tokens"))


def tool_calls(entries: DataFrame) -> DataFrame:
    """One row a call: session_id, window_id, ord, pos, name, input, command, result, is_error (and index if there is one)."""
    keep = [c for c in ("session_id", "window_id", "ord", "index") if c in entries.columns]
    rows = entries.select(*keep, F.posexplode("tools").alias("pos", "t"))
    return rows.select(*keep, "pos", "t.name", "t.input", F.col("t.input")["command"].alias("command"), F.col("t.text").alias("result"), "t.is_error")


def haystack() -> Column:
    """What searches look at in an entry: its text, and the names, arguments and results of its calls."""
    arguments = lambda t: F.array_join(F.transform(F.map_entries(t["input"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    calls = F.transform("tools", lambda t: F.concat_ws("\n", t["name"], F.nullif(arguments(t), F.lit("")), F.nullif(t["text"], F.lit(""))))
    return F.concat_ws("\n", F.nullif(F.col("text"), F.lit("")), F.nullif(F.array_join(calls, "\n"), F.lit("")))
