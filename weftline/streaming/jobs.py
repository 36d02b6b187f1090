"""Continuous jobs over a stream of session messages. What must outlast a micro-batch is keyed state or a file of that batch, which is written
over when the batch comes again; results are those of one batch over all of the input, wherever the stream is cut."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import patterns as P
from ..functions import text as T
from ..operators import entries as E
from ..operators import summary as Y
from ..sources.archive import read_archive
from ..sources.checkpoints import cut

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What goes through the keyed state untouched.
REST = "text string, tools array<struct<name: string, input: map<string,string>, text: string, is_error: boolean>>, at_us long"
NUMBERED = "session_id string, window_id int, ord long, role string, key string, entry_id string, index long, fresh boolean, rest string"


class Numbering(StatefulProcessor):
    """Keys, ids and numbers of a session's entries, in the order of their message lists.

    State of a session is the place and key of its last message, the number of its entries and ids, and for each id its list
    and number. Ids lie in buckets of at most about ``bucket``, each read and written whole, as every access asks the engine: a batch costs in proportion to its
    own rows, and a short session's ids are read and written at once. Buckets double with the ids.
    """

    def __init__(self, ids_per_window: bool = False, bucket: int = 256):
        self.ids_per_window, self.bucket = ids_per_window, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "window_id int, ord long, key string, count long, ids long, buckets int")
        self.known = handle.getMapState("known", "bucket int", "ids string")

    def _read(self, bucket: int) -> dict[str, list[int]]:
        held = self.known.getValue((bucket,))
        return json.loads(held[0]) if held else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        window, at, before, count, n_ids, buckets = old or (None, -1, "", 0, 0, 1)
        read, changed = {} if old else {0: {}}, set()
        out = []
        for r in pd.concat(list(rows)).sort_values(["window_id", "ord"], kind="stable").itertuples():
            if window is not None and (r.window_id, r.ord) <= (window, at):
                continue
            if r.window_id != window:
                before = E.first_key(r.window_id, self.ids_per_window)
            window, at = int(r.window_id), int(r.ord)
            before = E.next_key(before, r.role, r.called if isinstance(r.called, str) else None, r.own)
            entry_id = E.entry_id_of(before)
            place = int(entry_id, 16) % buckets
            if place not in read:
                read[place] = self._read(place)
            held = read[place].get(entry_id)
            # what an earlier list has is the same entry; repeats within one list are entries of their own
            fresh = held is None or held[0] == window
            out.append((key[0], window, at, r.role, before, entry_id, count if fresh else held[1], fresh, r.rest))
            if held is None:
                read[place][entry_id] = [window, count]
                changed.add(place)
                n_ids += 1
            count += fresh
        if n_ids > self.bucket * buckets:
            every = [x for k in range(buckets) for x in (read[k] if k in read else self._read(k)).items()]
            while n_ids > self.bucket * buckets:
                buckets *= 2
            read = {k: {} for k in range(buckets)}
            for entry_id, held in every:
                read[int(entry_id, 16) % buckets][entry_id] = held
            changed = set(read)
        for k in changed:
            self.known.updateValue((k,), (json.dumps(read[k]),))
        if out:
            self.last.update((window, at, before, count, n_ids, buckets))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NUMBERED.split(", ")])

    def close(self) -> None:
        pass


def numbered(messages: DataFrame, ids_per_window: bool = False) -> DataFrame:
    """The entries of a stream of messages with key, entry_id, index, and whether they are ``fresh``: not known from an earlier message list of the session.

    Lists (window_id) and the messages in them (ord) come in order; a message that comes again, or after a later one of its session, is
    left out. So neither restarts nor redelivery change an id or a number. Needs the RocksDB state store, which is set
    where the session names none.
    """
    spark = messages.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    rest = F.to_json(F.struct("text", "tools", F.unix_micros("at").alias("at_us")))
    rows = E.cleaned(messages).select("session_id", F.col("window_id").cast("int").alias("window_id"), F.col("ord").cast("long").alias("ord"), "role", "called", F.md5("text").alias("own"), rest.alias("rest"))
    keyed = rows.groupBy("session_id").transformWithStateInPandas(Numbering(ids_per_window), NUMBERED, "Append", "None")
    told = keyed.withColumn("rest", F.from_json("rest", REST))
    return told.select("session_id", "window_id", "ord", "role", "rest.text", "rest.tools", F.timestamp_micros("rest.at_us").alias("at"), "key", "entry_id", "index", "fresh")


def archive_stream(messages: DataFrame, path: str, checkpoint: str, ids_per_window: bool = False) -> DataStreamWriter:
    """Append the unseen entries to the archive at ``path``, numbered on; the file sink commits each batch once. No archived row is read."""
    rows = E.bounded(numbered(messages, ids_per_window).where("fresh").drop("fresh")).withColumn("at", F.coalesce("at", F.current_timestamp()))
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def section_stream(messages: DataFrame, path: str, checkpoint: str, cwd: str | None = None) -> DataStreamWriter:
    """Keep the sections of each session up to each of its message lists: a list's sections, from all of its entries so far, merged under those
    of the lists before. Only sessions of a batch are built anew, and of their entries only those of open lists are read, from the first batch that has
    any of them on.

    ``path``/entries and ``path``/sections have a folder for each batch; ``latest_sections`` reads the result.
    """
    spark = messages.sparkSession

    def of_batches(name: str, condition: str) -> DataFrame | None:
        rows = read_archive(spark, f"{path}/{name}")
        return None if rows is None else rows.where(condition)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/entries/batch={number}")
        lists = of_batches("entries", f"batch = {number}").select("session_id", "window_id").distinct()
        lists = cut(lists.withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("window_id"))))
        before = of_batches("sections", f"batch < {number}")
        known = since = None
        if before is not None:
            near = before.join(lists.select("session_id").distinct(), "session_id", "left_semi")
            newest = F.row_number().over(Window.partitionBy("session_id", "window_id").orderBy(F.desc("batch")))
            all_known = cut(near.withColumn("_n", newest).where("_n = 1").drop("_n", "batch"))
            since = all_known.join(lists, ["session_id", "window_id"]).agg(F.min("first_batch")).first()[0]
            # lists of this batch are built anew
            known = all_known.join(lists, ["session_id", "window_id"], "left_anti")
        held = of_batches("entries", f"batch >= {number if since is None else since} and batch <= {number}").join(lists, ["session_id", "window_id"])
        # each list is a session of its own here
        one = F.to_json(F.struct("session_id", "window_id"))
        built = Y.build_sections(held.withColumn("session_id", one).drop("batch", "step"), cwd).withColumnRenamed("session_id", "list")
        first = held.groupBy("session_id", "window_id", "step").agg(F.min("batch").cast("long").alias("first_batch"))
        new = cut(first.withColumn("list", one).join(built, "list", "left").drop("list"))
        done = None
        for step in range(1, (lists.agg(F.max("step")).first()[0] or 0) + 1):
            mine = new.where(F.col("step") == step)
            keys = mine.select("session_id", F.col("window_id").alias("_this"), F.col("first_batch").alias("_first"))
            # the list before is of an earlier batch, or of the step before
            last = known.join(keys.select("session_id", "_this"), "session_id").where("window_id < _this").drop("_this") if known is not None else None
            if done is not None:
                earlier = done.join(keys.select("session_id"), "session_id", "left_semi")
                last = earlier if last is None else last.unionByName(earlier)
            rows = mine.drop("step")
            if last is not None:
                newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("window_id")))
                merged = Y.merge_sections(last.withColumn("_n", newest).where("_n = 1"), rows.where("files is not null"))
                rows = merged.join(keys, "session_id").withColumnsRenamed({"_this": "window_id", "_first": "first_batch"}).unionByName(rows.where("files is null").join(merged.select("session_id"), "session_id", "left_anti"))
            done = rows if done is None else done.unionByName(rows)
        if done is not None:
            none = F.expr(T.EMPTY)
            done.select("session_id", "window_id", "first_batch", F.coalesce("files", F.expr(Y.FILES)).alias("files"), *(F.coalesce(c, none).alias(c) for c in Y.LISTS)).write.mode("overwrite").parquet(f"{path}/sections/batch={number}")

    return numbered(messages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def latest_sections(spark: SparkSession, path: str) -> DataFrame:
    """The sections of each session after its last message list."""
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("window_id"), F.desc("batch")))
    return spark.read.parquet(f"{path}/sections").withColumn("_n", newest).where("_n = 1").drop("_n", "batch", "first_batch")


def idle_sessions(messages: DataFrame, days: int = 30, lateness: str = "1 day") -> DataFrame:
    """session_id, first_at, last_at, n_messages of sessions without activity for ``days`` days, once the watermark says so."""
    gap = F.session_window("at", f"{days} days")
    found = messages.withWatermark("at", lateness).groupBy("session_id", gap).agg(F.max("at").alias("last_at"), F.count("*").alias("n_messages"))
    return found.select("session_id", F.col("session_window.start").alias("first_at"), "last_at", "n_messages")


def threshold_stream(rows: DataFrame, least: int = P.OBSERVE_AFTER, wait_s: int = P.RETRY_WAIT_S) -> DataFrame:
    """session_id, from_ord, to_ord, tokens each time that the unobserved tokens of a session (session_id, ord, tokens, at_s, failed) reach
    ``least`` and its last failed worker call is ``wait_s`` seconds ago; they then start again from none. State is one row a session:
    tokens, first place, time of the last failure."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, failed_at = state.get if state.exists else (0, -1, -1)
        out = []
        for row in pd.concat(list(frames)).sort_values("ord").itertuples():
            first = row.ord if first < 0 else first
            held += row.tokens
            failed_at = row.at_s if row.failed else failed_at
            if held >= least and (failed_at < 0 or row.at_s - failed_at >= wait_s):
                out.append((key[0], first, row.ord, held))
                held, first = 0, -1
        state.update((held, first, failed_at))
        yield pd.DataFrame(out, columns=["session_id", "from_ord", "to_ord", "tokens"])

    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, from_ord long, to_ord long, tokens long", "tokens long, first long, failed_at long", "append", GroupStateTimeout.NoTimeout)


class Waiting(StatefulProcessor):
    """Stretches of a session's tokens that are due by the clock: at once, or when the wait after a failed call is over."""

    def __init__(self, least: int, wait_s: int):
        self.least, self.wait_ms = least, 1000 * wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "tokens long, first long, last long, failed_ms long")

    def _due(self, key: tuple, now: int, state: tuple) -> tuple[list[tuple], tuple]:
        """What is emitted, and the state after it; a stretch that has to wait gets a timer."""
        tokens, first, last, failed = state
        if tokens < self.least:
            return [], state
        if failed >= 0 and now - failed < self.wait_ms:
            self.handle.registerTimer(failed + self.wait_ms)
            return [], state
        return [(key[0], first, last, tokens)], (0, -1, -1, failed)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state, out = self.held.get() if self.held.exists() else (0, -1, -1, -1), []
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            tokens, first, _, failed = state
            found, state = self._due(key, now, (tokens + int(r.tokens), int(r.ord) if first < 0 else first, int(r.ord), now if r.failed else failed))
            out += found
        self.held.update(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            out, state = self._due(key, timerValues.getCurrentProcessingTimeInMs(), self.held.get())
            self.held.update(state)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "from_ord", "to_ord", "tokens"]).astype({"from_ord": "int64", "to_ord": "int64", "tokens": "int64"})

    def close(self) -> None:
        pass


def threshold_by_clock(rows: DataFrame, least: int = P.OBSERVE_AFTER, wait_s: int = P.RETRY_WAIT_S) -> DataFrame:
    """As ``threshold_stream`` for rows (session_id, ord, tokens, failed) as they happen: failures are as old as their arrival, and what
    has to wait is emitted by a timer when the wait is over, also where the session falls silent."""
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy("session_id").transformWithStateInPandas(Waiting(least, wait_s), "session_id string, from_ord long, to_ord long, tokens long", "Append", "ProcessingTime")
