"""Streams give one result wherever they are cut, and ids of long sessions are of fixed size."""

import hashlib
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import entries as E
from weftline.streaming import jobs as J

from .test_sessions import MESSAGES, call


def rows_of(session, window, turns):
    return [(session, window, i, role, text, list(calls), None) for i, (role, text, *calls) in enumerate(turns)]


FIRST = [("user", "go"), ("assistant", "", call("t1", "Bash", "ok", command="make")), ("user", "go"), ("user", "go"), ("assistant", "plain"), ("user", " \n"), ("assistant", "", call("t2", "Edit", "ok", file_path="a.ts")), ("user", "Please add a retry to it")]
SECOND = [("user", "[session summary] so far"), ("user", "go"), ("assistant", "", call("t2", "Edit", "ok", file_path="a.ts")), ("assistant", "", call("t3", "Bash", "ok", command="make all"), call("t4", "Bash", "ok")), ("assistant", "", call("t3", "Bash", "ok", command="make all"), call("t4", "Bash", "ok")), ("user", "Instead write the docs first")]
TALK = [*rows_of("a", 0, FIRST), *rows_of("b", 0, FIRST[:3]), *rows_of("a", 1, SECOND), *rows_of("b", 2, SECOND[::-1]), ("c", 0, 0, "assistant", "é", [], None)]


def expected():
    """(session, window, id, index) of all archived entries, by the rule, one message after another."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out, known, count, place, before = [], {}, {}, None, ""
    for session, window, _, role, text, calls, _ in sorted(TALK, key=lambda r: r[:3]):
        text = text.strip()
        if text.startswith("[session summary]") or not (text or calls):
            continue
        if (session, window) != place:
            place, before = (session, window), ""
        before = "a:" + ",".join(c[0] for c in calls) if calls else f"{role[0]}:{md5(before + chr(10) + md5(text))}"
        key = md5(before)[:12]
        if known.setdefault((session, key), window) == window:
            out.append((session, window, key, count.setdefault(session, 0)))
            count[session] += 1
    return out


def fed(spark, parts, folder, begin):
    for part in parts:
        if part:
            spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            begin(spark.readStream.schema(MESSAGES).parquet(f"{folder}/in")).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("cuts", [[], [4, 14], [1, 5, 13, 18]])
def test_archived_entries_do_not_depend_on_cuts(spark, tmp_path, cuts):
    folder = f"file://{tmp_path}"
    ends = [0, *cuts, len(TALK)]
    # the last three of each part come once more with the next one
    parts = [TALK[max(0, a - 3) : b][::-1] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    fed(spark, [*parts, parts[-1]], folder, lambda s: J.archive_stream(s, f"{folder}/archive", f"{folder}/state"))
    got = spark.read.parquet(f"{folder}/archive")
    assert sorted((r.session_id, r.window_id, r.entry_id, r["index"]) for r in got.collect()) == sorted(expected())
    row = got.where("entry_id = '%s'" % hashlib.md5(b"a:t1").hexdigest()[:12]).first()
    assert row.tools[0].input == {"command": "make"} and row.text == "" and row.at is not None


@pytest.mark.parametrize("cuts", [[], [6, 15]])
def test_sections_do_not_depend_on_cuts(spark, tmp_path, cuts):
    folder = f"file://{tmp_path}"
    ends = [0, *cuts, len(TALK)]
    fed(spark, [TALK[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], folder, lambda s: J.section_stream(s, folder, f"{folder}/state"))
    rows = {r.session_id: r for r in J.latest_sections(spark, folder).collect()}
    # the entry of t2 keeps its number in the second list
    assert rows["a"].goals == ["Please add a retry to it (#6)"] and rows["a"].files == {"Modified": ["a.ts"]}
    assert [x for x in rows["a"].brief if x.startswith("  (")] == ["  (1 tool call #1: Bash)", "  (1 tool call #5: Edit)", "  (5 tool calls #5–#8: Edit, Bash ×4)"] and rows["a"].brief[-1] == "[user #9] Instead write the docs first"
    assert rows["c"].brief == ["[assistant #0] é"] and rows["b"].window_id == 2


def test_ids_of_long_sessions(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.lit(0).alias("window_id"), F.col("id").cast("int").alias("ord"), F.lit("user").alias("role"), F.lit("the same").alias("text"), F.expr("cast(array() as array<struct<tool_use_id: string, tool: string, input: map<string,string>, text: string, is_error: boolean>>)").alias("tool_uses"), F.lit(None).cast("timestamp").alias("at"))
    began = time.time()
    found = E.to_entries(rows).agg(F.countDistinct("entry_id").alias("ids"), F.max(F.length("key")).alias("longest")).first()
    assert (found.ids, found.longest) == (n, 34) and time.time() - began < 30


def test_a_session_that_falls_silent_is_due_after_the_wait(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "session_id string, ord long, tokens long, failed boolean"
    rows = [("quiet", 0, 3, True), ("quiet", 1, 9, False), ("due", 0, 12, False), ("due", 1, 11, False), ("low", 0, 4, True)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/in")
    due = J.threshold_by_clock(spark.readStream.schema(shape).parquet(f"{folder}/in"), 10, 4)
    query = due.withColumn("at", F.current_timestamp()).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    out = lambda: spark.read.schema("session_id string, from_ord long, to_ord long, tokens long, at timestamp").parquet(f"{folder}/out").collect()
    try:
        end = time.time() + 90
        while time.time() < end and (not (tmp_path / "out" / "_spark_metadata").exists() or len(out()) < 3):
            time.sleep(1)
    finally:
        query.stop()
    got = {(r.session_id, r.from_ord, r.to_ord, r.tokens): r["at"] for r in out()}
    assert set(got) == {("due", 0, 0, 12), ("due", 1, 1, 11), ("quiet", 0, 1, 12)}
    assert (got["quiet", 0, 1, 12] - got["due", 0, 0, 12]).total_seconds() >= 3


class _Held:
    """A state of one key, and how often it is asked."""

    def __init__(self, of):
        self.of, self.value, self.rows = of, None, {}

    def exists(self):
        self.of.asked += 1
        return self.value is not None

    def get(self):
        self.of.asked += 1
        return self.value

    def update(self, value):
        self.of.asked, self.value = self.of.asked + 1, value

    def containsKey(self, key):
        self.of.asked += 1
        return key in self.rows

    def getValue(self, key):
        self.of.asked += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.of.asked += 1
        self.rows[key] = value


class _Handle:
    asked = 0

    def getValueState(self, *_):
        return _Held(self)

    getMapState = getValueState


def test_ids_of_a_session_are_read_and_written_together():
    """A round trip for each row took most of a batch's time; entries are those of ids looked up one by one, whatever the buckets hold."""
    rows = [(w, k, "user", None, f"{k % 11 if w == 1 else k}", "{}") for w in range(3) for k in range(60)]
    got = []
    for size in (256, 3, 1):
        job, handle, out = J.Numbering(bucket=size), _Handle(), []
        job.init(handle)
        for low, high in ((0, 50), (40, 130), (130, 180)):
            asked = handle.asked
            part = pd.DataFrame(rows[low:high], columns=["window_id", "ord", "role", "called", "own", "rest"])
            out += [tuple(r) for frame in job.handleInputRows(("s",), iter([part]), None) for r in frame.itertuples(index=False)]
            assert size < 256 or handle.asked - asked <= 5
        got.append(out)
    assert got[0] == got[1] == got[2] and len(got[0]) == 180
    first: dict = {}
    for _, window, _, _, _, entry_id, index, fresh, _ in got[0]:
        known = first.setdefault(entry_id, (window, index))
        assert fresh == (known[0] == window) and (fresh or index == known[1])
    assert 60 < len(first) < 180
