"""The ledger of memory items: budgets, prompts, replies, consolidation, migration.

Items: session_id, ord, id, kind, relevance, content, sources, at_ms, supersedes, dropped, superseded_by, unclassified.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import patterns as P
from ..functions import text as T
from .entries import ORDER

TITLES = {"constraint": "Constraints", "lesson": "Lessons", "decision": "Decisions", "state": "State", "fact": "Facts"}
ITEM = ["session_id", "ord", "id", "kind", "relevance", "content", "sources", "at_ms", "supersedes", "dropped", "superseded_by", "unclassified"]
REPLY = "struct<observations: array<struct<kind: string, content: string, relevance: string, sourceEntryIds: array<string>, sources: array<string>, supersedes: array<string>>>>"


def item_tokens() -> Column:
    return T.estimate_tokens(F.col("content")) + P.ITEM_TOKENS


def _lookup(values: dict, column: Column) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def kind_budget(kind: Column, pool: int) -> Column:
    return _lookup({k: int(pool * s + 1e-9) for k, s in P.KIND_SHARES.items()}, kind)


def rank(relevance: Column) -> Column:
    return _lookup({r: i for i, r in enumerate(P.RELEVANCES)}, relevance)


def inferred_kind(content: Column) -> Column:
    return F.when(content.rlike(r"(?i)^lesson(?![A-Za-z0-9_])"), "lesson").otherwise("fact")


def active(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("dropped", F.lit(False)))


def budget_status(items: DataFrame, pool: int = P.POOL_TOKENS) -> DataFrame:
    """session_id, kind (null: all kinds), n_items, tokens, budget, over (lasting kinds over their budget)."""
    totals = active(items).rollup("session_id", "kind").agg(F.count("*").alias("n_items"), F.sum(item_tokens()).alias("tokens")).where("session_id is not null")
    budget = F.coalesce(kind_budget(F.col("kind"), pool), F.lit(pool))
    return totals.select("session_id", "kind", "n_items", "tokens", budget.alias("budget"), (F.coalesce(F.col("kind").isin(P.LASTING_KINDS), F.lit(False)) & (F.col("tokens") > budget)).alias("over"))


def status_report(items: DataFrame, entries: DataFrame, observed: DataFrame) -> DataFrame:
    """session_id, n_active, n_items, pool_tokens, n_entries, n_pending, pending_tokens (of their raw texts) of each session with entries or items."""
    live = ~F.coalesce("dropped", F.lit(False))
    memory = items.groupBy("session_id").agg(F.sum(live.cast("long")).alias("n_active"), F.count("*").alias("n_items"), F.coalesce(F.sum(F.when(live, item_tokens())), F.lit(0)).alias("pool_tokens"))
    seen = observed.select("session_id", "entry_id").distinct().withColumn("_seen", F.lit(True))
    new = F.col("_seen").isNull()
    rows = entries.select("session_id", "entry_id", T.estimate_tokens(F.col("text")).alias("tokens")).join(seen, ["session_id", "entry_id"], "left")
    history = rows.groupBy("session_id").agg(F.count("*").alias("n_entries"), F.sum(new.cast("long")).alias("n_pending"), F.coalesce(F.sum(F.when(new, F.col("tokens"))), F.lit(0)).alias("pending_tokens"))
    return history.join(memory, "session_id", "full").na.fill(0)


def fit_budgets(items: DataFrame, pool: int = P.POOL_TOKENS) -> DataFrame:
    """``items`` with those dropped that don't fit their kind's budget: the least relevant first, then the oldest. What is
    not classified counts but stays. An item goes if the excess is not yet covered by those that go before it."""
    live = ~F.coalesce("dropped", F.lit(False))
    settled = live & ~F.coalesce("unclassified", F.lit(False))
    excess = F.sum(F.when(live, item_tokens())).over(Window.partitionBy("session_id", "kind")) - kind_budget(F.col("kind"), pool)
    turn = Window.partitionBy("session_id", "kind", settled).orderBy(rank(F.col("relevance")), "at_ms", "ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(item_tokens()).over(turn), F.lit(0))
    return items.withColumns({"_over": excess, "_before": before}).withColumn("dropped", F.coalesce("dropped", F.lit(False)) | (settled & (F.col("_before") < F.col("_over")))).drop("_over", "_before")


def rendered() -> Column:
    at = F.date_format(F.timestamp_millis(F.col("at_ms").cast("long")), "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("["), "id", F.lit("] "), at, F.lit(" ["), "relevance", F.lit("] "), "content")


def memory_text(items: DataFrame, level: str = "##", marks: bool = False) -> DataFrame:
    """session_id, memory: items under a heading a kind; with ``marks`` also the retired ones, marked as such."""
    mark = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit(" (superseded by "), "superseded_by", F.lit(")"))).when(F.col("dropped"), " (dropped)").otherwise("")
    rows = (items if marks else active(items)).where(F.col("kind").isin(list(TITLES)))
    line = F.concat(F.lit("- "), rendered(), mark if marks else F.lit(""))
    by_kind = rows.groupBy("session_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    place = _lookup({k: i for i, k in enumerate(TITLES)}, F.col("kind"))
    block = F.concat(F.lit(f"{level} "), _lookup(TITLES, F.col("kind")), F.lit("\n"), "lines")
    return by_kind.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), block.alias("block")))), lambda x: x["block"]), "\n\n").alias("memory"))


def observer_text(cwd: str | None = None) -> Column:
    """An entry as a worker reads it."""
    at = F.when(F.col("at").isNotNull(), F.concat(F.lit(" @ "), T.stamp(F.col("at")))).otherwise("")
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    said = F.when(F.col("text") != "", F.concat(F.lit("["), who, at, F.lit("]: "), T.clip(F.col("text"), 3000)))
    call = lambda t: F.concat_ws(
        "\n",
        F.concat(F.lit("[Tool call] "), T.tool_line(t["name"], t["input"], cwd, True)),
        F.when(t["text"] != "", F.concat(F.lit("[Tool result for "), t["name"], F.when(t["is_error"], " (error)").otherwise(""), F.lit("]: "), T.clip(t["text"], 600))),
    )
    return F.concat_ws("\n", F.concat(F.lit("[Source entry id: "), "entry_id", F.lit("]")), said, F.nullif(F.array_join(F.transform("tools", call), "\n"), F.lit("")))


def pending(entries: DataFrame, observed: DataFrame, cwd: str | None = None) -> DataFrame:
    """Entries that no worker has seen, with ``rendered`` and its ``tokens``."""
    rows = entries.join(observed.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_anti")
    return rows.withColumn("rendered", observer_text(cwd)).withColumn("tokens", T.estimate_tokens(F.col("rendered")))


def backlog(pending_: DataFrame, least: int = P.OBSERVE_AFTER) -> DataFrame:
    """session_id, n_entries, tokens of the sessions with enough to observe."""
    return pending_.groupBy("session_id").agg(F.count("*").alias("n_entries"), F.sum("tokens").alias("tokens")).where(F.col("tokens") >= least)


def chunk_numbers(tokens: list[int], most: int, held: int = 0, chunk: int = 0) -> list[int]:
    """Greedy chunks in order: a chunk takes the next row while it fits, and at least one. ``held`` tokens are in the chunk already."""
    out = []
    for n in tokens:
        if held and held + n > most:
            chunk, held = chunk + 1, 0
        held += n
        out.append(chunk)
    return out


def block_ends(tokens: list[int], most: int) -> tuple[list[int], list[int], list[int]]:
    """What greedy chunks make of a block of rows, however full the chunk is that they begin in.

    A chunk with ``h`` tokens takes rows up to the first one that doesn't fit; from there all is fixed. For each row that this can be (and for
    none), in order: the tokens before it, and the chunks closed and the tokens held at the block's end if it opens one.
    """
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    n = len(tokens)
    # the row at which a chunk that opens at each row no longer takes all
    full = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    closed, held = np.zeros(n, dtype=np.int64), sums[n] - sums[:-1]
    for i in range(n - 1, -1, -1):
        if full[i] < n:
            # a chunk without tokens takes any row
            after = full[i] + (sums[full[i]] == sums[i])
            if after < n:
                closed[i], held[i] = closed[after] + 1, held[after]
    reach = min(n, int(np.searchsorted(sums, most, "right")))
    return sums[: reach + 1].tolist(), (closed[:reach] + 1).tolist(), held[:reach].tolist()


def through_block(held: int, before: list[int], closed: list[int], held_after: list[int], most: int, total: int) -> tuple[int, int]:
    """Chunks closed in a block that begins with ``held`` tokens in a chunk, and the tokens held after it."""
    if not held:
        return (closed[0] - 1, held_after[0]) if closed else (0, total)
    for first in range(len(closed)):
        if held + before[first + 1] > most:
            return closed[first], held_after[first]
    return 0, held + total


#: Places of a session's rows that are numbered in one task.
BLOCK = 1 << 15


def chunks(pending_: DataFrame, most: int = P.CHUNK_TOKENS, block: int = BLOCK) -> DataFrame:
    """``pending_`` with chunk_no; only numbers go through the sequential step.

    A session's rows are numbered in blocks of ``block`` places. Of longer sessions, each block is first reduced to what it does to
    the chunk that it begins in, whatever that holds; these are applied one after another, a row a block, so that all blocks can be numbered
    by themselves.
    """
    keys = ["session_id", "window_id", "_block"]
    narrow = pending_.select("session_id", *ORDER, F.col("tokens").cast("long"), F.floor(F.col("ord") / block).cast("long").alias("_block"))
    several = narrow.groupBy(*keys).agg(F.lit(1).alias("_one")).groupBy("session_id").agg(F.count("*").alias("_blocks")).where("_blocks > 1").select("session_id")

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = pdf.sort_values(ORDER)["tokens"].tolist()
        before, closed, held = block_ends(tokens, most)
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "total": [sum(tokens)], "before": [before], "closed": [closed], "held": [held]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, held, begin = 0, 0, []
        pdf = pdf.sort_values(["window_id", "_block"])
        for r in pdf.itertuples():
            begin.append((chunk, held))
            more, held = through_block(held, list(r.before), list(r.closed), list(r.held), most, r.total)
            chunk += more
        return pdf[keys].assign(_chunk=[c for c, _ in begin], _held=[h for _, h in begin])

    parts = narrow.join(several, "session_id", "left_semi").groupBy(*keys).applyInPandas(reduced, "session_id string, window_id int, _block long, total long, before array<long>, closed array<long>, held array<long>")
    begins = parts.groupBy("session_id").applyInPandas(carried, "session_id string, window_id int, _block long, _chunk long, _held long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        chunk, held = int(pdf["_chunk"].iloc[0]), int(pdf["_held"].iloc[0])
        return pdf[["session_id", *ORDER]].assign(chunk_no=chunk_numbers(pdf["tokens"].tolist(), most, held, chunk))

    placed = narrow.join(begins.withColumnsRenamed({"_block": "_b", "window_id": "_w"}), (narrow["session_id"] == begins["session_id"]) & (F.col("window_id") == F.col("_w")) & (F.col("_block") == F.col("_b")), "left").select(
        narrow["session_id"], *ORDER, "tokens", "_block", F.coalesce("_chunk", F.lit(0)).cast("long").alias("_chunk"), F.coalesce("_held", F.lit(0)).cast("long").alias("_held")
    )
    schema = Y.StructType([*(f for f in narrow.schema.fields if f.name in ("session_id", *ORDER)), Y.StructField("chunk_no", Y.LongType())])
    return pending_.join(placed.groupBy(*keys).applyInPandas(number, schema), ["session_id", *ORDER])


def observer_prompts(chunks_: DataFrame, items: DataFrame) -> DataFrame:
    """session_id, chunk_no, prompt for a worker outside."""
    texts = chunks_.groupBy("session_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "rendered"))), lambda x: x["rendered"]), "\n\n").alias("chunk"))
    known = texts.join(memory_text(items, "###"), "session_id", "left")
    return known.select("session_id", "chunk_no", F.concat(F.lit("## Current memory\n\n"), F.coalesce("memory", F.lit("(none)")), F.lit("\n\n## New conversation chunk\n\n"), "chunk").alias("prompt"))


def over_budget_kinds(items: DataFrame, pool: int = P.POOL_TOKENS) -> DataFrame:
    return budget_status(items, pool).where("over and kind is not null").select("session_id", "kind", "tokens", "budget")


def consolidator_prompts(items: DataFrame, pool: int = P.POOL_TOKENS) -> DataFrame:
    """session_id, prompt: the items of each lasting kind over its budget."""
    rows = active(items).join(over_budget_kinds(items, pool), ["session_id", "kind"])
    by_kind = rows.groupBy("session_id", "kind", "tokens", "budget").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), rendered()).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = lambda c: c.cast("string")
    block = F.concat(F.lit("## "), _lookup(TITLES, F.col("kind")), F.lit(" (about "), text(F.col("tokens") - F.col("budget")), F.lit(" tokens over its "), text(F.col("budget")), F.lit("-token budget)\n"), "lines")
    place = _lookup({k: i for i, k in enumerate(TITLES)}, F.col("kind"))
    return by_kind.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), block.alias("block")))), lambda x: x["block"]), "\n\n").alias("prompt"))


def classifier_prompts(items: DataFrame) -> DataFrame:
    rows = active(items).where(F.coalesce("unclassified", F.lit(False)))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), rendered()).alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


#: A fenced block in a reply.
FENCED = r"```(?:json)?\s*([\s\S]*?)```"


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def first_json(reply: str | None) -> str | None:
    """The first JSON object or array in a reply, the longest span that parses; None if there is none."""
    text = re.sub(FENCED, r"\1", reply or "")
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    close = "}" if text[start] == "{" else "]"
    end = text.rfind(close)
    while end > start:
        try:
            return json.dumps(json.loads(text[start : end + 1], parse_constant=_no_number), ensure_ascii=False)
        except ValueError:
            end = text.rfind(close, 0, end)
    return None


@F.pandas_udf(Y.StringType())
def first_json_of(replies: pd.Series) -> pd.Series:
    return replies.map(first_json)


def reply_json(reply: Column) -> Column:
    """As ``first_json``. The engine's parser reads one value and leaves what follows, so a value that is whole where the first bracket opens is
    found without Python; what it refuses, such as keys that repeat, is looked at there, and all other rows come as nulls."""
    text = F.regexp_replace(reply, FENCED, "$1")
    start = F.regexp_instr(text, F.lit(r"[{\[]"))
    told = F.to_json(F.try_parse_json(F.substring(text, start, F.length(text))))
    return F.coalesce(told, first_json_of(F.when((start > 0) & told.isNull(), reply)))


def observations(replies: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Valid items in workers' replies (session_id, chunk_no, reply, now_ms): session_id, chunk_no, place, id, kind, relevance,
    content, sources, at_ms, supersedes. Only citations of the chunk's entries count, and an item needs one."""
    found = replies.withColumn("_json", reply_json(F.col("reply")))
    whole = F.when(F.substring("_json", 1, 1) == "[", F.concat(F.lit('{"observations":'), "_json", F.lit("}"))).otherwise(F.col("_json"))
    rows = found.select("session_id", "chunk_no", "now_ms", F.posexplode(F.from_json(whole, REPLY)["observations"]).alias("place", "o"))
    content = T.one_line(F.col("o.content"))
    rows = rows.where(F.col("o.content").isNotNull() & (content != "")).select("*", content.alias("content"))
    cited = rows.select("session_id", "chunk_no", "place", "now_ms", F.posexplode(F.coalesce("o.sourceEntryIds", "o.sources")).alias("at", "entry_id"))
    entries = chunks_.select("session_id", "chunk_no", "entry_id", F.unix_millis("at").alias("entry_ms")).dropDuplicates(["session_id", "chunk_no", "entry_id"])
    valid = cited.join(entries, ["session_id", "chunk_no", "entry_id"]).groupBy("session_id", "chunk_no", "place").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "entry_id"))), lambda x: x["entry_id"]).alias("sources"), F.max(F.coalesce("entry_ms", "now_ms")).alias("at_ms")
    )
    kind = F.when(F.col("o.kind").isin(list(TITLES)), F.col("o.kind")).otherwise(inferred_kind(F.col("content")))
    relevance = F.when(F.col("o.relevance").isin(P.RELEVANCES), F.col("o.relevance")).otherwise("medium")
    item_id = T.hash_id(F.concat(F.lit("o:"), "content", F.lit(":"), F.array_join("sources", ",")))
    return rows.join(valid, ["session_id", "chunk_no", "place"]).select(
        "session_id", "chunk_no", "place", item_id.alias("id"), kind.alias("kind"), relevance.alias("relevance"), "content", "sources", "at_ms", F.coalesce("o.supersedes", F.expr(T.EMPTY)).alias("supersedes")
    )


def retired(items: DataFrame, by: DataFrame) -> DataFrame:
    """``items`` with the active ones in ``by`` (session_id, id, new_id) dropped, superseded by new_id where there is one."""
    joined = items.join(by.select("session_id", "id", F.col("new_id").alias("_by"), F.lit(True).alias("_hit")), ["session_id", "id"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("dropped", F.lit(False))
    return joined.withColumns({"superseded_by": F.when(hit & F.col("_by").isNotNull(), F.col("_by")).otherwise(F.col("superseded_by")), "dropped": F.coalesce("dropped", F.lit(False)) | hit}).select(*ITEM)


def add_observations(items: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new items (as from ``observations``, ordered by chunk_no and place): those whose id is known or whose
    content an active item has are left out, and active items that the others supersede are retired."""
    live = active(items)
    fresh = new.withColumn("_c", F.lower("content")).join(live.select("session_id", F.lower("content").alias("_c")), ["session_id", "_c"], "left_anti").join(items.select("session_id", "id"), ["session_id", "id"], "left_anti")
    last = items.groupBy("session_id").agg(F.max("ord").alias("_last"))
    order = Window.partitionBy("session_id").orderBy("chunk_no", "place")
    fresh = fresh.join(last, "session_id", "left").withColumn("ord", F.coalesce("_last", F.lit(-1)) + F.row_number().over(order))
    links = fresh.select("session_id", F.col("id").alias("new_id"), F.col("ord").alias("new_ord"), F.posexplode("supersedes").alias("at", "id")).join(live.select("session_id", "id"), ["session_id", "id"], "left_semi")
    kept = links.groupBy("session_id", F.col("new_ord").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("_kept"))
    added = fresh.join(kept, ["session_id", "ord"], "left").withColumns({"supersedes": F.coalesce("_kept", F.expr(T.EMPTY)), "dropped": F.lit(False), "superseded_by": F.lit(None).cast("string"), "unclassified": F.lit(False)})
    by = links.groupBy("session_id", "id").agg(F.max_by("new_id", "new_ord").alias("new_id"))
    return retired(items, by).unionByName(added.select(*ITEM))


def add_observed(observed: DataFrame, chunk: DataFrame) -> DataFrame:
    """session_id, ord, entry_id with the chunk's entries after those seen before; the last of each session stay."""
    last = observed.groupBy("session_id").agg(F.max("ord").alias("_last"))
    rows = chunk.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER))).join(last, "session_id", "left")
    both = observed.select("session_id", "ord", "entry_id").union(rows.select("session_id", F.coalesce("_last", F.lit(-1)) + F.col("_n"), "entry_id"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ord")))
    return both.withColumn("_b", back).where(F.col("_b") <= P.OBSERVED_MAX).drop("_b")


def claims(replies: DataFrame, open_items: DataFrame) -> DataFrame:
    """Consolidators' replies (session_id, reply) against the items they may touch: session_id, place (null: retired only), seat (the
    item's place in the merge), id, content, relevance. An item goes to the first merge that names it, if it is of that merge's kind."""
    merged = "array<struct<content: string, relevance: string, replaces: array<string>>>"
    parsed = replies.select("session_id", F.from_json(reply_json(F.col("reply")), f"struct<merged: {merged}, retire: array<string>>").alias("r"))
    known = open_items.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "kind"))).alias("kinds"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for session, r, kinds in zip(pdf["session_id"], pdf["r"], pdf["kinds"], strict=True):
                kinds, taken = dict(kinds), set()
                merges = r["merged"] if r and r["merged"] is not None else []
                for place, item in enumerate(merges):
                    content = " ".join((item["content"] or "").split())
                    free = [i for i in (item["replaces"] if item["replaces"] is not None else []) if i in kinds and i not in taken]
                    if not content or not free:
                        continue
                    own = [i for i in dict.fromkeys(free) if kinds[i] == kinds[free[0]]]
                    taken.update(own)
                    rows += [(session, place, seat, i, content, item["relevance"]) for seat, i in enumerate(own)]
                retire = r["retire"] if r and r["retire"] is not None else []
                rows += [(session, None, None, i, None, None) for i in dict.fromkeys(retire) if i in kinds and i not in taken]
            yield pd.DataFrame(rows, columns=["session_id", "place", "seat", "id", "content", "relevance"]).astype({"place": "Int64", "seat": "Int64"})

    # open items of a session and a reply to them are what one worker call holds
    return parsed.join(known, "session_id").select("session_id", F.col("r"), F.col("kinds")).mapInPandas(take, "session_id string, place long, seat long, id string, content string, relevance string")


def consolidate(items: DataFrame, replies: DataFrame, pool: int = P.POOL_TOKENS) -> DataFrame:
    """The ledger after consolidators' replies (session_id, reply, now_ms). What a merge cites and replaces is in the order in which the
    reply names it; it is as old as the newest item it replaces, or as the reply where none has a time."""
    open_items = active(items).join(over_budget_kinds(items, pool).select("session_id", "kind"), ["session_id", "kind"], "left_semi")
    taken = claims(replies, open_items).join(open_items.select("session_id", "id", "kind", F.col("relevance").alias("old"), "sources", "at_ms", "ord"), ["session_id", "id"])
    merges = taken.where("place is not null").groupBy("session_id", "place").agg(
        F.first("content").alias("content"), F.first("kind").alias("kind"), F.first("relevance").alias("said"), F.max(rank(F.col("old"))).alias("top"), F.max("at_ms").alias("at_ms"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seat", "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("seat", "id"))), lambda x: x["id"]).alias("supersedes"),
    )
    if "now_ms" in replies.columns:
        merges = merges.join(replies.groupBy("session_id").agg(F.max("now_ms").alias("_now")), "session_id").withColumn("at_ms", F.coalesce(F.nullif(F.col("at_ms"), F.lit(0)), "_now")).drop("_now")
    content = T.one_line(F.col("content"))
    relevance = F.when(F.col("said").isin(P.RELEVANCES), F.col("said")).otherwise(F.get(F.array(*map(F.lit, P.RELEVANCES)), F.col("top")))
    merges = merges.withColumns({"content": content, "relevance": relevance}).withColumn("id", T.hash_id(F.concat(F.lit("o:"), "content", F.lit(":"), F.array_join("sources", ","))))
    by = taken.join(merges.select("session_id", "place", F.col("id").alias("new_id")), ["session_id", "place"], "left").select("session_id", "id", "new_id")
    last = items.groupBy("session_id").agg(F.max("ord").alias("_last"))
    order = Window.partitionBy("session_id").orderBy("place")
    added = merges.join(last, "session_id").withColumns({"ord": F.col("_last") + F.row_number().over(order), "dropped": F.lit(False), "superseded_by": F.lit(None).cast("string"), "unclassified": F.lit(False)})
    return retired(items, by).unionByName(added.select(*ITEM))


def migrate(items: DataFrame, reflections: DataFrame) -> DataFrame:
    """A ledger with separate reflections (session_id, ord, id, content, sources, at_ms, dropped) as one layer of items: a
    reflection cites what its items cite, and the items it covers give way to the last reflection that is live."""
    known = F.col("kind").isin(list(TITLES))
    base = items.withColumns({"unclassified": F.coalesce("unclassified", F.lit(False)) | ~F.coalesce(known, F.lit(False)), "kind": F.when(known, F.col("kind")).otherwise(inferred_kind(F.col("content")))})
    cites = reflections.select("session_id", F.col("id").alias("new_id"), F.col("ord").alias("new_ord"), "dropped", F.posexplode("sources").alias("at", "id"))
    cited = cites.join(base.select("session_id", "id", F.col("relevance").alias("r"), F.col("sources").alias("s")), ["session_id", "id"])
    facts = cited.groupBy("session_id", F.col("new_id").alias("id")).agg(F.bool_or(F.col("r") == "critical").alias("critical"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]))).alias("cited"))
    last = items.groupBy("session_id").agg(F.max("ord").alias("_last"))
    new = reflections.join(facts, ["session_id", "id"], "left").join(last, "session_id", "left")
    new = new.select(
        "session_id", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))).alias("ord"), "id", inferred_kind(F.col("content")).alias("kind"),
        F.when(F.coalesce("critical", F.lit(False)), "critical").otherwise("high").alias("relevance"), "content", F.coalesce("cited", F.expr(T.EMPTY)).alias("sources"), "at_ms", F.col("sources").alias("supersedes"),
        F.coalesce("dropped", F.lit(False)).alias("dropped"), F.lit(None).cast("string").alias("superseded_by"), F.lit(True).alias("unclassified"),
    )
    by = cites.where(~F.coalesce("dropped", F.lit(False))).groupBy("session_id", "id").agg(F.max_by("new_id", F.struct("new_ord", "at")).alias("new_id"))
    return retired(base, by).unionByName(new)


def classify(items: DataFrame, replies: DataFrame) -> DataFrame:
    """The ledger after classifiers' replies (session_id, reply): named kinds hold, and nothing of those sessions is
    unclassified any more. A reply that can't be read changes nothing."""
    parsed = replies.select("session_id", F.from_json(reply_json(F.col("reply")), "struct<kinds: map<string,string>>")["kinds"].alias("kinds")).where("kinds is not null")
    named = parsed.select("session_id", F.explode("kinds").alias("id", "named")).where(F.col("named").isin(list(TITLES)))
    rows = items.join(parsed.select("session_id", F.lit(True).alias("_read")), "session_id", "left").join(named, ["session_id", "id"], "left")
    open_ = F.coalesce("_read", F.lit(False)) & F.coalesce("unclassified", F.lit(False))
    return rows.withColumns({"kind": F.when(open_ & F.col("named").isNotNull(), F.col("named")).otherwise(F.col("kind")), "unclassified": F.coalesce("unclassified", F.lit(False)) & ~open_}).select(*ITEM)


def worker_usage(calls: DataFrame) -> DataFrame:
    """session_id, n_calls, failures, tokens_in, tokens_out, ms, ms_per_call, last_cycle from a log (session_id, cycle, failed,
    tokens_in, tokens_out, ms)."""
    out = calls.groupBy("session_id").agg(
        F.count("*").alias("n_calls"), F.sum(F.col("failed").cast("int")).alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("ms").alias("ms"), F.max("cycle").alias("last_cycle")
    )
    return out.withColumn("ms_per_call", F.round(F.col("ms") / F.greatest(F.lit(1), F.col("n_calls")), 6))
