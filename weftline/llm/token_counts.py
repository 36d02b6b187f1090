"""Operator 9: token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes inserts, deletes or revises counts of documents. Against the ledger of what counts
now it becomes signed rows; their sums are the batch's deltas, and totals are the sums of all
deltas. The ledger lies in buckets of documents, as many in each folder as its rows ask for, and a batch reads those that it touches. Ledger rows and deltas
are written to folders of the batch and count only when its commit is there too: a batch that was lost half way
is written over, and one that is committed is never applied again. Every so many commits, ledger and deltas
are summed up to a base, so what a batch reads, and the number of folders, do not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut, new_dir, spread

LEDGER = "doc_id long, version string, source string, lang string, tokens long, sign long, bucket int"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
COMMITS = "n long, batch long, parts int"
#: Ledger rows in one file, on average.
ROWS = 50_000
STATE = ["doc_id", "version", "source", "lang", "tokens"]


class TokenRollup:
    """Totals in a folder that driver and executors share; one writer at a time.

    Changes have doc_id, op (insert, revise or delete), version, source, lang, tokens and seq. They hold in the order of seq, then of op (a
    delete before an insert, that before a revision) and tokens; a null seq is before all others. A document counts once a version, and an
    insert of what is there already revises it; a null version is one of its own. A delete without a version takes all versions that
    the document has by then, an insert with a higher seq counts again. A delete of an unknown document changes nothing. A null doc_id is
    only ever inserted, as a document of its own. Null tokens count as 0, null sources and languages are groups of their own.
    Repeated changes count once, an empty batch is committed and changes nothing, other columns are ignored.

    ``buckets`` of the ledger hold documents by hash; a folder of few rows has runs of them in one file (see ``ROWS``); ``compact_every`` is the number of commits from one base to the next. Folders of
    batches that a base sums up are no longer read and may be deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 4096, compact_every: int = 16):
        self.spark, self.folder, self.buckets, self.compact_every = spark, folder, buckets, compact_every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _commits(self, kind: str) -> DataFrame:
        """(n, batch) of the commits, or of the bases, which sum up the commits to the n-th."""
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def _mark(self, kind: str, n: int, batch: int | None, parts: int) -> None:
        self.spark.createDataFrame([(n, batch, parts)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/{kind}")

    def committed(self, batch: int) -> bool:
        return not self._commits("commits").where(F.col("batch") == batch).isEmpty()

    def _folders(self, kind: str) -> list[tuple[str, int]]:
        """The last base and the batches since, at most ``compact_every`` of them, and the parts that each one's ledger has."""
        base = self._commits("bases").orderBy(F.desc("n")).first()
        since = self._commits("commits").where(F.col("n") > (base.n if base else 0)).select("batch", "parts").collect()
        return ([(f"{self.folder}/{kind}/base-{base.n}", base.parts)] if base else []) + [(f"{self.folder}/{kind}/batch-{r.batch}", r.parts) for r in since]

    def _part(self, bucket: Column | int, parts: int) -> Column | int:
        """Which of a folder's parts a bucket is in."""
        return bucket * parts // self.buckets if isinstance(bucket, int) else F.floor(bucket * parts / self.buckets).cast("int")

    def current(self, touched: list[int] | None = None) -> DataFrame:
        """What counts now, of all or some buckets: doc_id, version, source, lang, tokens."""
        rows = self.spark.createDataFrame([], LEDGER).select(*STATE, "sign")
        for path, parts in self._folders("ledger"):
            held = self.spark.read.schema(LEDGER).parquet(path)
            if touched is not None:
                held = held.where(F.col("bucket").isin(sorted({self._part(x, parts) for x in touched})) & self._bucket().isin(touched))
            rows = rows.union(held.select(*STATE, "sign"))
        return rows.groupBy(*STATE).agg(F.sum("sign").alias("n")).where("n > 0").select(*STATE)

    def _write_ledger(self, rows: DataFrame, name: str, parts: int) -> str:
        path = f"{self.folder}/ledger/{name}"
        rows.select(*STATE, F.col("sign").cast("long").alias("sign"), self._part(self._bucket(), parts).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return path

    def _parts(self, n: int) -> int:
        return max(1, min(self.buckets, -(-n // ROWS)))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        if self.committed(batch):
            return False
        # read several times below
        changes = cut(changes.select(F.col("doc_id").cast("long"), "op", "version", "source", "lang", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "seq"))
        unnamed = changes.where("doc_id is null and op != 'delete'").select(*STATE, F.lit(1).alias("sign"))
        named = changes.where("doc_id is not null").withColumn("order", F.struct("seq", "op", "tokens", "source", "lang"))
        all_gone = F.col("op").eqNullSafe("delete") & F.col("version").isNull()
        barrier = named.where(all_gone).groupBy("doc_id").agg(F.max("order").alias("barrier"))
        latest = named.where(~all_gone).groupBy("doc_id", "version").agg(F.max("order").alias("last")).join(barrier, "doc_id", "left")
        plus = latest.where((F.col("last.op") != "delete") & (F.col("barrier").isNull() | (F.col("last") > F.col("barrier")))).select("doc_id", "version", "last.source", "last.lang", "last.tokens")
        touched = sorted(r.bucket for r in named.select(self._bucket().alias("bucket")).distinct().collect())
        now, of = self.current(touched).alias("now"), latest.select("doc_id", "version").alias("of")
        changed = now.join(of, (F.col("now.doc_id") == F.col("of.doc_id")) & F.col("now.version").eqNullSafe(F.col("of.version")), "left_semi")
        minus = changed.union(now.join(barrier, "doc_id", "left_semi").select(*STATE)).distinct()
        parts = self._parts(changes.count())
        written = self._write_ledger(minus.withColumn("sign", F.lit(-1)).union(plus.withColumn("sign", F.lit(1))), f"batch-{batch}", parts)
        signed = self.spark.read.schema(LEDGER).parquet(written).select(*STATE, "sign").union(unnamed)
        sums = signed.groupBy("source", "lang", "version").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch-{batch}")
        n = 1 + (self._commits("commits").agg(F.max("n")).first()[0] or 0)
        self._mark("commits", n, batch, parts)
        if n % self.compact_every == 0:
            self._compact(n)
        return True

    def _compact(self, n: int) -> None:
        """Sum up what the commits to the n-th have written."""
        now = cut(self.current())
        parts = self._parts(now.count())
        self._write_ledger(now.withColumn("sign", F.lit(1)), f"base-{n}", parts)
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/deltas/base-{n}")
        self._mark("bases", n, None, parts)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups in which nothing counts any more are left out."""
        rows = self.spark.createDataFrame([], DELTAS)
        for path, _ in self._folders("deltas"):
            rows = rows.union(self.spark.read.schema(DELTAS).parquet(path))
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")


def bpe_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """``docs`` with the number of tokens of a text in the place of the text, by a tokenizers file; null texts have none."""
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .packing import word_tokens

        coder = word_tokens(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = coder.encode(part.column("_text").cast(pa.large_binary()).fill_null(b"").to_pylist())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], names=[*part.schema.names[:-1], name])

    schema = rows.drop("_text").schema
    return rows.mapInArrow(run, schema.add(name, "long"))


def _word_facts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, digest, words, real_words (those with a letter or digit), text."""
    text = F.coalesce("text", F.lit(""))
    words = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return docs.select("doc_id", "source", "lang", F.unhex(F.sha1("text")).alias("digest"), words(r"[^\x20\x09-\x0D]+").alias("words"), words(r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*").alias("real_words"), "text")


def _change(op: str, version: str | None, tokens: str | None) -> list:
    return ["doc_id", F.lit(op).alias("op"), F.lit(version).cast("string").alias("version"), "source", "lang", (F.col(tokens) if tokens else F.lit(0)).alias("tokens"), F.lit(0).alias("seq")]


def change_log(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word counts come in, copies of a text go (the smallest id stays), and word counts are revised to words that hold a letter or digit."""
    first = facts.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copies = facts.where("doc_id is not null and digest is not null").join(first, ["digest", "doc_id"], "left_anti")
    kept = facts.join(copies.select("doc_id"), "doc_id", "left_anti").where("words != real_words and doc_id is not null")
    return facts.select(*_change("insert", "words-1", "words")), copies.select(*_change("delete", None, None)), kept.select(*_change("revise", "words-1", "real_words"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of all documents (see ``change_log``) with token counts besides. The second batch is delivered twice."""
    import public_tokenizers

    rollup = TokenRollup(spark, new_dir(spark, "token-counts"))
    facts = cut(bpe_counts(_word_facts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), public_tokenizers.path("word_bpe_49k.json"), name="bpe"))
    counted = facts.select(*_change("insert", "word_bpe_49k-1", "bpe"))
    inserted, deleted, revised = change_log(facts)
    for batch, changes in enumerate((inserted, counted, deleted, revised), 1):
        rollup.commit(batch, changes)
    rollup.commit(2, counted)
    return rollup.totals()


def word_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with word counts alone, which SQL can express."""
    rollup = TokenRollup(spark, new_dir(spark, "token-counts"), compact_every=2)
    facts = cut(_word_facts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("text"))
    for batch, changes in enumerate(change_log(facts), 1):
        rollup.commit(batch, changes)
    return rollup.totals()


WORD_COUNT_SQL = r"""
WITH f AS (SELECT doc_id, source, lang, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')) AS real_words, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents)
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs, CAST(sum(coalesce(real_words, 0)) AS BIGINT) AS n_tokens FROM f WHERE copy = 1 OR text IS NULL GROUP BY source, lang
"""
