"""Operator 3 [native]: shards by a Feistel permutation with cycle walking over global row numbers.

Rows get dense numbers in the order of their keys; a keyed permutation of 0..n-1 shuffles the
numbers, and shard and slot are the permuted number's remainder and quotient. So both can be
computed from a row number alone, in either direction, and shard sizes are at most one row apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut, shuffle_partitions

#: A walk leaves the rows' range with a chance under 1/2 a step, so it is longer about never (2**-128).
STEPS = 128


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1: Feistel rounds over the least power of two that holds n
    (halves of unequal width swap places), walked on until the number is below n."""

    n: int
    key: int = 0x5EED
    rounds: int = 6

    @property
    def bits(self) -> tuple[int, int]:
        total = max(2, (max(1, self.n) - 1).bit_length())
        return total // 2, total - total // 2

    def _feistel(self, value: Column, inverse: bool) -> Column:
        left, right = self.bits
        steps = [F.struct(F.lit(self.key * 1000 + i).cast("long").alias("key"), F.lit((1 << (right if i % 2 else left)) - 1).cast("long").alias("mask")) for i in range(self.rounds)]

        def forth(at: Column, step: Column) -> Column:
            return F.struct(at["r"].alias("l"), at["l"].bitwiseXOR(F.xxhash64(at["r"], step["key"]).bitwiseAND(step["mask"])).alias("r"))

        def back(at: Column, step: Column) -> Column:
            return F.struct(at["r"].bitwiseXOR(F.xxhash64(at["l"], step["key"]).bitwiseAND(step["mask"])).alias("l"), at["l"].alias("r"))

        halves = F.struct(F.shiftright(value, right).alias("l"), value.bitwiseAND(F.lit((1 << right) - 1).cast("long")).alias("r"))
        return F.aggregate(F.array(*(steps[::-1] if inverse else steps)), halves, back if inverse else forth, lambda x: F.shiftleft(x["l"], right).bitwiseOR(x["r"]))

    def _walk(self, value: Column, inverse: bool) -> Column:
        n = F.lit(self.n).cast("long")
        last = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), self._feistel(value, inverse), lambda x, _: F.when(x < n, x).otherwise(self._feistel(x, inverse)))
        return F.when(last < n, last).otherwise(F.raise_error(F.lit("the walk is too long; take another key")).cast("long"))

    def forward(self, row: Column) -> Column:
        """The permuted number of a row number (long)."""
        return self._walk(row, False)

    def backward(self, number: Column) -> Column:
        """The row number of a permuted number: with ``slot * shards + shard`` it finds a shard's row."""
        return self._walk(number, True)


def numbered(df: DataFrame, keys: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """``df`` with dense row numbers from 0 in the order of ``keys``, and the number of rows.

    One range exchange sorts the rows; only one count a partition comes to the driver. ``keys``
    should tell most rows apart: rows equal in all of them meet in one partition.
    """
    n = shuffle_partitions(df.sparkSession)
    ordered = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())
    total, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, total))
        total += size
    offsets = df.sparkSession.createDataFrame(offsets, "part long, before long")
    joined = ordered.join(F.broadcast(offsets), part == offsets["part"])
    return joined.withColumn(name, F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).drop("_at", "part", "before"), total


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", key: int = 0x5EED) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, row, shard, slot.

    Rows are numbered by (id, size, CRC, text hash, place in the input), so equal input gives equal shards
    whatever its partitions, up to rows that are equal in id and text. Repeated rows are numbered apart. A null
    text counts as no bytes and CRC 0, a null id sorts first; texts may be of any length. An empty table gives an empty result; other columns
    are ignored.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.monotonically_increasing_id().alias("_place"),
    )
    rows, n = numbered(cut(narrow), ["id", "size", "text_crc32", "_hash", "_place"])
    mixed = rows.withColumn("_number", Permutation(n, key).forward(F.col("row")))
    return mixed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "row",
        F.pmod("_number", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_number div {int(shards)}").alias("slot"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))
