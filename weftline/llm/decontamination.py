"""Operator 7 [native]: benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Documents and items are sequences of lower-case words and the bags of their word shingles. A match has
at least ``percent`` of an item's shingles, so a document without a stretch that dense in shingles of items
of one length is dropped row by row, against a bit table. In the others, windows of
an item's length are laid where one begins with a benchmark shingle and has enough of them for a match
(or at the end of the document): moved right to its first shared shingle, a window loses none, so the best
one is among them. SimHash fingerprints tell which items a window resembles. Windows and items meet by blocks:
of ``parts`` blocks, two fingerprints within ``radius`` have one with at most ``radius // parts`` bits of difference,
and items are looked up under all these variants. Candidates are verified by the exact weighted Jaccard
similarity of the shingle bags (each shingle weighs as often as it occurs).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut

#: Least and most bits of the table of benchmark shingles, as powers of two. A shingle has 16 bits up to the most; a fuller table lets
#: more through to the exact steps.
TABLE_BITS = 16, 24
BLANKS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Lower-case words; an empty text has one empty word."""
    return F.split(F.btrim(F.lower(text), F.lit(BLANKS)), "[ \\t-\\r]+")


def shingles(words: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, in order. ``words`` should be a column, as it is used again and again."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))


def once(value: Column) -> Column:
    """Computes ``value`` here: later filters on it don't compute it anew."""
    return F.explode(F.array(value))


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, print): 64-bit SimHash of the rows (*keys, hash, weight) of each key."""
    sums = [F.sum(F.when(F.shiftright("hash", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"_{b}") for b in range(64)]
    bits = [F.when(F.col(f"_{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    whole = bits[0]
    for x in bits[1:]:
        whole = whole.bitwiseOR(x)
    return rows.groupBy(*keys).agg(*sums).select(*keys, whole.alias("print"))


def blocks(print_: Column, radius: int, parts: int, variants: bool = False) -> Column:
    """The fingerprint's blocks as structs (block, value); with ``variants``, also all values with at most ``radius // parts`` bits changed."""
    edges = [64 * i // parts for i in range(parts + 1)]

    def block(i: int) -> Column:
        width = edges[i + 1] - edges[i]
        value = F.shiftrightunsigned(print_, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = [sum(1 << x for x in bits) for k in range(radius // parts + 1) for bits in combinations(range(width), k)] if variants else [0]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*map(block, range(parts)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, radius: int = 20, parts: int = 7) -> DataFrame:
    """One row per document and item that it holds: id, item_id, start (first word of the best window), length, distance
    (of the fingerprints), shared and total (weights of the intersection and the union: 100 * shared >= percent * total).

    ``benchmark`` has item_id and text. Items of fewer than ``width`` words, null texts and null item ids match nothing.
    A document shorter than an item is one window. Whole texts are searched, however long. Rows that share a document id give the best
    window of any of them. Empty tables give an empty result; other columns are ignored. The items' different lengths come to the driver. At a similarity of 0.75 fingerprints differ in 11 of
    64 bits on average with a deviation of 3, so the default radius reaches about 99.8 % of such pairs, and more of
    closer ones.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    items = items.where("text is not null").select("item_id", once(word_array(F.col("text"))).alias("words"))
    items = items.select("item_id", F.size("words").alias("length"), shingles(F.col("words"), width).alias("hashes")).where(F.size("hashes") > 0)
    items = cut(items.select("item_id", "length", "hashes", F.size("hashes").alias("n")))
    told = items.agg(F.min(F.ceil(F.col("n") * percent / 100)), F.max("length"), F.collect_set("length"), F.sum("n")).first()
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)['item_id']}, start int, length int, distance int, shared long, total long"
    if told[0] is None:
        return spark.createDataFrame([], schema)
    fewest, longest, lengths = int(told[0]), int(told[1]), sorted(told[2])

    # shingles, and shingles with the length of their item
    bits = min(max(TABLE_BITS[0], (32 * int(told[3])).bit_length()), TABLE_BITS[1])
    mask = (1 << bits) - 1
    keys = items.select(F.explode("hashes").alias("h"), "length").select(F.explode(F.array("h", F.xxhash64("h", "length"))).alias("h"))
    table = [0] * (1 << (bits - 6))
    for row in keys.select(F.col("h").bitwiseAND(F.lit(mask)).alias("h")).distinct().toLocalIterator():
        table[row.h >> 6] |= 1 << (row.h & 63)
    table = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in table)), ",").cast("array<bigint>")
    powers = F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))

    def in_table(h: Column) -> Column:
        word = F.get(table, F.shiftright(h, 6).bitwiseAND(F.lit(mask >> 6)).cast("int"))
        return word.bitwiseAND(F.get(powers, h.bitwiseAND(F.lit(63)).cast("int"))) != 0

    read = docs.select(F.col(id_col).alias("id"), once(word_array(F.col(text_col).cast("string"))).alias("words"))
    read = read.select("id", F.size("words").alias("size"), once(shingles(F.col("words"), width)).alias("hashes"))
    hits = F.filter(F.transform("hashes", lambda h, i: F.when(in_table(h), i)), lambda i: i.isNotNull())
    read = read.select("id", "size", "hashes", once(hits).alias("hits")).where(F.size("hits") >= fewest)
    # some run of ``fewest`` hits lies within the longest window
    spread = F.zip_with(F.slice("hits", 1, F.size("hits") - (fewest - 1)), F.slice("hits", fewest, F.size("hits") - (fewest - 1)), lambda a, b: b - a <= longest - width)
    read = read.where(F.exists(spread, lambda x: x))

    def starts(length: Column, own: Column) -> Column:
        """Where windows of a length begin: at hits of items of this length after which enough others follow."""
        held, n = F.least("size", length) - (width - 1), length - (width - 1)
        # so many of a window's ``held`` shingles are shared in any match
        need = F.greatest(F.lit(1), F.ceil(percent * (held + n) / (100 + percent)).cast("int"))
        room = F.greatest(F.lit(0), F.size(own) - (need - 1))
        firsts = F.zip_with(F.slice(own, F.lit(1), room), F.slice(own, need, room), lambda a, b: F.when(b - a < held, a))
        firsts = F.filter(firsts, lambda a: a.isNotNull())
        return F.array_distinct(F.transform(firsts, lambda a: F.greatest(F.lit(0), F.least(a, F.col("size") - length))))

    of_length = lambda n: F.filter("hits", lambda i: in_table(F.xxhash64(F.get("hashes", i), n)))
    # one row for each length, so that its hits are computed once
    read = read.select("id", "size", "hashes", "hits", F.monotonically_increasing_id().alias("row"), F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    dense = read.select("id", "size", "hashes", "row", "length", once(of_length(F.col("length"))).alias("own")).withColumn("starts", starts(F.col("length"), F.col("own"))).where(F.size("starts") > 0)
    dense = cut(dense.select("row", "id", "length", "hashes", "starts"))
    own = items.select("item_id", "length", "n", F.explode("hashes").alias("hash"))

    windows = dense.select("row", "length", "hashes", F.explode("starts").alias("start"))
    bags = windows.select("row", "length", "start", F.explode(F.slice("hashes", F.col("start") + 1, F.col("length") - (width - 1))).alias("hash"))
    bags = cut(bags.groupBy("row", "length", "start", "hash").agg(F.count("*").alias("weight")))
    item_bags = own.groupBy("item_id", "length", "n", "hash").agg(F.count("*").alias("weight"))
    prints = simhash(bags, ["row", "length", "start"]).select("*", F.explode(blocks(F.col("print"), radius, parts)).alias("b"))
    item_prints = simhash(item_bags, ["item_id", "length", "n"]).select("item_id", "length", F.col("n").alias("item_n"), F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), radius, parts, variants=True)).alias("b"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = prints.join(item_prints, ["length", "b"]).select("row", "length", "start", "item_id", "item_n", distance.alias("distance")).where(F.col("distance") <= radius).distinct()

    sizes = bags.groupBy("row", "length", "start").agg(F.sum("weight").alias("n"))
    common = near.join(bags, ["row", "length", "start"]).join(item_bags.select("item_id", "hash", F.col("weight").alias("item_weight")), ["item_id", "hash"])
    common = common.groupBy("row", "length", "start", "item_id", "item_n", "distance").agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    scored = common.join(sizes, ["row", "length", "start"]).withColumn("total", F.col("n") + F.col("item_n") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("total"))
    best = F.max_by(F.struct("start", "length", "distance", "shared", "total"), F.struct(F.col("shared") / F.col("total"), -F.col("start")))
    out = scored.join(dense.select("row", "length", "id"), ["row", "length"]).groupBy("id", "item_id").agg(best.alias("best"))
    return out.select(F.col("id").alias(id_col), "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no item; rows with a null id stay."""
    found = leaks(docs, benchmark, id_col, **how).select(F.col(f"`{id_col}`").alias("_leaking")).distinct()
    return docs.join(found, docs[f"`{id_col}`"] == found["_leaking"], "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("start").alias("start_word"), F.col("length").alias("n_words"), F.round(F.col("shared") / F.col("total"), 6).alias("similarity"))


#: All windows that begin with a shingle of an item of their length (or at the end of the document), without fingerprints.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(words) AS size, i - 1 AS p, array_to_string(words[i : i + 4], ' ') AS gram FROM d, unnest(range(1, len(words) - 3)) AS t(i)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
k AS (SELECT item_id, len(words) AS l, array_to_string(words[i : i + 4], ' ') AS gram, count(*) AS weight FROM b, unnest(range(1, len(words) - 3)) AS t(i) GROUP BY ALL),
hits AS (SELECT doc_id, size, item_id, l, p, gram, weight FROM g JOIN k USING (gram)),
starts AS (SELECT DISTINCT doc_id, l, greatest(0, least(p, size - l)) AS start FROM hits),
scores AS (SELECT doc_id, item_id, l, start, least(size, l) - 4 AS held, sum(least(n, weight)) AS shared FROM (
  SELECT doc_id, size, item_id, l, start, gram, weight, count(*) AS n FROM hits JOIN starts USING (doc_id, l) WHERE p >= start AND p < start + l - 4 GROUP BY ALL) GROUP BY ALL),
found AS (SELECT *, shared / (held + l - 4 - shared) AS similarity FROM scores WHERE 100 * shared >= 75 * (held + l - 4 - shared))
SELECT doc_id, item_id, CAST(start AS INT) AS start_word, CAST(l AS INT) AS n_words, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rank FROM found) WHERE rank = 1
"""
