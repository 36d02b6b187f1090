"""Operator 4: vector bin packing of examples into training sequences.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. Every task
tokenizes its own rows and packs them as they come: of a pool of waiting examples, the next one
placed is the one that fits and has the largest dot product of its demands with what is left of
the limits (both as shares of the limits). Where none fits whole, the one with the largest
product is cut to fill the sequence. Nothing is shuffled, and a task holds one pool.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import spread

PIECES = pa.schema([
    ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
])
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids array<int>"


#: The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}
#: Texts of plain Latin-1 characters split to pieces like this once in lower case, as the tokenizer's own pattern does
#: (what begins a piece tells its kind, so the order of kinds is free). Texts of the bytes in COMMON are plain.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xff]*")
COMMON = bytes([*range(9, 14), *range(32, 127), 0xC3, *range(0x80, 0xC0)])
PIECES_OF = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


#: The parts of a tokenizers file whose plain texts are split here.
WORD_ENDED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokens:
    """Token ids of texts by a tokenizers file.

    If it is a word-ended byte-level BPE with the parts of ``WORD_ENDED``, plain texts are split to pieces here: ids never depend on what
    lies beyond white space. Pieces seen before come from a table of bounded size, new ones go to the tokenizer's model without its
    normalizer. All other texts, and all texts of any other file, go to the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.known: dict[str, bytes] = {}
        model = spec["model"]
        self.plain = all(spec.get(k) == v for k, v in WORD_ENDED.items()) and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and all(x["content"].startswith("<|") for x in spec.get("added_tokens") or [])
        if not self.plain:
            return
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        #: Whether an id ends a piece.
        self.final = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.final[[i for x, i in model["vocab"].items() if x.endswith("</w>")]] = True

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        if not pieces:
            return []
        mapped = [x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LEVEL) for x in pieces]
        out: list[bytes] = []
        groups = [mapped[i : i + 1000] for i in range(0, len(mapped), 1000)]
        for group, found in zip(groups, self.model.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = [0, *((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(cuts) != len(group) + 1:
                raise ValueError(f"{len(group)} pieces, {len(cuts) - 1} ends")
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        split = [self._pieces(x) for x in texts]
        pieces = set().union(*filter(None, split))
        # what this batch has, few enough to be looked up fast
        near = dict(zip(pieces, map(self.known.get, pieces), strict=True))
        new = [x for x, ids in near.items() if ids is None]
        fresh = dict(zip(new, self._ids(new), strict=True))
        near |= fresh
        if len(self.known) + len(fresh) > self.most:
            self.known = {x: near[x] for x in pieces.difference(new)}
        self.known.update((x, i) for x, i in fresh.items() if len(x) <= self.longest)
        others = [x.decode() for x, own in zip(texts, split, strict=True) if own is None]
        whole = iter(self.whole.encode_batch_fast(others, add_special_tokens=False) if others else [])
        get = near.__getitem__
        return [b"".join(map(get, own)) if own is not None else np.array(next(whole).ids, dtype="<u4").tobytes() for own in split]

    def _pieces(self, text: bytes) -> list[str] | None:
        """None if the text isn't plain."""
        if not self.plain or b"<|" in text:
            return None
        decoded = text.decode()
        return PIECES_OF.findall(decoded.lower()) if not text.translate(None, COMMON) or PLAIN.fullmatch(decoded) else None


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a worker."""
    return WordTokens(path)


@dataclass
class Example:
    id: int | None
    ids: np.ndarray
    loss_from: int
    start: int = 0

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def fitting(self, tokens: int, loss: int) -> int:
        """The most ids from ``start`` on that need no more than these."""
        free = max(0, self.loss_from - self.start)
        return min(len(self.ids) - self.start, tokens, free + loss)


class Packer:
    def __init__(self, tokens: int, segments: int, loss: int, pool: int, first: int, with_ids: bool):
        self.limits, self.most, self.sequence, self.with_ids = (tokens, segments, loss), pool, first, with_ids
        self.pool: list[Example] = []
        #: Tokens and loss-bearing tokens of each example in the pool.
        self.need = np.zeros((2 * pool, 2), dtype=np.int64)
        self.out: list[tuple] = []

    def add(self, x: Example) -> None:
        tokens, _, loss = self.limits
        while len(x.ids) - x.start >= tokens:
            n = x.fitting(tokens, loss)
            self.close([(x, x.start, n)])
            x.start += n
        if x.start < len(x.ids):
            self.pool.append(x)
            self.measure(len(self.pool) - 1)
        if len(self.pool) >= self.most:
            while len(self.pool) > self.most // 2:
                self.fill()

    def measure(self, i: int) -> None:
        left = len(self.pool[i].ids) - self.pool[i].start
        self.need[i] = left, self.pool[i].loss(left)

    def take(self, i: int, n: int) -> tuple[Example, int, int]:
        x = self.pool[i]
        piece = (x, x.start, n)
        x.start += n
        if x.start < len(x.ids):
            self.measure(i)
        else:
            last = self.pool.pop()
            if i < len(self.pool):
                self.pool[i] = last
                self.need[i] = self.need[len(self.pool)]
        return piece

    def fill(self, final: bool = False) -> None:
        """Pack one sequence from the pool."""
        tokens, segments, loss = self.limits
        left_t, left_s, left_l, bin_ = tokens, segments, loss, []
        while self.pool and left_t and left_s:
            need = self.need[: len(self.pool)]
            score = need[:, 0] * (left_t / tokens**2) + need[:, 1] * (left_l / max(1, loss) ** 2) + left_s / segments**2
            fits = (need[:, 0] <= left_t) & (need[:, 1] <= left_l)
            if left_s == 1:
                fits &= need[:, 0] == left_t
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1)))
            else:
                i = int(np.argmax(score))
            n = self.pool[i].fitting(left_t, left_l)
            if not n:
                break
            piece = self.take(i, n)
            bin_.append(piece)
            left_t, left_s, left_l = left_t - n, left_s - 1, left_l - max(0, piece[1] + n - max(piece[1], piece[0].loss_from))
        if not (final and not self.pool):
            self.close(bin_)
            return
        while bin_:  # the last one: cut at powers of two, which need no padding
            room = 1 << (sum(n for *_, n in bin_).bit_length() - 1)
            part, rest = [], []
            for x, start, n in bin_:
                now = min(n, room)
                room -= now
                part += [(x, start, now)] if now else []
                rest += [(x, start + now, n - now)] if n > now else []
            self.close(part)
            bin_ = rest

    def close(self, pieces: list[tuple[Example, int, int]]) -> None:
        offset = 0
        for x, start, n in pieces:
            ids = x.ids[start : start + n]
            loss = max(0, start + n - max(start, x.loss_from))
            self.out.append((x.id, start, n, zlib.crc32(ids.tobytes()), len(x.ids), loss, self.sequence, offset, ids.astype(np.int32) if self.with_ids else None))
            offset += n
        self.sequence += 1

    def finish(self) -> None:
        while self.pool:
            self.fill(final=True)

    def table(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.record_batch([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(PIECES), PIECES, strict=True)], schema=PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokens: int = 2048,
    segments: int = 128,
    loss: int = 2048,
    end_id: int = 1,
    pool: int = 512,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of an example: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset
    and, if wanted, the ids.

    An example is the ids of ``prompt_col`` (they bear no loss), those of ``text_col`` and ``end_id``; null texts
    are empty, so such a row is its end id alone. Texts may be of any length; each id lies in exactly one piece. ``tokenizer`` is the
    path of a tokenizers file. A task's last sequence is cut at powers of two, so
    only sequences that reach the limit on segments or loss are short. Repeated rows are separate examples, an empty
    table has no pieces, other columns are ignored. Sequence ids count up from ``partition << 40``.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits start at 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(tokenizer)
        packer = Packer(tokens, segments, loss, pool, TaskContext.get().partitionId() << 40, with_ids)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts, prompts = (coder.encode(part.column(c).cast(pa.large_binary()).fill_null(b"").to_pylist()) for c in ("text", "prompt"))
                for key, text, prompt in zip(part.column("id").to_pylist(), texts, prompts, strict=True):
                    packer.add(Example(key, np.frombuffer(prompt + text + end, dtype="<u4"), len(prompt) // 4))
                if len(packer.out) > 4000:
                    yield packer.table()
        packer.finish()
        yield packer.table()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_col).cast("string") if prompt_col else F.lit("")).alias("prompt"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of an assistant with the turns before it as its prompt, under limits that all bind: 512 tokens, 6 segments and
    192 tokens that bear loss."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.array_join(F.collect_list(F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))).over(before), "\n")
    examples = turns.withColumn("prompt", asked).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"), "prompt", "text")
    out = pack(examples, public_tokenizers.path("word_bpe_49k.json"), "example_id", prompt_col="prompt", tokens=512, segments=6, loss=192)
    return out.select("example_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")
