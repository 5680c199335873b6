"""Whole-corpus encoding with a public tokenizer, each distinct word encoded once.

Texts are cut into pre-tokens by the tokenizer's own pattern. Each block of texts keeps its words once
and a list of word numbers by position; the distinct words of all blocks are encoded once each, their
ids joined back to the blocks, and every text is put together by position.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.persist import cut

#: Folder of the public vocabularies; pass another where they lie elsewhere.
VOCABULARIES = "/opt/tokenizers"
#: Pre-tokens in a block. A block is what one task holds at a time.
BLOCK = 500_000

# The pattern that parts texts before merging, and white space as it understands it.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


@cache
def vocabulary(folder: str, name: str = "byte_bpe_50k"):  # noqa: ANN201
    """The tokenizer, read once per worker from its rank file."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _splitter():  # noqa: ANN202
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def _split(text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]


_PACKED = "block bigint, words array<string>, docs array<bigint>, counts array<int>, codes binary"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of texts: the block's distinct words, its documents, their numbers of words, and the words'
    numbers by position. Written to the shared folder.

    The pattern runs in the JVM; a text with characters newer than its Unicode tables is parted by the
    tokenizer's own splitter instead. Null and empty texts have no words. Whole texts of any length are
    read; one longer than a block is a block by itself.
    """
    t = F.col(text)
    odd = t.rlike(r"\p{Cn}")
    parted = docs.select(F.col(key).cast("bigint").alias("doc"), F.when(~odd, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias("words"), F.when(odd, t).alias("odd"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            words = b.column(1)
            if b.column(2).null_count < len(b):
                whole = [_split(o) if o is not None else w for w, o in zip(words.to_pylist(), b.column(2).to_pylist())]
                words = pa.array(whole, pa.list_(pa.string()))
            counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(counts):
                base = ends[lo] - counts[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, base + block, side="right")))
                coded = words.slice(lo, hi - lo).flatten().dictionary_encode()
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number], pa.int64()),
                        "words": _one(coded.dictionary.cast(pa.string())),
                        "docs": _one(b.column(0).slice(lo, hi - lo)),
                        "counts": _one(pa.array(counts[lo:hi], pa.int32())),
                        "codes": pa.array([_small(np.asarray(coded.indices), len(coded.dictionary))], pa.binary()),
                    }
                )
                number += 1
                lo = hi

    return cut(parted.mapInArrow(blocks, _PACKED), "packed", rows_together=4)


def _small(codes: np.ndarray, words: int) -> bytes:
    """The numbers in two bytes each where they fit, else in four, of which the first byte tells."""
    wide = words > 1 << 16
    return bytes([wide]) + codes.astype("<u4" if wide else "<u2").tobytes()


def _codes(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u4" if stored[0] else "<u2", offset=1).astype(np.int64)


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def encode_words(words: DataFrame, folder: str, name: str) -> DataFrame:
    """``(word, ids)`` for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(folder, name)._core_bpe.encode_single_piece
        for b in batches:
            ids = [encode(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


def _joined(packed: DataFrame, folder: str, name: str) -> DataFrame:
    words = packed.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    return words.join(encode_words(words, folder, name), "word").select("of", "at", "ids")


def _block(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    docs, counts, codes = (block[c].chunk(0)[0] for c in ("docs", "counts", "codes"))
    return docs.values, np.asarray(counts.values), _codes(codes.as_py())


def _by_position(ids: pa.Table, block: pa.Table) -> tuple[pa.Array, np.ndarray, pa.ListArray, np.ndarray]:
    """Documents, ends of their words, the ids of each word, and word numbers by position, of one block."""
    order = np.argsort(np.asarray(ids["at"]))
    table = ids["ids"].combine_chunks()
    if isinstance(table, pa.ChunkedArray):
        table = pa.concat_arrays(table.chunks) if table.num_chunks else pa.array([], pa.list_(pa.int32()))
    docs, counts, codes = _block(block)
    return docs, np.r_[0, np.cumsum(counts)], table.take(pa.array(order)), codes


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, block: int = BLOCK) -> DataFrame:
    """``(key, ids)``: each text's token ids without special tokens.

    An empty text and a null one have the empty list. Special tokens' names in a text are ordinary text.
    Rows repeated under one key come out as often as they went in; other columns aren't carried; an empty
    table gives an empty result.
    """
    packed = pack(docs, key, text, block)

    def reassemble(ids: pa.Table, block: pa.Table) -> pa.Table:
        if block.num_rows == 0:
            return pa.table({key: pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        docs, ends, table, codes = _by_position(ids, block)
        flat = table.take(pa.array(codes))
        lengths = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(flat)).astype(np.int64))] if len(flat) else np.zeros(1, np.int64)
        values = flat.flatten()
        return pa.table({key: docs, "ids": pa.ListArray.from_arrays(pa.array(lengths[ends], pa.int32()), values)})

    return _joined(packed, folder, name).groupBy("of").cogroup(packed.groupBy("block")).applyInArrow(reassemble, f"`{key}` bigint, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, block: int = BLOCK) -> DataFrame:
    """``(key, n_tokens)`` the same way, without the ids leaving the words' table."""
    packed = pack(docs, key, text, block)
    words = packed.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word"))
    sizes = encode_words(words, folder, name).select("word", F.size("ids").alias("n"))
    sized = words.join(sizes, "word").select("of", "at", "n")

    def total(sizes: pa.Table, block: pa.Table) -> pa.Table:
        if block.num_rows == 0:
            return pa.table({key: pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})
        docs, counts, codes = _block(block)
        n = np.zeros(sizes.num_rows, np.int64)
        n[np.asarray(sizes["at"])] = np.asarray(sizes["n"])
        sums = np.r_[0, np.cumsum(n[codes])] if len(codes) else np.zeros(1, np.int64)
        ends = np.r_[0, np.cumsum(counts)]
        return pa.table({key: docs, "n_tokens": pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())})

    return sized.groupBy("of").cogroup(packed.groupBy("block")).applyInArrow(total, f"`{key}` bigint, n_tokens bigint")


def token_bytes(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(id, bytes)`` of every token of the vocabulary: some fifty thousand rows, whatever the corpus."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in (line.split() for line in f if line.strip())]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(key, text)`` back from ``(key, ids)``: ids joined with the table of token bytes and put together by position.

    The table has one row per id of the vocabulary, so it is broadcast and a frequent id is no hot key. Each row is put
    together by itself, rows repeated under one key too; a null list is a null text, an id outside the vocabulary
    makes its text null. A text is as long as its row was.
    """
    tagged = encoded.select(F.col(key).alias("_key"), F.col("ids"), F.monotonically_increasing_id().alias("_row"))
    each = tagged.select("_key", "_row", F.col("ids").isNull().alias("_null"), F.posexplode_outer("ids").alias("_at", "id"))
    table = F.broadcast(token_bytes(encoded.sparkSession, name, folder))
    spelled = each.join(table, "id", "left").select("_key", "_row", "_null", F.struct("_at", F.hex("bytes").alias("b")).alias("_e"), (F.col("id").isNotNull() & F.col("bytes").isNull()).alias("_lost"))
    whole = spelled.groupBy("_row").agg(F.first("_key").alias("_key"), F.max("_null").alias("_null"), F.max("_lost").alias("_lost"), F.array_sort(F.collect_list("_e")).alias("_e"))
    text = F.decode(F.unhex(F.array_join(F.transform("_e", lambda x: x["b"]), "")), "utf-8")
    return whole.select(F.col("_key").cast("bigint").alias(key), F.when(~F.col("_null") & ~F.col("_lost"), text).alias("text"))
