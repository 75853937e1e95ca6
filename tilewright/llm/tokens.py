"""Encoding a corpus with a public byte-level tokenizer, and decoding it."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import Scratch, env_path, ship_package

#: Where the vocabulary lies; a parameter of every function here, never part of this repository.
VOCABULARY = env_path("TILEWRIGHT_BYTE_BPE_50K", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pattern by which this vocabulary's pre-tokens are split. The white space of the pattern is Unicode's
#: White_Space, spelled out since engines differ on control characters.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
BLOCK_CHARS = 8 << 20
MAX_VOCABULARY_BYTES = 16 << 20


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file, broadcast; its size is checked."""
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@cache
def _encoder(data: bytes):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=_ranks(data), special_tokens={})


@cache
def _token_bytes(data: bytes) -> list[bytes]:
    ranks = _ranks(data)
    out = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_PRE = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("word", pa.string()), ("code", pa.int32())])


def _pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a document as the codes of its pre-tokens in order, and a block's distinct pre-tokens with their codes."""
    import regex
    from pyspark import TaskContext

    split = regex.compile(PATTERN).findall
    block, room, codes = TaskContext.get().partitionId() << 32, BLOCK_CHARS, _Codes()

    def words() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 50_000):
            part = list(codes)[at : at + 50_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, _PRE.field(2).type), pa.array(part, pa.string()), pa.array(np.arange(at, at + n, dtype=np.int32))], schema=_PRE)

    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        at = 0
        while at < len(ids):
            flat, lengths, start = [], [], at
            while at < len(ids) and room > 0:
                text = texts[at].as_py() or ""
                got = split(text)
                lengths.append(len(got))
                flat.append(np.fromiter(map(codes.__getitem__, got), np.int32, len(got)))
                room -= len(text) + 64
                at += 1
            n = at - start
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids.slice(start, n).cast(pa.int64()), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema=_PRE)
            if room <= 0:
                yield from words()
                block, room, codes = block + 1, BLOCK_CHARS, _Codes()
    yield from words()


def _encode_words(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        last: tuple[str, list[int]] | None = None
        for b in batches:
            d = b.column("word").dictionary_encode()
            if isinstance(d, pa.ChunkedArray):
                d = d.combine_chunks()
            known = d.dictionary.to_pylist()
            ids = [last[1] if last and last[0] == w else enc.encode_ordinary(w) for w in known]
            if known:
                last = (known[-1], ids[-1])
            each = pa.array(ids, pa.list_(pa.int32())).take(d.indices)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("code"), each], names=["block", "code", "ids"])

    return f


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    offsets = np.asarray(a.offsets)
    return np.asarray(a.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    codes, doc_at = _flat(docs.column("codes"))
    ids, at = _flat(words.column("ids"))
    size = words.num_rows
    start, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    code = np.asarray(words.column("code"))
    start[code], length[code] = at[:-1], np.diff(at)
    n = length[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(start[codes] - ends[:-1], n) + np.arange(ends[-1])
    out = pa.ListArray.from_arrays(pa.array(ends[doc_at].astype(np.int32)), pa.array(ids[place].astype(np.int32) if size else np.empty(0, np.int32)))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": out})


def encode_corpus(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): each row's text as token ids, without special tokens; null and empty texts have an empty list.

    Rows come out as they came in, repeated ones and null doc_ids included; texts that look like special tokens are text.
    Texts are split into pre-tokens once. Within a block (bounded by BLOCK_CHARS of text; a longer text is a block alone) each
    distinct pre-token gets a code, and a document becomes the codes of its positions, so that what is shuffled is the distinct
    words of blocks and not their occurrences. Blocks' words are brought together over the whole corpus and each distinct word
    is encoded once; its ids return to the blocks, where documents are put together by position.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "tokens")
    pre = scratch.write(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pre_tokens, "block bigint, doc_id bigint, codes array<int>, word string, code int"))
    words = pre.filter("codes is null").select("word", "block", "code").repartition("word").sortWithinPartitions("word")
    coded = words.mapInArrow(_encode_words(vocabulary(spark, path)), "block bigint, code int, ids array<int>")
    texts = pre.filter("codes is not null").select("block", "doc_id", "codes")
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble, "doc_id bigint, ids array<int>")


def _decode(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(shared.value)
        for b in batches:
            texts = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return f


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): joins the token-byte table, which is as large as the vocabulary and broadcast with it.

    A null list gives a null text; bytes that are no UTF-8 give U+FFFD. Texts of null or no length come back as ''.
    """
    spark = encoded.sparkSession
    ship_package(spark)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary(spark, path)), "doc_id bigint, text string")
