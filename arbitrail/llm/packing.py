"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, and equal lengths are bucketed.

A document of n tokens gives n // LIMIT pieces of LIMIT tokens and then one piece for each binary digit of the rest, the longest
first. A piece is a sequence of its own: its length is a power of two, so that it needs no padding, and no sequence holds
tokens of two documents. Sequences of one length are numbered one after the other, the longest lengths first, so a batch of
equal lengths is a range of numbers within its bucket.

Texts are tokenised once and where they lie. A task numbers its own pieces of each length; what tasks have before them is summed up
over one small row for each task and length. Nothing else is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbitrail.llm.bpe import _texts, tokenizer
from arbitrail.llm.common import attach, give_back, stored, text_bytes

LIMIT, END = 1024, 0
#: Bytes of token ids that are handed on in one batch.
BATCH_BYTES = 4 << 20
PIECE = "doc_id long, start long, length long, doc_tokens long, part int, at long"


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """The lengths of the pieces of n tokens: powers of two, at most ``limit``, the longest first."""
    return [limit] * (n // limit) + [1 << k for k in reversed(range(limit.bit_length() - 1)) if n >> k & 1]


def _cut(docs: DataFrame, path: str, doc_id: str, text: str, limit: int, end: int, last: str, value: Callable[[bytes], object]) -> DataFrame:
    """The pieces of each document with their number among those of the same length and task, and ``value`` of their ids, stored."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the limit has to be a power of two")
    closing = np.uint32(end).astype("<u4").tobytes()
    kind = pa.binary() if last.endswith("binary") else pa.int64()
    names = [f.split()[0] for f in f"{PIECE}, {last}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        part, counts = TaskContext.get().partitionId(), dict.fromkeys((1 << k for k in range(limit.bit_length())), 0)
        rows: list[tuple] = []
        size = 0

        def done():
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), kind]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            bpe, ids, row = tokenizer(path), batch.column(0), 0
            for texts in _texts(batch.column(1)):
                for found in bpe.encode(texts):
                    tokens, start = found + closing, 0
                    for length in binary_lengths(len(tokens) // 4, limit):
                        piece = tokens[4 * start : 4 * (start + length)]
                        rows.append((ids[row].as_py(), start, length, len(tokens) // 4, part, counts[length], value(piece)))
                        counts[length] += 1
                        start += length
                        size += len(piece)
                        if size >= BATCH_BYTES:
                            yield done()
                            rows, size = [], 0
                    row += 1
        if rows:
            yield done()
        give_back()

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return stored(texts.mapInArrow(run, f"{PIECE}, {last}"), "pieces")


def _numbered(pieces: DataFrame) -> DataFrame:
    """The pieces with ``sequence_id``, dense from 0: by length, longest first, then by task and place in it. The sums run over a row for each
    length and task."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "bases")
    return attach(pieces, base, ["length", "part"]).withColumn("sequence_id", F.col("base") + F.col("at"))


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece of each row of ``docs``.

    A document is the ids of its text by the tokenizer at ``path`` and the id ``end``; a null or empty text is that id alone. start: the document's ids before
    the piece; ids_crc32: of its ids as little-endian unsigned 32-bit integers; offset: 0, as each piece is a sequence. Repeated rows
    and ids are packed as often as they come; a null id stays null. Without documents there are no sequences.
    """
    pieces = _numbered(_cut(docs, path, doc_id, text, limit, end, "ids_crc32 long", zlib.crc32))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def sequences(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """(sequence_id, length, doc_id, start, doc_tokens, ids) with the ids as little-endian unsigned 32-bit integers; rows as in ``pack``.

    Write them partitioned by ``length`` to have one folder for each bucket.
    """
    pieces = _numbered(_cut(docs, path, doc_id, text, limit, end, "ids binary", lambda ids: ids))
    return pieces.select("sequence_id", "length", "doc_id", "start", "doc_tokens", "ids")
