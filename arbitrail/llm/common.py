"""What several operators of this subpackage share: array kernels for words, size-checked joins, tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.session import remove_folder, shared_dir

#: A side is broadcast only while it has at most this many bytes; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that the array kernels look at in one go. One longer text is one slice.
SLICE_BYTES = 1 << 20
#: Rows whose texts are rewritten in one go.
REWRITTEN = 1000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SYMBOL = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _POWERS or len(_POWERS["n"]) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("n", _BASE), ("inverse", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["n"], _POWERS["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of consecutive texts, as places in one byte array.

    data: the bytes; starts, ends: of each word; first: number of the first word of each text, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~_WHITE[data]
        fresh = np.ones(n + 1, bool)  # no word reaches over this place from the left
        fresh[1:n] = ~solid[:-1]
        fresh[offsets] = True
        self.starts = np.flatnonzero(solid & fresh[:n])
        stop = np.ones(n, bool)
        stop[: n - 1] = ~solid[1:] | fresh[1:n]
        self.ends = np.flatnonzero(solid & stop) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        powers, inverse = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_SYMBOL[self.data] * powers[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + h[j : len(h) - n + 1 + j])
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of a binary column with about ``limit`` bytes each."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(where, where[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[where[a] : where[b]], where[a : b + 1] - where[a]
        a = b


def chunks(column: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def slice_words(batch: pa.RecordBatch, name: str, lower: bool) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in text_slices(batch.column(batch.schema.get_field_index(name))):
        yield a, b, Words(data, offsets, lower)


def text_bytes(name: str) -> Column:
    """A text column as bytes; nulls are empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, text): rows of one id and one text share a key; rows of one id and different texts don't.

    Only these columns are read, so that other columns of any name do no harm.
    """
    body = text_bytes(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def same_key(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of keys, still a hash or merge join."""
    out = None
    for name in names:
        one = left[name].eqNullSafe(right[name])
        out = one if out is None else out & one
    return out


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: a short lineage that survives lost executors."""
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


def remove_stored(df: DataFrame) -> None:
    """Deletes a table that ``stored`` made, once nothing that is still to be computed reads it."""
    for folder in {f.rsplit("/table/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], bytes_of_facts: Column | None = None) -> DataFrame:
    """Left join of ``facts``, at most one for each key, to ``rows``.

    ``facts`` is a stored table. While it is small (its size is measured) it is broadcast and ``rows`` stay where they
    are; else both are shuffled. Both ways give the same rows.
    """
    per_row = F.lit(16 * len(keys)) if bytes_of_facts is None else bytes_of_facts + 16 * len(keys)
    size = facts.agg(F.sum(per_row.cast("long"))).first()[0] or 0
    right = F.broadcast(facts) if size <= BROADCAST_BYTES else facts
    joined = rows.join(right, same_key(rows, facts, keys), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[facts[c] for c in facts.columns if c not in keys])


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers go on to other tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        give_back()

    return df.mapInArrow(run, schema)


def rewrite_texts(df: DataFrame, text: str, work: Callable[[list], list]) -> DataFrame:
    """The rows with the same columns, their text replaced by what ``work`` makes of a list of texts: bytes, null, or
    False for a row that goes. Other columns pass by untouched, whatever their names."""
    schema = df.schema
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for a in range(0, batch.num_rows, REWRITTEN):  # a part at a time, so that few texts are in memory twice
                part = batch.slice(a, REWRITTEN)
                column = part.column(place)
                out = work(column.cast(pa.binary()).to_pylist())
                keep = pa.array([x is not False for x in out], pa.bool_())
                texts = pa.array([x if x is not False else None for x in out], pa.binary()).cast(column.type)
                arrays = [texts if i == place else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(keep)
        give_back()

    return df.mapInArrow(run, schema)


def numbered_runs(df: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """The rows in a global order: range-sorted, stored, with the number of the range in ``run``.

    Ranges split ties by every column of ``order``. The stored numbers stay what they are when a task is repeated.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return stored(ranged.withColumn("run", F.spark_partition_id()), purpose)


def connected(links: DataFrame, purpose: str = "links") -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches.

    Alternates the two star contractions: every node's larger, then every node's smaller neighbours are linked with its
    smallest one. Each round is a grouped minimum and a join on stored tables, in a number of rounds near the logarithm
    of the longest path. A node with very many neighbours is only ever aggregated or joined, never gathered.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a <> b"), purpose)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = stored(small.where("a <> b").distinct(), purpose)
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state

