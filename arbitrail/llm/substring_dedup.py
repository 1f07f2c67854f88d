"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among its runs of ``core`` words. Consecutive
windows with one minimiser form a super-k-mer, which travels as one packed string to the minimiser's bucket; equal windows
always meet in one bucket, where sorting them counts them exactly, word by word.

1. The super-k-mers of all texts, without their words, are counted by minimiser. One whose minimiser no other super-k-mer
   has can't hold a repeated window and need not travel. The minimisers that count are marked in a bit field of fixed size;
   a wrongly marked one only makes a string travel in vain.
2. The others are packed from the texts. Of equal strings of a batch only one travels, with their number. A minimiser with
   more than HOT super-k-mers is too common for one bucket: its windows travel singly, each in a bucket of its own hash.
3. In each bucket the windows are sorted; those met twice or more give the spans to remove.

Hashes only decide what meets where: words are compared as they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import Words, attach, give_back, gram_hashes, keyed, map_batches, slice_words, stored, text_bytes

WINDOW, CORE = 35, 8
HOT = 10_000
#: Size of the bit field of minimisers: 16 MB.
FIELD_BITS = 1 << 27
KEY = ["doc_id", "text_key"]


def super_kmers(words: Words, window: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, number of windows, minimiser, whether the minimiser stands in two places) of each."""
    h = words.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    grams = gram_hashes(h, core)
    reach = window - core + 1
    low, width = grams, 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(grams) - reach + 1], low[reach - width :])
    doc = words.doc_of_word()
    at = np.arange(len(low))
    at = at[doc[: len(low)] == doc[window - 1 :]]
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    value = low[at]
    head = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (value[1:] != value[:-1])))
    count = np.diff(np.append(head, len(at)))
    first, value = at[head], value[head]
    last = first + count - 1
    leftmost = first + _first_place(grams, first, value, reach)
    rightmost = last + reach - 1 - _first_place(grams, last, value, reach, backwards=True)
    text = doc[first]
    return text, first - words.first[text], count, value, leftmost != rightmost


def _first_place(grams: np.ndarray, at: np.ndarray, value: np.ndarray, reach: int, backwards: bool = False) -> np.ndarray:
    out = np.full(len(at), -1)
    for j in range(reach):
        k = reach - 1 - j if backwards else j
        out[(out < 0) & (grams[at + k] == value)] = j
    return out


def _minimisers(batch, window, core):
    for _, _, words in slice_words(batch, "text", False):
        _, _, _, value, twice = super_kmers(words, window, core)
        if len(value):
            value, back, times = np.unique(value, return_inverse=True, return_counts=True)
            again = np.zeros(len(value), bool)
            again[back[twice]] = True
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times), pa.array(again)], ["minimiser", "times", "twice"])


def shared_minimisers(texts: DataFrame, window: int, core: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit field of the minimisers of several super-k-mers or of two places of one, sorted common ones).

    The field has FIELD_BITS bits. Common ones have more than ``hot`` super-k-mers and more than one in 2**20 of all, so
    there are at most 2**20.
    """
    counts = map_batches(texts, lambda b: _minimisers(b, window, core), "minimiser long, times long, twice boolean")
    counts = stored(counts.groupBy("minimiser").agg(F.sum("times").alias("times"), F.max("twice").alias("twice")), "minimisers")
    shared = counts.where("times > 1 or twice")
    place = F.col("minimiser").bitwiseAND(F.lit(FIELD_BITS - 1))
    one = F.expr(f"shiftleft(1L, cast((minimiser & {FIELD_BITS - 1}) & 63 as int))")
    cells = shared.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    field = np.zeros(FIELD_BITS // 64, np.int64)
    field[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    total = counts.agg(F.sum("times")).first()[0] or 0
    common = counts.where(F.col("times") > max(hot, total >> 20)).select("minimiser").toArrow()["minimiser"].to_numpy()
    return field, np.sort(common)


def _pack(batch, window, core, field, common):
    """Places and strings of the super-k-mers whose minimiser is marked; of equal strings of a batch one has its words."""
    ids, keys = batch.column(0), batch.column(1)
    for a, _, words in slice_words(batch, "text", False):
        text, first, count, value, _ = super_kmers(words, window, core)
        place = (value & np.uint64(FIELD_BITS - 1)).astype(np.int64)
        marked = (field[place >> 6] >> (place & 63)) & 1 == 1
        if not marked.any():
            continue
        text, first, count, bucket = text[marked], first[marked], count[marked], value[marked].view(np.int64)
        hot = np.isin(bucket, common)
        if hot.any():
            single = np.repeat(np.arange(len(text))[hot], count[hot])
            step = np.arange(len(single)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
            bucket = np.concatenate([bucket[~hot], np.zeros(len(single), np.int64)])
            text, first, count = (np.concatenate(x) for x in ((text[~hot], text[single]), (first[~hot], first[single] + step), (count[~hot], np.ones(len(single), np.int64))))
            own = np.arange(len(text)) >= (~hot).sum()
        else:
            own = np.zeros(len(text), bool)
        raw = words.data.tobytes()
        begin = words.first[text] + first
        starts, ends = words.starts[begin].tolist(), words.ends[begin + count + window - 2].tolist()
        strings = [b" ".join(raw[x:y].split()) for x, y in zip(starts, ends, strict=True)]
        names = [hashlib.blake2b(x, digest_size=16).digest() for x in strings]
        buckets = [int.from_bytes(n[:8], "little", signed=True) if o else b for n, o, b in zip(names, own.tolist(), bucket.tolist(), strict=True)]
        times = Counter(names)
        number = [times.pop(n, 0) for n in names]  # all of a batch's equal strings count with the first
        packed = [x if n else None for n, x in zip(number, strings, strict=True)]
        at = pa.array(text + a)
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), keys.take(at), pa.array(buckets, pa.int64()), pa.array(packed, pa.binary()), pa.array(names, pa.binary()), pa.array(first.astype(np.int32)), pa.array(number, pa.int64())],
            ["doc_id", "text_key", "bucket", "packed", "name", "first", "times"],
        )


def repeated_places(strings: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """Word spans of each string that repeated windows cover. A string comes with the number of its occurrences."""
    rows = []
    for s, (packed, times) in enumerate(strings):
        edges = [-1]
        at = packed.find(b" ")
        while at >= 0:
            edges.append(at)
            at = packed.find(b" ", at + 1)
        edges.append(len(packed))
        rows += [(packed[edges[i] + 1 : edges[i + window]], s, i, times) for i in range(len(edges) - window)]
    rows.sort()
    spans: list[list[tuple[int, int]]] = [[] for _ in strings]
    i = 0
    while i < len(rows):
        j, total = i, 0
        while j < len(rows) and rows[j][0] == rows[i][0]:
            total += rows[j][3]
            j += 1
        if total > 1:
            for _, s, place, _ in rows[i:j]:
                spans[s].append((place, place + window))
        i = j
    return [merged(sorted(x)) for x in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<a: int, b: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _count_buckets(window):
    """Over rows sorted by bucket and string: (bucket, packed, times)."""

    def finish(bucket, strings, out):
        for (packed, _), spans in zip(strings, repeated_places(strings, window), strict=True):
            if spans:
                out.append((bucket, hashlib.blake2b(packed, digest_size=16).digest(), [{"a": a, "b": b} for a, b in spans]))

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], _SPAN_TYPE)], ["bucket", "name", "found"])

    def run(batches):
        current, strings, out = None, [], []
        for batch in batches:
            for bucket, packed, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != current and strings:
                    finish(current, strings, out)
                    strings = []
                current = bucket
                if strings and strings[-1][0] == packed:
                    strings[-1] = (packed, strings[-1][1] + times)
                else:
                    strings.append((packed, times))
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        if strings:
            finish(current, strings, out)
        if out:
            yield batch_of(out)
        give_back()

    return run


def find_repeats(texts: DataFrame, window: int = WINDOW, core: int = CORE, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, spans of words [a, b)) of every text that has a window whose words also start anywhere else.

    ``texts`` is (doc_id, text_key, text) as ``keyed`` gives it. Words are runs of anything but ASCII white space.
    Repeated rows repeat each other's windows. Texts of fewer than ``window`` words have none.
    """
    spark = texts.sparkSession
    marks = spark.sparkContext.broadcast(shared_minimisers(texts, window, core, hot))
    schema = "doc_id long, text_key long, bucket long, packed binary, name binary, first int, times long"
    packed = stored(map_batches(texts, lambda b: _pack(b, window, core, *marks.value), schema), "packed")
    strings = packed.where("times > 0").select("bucket", "packed", "times")
    strings = strings.repartition("bucket").sortWithinPartitions("bucket", "packed")
    found = stored(strings.mapInArrow(_count_buckets(window), f"bucket long, name binary, found {SPANS}"), "found")
    places = packed.select("doc_id", "text_key", "bucket", "name", "first").join(found, ["bucket", "name"])
    moved = F.transform("found", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    spans = places.select(*KEY, moved.alias("spans")).groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return stored(spans, "spans")


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    return attach(texts, spans, KEY, F.size("spans") * 8)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of ``docs``; null and empty texts have no words."""
    texts = keyed(docs, doc_id, text)
    rows = with_spans(texts, find_repeats(texts, window, core)).select("doc_id", "text", "spans")

    def work(batch):
        counts, gone, kept = [], [], []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = data.split()
            left, at = [], 0
            for a, b in merged([(s["a"], s["b"]) for s in spans or ()]):
                left += words[at:a]
                at = b
            left += words[at:]
            counts.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(rows, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, each cut from where a word starts to where the next kept one does."""
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), False)
    places = [*words.starts.tolist(), len(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a]])
        at = places[b]
    out.append(data[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, core: int = CORE) -> DataFrame:
    """The rows of ``docs`` with the same columns, whatever their names; repeated passages are cut out of the texts.

    A text with nothing to remove stays as it is, a null text too. A text that loses all its words becomes empty.
    """
    texts = keyed(docs, doc_id, text)
    spans = find_repeats(texts, window, core)
    body = text_bytes(text)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"))
    rows = attach(rows, spans, KEY, F.size("spans") * 8)

    @F.pandas_udf("string")
    def shortened(data: pd.Series, found: pd.Series) -> pd.Series:
        out = [None if d is None or s is None else cut_words(bytes(d), merged([(x["a"], x["b"]) for x in s])).decode("utf-8", "replace") for d, s in zip(data, found, strict=True)]
        return pd.Series(out, dtype=object)

    whole = F.col("row").getField(text)
    touched = F.when(F.col("spans").isNotNull(), whole.cast("binary"))
    new = F.coalesce(shortened(touched, F.col("spans")), whole)
    return rows.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])

