"""Spelling variants: words one inserted, deleted or replaced character apart, found by Bloom-guided neighbourhoods.

The vocabulary is counted first: the words of a batch are added up before they travel. Then every word generates its edits (each
pair of words is generated from one side: a deletion from the longer word, a replacement from the smaller character) as 64-bit
hashes, and probes them against Bloom filters of the vocabulary. Filters are sharded by word length and, where a length has many
words, by hash; a shard's blocks are single 64-bit numbers, so that a probe looks at one place. The shards are broadcast in groups of at
most FILTER_BYTES; each further group is a further pass over the vocabulary, never over the texts. Only edits that a filter
lets through travel, as a few numbers each, to an exact join with the vocabulary; the joined words are then compared
character by character, so that neither a filter's nor a hash's mistake is left.

Words are of the letters a-z and U+00C0-U+00FF, a byte each in Latin-1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import _SYMBOL, SLICE_BYTES, _powers, map_batches, mix, stored, text_bytes

MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Bits of a filter for each word, and how many of these a word sets within one block of 64.
BITS_PER_WORD, BITS_SET = 16, 4
#: Bytes of the filters that are broadcast together, and of one shard.
FILTER_BYTES, SHARD_BYTES = 32 << 20, 4 << 20
#: Distinct words of a batch that are counted together before they are handed on.
HELD = 500_000
#: Edits generated in one go.
EDITS = 1 << 20

#: The letters that words are made of, after A-Z have been lower-cased.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Changes a word before it is counted: (doc_id, lower-cased word) to word.
Rewrite = Callable[[int | None, str], str]


# --- vocabulary -----------------------------------------------------------------------------------------


def _pieces(text: str):
    """A text in parts of about a megabyte that cut no word."""
    a = 0
    while a < len(text):
        stop = _BREAK.search(text, a + SLICE_BYTES) if len(text) - a > SLICE_BYTES else None
        b = stop.start() if stop else len(text)
        yield text[a:b]
        a = b


def vocabulary(docs: DataFrame, doc_id: str, text: str, rewrite: Rewrite | None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts with at least that many letters and occurrences. Null texts have none."""

    def work(batch):
        counts: Counter[str] = Counter()

        def done():
            words = [w for w in counts if len(w) >= min_letters]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

        for number, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _pieces(value.as_py().decode("utf-8", "replace")):
                found = Counter(_RUN.findall(part.translate(_LOWER)))
                if rewrite:
                    for w, n in found.items():
                        counts[rewrite(number, w)] += n
                else:
                    counts.update(found)
                if len(counts) > HELD:
                    yield from done()
                    counts.clear()
        yield from done()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    counted = map_batches(rows, work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


# --- hashes of words and of their edits -----------------------------------------------------------------


def _finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of each row of a table of letters, words of one length."""
    power = _powers(letters.shape[1])[0][: letters.shape[1]]
    return _finish((_SYMBOL[letters] * power).sum(1, dtype=np.uint64), letters.shape[1])


def _tables(words: list[str]):
    """(rows, letters) of the words of each length, some at a time."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, rows in by_length.items():
        step = max(1, EDITS // (length * len(LETTERS)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            data = "".join([words[i] for i in part]).encode("latin-1")
            yield np.array(part), np.frombuffer(data, np.uint8).reshape(len(part), length)


def edits(letters: np.ndarray):
    """(length, row, hash) of the edits of words of one length: each other word a letter shorter, once, and each one with one
    letter replaced by a greater one. A part of the places at a time."""
    n, length = letters.shape
    power, inverse = (p[:length] for p in _powers(length))
    value = _SYMBOL[letters] * power
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(value, axis=1, out=before[:, 1:])
    total = before[:, -1:]
    step = max(1, EDITS // (n * len(LETTERS)))
    for a in range(0, length, step):
        b = min(length, a + step)
        if length > 1:
            shorter = before[:, a:b] + (total - before[:, a + 1 : b + 1]) * inverse[1]
            last = np.ones((n, b - a), bool)  # of equal letters side by side only the last goes: the others give the same
            if b > a:
                inner = min(b, length - 1) - a
                last[:, :inner] = letters[:, a : a + inner] != letters[:, a + 1 : a + 1 + inner]
            row, at = np.nonzero(last)
            yield length - 1, row, _finish(shorter[row, at], length - 1)
        greater = LETTERS[None, None, :] > letters[:, a:b, None]
        row, at, to = np.nonzero(greater)
        place = at + a
        changed = total[row, 0] + (_SYMBOL[LETTERS[to]] - _SYMBOL[letters[row, place]]) * power[place]
        yield length, row, _finish(changed, length)


# --- filters --------------------------------------------------------------------------------------------


def bits(h: np.ndarray) -> np.ndarray:
    """The bits that a hash sets within its block."""
    out = np.zeros(len(h), np.uint64)
    for i in range(BITS_SET):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def groups_of(counts: list[tuple[int, int]], limit: int = FILTER_BYTES, shard: int = SHARD_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """Shards (length, part, parts, words) in groups whose filters have at most ``limit`` bytes."""
    groups: list[list[tuple[int, int, int, int]]] = []
    size = limit + 1
    for length, n in sorted(counts):
        parts = max(1, -(-n * BITS_PER_WORD // (8 * shard)))
        each = -(-n // parts)
        for part in range(parts):
            need = each * BITS_PER_WORD // 8 + 8
            if size + need > limit:
                groups.append([])
                size = 0
            groups[-1].append((length, part, parts, each))
            size += need
    return groups


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The shard of a hash."""
    return ((mix(h) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Filter:
    """The Bloom filters of one group of shards (length, part, parts, words), laid out in one array of blocks."""

    def __init__(self, group: list[tuple[int, int, int, int]]):
        self.parts = {length: parts for length, _, parts, _ in group}
        self.shards: dict[tuple[int, int], tuple[int, int]] = {}
        total = 0
        for length, part, _, n in group:
            size = max(1, -(-n * BITS_PER_WORD // 64))
            self.shards[length, part] = (total, size)
            total += size
        self.blocks = np.zeros(total, np.uint64)

    def places(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes of words of a length belong to this group, their blocks)."""
        part = _part(h, self.parts[length])
        place = np.full(len(h), -1)
        for p in range(self.parts[length]):
            if (length, p) in self.shards:
                first, size = self.shards[length, p]
                mine = part == p
                place[mine] = first + ((h[mine] >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        here = np.flatnonzero(place >= 0)
        return here, place[here]

    def may_have(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes of words of a length that may be in the vocabulary."""
        if length not in self.parts:
            return np.zeros(0, np.int64)
        here, place = self.places(length, h)
        want = bits(h[here])
        return here[(self.blocks[place] & want) == want]


def build(words: DataFrame, group: list[tuple[int, int, int, int]]) -> Filter:
    """The filter of a group over (letters, key): tasks make the bits, blocks are added up by Spark; the driver gets one row for each block."""
    empty = Filter(group)

    def work(batch):
        lengths, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for length in np.unique(lengths):
            own = h[lengths == length]
            here, place = empty.places(int(length), own)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bits(own[here]).view(np.int64))], ["block", "bits"])

    wanted = words.where(F.col("letters").isin(sorted(empty.parts))).select("letters", "key")
    found = map_batches(wanted, work, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.blocks[found["block"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return empty


# --- neighbours -----------------------------------------------------------------------------------------


def _keys(batch):
    """(word, n, letters, key)."""
    words = batch.column(0).to_pylist()
    key = np.zeros(len(words), np.uint64)
    for rows, letters in _tables(words):
        key[rows] = word_hashes(letters)
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(key.view(np.int64))], ["word", "n", "letters", "key"])


def _probe(batch, found_in: Filter):
    """(key, edit): hashes of words and of those of their edits that the filter lets through."""
    words, key = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    for rows, letters in _tables(words):
        if letters.shape[1] not in found_in.parts and letters.shape[1] - 1 not in found_in.parts:
            continue
        for length, row, h in edits(letters):
            hit = found_in.may_have(length, h)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows[row[hit]]]), pa.array(h[hit].view(np.int64))], ["key", "edit"])


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of (word, n, letters, key) one edit apart, once."""
    spark = words.sparkSession
    counts = [(r["letters"], r["count"]) for r in words.groupBy("letters").count().collect()]  # a row for each length of a word
    pairs = None
    for group in groups_of(counts, filter_bytes, shard_bytes):
        shared = spark.sparkContext.broadcast(build(words, group))
        lengths = {length + more for length, *_ in group for more in (0, 1)}
        mine = words.where(F.col("letters").isin(sorted(lengths))).select("word", "key")
        found = stored(map_batches(mine, lambda b, shared=shared: _probe(b, shared.value), "key long, edit long"), "edits")
        shared.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).where("false")
    to = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("key").alias("edit"))
    of = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key")
    joined = pairs.join(to, "edit").join(of, "key")
    return joined.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) by pointer jumping. A form has a larger count than its word, so that chains end; their length is
    at most the logarithm of the largest count, the number of rounds the logarithm of that."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return at


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rewrite: Rewrite | None = None,
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    ratio: float = RATIO,
    filter_bytes: int = FILTER_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(word, n, form, root, n_near, form_n), a row for each word of ``docs`` with enough letters and occurrences.

    form: the near word of largest n, of equal ones the smallest, if that is at least ``ratio`` times the word's n; root: where
    forms lead from the word, itself without any. Null and empty texts have no words; without words there are no rows. Repeated
    rows count as often as they come. Other columns aren't read.
    """
    words = stored(map_batches(vocabulary(docs, doc_id, text, rewrite, min_letters, min_count), _keys, "word string, n long, letters long, key long"), "words")
    pairs = stored(near_pairs(words, filter_bytes, shard_bytes), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = F.min_by("near", F.struct(-F.col("m"), F.col("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.max("m").alias("best_n"))
    known = words.select("word", "n").join(near, "word", "left")
    passes = F.col("best_n") >= F.lit(ratio) * F.col("n")
    known = stored(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(passes, F.col("best")).alias("form"), F.when(passes, F.col("best_n")).alias("form_n")), "forms"
    )
    root = roots(known.where("form is not null").select("word", "form"))
    return known.join(root, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
