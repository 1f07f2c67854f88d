"""Scores texts under a probabilistic suffix tree over words and under a word unigram model, both counted over the corpus.

The tree's symbols are all words and the end of a text. A context, a run of words before a word, becomes a state when it was
seen MIN_COUNT times or more and its next words diverge from those of its parent, the context without its oldest word, by
more than chance: the gain is count times Kullback-Leibler divergence, less one for each cell, and has to reach MIN_GAIN. Cells
are the next words seen LEAST times or more, the usual least size of a cell in such a test, and all others pooled. Contexts grow
word by word, up to the first length, from two on, at which no context of the corpus passes; a longer one that tells more after
such a gap isn't looked for. Nothing else bounds the tree: it has as many words, contexts and lengths as pass the tests. A state's distribution is smoothed towards the next shorter state's; the pooled words
share what is left in the proportions they have there. The root's is the unigram one. Each word is scored in the longest state
that is a suffix of what came before in its text. Unigram shares are discounted by DISCOUNT of a word each; what that frees is
the share of all unseen words together.

A score is the sum of unigram logarithms and of what the states change in them. Unigram counts cover the whole vocabulary: the
words met most often, at most FREQUENT, have their counts sent to the scoring tasks; every other word's occurrences meet its
count in a shuffle by word. The states are stored tables, sent to the scoring tasks in parts of about BROADCAST_BYTES by the
newest word of the context; a further part costs a further pass over the texts.

Contexts of one and two words are counted in a pass over the texts each, longer ones over windows of the texts that are stored once: the
stretches in which longer contexts can be seen often enough. Only occurrences travel whose context and whose next word after
the shorter context can be counted often enough, by two bit fields of fixed size; what they let through by mistake is sorted out
by the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import BROADCAST_BYTES, Words, _powers, map_batches, mix, remove_stored, stored, text_bytes, text_slices

FREQUENT = 1 << 18
MIN_COUNT, MIN_GAIN, LEAST = 50, 20.0, 5
PULL = 20.0
DISCOUNT = 0.5
FOLDS = 10
#: The hash of a text's end, which also stands before its first word.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of a bit field, as a power of two: 16 MB.
FIELD = 27
#: Rows of a batch's counts that are held before they are added up.
HELD = 1 << 20


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether texts of this id are left out of the counts; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the frequent words, and their counts."""

    hashes: np.ndarray
    sizes: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether frequent) of each word hash."""
        return find(self.hashes, h)


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each value in sorted keys."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _often(batch):
    """(word, n): each training word of a batch with its count, and as the null word the batch's words and texts."""
    texts = batch.column(1).filter(pc.invert(batch.column(0)))
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    seen: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(texts):
        seen.append(Words(data, offsets, True).hashes())
        if sum(map(len, seen)) > 1 << 20:  # a batch may hold far more words than distinct ones
            counted, seen = [*counted, np.unique(np.concatenate(seen), return_counts=True)], []
    if not len(texts):
        return
    values, times = _added([*counted, *(np.unique(h, return_counts=True) for h in seen)])
    total = int(times.sum())
    word = pa.array(np.append(values.view(np.int64), 0), mask=np.append(np.zeros(len(values), bool), True))
    texts_of = np.append(np.zeros(len(values), np.int64), len(texts))
    yield pa.RecordBatch.from_arrays([word, pa.array(np.append(times, total)), pa.array(texts_of)], ["word", "n", "texts"])


def _added(parts):
    """Counts by key, of several such."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


# --- contexts -------------------------------------------------------------------------------------------


def sequence(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place in its text, text) of the words of a slice, with an end before and behind each text."""
    size = np.diff(words.first) + 2
    out = np.full(int(size.sum()), END)
    out[np.arange(len(h)) + 2 * words.doc_of_word() + 1] = h
    begins = np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
    return out, np.arange(len(out)) - begins, np.repeat(np.arange(len(size)), size)


class Grams:
    """Hashes of the k words up to a place of a slice, for any k, from sums over the slice: a longer context costs no more."""

    def __init__(self, h: np.ndarray):
        self.h = h
        power, self.inverse = _powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h) * power[: len(h)], out=self.sums[1:])

    def upto(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the k words up to each place of ``at``; a single word's is its own."""
        if k == 1:
            return self.h[at]
        first = at + 1 - k
        return mix((self.sums[at + 1] - self.sums[first]) * self.inverse[first] + np.uint64(k))


def marked(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - FIELD)
    return (field[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bit_field(grams: DataFrame) -> np.ndarray:
    """A bit for each value of column ``gram``; its words, never more than the field has, come to the driver."""
    bit = F.shiftrightunsigned("gram", 64 - FIELD)
    bits = grams.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FIELD}) & 63 as int))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD - 6), np.uint64)
    field[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return field


WINDOWS = "words binary, lengths binary"
#: From this length of contexts on, only windows of the texts are read.
WINDOWS_FROM = 3


def _sequences(batch):
    """(hashes, place in its text or window) of the training texts of a batch of (held_out, text) or of its windows, a slice at a time."""
    if batch.schema.names == ["words", "lengths"]:
        for words, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h, size = np.frombuffer(words, np.uint64), np.frombuffer(lengths, np.int64)
            yield h, np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        return
    for _, _, data, offsets in text_slices(batch.column(1).filter(pc.invert(batch.column(0)))):
        words = Words(data, offsets, True)
        yield sequence(words, words.hashes())[:2]


def _windows(batch, k: int, contexts: np.ndarray):
    """The stretches of training texts that contexts of k words or more can lie in, with the words after them.

    A context of k + 1 words is seen often enough only if both contexts of k words within it are. So a window that begins with
    the first of a row of such contexts of k words holds all longer ones of that row.
    """
    for h, place in _sequences(batch):
        at = np.flatnonzero(place >= k)
        at = at[marked(contexts, Grams(h).upto(at - 1, k))]
        if len(at):
            first = at[np.append(True, (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]] + 1))]
            last = at[np.append((at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]] + 1), True)]
            size = last - first + 1 + k
            where = np.repeat(first - k - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h[where], size.astype(np.int64))], ["words", "lengths"])


COUNTED = "gram long, context long, suffix long, n long"


def _count(batch, k: int, fields: tuple[np.ndarray, np.ndarray]):
    """(gram, context, suffix, n): how often a word follows k others in training texts. gram names all k + 1, context the k
    before the word, suffix the last k."""
    parts: list[list[np.ndarray]] = []
    held = 0
    for h, place in _sequences(batch):
        grams = Grams(h)
        at = np.flatnonzero(place >= k)
        at = at[marked(fields[0], grams.upto(at - 1, k))]
        suffix = grams.upto(at, k)
        passes = marked(fields[1], suffix)
        at, suffix = at[passes], suffix[passes]
        context, whole = grams.upto(at - 1, k), grams.upto(at, k + 1)
        names, first, times = np.unique(whole, return_index=True, return_counts=True)
        parts.append([names, context[first], suffix[first], times])
        held += len(names)
        if held > HELD:
            parts = [_met(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield _counts_of(parts.pop())
            held = sum(len(p[0]) for p in parts)
    if parts:
        yield _counts_of(_met(parts))


def _met(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    names, context, suffix, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, first, number = np.unique(names, return_index=True, return_inverse=True)
    return [names, context[first], suffix[first], np.bincount(number, times, len(names)).astype(np.int64)]


def _counts_of(part: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in part], ["gram", "context", "suffix", "n"])


def level(counted: DataFrame, totals: DataFrame, before: DataFrame, min_count: int, min_gain: float) -> tuple[DataFrame, DataFrame]:
    """Contexts one word longer than those of ``before``: (table, states).

    table: (gram, context, n, total, newest, chance, root, is_state) of next words seen LEAST times or more, chance as the tree
    gives it after this context, root after none. states: (context, newest, alpha) of the contexts that pass; alpha is
    log10 of what a pooled word's share in the next shorter state is multiplied by.
    """
    shorter = before.select(F.col("gram").alias("suffix"), (F.col("n") / F.col("total")).alias("above"), F.col("chance").alias("shorter"), "root", "newest")
    rows = counted.where(F.col("n") >= LEAST).join(totals.where(F.col("total") >= min_count), "context").join(shorter, "suffix")
    rows = stored(rows.withColumn("newest", F.coalesce("newest", "context")), "followers")
    each = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("above"))
    sums = rows.groupBy("context", "newest", "total").agg(
        F.sum("n").alias("n"), F.sum(each).alias("parted"), F.sum("above").alias("above"), F.sum("shorter").alias("shorter"), F.count("*").alias("cells")
    )
    rest = F.col("total") - F.col("n")
    pooled = F.when(rest > 0, rest * F.log(rest / F.col("total") / F.greatest(1 - F.col("above"), F.lit(1e-12)))).otherwise(0.0)
    left = F.greatest(1 - F.col("shorter"), F.lit(1e-12))
    alpha = F.log10((rest + PULL * left) / (F.col("total") + PULL) / left)
    passed = F.round(F.col("parted") + pooled - F.col("cells"), 6) >= min_gain
    states = stored(sums.where(passed).select("context", "newest", alpha.alias("alpha")), "states")
    known = states.select("context", F.lit(True).alias("is_state"))
    own = F.when(F.col("is_state"), (F.col("n") + PULL * F.col("shorter")) / (F.col("total") + PULL)).otherwise(F.col("shorter"))
    table = rows.join(known, "context", "left").withColumn("chance", own)
    done = stored(table.select("gram", "context", "n", "total", "newest", "chance", "root", "is_state"), "level")
    remove_stored(rows)
    return done, states


@dataclass(frozen=True)
class Part:
    """Of each context length: states and log10 alpha, next words in states and log10 of their chance over the unigram one."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def change(self, words: Words, h: np.ndarray, often: np.ndarray) -> np.ndarray:
        """What the states of this part add to each text's sum of unigram logarithms.

        often: a bit field of the contexts seen often enough for a state. Where a context isn't, no longer one is, so that few places are
        left for the longer ones.
        """
        h, place, doc = sequence(words, h)
        out, grams = np.zeros(len(h)), Grams(h)
        going = np.flatnonzero(place >= 1)
        for k, (states, alpha, entries, value) in enumerate(self.levels, 1):
            going = going[place[going] >= k]
            context = grams.upto(going - 1, k)
            left = marked(often, context)
            going, context = going[left], context[left]
            which, there = find(states, context)
            at, which = going[there], which[there]
            entry, there = find(entries, grams.upto(at, k + 1))
            out[at] = np.where(there, value[entry] if len(entries) else 0.0, out[at] + alpha[which])
        return np.bincount(doc, out, minlength=len(words.offsets) - 1)


@dataclass(frozen=True)
class Tree:
    """(table, states) of each context length from one word on, and a bit field of the contexts seen often enough for a state."""

    levels: list[tuple[DataFrame, DataFrame]]
    often: np.ndarray

    def parts(self, limit: int = BROADCAST_BYTES) -> list[int]:
        rows = sum(states.count() + table.where("is_state").count() for table, states in self.levels)
        return list(range(max(1, -(-rows * 16 // limit))))

    def part(self, number: int, of: int) -> Part:
        mine = F.pmod("newest", F.lit(of)) == number
        out = []
        for table, states in self.levels:
            pairs = (
                states.where(mine).select(F.col("context").alias("key"), F.col("alpha").alias("value")),
                table.where(mine & F.col("is_state")).select(F.col("gram").alias("key"), F.log10(F.col("chance") / F.col("root")).alias("value")),
            )
            arrays: list[np.ndarray] = []
            for pair in pairs:
                found = pair.toArrow()
                key = found["key"].to_numpy().view(np.uint64)
                order = np.argsort(key)
                arrays += [key[order], found["value"].to_numpy()[order]]
            out.append(tuple(arrays))
        return Part(out)


def grow(rows: DataFrame, root: DataFrame, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> Tree:
    """The tree over (held_out, text). root: as a level's table, of contexts of no words."""
    spark = rows.sparkSession
    before, levels = root, []
    often = np.zeros(1 << (FIELD - 6), np.uint64)
    while True:
        contexts = bit_field(before.where(F.col("n") >= min_count))
        often |= contexts
        fields = spark.sparkContext.broadcast((contexts, bit_field(before)))
        k = len(levels) + 1
        if k == WINDOWS_FROM:
            rows = stored(map_batches(rows, lambda b, k=k, fields=fields: _windows(b, k, fields.value[0]), WINDOWS), "windows")
        counted = map_batches(rows, lambda b, k=k, fields=fields: _count(b, k, fields.value), COUNTED)
        counted = counted.groupBy("gram", "context", "suffix").agg(F.sum("n").alias("n"))
        totals = before.select(F.col("gram").alias("context"), F.col("n").alias("total"))
        before, states = level(counted, totals, before, min_count, min_gain)
        fields.destroy()
        levels.append((before, states))
        if k > 1 and states.isEmpty():
            return Tree(levels, often)


@dataclass(frozen=True)
class SmallTree:
    """log10 of each symbol's share in each state, the root first."""

    log10: np.ndarray


def build_tree(counts: DataFrame, root: np.ndarray, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> SmallTree:
    """A tree of contexts of up to two symbols with every share written out, by the same tests, to look at. The symbols are the
    places of ``root``, s; counts: (word, n), word a context's and the next symbol as digits to the base s."""
    s = len(root)
    shares = counts.sparkSession.createDataFrame(list(enumerate(map(float, root))), "gram long, chance double")
    digits = lambda k: F.pmod("word", F.lit(s**k))
    n = counts.agg(F.sum("n")).first()[0]
    before = counts.groupBy(digits(1).alias("gram")).agg(F.sum("n").alias("n")).join(shares, "gram")
    before = before.select("gram", "n", F.lit(n).alias("total"), F.lit(None).cast("long").alias("newest"), "chance", F.col("chance").alias("root"))
    dense, found = {(0, 0): root}, [root]
    for k in (1, 2):
        context = F.floor(digits(k + 1) / s)
        counted = counts.groupBy(digits(k + 1).alias("gram"), context.alias("context"), digits(k).alias("suffix")).agg(F.sum("n").alias("n"))
        before, states = level(counted, counted.groupBy("context").agg(F.sum("n").alias("total")), before, min_count, min_gain)
        chances = before.where("is_state").collect()
        for state in states.collect():
            row = dense.get((k - 1, state.context % s ** (k - 1)), root) * 10.0**state.alpha
            for r in chances:
                if r.context == state.context:
                    row[r.gram % s] = r.chance
            dense[k, state.context] = row
            found.append(row)
    return SmallTree(np.log10(np.maximum(found, 1e-30)))


# --- unigrams and scores --------------------------------------------------------------------------------


def _occurrences(batch, vocabulary: Vocabulary):
    """(word, doc_id, text_key, n): each occurrence of a word that isn't frequent, n 1 in training texts, else 0."""
    ids, keys = batch.column(2), batch.column(3)
    learnt = ~batch.column(0).to_numpy(zero_copy_only=False)
    for a, _, data, offsets in text_slices(batch.column(1)):
        words = Words(data, offsets, True)
        h, doc = words.hashes(), words.doc_of_word() + a
        rare = ~vocabulary.find(h)[1]
        if rare.any():
            which = pa.array(doc[rare])
            arrays = [pa.array(h[rare].view(np.int64)), ids.take(which), keys.take(which), pa.array(learnt[doc[rare]].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "doc_id", "text_key", "n"])


def _meet_counts(batches):
    """Over rows sorted by word: (doc_id, text_key, logs, discounted, known) of each occurrence: log10(count + 0.1) and, if
    training has the word, log10(count - DISCOUNT)."""

    def finish(word, doc, key, n):
        word, n = word.to_numpy(), n.to_numpy()
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        c = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(word))))
        arrays = [doc, key, pa.array(np.log10(c + 0.1)), pa.array(np.log10(np.where(c > 0, c - DISCOUNT, 1.0))), pa.array((c > 0).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "logs", "discounted", "known"])

    held, rows, enough = [], 0, 300_000
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        both = pa.Table.from_batches(held).combine_chunks()
        words = both.column(0).to_numpy()
        cut = int(np.searchsorted(words, words[-1]))  # the last word may go on
        if cut:
            yield from finish(*(_one(c) for c in both.slice(0, cut).columns))
        held = both.slice(cut).to_batches()
        rows = both.num_rows - cut
        enough = max(300_000, 2 * rows)
    if rows:
        yield from finish(*(_one(c) for c in pa.Table.from_batches(held).columns))


def _one(column: pa.ChunkedArray) -> pa.Array:
    both = column.combine_chunks()
    return both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, part_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end. Null and empty texts have only the end. Counts come from all texts
    whose id isn't held out, whole; with none of these every token is unknown. Repeated rows count and are scored as often.
    """
    spark = docs.sparkSession
    ids, body = F.col(doc_id).cast("long"), text_bytes(text)
    rows = docs.select(held_out(ids).alias("held_out"), body.alias("text"), ids.alias("doc_id"), F.hash(body).alias("text_key"))
    often = map_batches(rows.select("held_out", "text"), _often, "word long, n long, texts long")
    often = stored(often.groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "often")
    totals = often.where("word is null").select("n", "texts").first()
    n_words, n_texts = (totals[0], totals[1]) if totals else (0, 0)
    n = n_words + n_texts
    ranked = often.where("word is not null").orderBy(F.desc("n"), "word").limit(frequent).select("word", "n").toArrow()
    hashes = ranked["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[order], ranked["n"].to_numpy()[order])
    words = spark.sparkContext.broadcast(vocabulary)

    occurrences = map_batches(rows, lambda b: _occurrences(b, words.value), "word long, doc_id long, text_key int, n long")
    by_word = occurrences.repartition("word").sortWithinPartitions("word")
    met = by_word.mapInArrow(_meet_counts, "doc_id long, text_key int, logs double, discounted double, known long")
    sums = [F.sum(c).alias("their_" + c) for c in ("logs", "discounted", "known")]
    rest = stored(met.groupBy("doc_id", "text_key").agg(*sums), "met")

    known_words = often.where("word is not null").count() + (n_texts > 0)
    base = float(np.log10(n + 0.1 * (known_words + 1)))
    unseen = float(np.log10(DISCOUNT * known_words / n)) if n else 0.0
    end = float(np.log10((n_texts - DISCOUNT) / n)) if n else unseen
    root = often.where("word is not null").select(F.col("word").alias("gram"), "n")
    if n_texts:
        root = root.unionByName(spark.range(1).select(F.lit(int(END.view(np.int64))).alias("gram"), F.lit(n_texts).cast("long").alias("n")))
    share = (F.col("n") - DISCOUNT) / max(n, 1)
    root = root.where(F.col("n") >= LEAST).select("gram", "n", F.lit(n).cast("long").alias("total"), F.lit(None).cast("long").alias("newest"), share.alias("chance"), share.alias("root"))
    tree = grow(rows.select("held_out", "text"), stored(root, "root"))
    parts = tree.parts(part_bytes)
    first, often_seen = spark.sparkContext.broadcast(tree.part(0, len(parts))), spark.sparkContext.broadcast(tree.often)
    shared = spark.sparkContext.broadcast((np.log10(vocabulary.sizes + 0.1), np.log10((vocabulary.sizes - DISCOUNT) / max(n, 1))))

    def work(batch):
        logs, shares = shared.value
        for a, b, data, offsets in text_slices(batch.column(1)):
            its_words = Words(data, offsets, True)
            h = its_words.hashes()
            at, known = words.value.find(h)
            count = np.diff(its_words.first)
            doc, at, size = its_words.doc_of_word()[known], at[known], b - a
            added = lambda x: np.bincount(doc, x, minlength=size)[:size] if len(doc) else np.zeros(size)
            inside = np.bincount(doc, minlength=size)[:size]
            changed = first.value.change(its_words, h, often_seen.value) + added(shares[at]) + end
            values = [count + 1, inside + (n_texts > 0), added(logs[at]) + np.log10(n_texts + 0.1), changed, count - inside]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, size) for i in (2, 3, 0)), *map(pa.array, values)], ["doc_id", "text_key", "held_out", "n_tokens", "known", "logs", "score", "outside"])

    def more(batch, part):
        for a, b, data, offsets in text_slices(batch.column(1)):
            its_words = Words(data, offsets, True)
            values = [np.diff(its_words.first) + 1, part.value.change(its_words, its_words.hashes(), often_seen.value)]
            nothing = [pa.nulls(b - a, t) for t in (pa.int64(), pa.float64(), pa.int64())]
            arrays = [*(batch.column(i).slice(a, b - a) for i in (2, 3, 0)), pa.array(values[0]), *nothing[:2], pa.array(values[1]), nothing[2]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "held_out", "n_tokens", "known", "logs", "score", "outside"])

    schema = "doc_id long, text_key int, held_out boolean, n_tokens long, known long, logs double, score double, outside long"
    scored = map_batches(rows, work, schema)
    for number in parts[1:]:
        part = spark.sparkContext.broadcast(tree.part(number, len(parts)))
        scored = scored.unionByName(map_batches(rows, lambda b, part=part: more(b, part), schema))
    # rows of one key are equal; the sums of their other words, and of what the parts add, hold all of them
    alike = [F.first(c, ignorenulls=True).alias(c) for c in ("known", "logs", "outside")]
    whole = scored.groupBy("doc_id", "text_key", "held_out", "n_tokens").agg(F.count("known").alias("copies"), F.sum("score").alias("score"), *alike)
    same = whole["doc_id"].eqNullSafe(rest["doc_id"]) & (whole["text_key"] == rest["text_key"])
    each = lambda name: F.coalesce(name, F.lit(0)) / F.col("copies")
    outside = each("their_discounted") - each("their_known") * F.lit(float(np.log10(max(n, 1)))) + (F.col("outside") - each("their_known")) * F.lit(unseen)
    out = whole.join(rest, same, "left").select(
        whole["doc_id"],
        "held_out",
        "n_tokens",
        (F.col("known") + each("their_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + each("their_logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("score") / F.col("copies") + outside).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
