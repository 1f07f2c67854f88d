"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are put into one automaton whose states stand for the word sequences that occur in some item. A text's
words are streamed through it: after each word the automaton knows the longest item passage that ends there. A passage of
at least ``window`` words (or a whole shorter item) is a leak; its words are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import REWRITTEN, give_back, map_batches, stored, text_bytes

#: ASCII letters in lower case, digits, and every byte over 7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Items are put into automata of at most this many words (or one longer item); documents pass through one after another.
AUTOMATON_WORDS = 100_000
#: Blocks that travel together.
BLOCKS_AT_ONCE = 16


class Automaton:
    """Generalised suffix automaton over words; no passage reaches from one item into the next."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(items)

    def _new(self, following: dict[bytes, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the passage that comes from p by word, apart from the longer ones in q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        state, p = self._new({}, self.length[last] + 1, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word, self.next[p][word])
        return state

    def _mark(self, items: list[tuple[str, list[bytes]]]) -> None:
        """Items of each full window's state, and whole short items by the state of all their words."""
        n = len(self.next)
        self.window_state = [-1] * n  # the state that holds the last ``window`` words of a state's passage
        self.short_states: list[tuple[int, ...]] = [()] * n
        self.items: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= self.window:
                self.window_state[state] = state if self.length[up] < self.window else self.window_state[up]
        for name, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.items.setdefault(self.window_state[state], set()).add(name)
            if 0 < len(words) < self.window:
                whole.setdefault(state, set()).add(name)
        self.whole = whole
        for state in sorted(range(1, n), key=self.length.__getitem__):
            above = self.short_states[self.link[state]]
            self.short_states[state] = (*above, state) if state in whole else above

    def leaks(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, end) of the maximal hit spans, and the items whose windows occur."""
        following, link, length, window, short = self.next, self.link, self.length, self.window, self.short_states
        has_short = bool(self.whole)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = size = 0
        for i, word in enumerate(words):
            step = following[state].get(word)
            if step is not None:
                size += 1
            elif state:
                while state and word not in following[state]:
                    state = link[state]
                size = length[state]
                step = following[state].get(word)
                if step is None:
                    continue
                size += 1
            else:
                continue
            state = step
            if size >= window:
                spans.append((i + 1 - size, i + 1))
                found |= self.items[self.window_state[state]]
            if has_short:
                for s in short[state]:
                    if length[s] <= size:
                        spans.append((i + 1 - length[s], i + 1))
                        found |= self.whole[s]
        return merge_spans(spans), found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about AUTOMATON_WORDS words; the driver holds one block at a time.

    A null or wordless item has no windows. Items without an id have the empty id.
    """
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("text"))
    block: list[tuple[str, list[bytes]]] = []
    words = 0
    for row in rows.toLocalIterator():
        found = WORD.findall(bytes(row["text"]).lower())
        if found:
            block.append((row["item"], found))
            words += len(found)
        if words >= AUTOMATON_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


class Scanner:
    """Passes texts through the automata of some blocks. Few automata are kept; of many, each is built anew for a batch."""

    def __init__(self, blocks: list[list[tuple[str, list[bytes]]]], window: int):
        self.blocks, self.window = blocks, window
        self.kept = [Automaton(b, window) for b in blocks or [[]]] if len(blocks) <= 3 else None

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(number of words, hit spans, items) of each text."""
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set()) for _ in texts]
        for automaton in self.kept or (Automaton(b, self.window) for b in self.blocks):
            for i, text in enumerate(texts):  # the words of one text at a time are in memory
                words = WORD.findall(text.lower())
                spans, names = automaton.leaks(words)
                out[i] = (len(words), merge_spans(out[i][1] + spans) if spans else out[i][1], out[i][2] | names)
        return out


LEAKS = "doc_id long, n_words long, spans array<struct<a: bigint, b: bigint>>, items array<string>"


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """(doc_id, n_words, spans of hit words [a, b), ids of the items), a row for each row of ``docs``; no shuffle.

    Item words go to the executors in groups of at most BLOCKS_AT_ONCE blocks, a bounded size; with more items than
    that, the documents are scanned once for each group. Null and empty texts have no words. Repeated rows give
    repeated rows; repeated items count under each of their ids; without items nothing is hit.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    empty = F.array().cast("array<struct<a: bigint, b: bigint>>")
    rows = rows.withColumns({"spans": empty, "items": F.array().cast("array<string>")})
    groups = list(_groups(item_blocks(items, item_id, item_text))) or [[]]
    for number, blocks in enumerate(groups):
        last = number == len(groups) - 1
        rows = map_batches(rows, _scan_work(docs, blocks, window, last), LEAKS if last else LEAKS.replace("n_words long", "text binary"))
        rows = rows if last else stored(rows, "leaks")
    return rows


def _groups(blocks: Iterator[list]) -> Iterator[list[list]]:
    group: list[list] = []
    for block in blocks:
        group.append(block)
        if len(group) == BLOCKS_AT_ONCE:
            yield group
            group = []
    if group:
        yield group


def _scan_work(docs: DataFrame, blocks: list, window: int, last: bool):
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    made: list[Scanner] = []

    def work(batch):
        if not made:
            made.append(Scanner(shared.value, window))
        texts = batch.column(1).to_pylist()
        spans, items, counts = [], [], []
        for (n, hit, names), old, named in zip(made[0].scan(texts), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            hit = merge_spans(hit + [(s["a"], s["b"]) for s in old]) if old else hit
            spans.append([{"a": a, "b": b} for a, b in hit])
            items.append(sorted(names.union(named)) if named else sorted(names))
            counts.append(n)
        second = pa.array(counts, pa.int64()) if last else batch.column(1)
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        arrays = [batch.column(0), second, pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words" if last else "text", "spans", "items"])

    return work


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what follows them up to the next word."""
    places = [m.start() for m in WORD.finditer(data.lower())] + [len(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a]])
        at = places[b]
    out.append(data[at:])
    return b"".join(out)


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    longest_span: int = 9,
    most_coverage: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` with the same columns, whatever their names, decontaminated.

    Hit spans of more than ``longest_span`` words, and whole short items, are cut out of the text. A row of whose words
    more than the share ``most_coverage`` is hit goes. Other rows stay as they are, null texts too. No shuffle.
    """
    groups = list(_groups(item_blocks(items, item_id, item_text)))
    if not groups:
        return docs
    place, name = docs.columns.index(text), "spans"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    rows = docs
    if len(groups) > 1:  # the spans of all groups are found on the unchanged text
        rows = docs.select("*", F.array().cast(SPANS).alias(name))
        for blocks in groups[:-1]:
            rows = rows.mapInArrow(_gatherer(docs, blocks, window, place), rows.schema)
    return rows.mapInArrow(_cleaner(docs, groups[-1], window, longest_span, most_coverage, place), docs.schema)


SPANS = "array<struct<a: bigint, b: bigint>>"


def _scanned(docs: DataFrame, blocks: list, window: int, place: int):
    """Over batches: (a part of its rows, its texts, number of words and hit spans of each); spans found before stand in the last column, if
    there is one more than ``docs`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    width = len(docs.columns)
    made: list[Scanner] = []

    def scan(batches):
        for batch in batches:
            if not made:
                made.append(Scanner(shared.value, window))
            for a in range(0, batch.num_rows, REWRITTEN):  # a part at a time, so that few texts are in memory twice
                part = batch.slice(a, REWRITTEN)
                texts = part.column(place).cast(pa.binary()).to_pylist()
                olds = part.column(width).to_pylist() if part.num_columns > width else [()] * len(texts)
                found = made[0].scan([t or b"" for t in texts])
                spans = [(n, merge_spans(hit + [(s["a"], s["b"]) for s in old]) if old else hit) for (n, hit, _), old in zip(found, olds, strict=True)]
                yield part, texts, spans
        give_back()

    return scan


def _gatherer(docs: DataFrame, blocks: list, window: int, place: int):
    scan = _scanned(docs, blocks, window, place)

    def work(batches):
        for part, _, spans in scan(batches):
            found = pa.array([[{"a": a, "b": b} for a, b in hit] for _, hit in spans], part.columns[-1].type)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], schema=part.schema)

    return work


def _cleaner(docs: DataFrame, blocks: list, window: int, longest_span: int, most_coverage: float, place: int):
    scan = _scanned(docs, blocks, window, place)
    width = len(docs.columns)

    def clean(data, n: int, spans: list[tuple[int, int]]):
        hit = sum(b - a for a, b in spans)
        long = [(a, b) for a, b in spans if b - a > longest_span or b - a < window]
        return False if hit > most_coverage * n else cut(data, long) if long else data

    def work(batches):
        for part, texts, spans in scan(batches):
            out = [clean(data, n, hit) for data, (n, hit) in zip(texts, spans, strict=True)]
            kind = part.column(place).type
            cleaned = pa.array([x if x is not False else None for x in out], pa.binary()).cast(kind)
            arrays = [cleaned if i == place else part.column(i) for i in range(width)]
            fields = pa.schema([part.schema.field(i) for i in range(width)])
            yield pa.RecordBatch.from_arrays(arrays, schema=fields).filter(pa.array([x is not False for x in out], pa.bool_()))

    return work
