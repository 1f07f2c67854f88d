"""Periodic runs: stretches of words that repeat a passage again and again, found by recursive frequency splitting.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) that is at least REPEATS periods
and MIN_LENGTH words long, and that no neighbouring word extends keeping that period. Each of its words stands in it REPEATS times
or more. A word that is rarer than that within its segment, at first the text, is therefore in no run and splits the segment;
the pieces are counted and split again until none has a rare word. The surviving segments are scanned lag by lag, up to a
part of their length: for each lag only places at its multiples are looked at, since a run covers REPEATS - 1 of these in a row, so
a segment of n words costs about n log n whatever it holds. What the places, and then hashes of the words between them, point
out is measured word by word.

Texts are worked on where they lie: nothing is shuffled. Words are numbered exactly, not hashed. A text of any length is looked at as a
whole, in some tens of bytes for each of its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import SLICE_BYTES, _powers, map_batches, mix, rewrite_texts, text_bytes

MIN_LENGTH, REPEATS = 6, 4
#: Rounds of splitting. What a text still has to split after these goes to the scan as it is, with the same result.
ROUNDS = 64
#: (start, length, period), the start as a word number.
Run = tuple[int, int, int]
#: Changes the word numbers of a text before it is looked at: (doc_id, numbers) to numbers.
Rewrite = Callable[[int | None, np.ndarray], np.ndarray]

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"


class Numbered:
    """Words as numbers in the order in which they are first met, the same number for the same word."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}

    def add(self, text: bytes) -> np.ndarray:
        """The numbers of the words of a text, cut from about a megabyte of it at a time."""
        numbers, out, a = self.numbers, [], 0
        while a < len(text):
            stop = _WHITE.search(text, a + SLICE_BYTES) if len(text) - a > SLICE_BYTES else None
            b = stop.start() if stop else len(text)
            words = (text[a:b] if a or b < len(text) else text).split()
            out.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
            a = b
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int64), *out])

    def joined(self, ids: np.ndarray) -> bytes:
        """The words of some numbers, joined by one space."""
        if not hasattr(self, "words") or len(self.words) != len(self.numbers):
            self.words = list(self.numbers)
        return b" ".join(map(self.words.__getitem__, ids.tolist()))


def segments(ids: np.ndarray, bounds: np.ndarray, min_length: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, starts): the places of words that can be in a run, and which of these begin a segment.

    bounds: the place where each text begins, and the end. A segment never reaches over the end of a text.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places, segment, settled = np.arange(len(ids)), text, []
    width = int(ids.max()) + 1 if len(ids) else 1
    for _ in range(ROUNDS):
        if not len(places):
            break
        _, which, counts = np.unique(segment * width + ids[places], return_inverse=True, return_counts=True)
        often = counts[which] >= repeats
        whole = np.ones(int(segment[-1]) + 1, bool)
        whole[segment[~often]] = False
        stable = whole[segment]
        settled.append(places[stable])
        places, segment = places[often & ~stable], segment[often & ~stable]
        segment = np.cumsum(_breaks(places, segment)) - 1
        long = np.bincount(segment, minlength=1) >= min_length
        places, segment = places[long[segment]], segment[long[segment]]
    places = np.sort(np.concatenate([*settled, places]))
    starts = _breaks(places, text[places])
    long = np.bincount(np.cumsum(starts) - 1, minlength=1) >= min_length
    keep = long[np.cumsum(starts) - 1]
    return places[keep], starts[keep]


def _breaks(places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a place doesn't follow the one before it in the same group."""
    out = np.ones(len(places), bool)
    out[1:] = (places[1:] != places[:-1] + 1) | (group[1:] != group[:-1])
    return out


def _stretch(w: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places around ``at`` whose words equal those ``lag`` later."""
    a, step = at, 64
    while a > 0:
        low = max(0, a - step)
        other = np.flatnonzero(w[low:a] != w[low + lag : a + lag])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a, step = low, 2 * step
    b, step, end = at, 64, len(w) - lag
    while b < end:
        high = min(end, b + step)
        other = np.flatnonzero(w[b:high] != w[b + lag : high + lag])
        if len(other):
            b += int(other[0])
            break
        b, step = high, 2 * step
    return a, b


def find_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[Run]:
    """All runs of consecutive texts, by start and period. Starts count through all texts.

    ids: the word numbers of the texts, joined; bounds: where each text begins, and the end.
    """
    if repeats < 3:
        raise ValueError("a run needs three repeats or more")
    places, starts = segments(ids, bounds, min_length, repeats)
    reach = np.zeros(len(ids), np.int64)  # how far the runs found so far reach that hold a place
    runs: list[Run] = []
    lag, enough = 0, 0
    while len(places):
        lag += 1
        if lag > enough:  # from here on only segments that are long enough, for as many lags again
            sizes = np.diff(np.append(np.flatnonzero(starts), len(places)))
            keep = np.repeat(sizes >= repeats * lag, sizes)
            places, starts = places[keep], starts[keep]
            if not len(places):
                break
            enough = 2 * lag
            # each segment is followed by a word that is found nowhere else
            where = np.arange(len(places)) + np.cumsum(starts) - 1
            w = -1 - np.arange(int(where[-1]) + 2)
            w[where] = ids[places]
            place = np.zeros(len(w), np.int64)
            place[where] = places
            power = _powers(len(w) + 1)[0]
            sums = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(mix(w.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * power[: len(w)], out=sums[1:])
        every = w[::lag]
        equal = every[1:] == every[:-1]
        found = len(equal) - repeats + 2
        if found <= 0:
            continue
        hits = equal[:found]
        for i in range(1, repeats - 1):
            hits = hits & equal[i : i + found]
        at = np.flatnonzero(hits) * lag
        if not len(at):
            continue
        span = (repeats - 2) * lag
        at = at[reach[place[at]] < place[at] + span + lag]  # else within a run of a period that divides the lag
        same = (sums[at + span] - sums[at]) * power[lag] == sums[at + span + lag] - sums[at + lag]
        at = at[same]
        while len(at):
            a, b = _stretch(w, lag, int(at[0]))
            if b - a + lag >= max(min_length, repeats * lag):
                start, end = int(place[a]), int(place[a]) + b - a + lag
                runs.append((start, end - start, lag))
                reach[start:end] = np.maximum(reach[start:end], end)
            at = at[at > max(b, int(at[0]))]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    stays = np.ones(n, bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return stays


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; of equal ones the first, then that of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _slices(texts: Iterator[bytes | None], ids: Iterator[int | None], rewrite: Rewrite | None, min_length: int, repeats: int):
    """Of each text: (its words' numbers, runs, Numbered). Texts are looked at in groups of about a megabyte."""
    held: list[np.ndarray] = []
    words, size = Numbered(), 0

    def done():
        bounds = np.cumsum([0, *map(len, held)])
        runs, i = find_runs(np.concatenate(held), bounds, min_length, repeats), 0
        for k, numbers in enumerate(held):
            own = []
            while i < len(runs) and runs[i][0] < bounds[k + 1]:
                own.append((runs[i][0] - int(bounds[k]), *runs[i][1:]))
                i += 1
            yield numbers, own, words

    for text, doc_id in zip(texts, ids, strict=True):
        numbers = words.add(text or b"")
        held.append(rewrite(doc_id, numbers) if rewrite else numbers)
        size += len(text or b"")
        if size >= SLICE_BYTES:
            yield from done()
            held, words, size = [], Numbered(), 0
    if held:
        yield from done()


def _mapped(docs: DataFrame, doc_id: str, text: str, schema: str, row: Callable, rewrite: Rewrite | None, min_length: int, repeats: int) -> DataFrame:
    """``row`` of (numbers, runs, Numbered) for each row of ``docs``, behind its id."""
    kinds = None

    def work(batch):
        ids, texts = batch.column(0), batch.column(1)
        found = _slices((x.as_py() for x in texts), ids.to_pylist(), rewrite, min_length, repeats)
        rows = [row(*x) for x in found]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *columns], schema=kinds)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return map_batches(rows, work, schema)


def runs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_words, runs), a row for each row of ``docs``; runs by start, then period.

    Null and empty texts have no words and no runs. Repeated rows and ids are looked at one by one. Other columns aren't read.
    """

    def row(numbers, runs, words):
        return len(numbers), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]

    return _mapped(docs, doc_id, text, f"doc_id long, n_words long, {RUNS}", row, rewrite, min_length, repeats)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the strongest run of each row,
    and digests of all its runs and of the words that stay when each run is cut to its first period. Rows as in ``runs_of``."""

    def row(numbers, runs, words):
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        best = strongest(runs)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text = words.joined(numbers[kept(len(numbers), runs)] if runs else numbers)
        return len(numbers), len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, doc_id, text, schema, row, rewrite, min_length, repeats)


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """The rows with each run cut to its first period; a changed text has its words joined by one space, others stay as they are.

    All columns and rows are kept; null texts stay null.
    """

    def work(texts: list) -> list:
        found = _slices(texts, [None] * len(texts), None, min_length, repeats)
        return [words.joined(numbers[kept(len(numbers), runs)]) if runs else t for t, (numbers, runs, words) in zip(texts, found, strict=True)]

    return rewrite_texts(docs, text, work)
