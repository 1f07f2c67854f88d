"""Quality rules as a short-circuit cascade.

Each rule looks at one text and may reject it. A text is kept if no rule rejects it, so the verdict doesn't depend on the
order; the work does. ``plan_cascade`` runs every rule on a sample, measures its cost and how many of the texts it rejects,
and orders the rules by rejections per unit of cost; ``apply_rules`` stops at the first rejection.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import map_batches, rewrite_texts, text_bytes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
CONTINUATION = bytes(range(0x80, 0xC0))


class Text:
    """One text with the measures that rules ask for; each is computed when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(grams)) == len(grams):
            return 0
        counts, covered, until = Counter(grams), 0, 0
        for i, gram in enumerate(grams):
            if counts[gram] > 1:
                covered += i + 3 - max(i, until)
                until = i + 3
        return covered


@dataclass(frozen=True)
class Limits:
    """Bounds of the default rules, all on whole texts."""

    min_words: int = 50
    max_repeat_share: float = 0.5  # words in repeated 3-word windows
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.5
    max_upper_share: float = 0.3  # of ASCII letters
    max_bangs_per_word: float = 0.3
    min_mean_word: float = 3.0
    max_mean_word: float = 10.0
    min_word_share_with_letter: float = 0.8


def _upper(t: Text, limit: float) -> bool:
    upper = len(t.data) - len(t.data.translate(None, UPPER))
    return upper > limit * (upper + len(t.data) - len(t.data.translate(None, LOWER)))


def _letterless(t: Text, least: float) -> bool:
    return sum(1 for w in t.words if w.translate(None, NOT_LETTERS)) < least * t.n_words


#: Name and test of each rule; a test is true when it rejects the text.
RULES = {
    "few_words": lambda t, k: t.n_words < k.min_words,
    "repetition": lambda t, k: t.n_repeat_words > k.max_repeat_share * t.n_words,
    "symbols": lambda t, k: t.n_symbols > k.max_symbols_per_word * t.n_words,
    "repeated_lines": lambda t, k: t.n_dup_lines > k.max_dup_line_share * len(t.lines),
    "upper_case": lambda t, k: _upper(t, k.max_upper_share),
    "exclamations": lambda t, k: t.data.count(b"!") > k.max_bangs_per_word * t.n_words,
    "word_length": lambda t, k: not k.min_mean_word * t.n_words <= t.word_chars <= k.max_mean_word * t.n_words,
    "letterless_words": lambda t, k: _letterless(t, k.min_word_share_with_letter),
}


def plan_cascade(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 2000) -> list[str]:
    """The rules' names, best rejection per cost first.

    Measured where the rows lie, on about ``sample_rows`` rows (a Bernoulli sample); only one row for each rule and task
    comes to the driver. Without rows the order is that of RULES. The sample steers the order alone, never a verdict.
    """
    total = docs.count()
    if total == 0:
        return list(RULES)
    fraction = min(1.0, sample_rows / total)
    part = docs.select(text_bytes(text).alias("text")).sample(False, fraction, seed=7) if fraction < 1 else docs.select(text_bytes(text).alias("text"))

    def measure(batch):
        rows = batch.column(0).to_pylist()
        names, seconds, rejected = [], [], []
        for name, test in RULES.items():
            began, hits = time.perf_counter(), 0
            for row in rows:
                hits += bool(test(Text(row), limits))
            names.append(name)
            seconds.append(time.perf_counter() - began)
            rejected.append(float(hits))
        yield pa.RecordBatch.from_pydict({"rule": names, "seconds": seconds, "rejected": rejected})

    measured = map_batches(part, measure, "rule string, seconds double, rejected double")
    found = {r[0]: r[2] / max(r[1], 1e-9) for r in measured.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()}
    return sorted(RULES, key=lambda name: (-found.get(name, 0.0), name))


def apply_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), order: list[str] | None = None, measures: bool = True
) -> DataFrame:
    """(doc_id, measures, base_failed, kept), a row for each row of ``docs``.

    base_failed is the verdict of the two base rules (too few words, repetition), kept that of all. Null and empty texts
    have no words and fail. Repeated rows give repeated rows; a null doc_id stays null. With ``measures`` false, the
    measures a text's verdict doesn't need are never computed, and only (doc_id, kept) is returned. No shuffle.
    """
    order = plan_cascade(docs, text, limits) if order is None else order
    later = [name for name in order if name not in ("few_words", "repetition")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))

    def verdicts(batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        if not measures:
            kept = [not any(RULES[name](t, limits) for name in order) for t in map(Text, texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.bool_())], ["doc_id", "kept"])
            return
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        failed, kept = [], []
        for t in map(Text, texts):
            for name, values in out.items():
                values.append(getattr(t, name))
            failed.append(RULES["few_words"](t, limits) or RULES["repetition"](t, limits))
            kept.append(not failed[-1] and not any(RULES[name](t, limits) for name in later))
        arrays = [ids, *(pa.array(v, pa.int64()) for v in out.values()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *out, "base_failed", "kept"])

    if not measures:
        return map_batches(rows, verdicts, "doc_id long, kept boolean")
    return map_batches(rows, verdicts, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are, whatever their names.

    Texts pass the cascade where they lie; nothing is moved or joined.
    """
    order = plan_cascade(docs, text, limits)

    def good(texts):
        return [data if data and not any(RULES[name](t, limits) for t in (Text(data),) for name in order) else False for data in texts]

    return rewrite_texts(docs, text, good)
