"""Periodic runs, spelling variants and packing, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arbitrail.llm import packing, period_runs, spelling_groups
from arbitrail.llm.queries import REGISTRY, planted_periods, spelling_slip

PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    """(doc_id, text) with columns of names that operators use themselves."""
    names = "n long, word string, start string, length string, part string, key string, ids string"
    return spark.createDataFrame([(*r, 7, *["own"] * 6) for r in rows], "doc_id long, text string, " + names)


# --- periodic runs --------------------------------------------------------------------------------------


def brute_runs(w, min_length=6, repeats=4):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            part = w[i : i + size]
            if j > i and size >= max(min_length, repeats * q) and not any(part[d:] == part[: size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 7)), max_size=6), min_size=1, max_size=3), st.sampled_from([(6, 4), (3, 3), (20, 5)]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_brute_force(parts, limits):
    texts = [list("".join(unit * k for unit, k in text)) for text in parts]
    bounds = np.cumsum([0, *map(len, texts)])
    numbers = np.array([ord(c) for t in texts for c in t], np.int64)
    expected = [(s + int(b), n, q) for t, b in zip(texts, bounds, strict=False) for s, n, q in brute_runs(t, *limits)]
    assert period_runs.find_runs(numbers, bounds, *limits) == expected


def test_rare_words_split_again_and_again():
    # x is often enough at first, but not within the pieces that the one-time words leave
    text = [1, 9, 2, 9, 1, 9, 3, 9, 4, 5, 4, 5, 4, 5, 4, 5, 9, 6, 7, 9]
    places, starts = period_runs.segments(np.array(text), np.array([0, len(text)]), 6, 4)
    assert places.tolist() == list(range(8, 16)) and starts.tolist() == [True] + [False] * 7


def test_long_runs_take_no_square_of_their_length():
    n = 200_000
    for period in (1, 7, 30_000):
        assert period_runs.find_runs(np.arange(n) % period, np.array([0, n])) == [(0, n, period)]


def expected_runs(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return len(w), len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), runs, kept


def odd_rows(rng):
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "x y " * 4 + "x", "é ü ü " * 9, "one two " * 7, "same line here\n" * 30]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("pqrstuvw") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))]
            parts += unit * rng.randrange(1, 9)
        texts.append(" ".join(parts))
    texts.append(" ".join(str(i % 331) for i in range(2000)))
    return [*enumerate(texts), (3, "a"), (3, "other " * 9), (None, "b " * 8)]


def test_digests_of_runs(spark, monkeypatch):
    monkeypatch.setattr(period_runs, "SLICE_BYTES", 2000)
    rows = odd_rows(random.Random(2))
    for plant in (None, planted_periods):
        got = period_runs.digests(frame(spark, rows), rewrite=plant).collect()
        assert Counter(map(tuple, got)) == Counter((i, *expected_runs(i, t, plant)[:8]) for i, t in rows)
    runs = period_runs.runs_of(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs))) for r in runs) == Counter((i, e[0], tuple(e[8])) for i, t in rows for e in [expected_runs(i, t, None)])
    assert period_runs.digests(frame(spark, rows).where("false")).isEmpty()


def test_collapse_changes_only_texts_with_runs(spark):
    rows = odd_rows(random.Random(4))
    out = period_runs.collapse(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns

    def collapsed(text):
        e = expected_runs(None, text, None)
        return e[9] if e[8] else text

    assert Counter((r.doc_id, r.text, r.n) for r in out.collect()) == Counter((i, collapsed(t), 7) for i, t in rows)


# --- spelling variants ----------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, slip):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            counts[slip(i, w) if slip else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, form.get(w), root, len(beside[w]), words[form[w]] if w in form else None))
    return Counter(out)


@pytest.mark.parametrize("slip, filter_bytes, shard_bytes", [(None, 32 << 20, 4 << 20), (spelling_slip, 32 << 20, 4 << 20), (None, 600, 64)])
def test_variants_equal_brute_force(spark, monkeypatch, slip, filter_bytes, shard_bytes):
    monkeypatch.setattr(spelling_groups, "HELD", 20)
    monkeypatch.setattr(spelling_groups, "EDITS", 3000)
    monkeypatch.setattr(spelling_groups, "SLICE_BYTES", 500)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéßÿ×") for _ in range(rng.randrange(4, 11))) for _ in range(40)] + ["aabbcc", "Éclair", "hello", "hallo", "hallos", "hallosa"]
    pool = []
    for w in base:
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            v = rng.choice([w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abzÿ") + w[i + 1 :], w[:i] + rng.choice("aü") + w[i:]])
            pool += [v] * rng.choice([1, 2, 4, 9, 30])
    pool += ["hello"] * 100 + ["hallo"] * 40 + ["hallos"] * 15 + ["hallosa"] * 5 + ["q" * 700] * 4 + ["q" * 699 + "r"] * 9
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(30)]
    rows = [*enumerate(texts), (0, texts[0]), (1, "HELLO,Hello;helloĀhello"), (90, None), (91, ""), (92, "12 34 \n"), (93, " ".join(["q" * 700, "q" * 699 + "r", "aabbcc"] * 20))]
    docs = frame(spark, rows)
    got = spelling_groups.variants(docs, rewrite=slip, filter_bytes=filter_bytes, shard_bytes=shard_bytes)
    assert got.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    expected = brute_variants(rows, slip)
    assert Counter(map(tuple, got.collect())) == expected
    assert any(r[3] != r[2] for r in expected if r[2])  # chains of several forms
    assert spelling_groups.variants(docs.where("false")).isEmpty()


def test_shards_share_out_all_words_within_the_limit():
    groups = spelling_groups.groups_of([(5, 1000), (6, 10), (7, 40_000)], limit=8000, shard=4000)
    for group in groups:
        assert len(spelling_groups.Filter(group).blocks) * 8 <= 8000
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    for length in (5, 6, 7):
        here = [spelling_groups.Filter(g).places(length, h)[0] for g in groups if any(s[0] == length for s in g)]
        assert sorted(np.concatenate(here).tolist()) == list(range(5000))


# --- packing --------------------------------------------------------------------------------------------


@given(st.integers(0, 100_000), st.sampled_from([1, 2, 64, 1024]))
@settings(deadline=None)
def test_binary_lengths(n, limit):
    lengths = packing.binary_lengths(n, limit)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= limit for x in lengths)
    assert len([x for x in lengths if x < limit]) == len({x for x in lengths if x < limit})


def test_packing_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 3000)
    rng = random.Random(3)
    texts = [None, "", " ", "one", "word " * 3000, "naïve café\n" * 50] + ["".join(rng.choice("abc d中!") for _ in range(rng.randrange(3000))) for _ in range(30)]
    rows = [*enumerate(texts), (4, texts[4]), (4, "other"), (None, "no id")]
    docs = frame(spark, rows).repartition(3)
    library = Tokenizer.from_file(PATH)
    tokens = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    expected, buckets = Counter(), Counter()
    for i, ids in tokens:
        start = 0
        for length in packing.binary_lengths(len(ids), 1024):
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            expected[i, start, length, crc, len(ids), 0] += 1
            buckets[length] += 1
            start += length
        assert start == len(ids)
    got = packing.pack(docs, PATH).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == expected
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(by_id)))
    assert [r.length for r in by_id] == [length for length, n in sorted(buckets.items(), reverse=True) for _ in range(n)]
    whole = packing.sequences(docs, PATH, limit=64).collect()
    assert len({r.sequence_id for r in whole}) == len(whole)
    again = Counter()
    for r in whole:
        assert len(r.ids) == 4 * r.length <= 256
        again[r.doc_id, r.doc_tokens, r.start, bytes(r.ids)] += 1
    want = Counter()
    for i, ids in tokens:
        start = 0
        for length in packing.binary_lengths(len(ids), 64):
            want[i, len(ids), start, np.array(ids[start : start + length], "<u4").tobytes()] += 1
            start += length
    assert again == want
    assert packing.pack(docs.where("false"), PATH).isEmpty()
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, limit=1000)


# --- the registered queries, whole tables ---------------------------------------------------------------


def test_packing_query_covers_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = REGISTRY["op13_packing"](spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs}
    library, pieces = Tokenizer.from_file(PATH), {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in docs:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc in sorted(pieces[r.doc_id]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_run_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in REGISTRY["op11_periodic_runs"](spark, sf).collect()}
    for r in docs:
        assert got[r.doc_id] == expected_runs(r.doc_id, r.text, True)[:8]
