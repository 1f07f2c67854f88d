"""Operators that look at one text at a time, against brute force and public libraries."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arbitrail.llm import bpe, decontaminate, license_scan, quality_rules
from arbitrail.llm.common import Words, gram_hashes, text_slices
from arbitrail.llm.queries import ORACLES, REGISTRY

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_DOCS = [
    (1, "the cat sat on the mat and the dog sat on the log by the old mill stream", "en"),
    (1, "the cat sat on the mat and the dog sat on the log by the old mill stream", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "the cat sat on the mat and the dog sat", "de"),
    (4, "x " * 30_000, "fr"),
    (5, "\n\t \x0b", "fr"),
]


def odd(spark, rows=ODD_DOCS):
    """Texts with nulls, repeats, a very long one, and columns whose names operators use themselves."""
    schema = "doc_id long, text string, n_words string, leak string, kept string, spans string, row string, component string"
    return spark.createDataFrame([(*r[:2], *["own"] * 6) for r in rows], schema)


def same_as_sql(spark, sf, name, **tables):
    got = REGISTRY[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_quality_rules", "op3_url_filter", "op4_license_scan", "op7_substring_dedup", "op8_ngram_join", "op10_warc"])
def test_same_as_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


@given(st.lists(st.text("ab é\n\t 🙂A", max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_of_joined_texts(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, True)
    found = [[bytes(words.data[a:b]) for a, b in zip(words.starts[i:j], words.ends[i:j], strict=True)] for i, j in zip(words.first, words.first[1:], strict=False)]
    assert found == [t.lower().split() for t in raw]
    by_hash = {}
    for word, h in zip((w for ws in found for w in ws), words.hashes().tolist(), strict=True):
        assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_slices_hold_every_row():
    import pyarrow as pa

    column = pa.array([b"abc", None, b"", b"d" * 100, b"e"], pa.binary()).slice(1)
    seen = [(a, b, data.tobytes()) for a, b, data, _ in text_slices(column, 10)]
    assert [x[0] for x in seen][0] == 0 and seen[-1][1] == 4
    assert b"".join(x[2] for x in seen) == b"d" * 100 + b"e"
    assert len(gram_hashes(np.zeros(3, np.uint64), 5)) == 0


# --- decontamination ------------------------------------------------------------------------------------


def brute_leaks(words, items, window):
    hit, names = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for i in range(len(item) - n + 1 if item else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == item[i : i + n]:
                    hit |= set(range(at, at + n))
                    names.add(name)
    return hit, names


@given(st.lists(st.text("abc", min_size=0, max_size=9), max_size=5), st.text("abc", max_size=40), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_what_brute_force_finds(items, text, window):
    items = [(str(i), [c.encode() for c in x]) for i, x in enumerate(items)]
    words = [c.encode() for c in text]
    automaton = decontaminate.Automaton([x for x in items if x[1]], window)
    spans, names = automaton.leaks(words)
    assert ({i for a, b in spans for i in range(a, b)}, names) == brute_leaks(words, items, window)


def test_leaks_of_odd_rows_and_many_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "dog sat on the log by the old mill stream now"), (2, "the CAT"), (3, None), (4, ""), (4, "the log")], "item_id long, text string")
    one = decontaminate.find_leaks(odd(spark), items, window=4).collect()
    assert len(one) == len(ODD_DOCS)
    by_id = {r.doc_id: r for r in one}
    assert by_id[2].n_words == by_id[3].n_words == by_id[5].n_words == 0 and by_id[4].n_words == 30_000
    assert by_id[1]["items"] == ["1", "2", "4"] and by_id[None]["items"] == ["2"]
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 3)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    many = decontaminate.find_leaks(odd(spark), items, window=4).collect()
    assert sorted(map(repr, many)) == sorted(map(repr, one))
    assert decontaminate.find_leaks(odd(spark), items.where("false")).where("size(spans) > 0").isEmpty()
    assert decontaminate.find_leaks(odd(spark).where("false"), items).isEmpty()


def test_leaks_are_cut_and_heavy_rows_go(spark):
    items = spark.createDataFrame([(1, "dog sat on the log by the old mill stream")], "item_id long, text string")
    rows = [(1, "Before: a Dog sat  on the log, by the old\nmill stream. After it all went on for quite some time."), (2, "dog sat on the log by the old mill stream"), (3, None), (4, "clean, as it is")]
    out = decontaminate.remove_leaks(odd(spark, rows), items)
    assert out.columns == odd(spark).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before: a After it all went on for quite some time.", 3: None, 4: "clean, as it is"}


def test_leaks_of_many_groups_are_judged_together(spark, monkeypatch):
    """Coverage adds up over groups, leaks that overlap go whole, and no cut makes a new leak."""
    a, b, c, d = ([f"{x}{i}" for i in range(30)] for x in "abcd")
    items = spark.createDataFrame([(1, " ".join(a[:14])), (2, " ".join(a[8:20])), (3, " ".join(b[:12])), (4, " ".join(c[:5] + c[20:26]))], "item_id long, text string")
    texts = [d + a[:20] + d, a[:14] + b[:12] + d[:20], d + c[:5] + b[:12] + c[20:26] + d, d]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts)]
    one = sorted(map(repr, decontaminate.remove_leaks(odd(spark, rows), items).collect()))
    assert len(one) == 3
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 3)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 1)
    assert sorted(map(repr, decontaminate.remove_leaks(odd(spark, rows), items).collect())) == one


# --- quality rules --------------------------------------------------------------------------------------


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@given(st.text("ab#é \n\x1c\x85", max_size=60))
@settings(max_examples=200, deadline=None)
def test_measures(text):
    t = quality_rules.Text(text.encode())
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_measures(text)


def test_rules_on_odd_rows(spark, sf):
    got = quality_rules.apply_rules(odd(spark)).collect()
    assert len(got) == len(ODD_DOCS) and not any(r.kept for r in got)
    assert quality_rules.apply_rules(odd(spark).where("false")).isEmpty()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    orders = [list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    verdicts = [quality_rules.apply_rules(docs, order=o, measures=False).orderBy("doc_id").collect() for o in orders]
    assert verdicts[0] == verdicts[1]
    assert sorted(quality_rules.plan_cascade(docs)) == sorted(quality_rules.RULES)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdicts[0] if r.kept}
    assert quality_rules.keep_good(odd(spark)).isEmpty()


def test_rules_agree_with_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = REGISTRY["op2_quality_rules"](spark, sf).join(labels, "doc_id").collect()
    assert not [r for r in rows if r.quality == 0 and r.kept]
    assert not [r for r in rows if r.quality == 1 and not r.kept and not r.base_failed]


# --- byte-level BPE -------------------------------------------------------------------------------------


def test_bpe_is_the_library_s(spark, sf):
    ours, theirs = bpe.ByteBpe(PATH), Tokenizer.from_file(PATH)
    theirs.no_truncation()
    theirs.no_padding()
    rng = random.Random(5)
    alphabet = ["'s", "'t", "'re", "'ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "'", '"', "!", "　", "\x1c", "\x85", "🙂", "<|endoftext|>", "aaaa", "$$$", "\r\n", "_"]
    texts = ["", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        expected = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert ours.decode(ids).decode() == theirs.decode(expected, skip_special_tokens=False)


def test_bpe_cache_may_run_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small, large = bpe.ByteBpe(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three four five", "one six one seven", "aaaaaaa aaaaaaaa"):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == large.encode(text).ids


def test_bpe_of_odd_rows(spark):
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.encode(odd(spark), PATH).collect()}
    assert rows[2, 0].ids == rows[3, 0].ids == []
    assert rows[4, 30_001].n_tokens == 30_001
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd(spark), PATH), PATH).collect()}
    assert texts[4] == "x " * 30_000 and texts[2] == "" and texts[5] == "\n\t \x0b"
    digests = {r.doc_id: r for r in bpe.round_trip(odd(spark), PATH).collect()}
    assert digests[1].decoded_sha256 == hashlib.sha256(ODD_DOCS[0][1].encode()).hexdigest()
    assert bpe.encode(odd(spark).where("false"), PATH).isEmpty()


# --- licenses -------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "Code.\nReleased under the MIT License. All rights reserved."),
        (2, "LICENSED under the Apache License,   Version 2.0. You may not use this file except in compliance with the License!"),
        (3, None),
        (4, "you may not use this file except in compliance with the license"),
        (5, "Licensed under CC BY-NC 4.0. Words between. All rights reserved."),
        (6, ""),
        (6, ""),
    ]
    got = {r.doc_id: (r.n_known, r.sentence_ids, r.licenses) for r in license_scan.scan(odd(spark, rows)).collect()}
    assert got[1] == (2, "mit-line,reserved", "MIT,All-Rights-Reserved")
    assert got[2] == (2, "apache-line,apache-except", "Apache-2.0")
    assert got[4] == (1, "apache-except", "") and got[3] == got[6] == (0, "", "")
    assert got[5] == (2, "cc-by-nc-line,reserved", "CC-BY-NC-4.0")
    assert license_scan.scan(odd(spark, rows)).count() == 7
    assert license_scan.scan(odd(spark).where("false")).isEmpty()


@pytest.mark.parametrize("limit", [32 << 20, 1])
def test_licenses_of_own_tables(spark, monkeypatch, limit):
    """Identifiers of any characters, sentences sent to the tasks or shuffled to."""
    monkeypatch.setattr(license_scan, "BROADCAST_BYTES", limit)
    known = spark.createDataFrame([("gpl-2.0+", "use it freely"), ("a(b", "at your own risk"), ("<c>", "keep this notice"), ("x,y|", "no warranty")], "sentence_id string, sentence string")
    rules = [("GPL", ["gpl-2.0+"]), ("Both", ["a(b", "<c>"]), ("Odd", ["x,y|"]), ("Never", []), ("Again", ["gpl-2.0+"])]
    rows = [(1, "Use it freely!"), (2, "At your own risk. Keep this notice.\nNo warranty"), (3, "keep this notice. At your own risk."), (4, None)]
    got = {r.doc_id: (r.n_known, r.licenses) for r in license_scan.scan(odd(spark, rows), known, rules).collect()}
    assert got == {1: (1, "GPL"), 2: (3, "Both,Odd"), 3: (2, ""), 4: (0, "")}
    assert {r.licenses for r in license_scan.scan(odd(spark, rows), known, []).collect()} == {""}
    assert {r.n_known for r in license_scan.scan(odd(spark, rows), known.where("false"), rules).collect()} == {0}
