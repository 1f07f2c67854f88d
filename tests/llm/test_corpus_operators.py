"""Operators that compare texts or gather from the corpus, against brute force, and the pipeline as a whole."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbitrail.llm import lm_score, ngram_join, quality_classifier, quality_rules, substring_dedup, url_filter, warc
from arbitrail.llm.common import connected, keyed
from arbitrail.llm.queries import REGISTRY
from arbitrail.session import shared_dir

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(doc_id, text) with columns of names that operators use themselves."""
    names = "component string, spans string, row string, size string, name string, bucket string, goes string, held_out string"
    return spark.createDataFrame([(*r, *["own"] * 8) for r in rows], "doc_id long, text string, " + names)


def words_of(text):
    return SPACE.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- components -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_connected(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    up = {x: x for pair in links for x in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert connected(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- substring dedup ------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    seen = Counter()
    all_words = [words_of(t) for t in texts]
    for w in all_words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 10_000])
def test_substring_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup.find_repeats, "__defaults__", (35, 8, hot))
    rng = random.Random(3)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 90))]
        if i % 3 == 0:
            parts += [rng.choice(shared), prose(rng, 20)]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], None, "", "a b " * 60, "same " * 5000, "\n\t", shared[0] + "\n" + shared[0], "é " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[2]), (1, "other text of the same id")]
    got = substring_dedup.digests(frame(spark, rows), window=35, core=8).collect()
    expected = brute_repeats([t for _, t in rows], 35)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *e) for (i, _), e in zip(rows, expected, strict=True))
    assert substring_dedup.digests(frame(spark, rows).where("false")).isEmpty()


@given(st.lists(st.text("ab ", max_size=40), max_size=4))
@settings(max_examples=50, deadline=None)
def test_windows_of_a_bucket(texts):
    strings = [(" ".join(t.split()).encode(), 1) for t in texts if len(t.split()) >= 3]
    seen = Counter()
    for s, _ in strings:
        w = s.split()
        seen.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for (s, _), spans in zip(strings, substring_dedup.repeated_places(strings, 3), strict=True):
        w = s.split()
        expected = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert {i for a, b in spans for i in range(a, b)} == expected


def test_repeats_are_cut_from_whole_rows(spark):
    rng = random.Random(4)
    passage = prose(rng, 50)
    rows = [(1, f"one start\n{passage}\nthe  end"), (2, f"{passage} tail"), (3, "clean \n as it is"), (4, None)]
    docs = frame(spark, rows)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one start\nthe  end", 2: "tail", 3: "clean \n as it is", 4: None}


# --- n-gram join ----------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), low.get(find(i))) for i, (doc_id, _) in enumerate(rows))


def near_copies(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [4, 2048])
def test_ngram_join_is_exact(spark, block):
    rng = random.Random(8)
    passage = prose(rng, 60, 10**6)
    rows = [(1000 - i, prose(rng, rng.randrange(1, 200), 10**6)) for i in range(40)]
    for i in range(8):
        original = prose(rng, rng.choice([30, 120, 400]), 10**6)
        rows += [(i * 10 + k, near_copies(rng, original, rng.randrange(0, 9))) for k in range(8)]
    rows += [(2000 + i, f"{passage} {prose(rng, 8, 10**6)}") for i in range(15)]  # a passage shared by many, similar or not
    rows += [(2100 + i, f"{passage} {prose(rng, 40, 10**6)}") for i in range(15)]
    rows += [(3000, "a b"), (3001, "A b"), (3002, None), (3003, ""), (3004, ""), (3005, "x " * 30_000), (3006, rows[0][1].upper().replace("W", "w"))]
    rows += [(5, rows[45][1]), rows[45], (None, rows[50][1]), (None, "only this one has these words"), (7, "a b c d e f g h i j k l")]
    got = ngram_join.components(frame(spark, rows), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_ngram_join_without_rows(spark):
    assert ngram_join.components(frame(spark, [(1, "x")]).where("false")).isEmpty()


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=40), st.sampled_from([50, 80, 100]))
@settings(max_examples=100, deadline=None)
def test_tree_drops_no_link(sets, threshold):
    values = np.random.default_rng(1).integers(0, 2**63, 41, dtype=np.uint64)
    arrays = sorted((np.sort(values[sorted(s)]) for s in sets), key=len)
    tree = ngram_join.SignatureTree(np.array([len(a) for a in arrays]), [ngram_join.bitmap(a) for a in arrays], threshold)

    def linked(a, b):
        both = len(np.intersect1d(arrays[a], arrays[b]))
        return 100 * both >= threshold * (len(arrays[a]) + len(arrays[b]) - both)

    groups, brute = ngram_join.Groups(len(arrays)), ngram_join.Groups(len(arrays))
    tree.traverse(groups, linked)
    for a in range(len(arrays)):
        for b in range(a):
            if linked(a, b):
                brute.join(a, b)
    same = lambda g: [[g.find(a) == g.find(b) for b in range(len(arrays))] for a in range(len(arrays))]
    assert same(groups) == same(brute)


def test_one_of_each(spark):
    rng = random.Random(2)
    text = prose(rng, 100)
    rows = [(5, text), (3, near_copies(rng, text, 1)), (3, "quite another text of its own"), (3, "quite another text of its own"), (9, None), (10, ""), (None, text)]
    out = ngram_join.one_of_each(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[1], rows[2], rows[4], rows[5]])


# --- url rules ------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_url_rules(spark):
    rng = random.Random(1)
    labels = ["a", "b", "com", "www", "x-y", "é"]
    rules = {}
    for _ in range(80):
        host = ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
        rules[host, rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/é"])] = rng.choice(["allow", "block"])
    rules = [(*k, v) for k, v in rules.items()]
    urls = [None, "", "no url", "http://", "HTTP://A.COM", "http://a.com", "http://a.com?q", "x://a.com#f", "http://.com/a", "http://com./a", "http://a.com/a://b"]
    urls += ["http://" + ".".join(rng.choice([*labels, "B"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/a", "/abc", "/a/b/c?x", "/é#y"]) for _ in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/a"), (5, "http://a.com/a"), (5, "http://a.com/a")] + [(9000 + i, "http://www.a.com/a/b") for i in range(200)]
    pages = spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, host string, open string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), rules[0][:2] + ("block",)], "host string, path string, verdict string")
    rules[0] = rules[0][:2] + ("block",)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table).collect())
    assert got == Counter((i, *brute_verdict(u, rules)) for i, u in rows)
    assert Counter(r.verdict for r in url_filter.judge(pages, table.where("false")).collect()) == {"allow": len(rows)}
    assert url_filter.judge(pages.where("false"), table).isEmpty()


def test_url_sweep_is_native(spark, sf):
    plan = REGISTRY["op3_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- WARC -----------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, html string, digest string, first string")


def test_warc_of_odd_rows_is_the_same_each_time(spark):
    long = "<p>" + "x" * 200
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 40)) for i in range(200)]
    rows += [(500, "http://h/a b\r\nc", long), (501, None, long), (502, "u", None), (None, None, long), (503, "u", ""), (504, "u", "é" * 300_000), (501, None, long), (500, "v", long), (505, "u", "\r\n\r\nWARC/1.1\r\n")]
    files = []
    for n in (1, 7):
        folder = shared_dir(spark, "warc-test")
        manifest = warc.write_archives(pages_of(spark, rows).repartition(n), folder, chunk_bytes=5000, file_bytes=1500)
        files.append(sorted((r.file, r.records, r.bytes, r.sha256) for r in manifest.collect()))
        back = warc.read_archives(spark, folder)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in back.collect())
        expected = Counter()
        for page, _, html in rows:
            data = (html or "").encode()
            revisit = html == long and page != 500
            expected[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 500 if revisit else None, None if revisit else data] += 1
        assert got == expected
    assert files[0] == files[1] and len(files[0]) > 5


def test_warc_damage_is_noticed():
    record = warc.build_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    (fields, block), = warc.parse_records(record)
    assert block == b"payload" and fields["WARC-Target-URI"] == "u"
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse_records(record[:-9]))


def test_warc_without_pages(spark):
    assert warc.archive(pages_of(spark, [(1, "u", "h")]).where("false")).isEmpty()


# --- classifier -----------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = REGISTRY["op6_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows} == {0}
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)


def test_classifier_ignores_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_classifier.train(docs, labels).weights, quality_classifier.train(docs, flipped).weights)


def test_classifier_on_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "text"), (3, "x" * 50_000), (3, "x" * 50_000), (4, "\n\n")])
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 1), (3, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        got = quality_classifier.score(docs, quality_classifier.train(docs, known)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_classifier.score(docs.where("false"), quality_classifier.train(docs.where("false"), labels)).isEmpty()


def brute_risk(positive, unlabelled, w, b, prior):
    """Both parts of the risk, row by row: of positives as positives, and of negatives."""
    z = lambda x: sum(a * c for a, c in zip(x, w, strict=True)) + b
    mean = lambda rows, sign: sum(math.log(1 + math.exp(sign * z(x))) for x in rows) / len(rows)
    return prior * mean(positive, -1), mean(unlabelled, 1) - prior * mean(positive, 1)


@pytest.mark.parametrize("centre", [1.5, -1.0])
def test_classifier_step_follows_the_brute_force_risk(centre):
    """In the second case unlabelled rows score lower than positives among them allow, so that the step goes back."""
    rng = random.Random(3)
    positive, unlabelled = ([[rng.gauss(m, 1) for _ in range(4)] for _ in range(n)] for m, n in ((2.0, 7), (centre, 11)))
    w, bias, prior = [0.5, -0.2, 0.9, 0.7], 0.3, 0.6
    terms = quality_classifier.negative_terms(np.array(unlabelled), np.array(w), bias)
    got = quality_classifier.risk_gradient(np.array(positive), terms, np.array(w), bias, prior)
    backwards = brute_risk(positive, unlabelled, w, bias, prior)[1] < 0
    assert backwards == (centre < 0)
    value = lambda at: (lambda r: -r[1] if backwards else r[0] + r[1])(brute_risk(positive, unlabelled, at[:-1], at[-1], prior))
    for i in range(5):
        low, high = ([x + (step if i == j else 0) for j, x in enumerate([*w, bias])] for step in (-1e-5, 1e-5))
        assert math.isclose(got[i], (value(high) - value(low)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled_rows(prior):
    rng = np.random.default_rng(5)
    draw = lambda n, share: np.where((rng.random(n) < share)[:, None], rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3)))
    assert abs(quality_classifier.estimate_prior(draw(6000, 1.0), draw(6000, prior)) - prior) < 0.05
    assert quality_classifier.estimate_prior(draw(39, 1.0), draw(4000, prior)) is None


def test_classifier_sums_all_rows_and_samples_one_row_of_an_id(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i % 50, prose(rng, 40)) for i in range(300)])
    rows = docs.select(F.col("text").cast("binary").alias("text")).collect()
    data, offsets = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.uint8), np.append(0, np.cumsum([len(r[0]) for r in rows]))
    x = quality_classifier.features(data, offsets).astype(np.float16)
    packed = spark.createDataFrame([(r.tobytes(),) for r in x], "features binary").repartition(7)
    assert np.allclose(quality_classifier._summed(packed, quality_classifier.N_FEATURES, lambda b: b.sum(0)), x.astype(float).sum(0), atol=1e-3)
    held, matrix = [], quality_classifier._matrix
    monkeypatch.setattr(quality_classifier, "_matrix", lambda rows: held.append(len(rows)) or matrix(rows))
    quality_classifier.train(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"), sample_rows=20, rounds=2, last_rounds=1)
    assert held == [20, 20]


# --- LM scores ------------------------------------------------------------------------------------------


def brute_base(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = [[*words_of((t or "").translate(lower)), None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for ws, o in zip(tokens, out, strict=True) if not o for w in ws)
    n = sum(counts.values())
    base = [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in ws) for ws in tokens]
    return [(i, o, len(ws), sum(counts[w] > 0 for w in ws), n, b) for (i, _), o, ws, b in zip(rows, out, tokens, base, strict=True)]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 18])
def test_unigram_scores(spark, frequent):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 300), 60 + i)) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "w1 w2"), (103, "w1 " * 20_000), (3, rows[3][1]), (3, rows[3][1]), (3, "W1 é"), (104, "\x1c w1\x85")]
    got = lm_score.score(frame(spark, rows), frequent=frequent).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=order)
    for a, b in zip(got, sorted(brute_base(rows), key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_tree_scores_are_probabilities(spark):
    """In every state the symbols' shares add up to 1, and texts with a pattern are more likely than under single words."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["a b", "c d", "e f"]) for _ in range(200))) for i in range(40)]
    got = lm_score.score(frame(spark, rows)).collect()
    assert all(r.score > r.base_score + 20 for r in got)
    counts = spark.createDataFrame([((2 * 256 + 3) * 256 + s, n) for s, n in ((2, 500), (3, 500))] + [((3 * 256 + 3) * 256 + 2, 1000)], "word long, n long")
    root = np.full(256, 1 / 256)
    tree = lm_score.build_tree(counts, root)
    assert np.allclose((10.0 ** tree.log10).sum(1), 1, atol=1e-3) and len(tree.log10) > 2


def test_scores_beat_single_words_on_held_out_texts(spark):
    rows = [r for r in REGISTRY["op9_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def brute_tree(rows):
    """(scores, states): the rule of the suffix tree in plain Python, over all words and all lengths of contexts."""
    texts = [[None, *words_of(t), None] for _, t in rows]
    learnt = [ws for (i, _), ws in zip(rows, texts, strict=True) if zlib.crc32(str(i).encode()) % 10]
    n = Counter((w,) for ws in learnt for w in ws[1:])
    total = sum(n.values())
    unseen, root = 0.5 * len(n) / total, {g: (c - 0.5) / total for g, c in n.items()}
    chance, above, alpha, entry = dict(root), {g: c / total for g, c in n.items()}, {}, {}
    for k in range(1, 1000):
        grams = Counter(tuple(ws[i - k : i + 1]) for ws in learnt for i in range(k, len(ws)))
        followers = {}
        for g, c in grams.items():
            if n[g[:-1]] >= 50:
                followers.setdefault(g[:-1], {}).update({g: c} if c >= 5 else {})
        now, before = {}, len(alpha)
        for context, found in followers.items():
            size = n[context]
            rest, free = size - sum(found.values()), 1 - sum(chance[g[1:]] for g in found)
            gain = sum(c * math.log(c / size / above[g[1:]]) for g, c in found.items()) - len(found)
            gain += rest * math.log(rest / size / (1 - sum(above[g[1:]] for g in found))) if rest else 0
            if found and gain >= 20:
                alpha[context] = math.log10((rest + 20 * free) / (size + 20) / free)
            for g, c in found.items():
                now[g] = (c + 20 * chance[g[1:]]) / (size + 20) if context in alpha else chance[g[1:]]
                if context in alpha:
                    entry[g] = math.log10(now[g] / root[g[-1:]])
        above = {g: c / n[g[:-1]] for f in followers.values() for g, c in f.items()}
        chance, n = now, grams
        if k > 1 and len(alpha) == before:
            break
    scores, deepest = [], max(map(len, alpha), default=0)
    for ws in texts:
        sums = 0.0
        for i in range(1, len(ws)):
            sums += math.log10(root.get((ws[i],), unseen))
            change = 0.0
            for j in range(i - 1, max(i - 1 - deepest, -1), -1):
                if tuple(ws[j:i]) in alpha:
                    change = entry[tuple(ws[j : i + 1])] if tuple(ws[j : i + 1]) in entry else change + alpha[tuple(ws[j:i])]
            sums += change
        scores.append(sums)
    return scores, alpha


def test_tree_has_all_words_and_lengths_that_pass(spark):
    """More than 254 words foretell the next one, and some only the fourth after them."""
    rng = random.Random(9)
    far = lambda j: f"far{j % 2} {' '.join('mno'[: 1 + j % 3])} end{j % 2}"
    rows = [(i, " ".join(rng.choice([f"k{j} v{j}" for j in range(400)] + [far(j) for j in range(102)]) for _ in range(600))) for i in range(90)]
    scores, states = brute_tree(rows)
    assert sum(len(s) == 1 for s in states) > 300 and any(len(s) >= 4 for s in states)
    for options in ({}, {"frequent": 30, "part_bytes": 4000}):
        got = {r.doc_id: r.score for r in lm_score.score(frame(spark, rows), **options).collect()}
        assert all(math.isclose(got[i], s, rel_tol=1e-6) for (i, _), s in zip(rows, scores, strict=True))


def test_scores_do_not_depend_on_batches(spark):
    """Words that no single text has more than three times count as much as if all texts were one batch."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 500} v{rng.randrange(300)}" for _ in range(40))) for i in range(80)]
    found = []
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append({r.doc_id: r.score for r in lm_score.score(frame(spark, rows), frequent=100).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(math.isclose(found[0][i], found[1][i], rel_tol=1e-9) for i, _ in rows)


def test_scores_without_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm_score.score(frame(spark, [(i, "a b") for i in held])).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm_score.score(frame(spark, [(1, "a")]).where("false")).isEmpty()


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage redone in plain Python on a mixture of clean, bad, copied, shared and leaked texts."""
    import corpus_pipeline

    rng = random.Random(9)
    item = prose(rng, 30, 10**6)
    passage = prose(rng, 60, 10**6)
    clean = [prose(rng, 120, 10**6) + "." for _ in range(12)]
    texts = [*clean, clean[0], near_copies(rng, clean[1], 1), f"{prose(rng, 80, 10**6)} {passage}", f"{passage} {prose(rng, 90, 10**6)}"]
    texts += [f"{prose(rng, 60, 10**6)}\n{item}\n{prose(rng, 50, 10**6)}", item + " " + item[: len(item) // 3] + " " + prose(rng, 22, 10**6), "few words", None, "", "$$$ ### " * 60, "SHOUT! " * 80]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name

    kept = [(i, t) for i, t, *_ in rows if not any(test(quality_rules.Text((t or "").encode()), quality_rules.Limits()) for test in quality_rules.RULES.values())]
    component = {}
    for (doc_id, _, root), n in brute_components(kept).items():
        component[doc_id] = root
    kept = [(i, t) for i, t in kept if component[i] == i]
    seen = Counter(tuple(w[i : i + 35]) for _, t in kept for w in [words_of(t)] for i in range(len(w) - 34))
    shorter = []
    for i, t in kept:
        w = words_of(t)
        gone = {p + j for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for j in range(35)}
        shorter.append((i, t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)))
    leaked = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    item_words = leaked.findall(item.lower())
    final = {}
    for i, t in shorter:
        w = leaked.findall(t.lower())
        hit = {at + j for at in range(len(w) - 9) for p in range(len(item_words) - 9) if w[at : at + 10] == item_words[p : p + 10] for j in range(10)}
        if len(hit) <= 0.5 * len(w):
            final[i] = [x for k, x in enumerate(w) if k not in hit]
    assert {r.doc_id: leaked.findall(r.text.lower()) for r in docs.collect()} == final
    assert set(range(12)) - {0} <= set(final) | {0} and 12 not in final

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == {r.doc_id: theirs.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_pipeline_stages_take_odd_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(1, None), (1, None), (None, "x"), (2, ""), (3, "y " * 20_000), (3, "y " * 20_000)])
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= 6
    assert keyed(docs, "doc_id", "text").count() == 6
