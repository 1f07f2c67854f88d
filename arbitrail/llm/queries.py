"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        REGISTRY[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def span_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])


OP1_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS g FROM doc, sizes s, unnest(range(1, len(w) - s.n + 2)) AS u(i) WHERE len(w) >= s.n),
found AS (SELECT h.doc_id, h.i, h.n, x.item_id FROM hits h JOIN windows x ON x.g = h.g AND x.n = h.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN places p USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


@query(OP1_SQL)
def op1_decontamination(spark, sf):
    from arbitrail.llm.decontaminate import find_leaks

    leaks = find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hit = span_words(F.col("spans"))
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM doc, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
again AS (SELECT doc_id, i FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 3)) AS u(p) GROUP BY doc_id),
measured AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs
  FROM doc LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words
    OR n_dup_lines > 0.5::DOUBLE * len(lines) OR upper > 0.3::DOUBLE * (upper + lower) OR bangs > 0.3::DOUBLE * n_words OR NOT word_chars BETWEEN 3 * n_words AND 10 * n_words
    OR len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) < 0.8::DOUBLE * n_words) AS kept
FROM judged
"""


@query(OP2_SQL)
def op2_quality_rules(spark, sf):
    from arbitrail.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf, "documents"))


@query()
def op5_bpe(spark, sf):
    import public_tokenizers

    from arbitrail.llm.bpe import round_trip

    return round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP7_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM doc, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
repeated AS (SELECT doc_id, i FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p FROM repeated, unnest(range(i, i + 35)) AS u(p)),
lists AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM doc d LEFT JOIN lists l USING (doc_id)
"""


@query(OP7_SQL)
def op7_substring_dedup(spark, sf):
    from arbitrail.llm.substring_dedup import digests

    return digests(table(spark, sf, "documents"))


OP3_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
OP3_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""


@query(OP3_SQL)
def op3_url_filter(spark, sf):
    from arbitrail.llm.url_filter import judge

    rules = spark.createDataFrame(OP3_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf, "pages"), rules)


def op4_sql() -> str:
    from arbitrail.llm.license_scan import RULES, SENTENCES

    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    names: dict[str, str] = {}
    for name, sequence in RULES:
        names.setdefault("".join(f"<{i}>" for i in sequence), name)
    rules = ", ".join(f"('{m}', '{n}')" for m, n in names.items())
    return rf"""
WITH known(sentence_id, sentence) AS (VALUES {known}), rules(m, license) AS (VALUES {rules}),
lines AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r\f\x0B]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM documents),
places AS (SELECT doc_id, i, trim(regexp_replace(translate(s[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS sentence FROM lines, unnest(range(1, len(s) + 1)) AS u(i)),
found AS (SELECT doc_id, list(sentence_id ORDER BY i) AS ids FROM places JOIN known USING (sentence) GROUP BY doc_id),
matches AS (SELECT doc_id, regexp_extract_all(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '{"|".join(names)}') AS ms FROM found),
named AS (SELECT doc_id, license, min(k) AS k FROM (SELECT doc_id, ms[k] AS m, k FROM matches, unnest(range(1, len(ms) + 1)) AS u(k)) JOIN rules USING (m) GROUP BY doc_id, license)
SELECT d.doc_id, CAST(coalesce(len(f.ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN found f USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(license, ',' ORDER BY k) AS licenses FROM named GROUP BY doc_id) n USING (doc_id)
"""


@query()
def op4_license_scan(spark, sf):
    from arbitrail.llm.license_scan import scan

    return scan(table(spark, sf, "documents"))


ORACLES["op4_license_scan"] = op4_sql()


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to
FROM p LEFT JOIN firsts USING (d)
"""


@query(OP10_SQL)
def op10_warc(spark, sf):
    from arbitrail.llm.warc import archive

    return archive(table(spark, sf, "pages"))


@query()
def op6_quality_classifier(spark, sf):
    from arbitrail.llm.quality_classifier import score, train

    docs = table(spark, sf, "documents")
    return score(docs, train(docs, table(spark, sf, "labels")))


OP8_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL
"""


@query(OP8_SQL)
def op8_ngram_join(spark, sf):
    from arbitrail.llm.ngram_join import components

    return components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op9_lm_score(spark, sf):
    from arbitrail.llm.lm_score import score

    return score(table(spark, sf, "documents"))


#: Relation crc(t): the 256 remainders of CRC-32, from its polynomial.
CRC_SQL = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS u(i)))"""


def crc_of(chars: str) -> str:
    """SQL for the CRC-32 of a list of characters up to U+07FF in UTF-8."""
    octets = f"flatten(list_transform({chars}, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH {CRC_SQL},
given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc_of("string_split(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents, crc),
places AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM given),
doc AS MATERIALIZED (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM places),
lags AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, w, n, q FROM doc, unnest(range(1, n // 4 + 1)) AS u(q)), unnest(range(0, n - 3 * q, q)) AS v(j)
  WHERE w[j + 1] = w[j + q + 1] AND w[j + q + 1] = w[j + 2 * q + 1] AND w[j + 2 * q + 1] = w[j + 3 * q + 1]),
breaks AS (SELECT doc_id, q, i FROM lags JOIN doc USING (doc_id), unnest(range(0, n - q)) AS u(i) WHERE w[i + 1] <> w[i + q + 1] UNION ALL SELECT doc_id, q, n - q FROM lags JOIN doc USING (doc_id)),
gaps AS (SELECT doc_id, q, 1 + coalesce(lag(i) OVER (PARTITION BY doc_id, q ORDER BY i), -1) AS s, i AS e FROM breaks),
runs AS MATERIALIZED (SELECT doc_id, s, e - s + q AS n, min(q) AS q FROM gaps WHERE e - s + q >= greatest(6, 4 * q) AND e > s GROUP BY doc_id, s, e - s + q),
named AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, s, n, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(n AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + q, s + n)) AS u(i)),
words AS (SELECT doc_id, i, w[i + 1] AS x FROM doc SEMI JOIN runs USING (doc_id), unnest(range(n)) AS u(i)),
cut AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(b.n AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.n // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(t, '') END) AS collapsed_sha256
FROM doc d LEFT JOIN named USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


def planted_periods(doc_id, words):
    """The contract's change of a tenth of the texts: from some word on, a passage again and again."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], np.resize(words[a : a + period], n - a)])


@query(OP11_SQL)
def op11_periodic_runs(spark, sf):
    from arbitrail.llm.period_runs import digests

    return digests(table(spark, sf, "documents"), rewrite=planted_periods)


OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
counted AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT r, c, {crc_of("string_split(doc_id || ':' || r, '')")} AS h FROM counted, crc),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM changed GROUP BY word HAVING sum(c) >= 3 AND length(word) >= 5),
shorter AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (SELECT x.word AS a, y.word AS b FROM shorter x JOIN shorter y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.s UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.s),
ranked AS (SELECT a AS word, b AS near, n AS m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM pairs JOIN words ON word = b),
forms AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain(word, tip, depth) AS (SELECT word, word, 0 FROM words UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL)
SELECT f.word, n, form, root, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(tip, depth) AS root FROM chain GROUP BY word) USING (word)
"""


def spelling_slip(doc_id, word):
    """The contract's change of one word in 97 of a text: a letter is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


@query(OP12_SQL)
def op12_spelling_variants(spark, sf):
    from arbitrail.llm.spelling_groups import variants

    return variants(table(spark, sf, "documents"), rewrite=spelling_slip)


@query()
def op13_packing(spark, sf):
    import public_tokenizers

    from arbitrail.llm.packing import pack

    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
