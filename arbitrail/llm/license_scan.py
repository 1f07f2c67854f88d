"""License recognition by sentences.

Texts are cut into sentences, each normalised to lower-case words. A normalised sentence that is known (a table of
sentences and their identifiers) becomes its identifier; what remains of a text is a sequence of identifiers, in order, with
the sentences in between left out. Rules are ordered identifier sequences; one matches where its identifiers stand one after
another without another known sentence between them. Of matches at one place the rule that comes first wins, and the search
goes on after it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import BROADCAST_BYTES, attach, stored, text_bytes

#: Sentences of public licenses and notices, normalised, with the license each speaks of.
SENTENCES = [
    ("mit-line", "released under the mit license"),
    ("mit-line", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-line", "licensed under the apache license version 2 0"),
    ("apache-except", "you may not use this file except in compliance with the license"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-line", "licensed under the gnu general public license"),
    ("gpl-3-line", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-line", "licensed under cc by nc 4 0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-line", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-line", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache", "spdx license identifier apache 2 0"),
    ("spdx-bsd", "spdx license identifier bsd 3 clause"),
    ("spdx-gpl", "spdx license identifier gpl 3 0 only"),
    ("reserved", "all rights reserved"),
]
#: Rules in order of preference: longer sequences first.
RULES = [
    ("MIT", ["mit-line", "mit-grant", "as-is"]),
    ("MIT", ["mit-grant", "as-is"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache-line", "apache-except"]),
    ("Apache-2.0", ["apache-line"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL", ["gpl-free"]),
    ("GPL-3.0", ["gpl-3-line"]),
    ("GPL", ["gpl-line"]),
    ("GPL", ["spdx-gpl"]),
    ("BSD", ["bsd-grant", "as-is"]),
    ("BSD", ["bsd-grant"]),
    ("BSD", ["spdx-bsd"]),
    ("CC-BY-4.0", ["cc-by-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-line", "reserved"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-line"]),
    ("All-Rights-Reserved", ["reserved"]),
]

KEY = ["doc_id", "text_key"]


def sentences(text: Column) -> Column:
    """Sentences of a text: lines, cut after a full stop, exclamation or question mark with white space behind it."""
    return F.split(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"([.!?])[ \t\r\f\x0B]+", "$1\n"), "\n")


def normalised(sentence: Column) -> Column:
    """A-Z lower-cased, runs of other ASCII than letters and digits as one space, none at the ends."""
    small = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(small, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def scan(
    docs: DataFrame, known: DataFrame | None = None, rules: list[tuple[str, list[str]]] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses), a row for each row of ``docs``.

    known: (sentence_id, sentence), distinct sentences already normalised; while small (it is measured) it is broadcast, else the
    sentences of all texts are shuffled to it. n_known counts
    a text's known sentences; sentence_ids lists them in order, licenses those of the rules that match, in order of place,
    each once; both comma-joined and empty where there is none. Null and empty texts have none. Repeated rows give
    repeated rows.
    """
    rules = RULES if rules is None else rules
    if known is None:
        known = docs.sparkSession.createDataFrame(SENTENCES, "sentence_id string, sentence string")
    size = known.agg(F.sum(F.length("sentence_id") + F.length("sentence") + 32)).first()[0] or 0
    lookup = known.select("sentence_id", "sentence")
    lookup = F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_bytes(text)).alias("text_key"), F.posexplode(sentences(body)).alias("place", "raw"))
    hits = rows.select(*KEY, "place", normalised(F.col("raw")).alias("sentence")).join(lookup, "sentence")
    # a set, since repeated rows bring each place again
    ordered = F.array_sort(F.collect_set(F.struct("place", "sentence_id")))
    found = hits.groupBy(*KEY).agg(ordered.alias("found")).select(*KEY, F.col("found.sentence_id").alias("ids"))
    found = stored(found, "licenses")
    keys = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_bytes(text)).alias("text_key"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = attach(keys, found, KEY, F.size("ids") * 24)
    return out.select("doc_id", F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(F.array_distinct(licenses(ids, rules)), ",").alias("licenses"))


def licenses(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licenses of an identifier sequence: leftmost matches first, of those at one place the first rule's. Rules without identifiers match nothing."""
    number = {i: str(n) for n, i in enumerate(dict.fromkeys(i for _, sequence in rules for i in sequence))}
    names: dict[str, str] = {}
    for name, sequence in rules:
        if sequence:
            names.setdefault("".join(f"<{number[i]}>" for i in sequence), name)
    if not names:
        return F.array().cast("array<string>")
    numbers, table = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (number, names))
    # identifiers stand as numbers, so that no character of theirs means anything in the pattern; one of no rule breaks every match
    marked = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), F.coalesce(F.try_element_at(numbers, i), F.lit("x")), F.lit(">"))), "")
    return F.transform(F.regexp_extract_all(marked, F.lit("|".join(names)), F.lit(0)), lambda m: F.element_at(table, m))
