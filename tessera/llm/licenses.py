"""License scan by a positional rare-token index, in DataFrame functions only.

Words are runs of 0-9, a-z and all characters from U+0080 on, after A-Z have been lower-cased. Document frequencies of the licence
words are counted over all documents; each template is indexed under its RARE words of highest IDF, with their positions. The
indexed words of a file, looked up by position, propose (template, offset) places; a place stays if at least VOTES of the
template's rare words stand at their relative positions, if COVER of its words do, and if its mandatory key phrases stand whole.
Nothing is shuffled but the word counts (at most one row per licence word comes to the driver).

Base labels come from the places of fixed phrases. Defined results: a null text is empty; no words give zero counts, null
positions, empty labels and score 0; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = WORD.replace("[^", "[")
RARE, VOTES, COVER = 4, 2, 0.8
LONGEST, TEMPLATE = 1 << 16, 1 << 40  # a template has fewer words, a text fewer than TEMPLATE less LONGEST
# Base phrases and labels; then licence templates (label, wording) with their mandatory phrases.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Names are cut to their distinctive core, without words that lead in, as notices differ there.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TEMPLATES = [
    ("apache-2.0", "Apache License, Version 2.0", ["apache license", "version 2"]),
    ("apache-2.0", "Apache License 2.0", ["apache license 2"]),
    ("mit", "MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("gpl-3.0", "GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "GPLv3", ["gplv3"]),
    ("gpl-2.0", "GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-2.0", "GPLv2", ["gplv2"]),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["general public license", "free software foundation"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    *[(f"cc-by{x}-4.0", f"CC BY{x.upper()} 4.0", [f"cc by{x}".replace("-", " ")]) for x in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")],
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International", ["creative commons attribution 4"]),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", ["creative commons attribution sharealike"]),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ["creative commons attribution noncommercial 4"]),
    ("cc0-1.0", "CC0 1.0 Universal", ["cc0 1"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "Mozilla Public License, v. 2.0", ["mozilla public license", "2 0"]),
    ("mpl-2.0", "Mozilla Public License Version 2.0", ["mozilla public license", "2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    *[(name.lower(), f"SPDX-License-Identifier: {name}", ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())]) for name in SPDX],
]


def words_of(s: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s))


def words(text: Column) -> Column:
    """The words; splitting at what is between them takes a quarter of the time that extracting them takes."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def vocabulary(templates: list) -> list[str]:
    return sorted({w for _, t, _ in templates for w in words_of(t)})


def document_counts(docs: DataFrame, templates: list) -> dict[str, int]:
    """In how many documents each licence word stands."""
    found = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.lit(vocabulary(templates)).cast("array<string>"))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def rare_index(templates: list, counts: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[list[int]]]:
    """Postings (template, position) of each template's rarest words, and the positions themselves by template."""
    postings: dict[str, list[tuple[int, int]]] = {}
    rare: list[list[int]] = []
    for t, (_, wording, _) in enumerate(templates):
        own = words_of(wording)
        chosen = sorted(set(own), key=lambda w: (counts.get(w, 0), w))[:RARE]
        rare.append([p for p, w in enumerate(own) if w in chosen])
        for p in rare[-1]:
            postings.setdefault(own[p], []).append((t, p))
    return postings, rare


def _runs(at: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands in words from at."""
    ok = F.lit(True)
    for j, w in enumerate(phrase):
        ok = ok & F.coalesce(F.get("words", at + j) == w, F.lit(False))
    return ok


def _standing(positions: list[int], body: list[str], offset: Column) -> Column:
    """How many of the template's words at these positions stand at their relative positions."""
    return sum((F.coalesce((F.get("words", offset + p) == body[p]).cast("int"), F.lit(0)) for p in positions), F.lit(0))


def _phrase_places(phrase: list[str], label: str) -> Column:
    return F.transform(F.filter("hits", lambda i: _runs(i, phrase)), lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label")))


def _template_places(t: int, label: str, keys: list[str], body: list[str], rare: list[int]) -> Column:
    """The proposed offsets of template t that hold its rare words, enough of all its words, and its mandatory phrases."""
    need = min(VOTES, len(rare))
    offsets = F.transform(F.filter("proposed", lambda c: c.between(t * TEMPLATE, (t + 1) * TEMPLATE - 1)), lambda c: (c - t * TEMPLATE - LONGEST).cast("int"))
    voted = F.filter(F.transform(offsets, lambda o: F.struct(o.alias("o"), _standing(rare, body, o).alias("votes"))), lambda c: c["votes"] >= need)
    every = list(range(len(body)))
    scored = F.transform(voted, lambda c: F.struct(F.lit(label).alias("label"), c["o"].alias("o"), c["votes"].alias("votes"), (_standing(every, body, c["o"]) / len(body)).alias("cover")))

    def verified(c: Column) -> Column:
        ok = c["cover"] >= COVER
        for k in map(words_of, keys):
            ok = ok & _runs(c["o"] + next(i for i in every if body[i : i + len(k)] == k), k)
        return ok

    return F.filter(scored, verified)


def scan_licenses(docs: DataFrame, templates: list = TEMPLATES, phrases: list = PHRASES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places: array<struct<label,start,votes,cover>> of the verified templates."""
    docs = docs.select("doc_id", "text")
    postings, rare = rare_index(templates, document_counts(docs, templates))
    bodies = [words_of(t) for _, t, _ in templates]
    wanted = sorted({*postings, *(words_of(p)[0] for p, _ in phrases)})
    df = docs.select("doc_id", words(F.col("text")).alias("words"))
    df = df.withColumn("hits", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(wanted), i))))
    df = df.withColumn("base", F.concat(*[_phrase_places(words_of(p), label) for p, label in phrases]))
    # a proposal is one number, as distinct numbers are found by hashing and distinct structs are not
    index = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(t * TEMPLATE - p) for t, p in ps]))])
    proposed = F.flatten(F.transform(F.filter("hits", lambda i: F.get("words", i).isin(sorted(postings))), lambda i: F.transform(index[F.get("words", i)], lambda x: x + i + LONGEST)))
    df = df.withColumn("proposed", F.array_distinct(proposed))

    df = df.withColumn("places", F.concat(*[_template_places(t, *templates[t][::2], bodies[t], rare[t]) for t in range(len(templates))]))
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    found = F.transform("places", lambda p: p["label"])
    return df.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"], p["o"].cast("bigint").alias("start"), p["votes"], p["cover"])).alias("places"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def _sql() -> str:
    bodies = [words_of(t) for _, t, _ in TEMPLATES]
    body = ", ".join(f"({t}, {p}, '{w}')" for t, b in enumerate(bodies) for p, w in enumerate(b))
    names = ", ".join(f"({t}, '{label}', {len(bodies[t])})" for t, (label, _, _) in enumerate(TEMPLATES))
    keys = []
    for t, (_, _, ks) in enumerate(TEMPLATES):
        for k in map(words_of, ks):
            at = next(i for i in range(len(bodies[t])) if bodies[t][i : i + len(k)] == k)
            keys += [f"({t}, {at + j})" for j in range(len(k))]
    heads = ", ".join(f"('{words_of(p)[0]}')" for p, _ in PHRASES)
    phrases = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' l FROM seen WHERE ws[i+1:i+{len(words_of(p))}] = {words_of(p)!r} AND w = '{words_of(p)[0]}'" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws FROM documents),
body(t, p, w) AS (VALUES {body}), names(t, label, n) AS (VALUES {names}), keys(t, p) AS (VALUES {", ".join(dict.fromkeys(keys))}),
seen AS (SELECT doc_id, ws, i, ws[i+1] w FROM d, LATERAL (SELECT unnest(range(len(ws))) i) WHERE ws[i+1] IN (SELECT w FROM body UNION ALL VALUES {heads})),
df AS (SELECT b.w, count(DISTINCT doc_id) n FROM (SELECT DISTINCT w FROM body) b LEFT JOIN seen USING (w) GROUP BY 1),
rare AS (SELECT t, w FROM (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY n, w) k FROM (SELECT DISTINCT t, w FROM body) JOIN df USING (w)) WHERE k <= {RARE}),
rp AS (SELECT b.* FROM body b JOIN rare USING (t, w)), need AS (SELECT t, least({VOTES}, count(*)) need FROM rp GROUP BY 1),
prop AS (SELECT DISTINCT doc_id, t, i - p o FROM seen JOIN rp USING (w)),
cand AS (SELECT doc_id, t, o, any_value(ws) ws FROM prop JOIN d USING (doc_id) GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, c.t, o, b.p, CASE WHEN o + b.p >= 0 THEN coalesce(ws[o + b.p + 1] = b.w, false) ELSE false END ok, rp.p IS NOT NULL r, k.p IS NOT NULL k FROM cand c JOIN body b ON b.t = c.t LEFT JOIN rp ON rp.t = b.t AND rp.p = b.p LEFT JOIN keys k ON k.t = b.t AND k.p = b.p),
good AS (SELECT doc_id, t, o, count(*) FILTER (ok)/CAST(count(*) AS DOUBLE) cover FROM hit JOIN need USING (t) GROUP BY 1, 2, 3 HAVING count(*) FILTER (ok AND r) >= max(need) AND count(*) FILTER (ok)/CAST(count(*) AS DOUBLE) >= {COVER} AND bool_and(ok OR NOT k)),
base AS ({phrases}),
bl AS (SELECT doc_id, count(*) n, min(i) lo, max(i) hi FROM base GROUP BY 1), gl AS (SELECT doc_id, max(cover) c FROM good GROUP BY 1),
b2 AS (SELECT doc_id, string_agg(l, ',' ORDER BY l) s FROM (SELECT DISTINCT doc_id, l FROM base) GROUP BY 1),
a2 AS (SELECT doc_id, string_agg(l, ',' ORDER BY l) s FROM (SELECT doc_id, l FROM base UNION SELECT doc_id, label FROM good JOIN names USING (t)) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(bl.n, 0) n_base, bl.lo first_word, bl.hi last_word, coalesce(b2.s, '') base_labels, coalesce(a2.s, '') labels,
 greatest(coalesce(gl.c, 0e0), CASE WHEN bl.n > 0 THEN 1e0 ELSE 0e0 END) score
FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN gl USING (doc_id) LEFT JOIN b2 USING (doc_id) LEFT JOIN a2 USING (doc_id)
"""


OP3_SQL = _sql()
