import re

from tessera.llm import licenses as L


def brute(texts):
    """Tries every template at every offset of every text."""
    split = [L.words_of(t or "") for t in texts]
    counts = {w: sum(w in set(s) for s in split) for w in L.vocabulary(L.TEMPLATES)}
    _, rare = L.rare_index(L.TEMPLATES, counts)
    out = []
    for w in split:
        at = lambda i, w=w: w[i] if 0 <= i < len(w) else None
        base = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(L.words_of(p))] == L.words_of(p)]
        best, labels = 0.0, {label for _, label in base}
        for t, (label, wording, keys) in enumerate(L.TEMPLATES):
            body = L.words_of(wording)
            for o in range(-len(body), len(w)):
                cover = sum(at(o + j) == x for j, x in enumerate(body)) / len(body)
                votes = sum(at(o + p) == body[p] for p in rare[t])
                joined = lambda k, o=o, body=body: any(body[i : i + len(k)] == k and w[max(0, o + i) : o + i + len(k)] == k and o + i >= 0 for i in range(len(body)))
                if cover >= L.COVER and votes >= min(L.VOTES, len(rare[t])) and all(joined(L.words_of(k)) for k in keys):
                    best, labels = max(best, cover), labels | {label}
        starts = [i for i, _ in base]
        out.append((len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max(best, 1.0 if base else 0.0)))
    return out


TEXTS = [
    None, "", "the of under", "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y",
    "THIS WORK is licensed under the GNU General Public License, version 3. All rights reserved", "Licensed under CC BY-NC 4.0.",
    "cc by cc by CC-BY", "general public licence, mit public license", "Übung ALL RIGHTS RESERVED", "all rights reserved " * 300,
    "Permission is hereby granted, free of charge, to any one obtaining the copy of this software and associated documentation files", "Released under the MIT License.",
    "Redistribution and use in source and binary forms with or without modification is permitted given that the following conditions are met",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, score int")
    got = {r["doc_id"]: tuple(r)[1:8] for r in L.scan_licenses(df).collect()}
    for i, want in enumerate(brute(TEXTS)):
        assert got[i][:6] == want[:6], TEXTS[i]
        assert abs(got[i][6] - want[6]) < 1e-9


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_pattern_is_the_same_on_both_sides(spark):
    s = "Été 12ab-Z_` {x}  \x7f中\U0001f600a\x00b"
    got = spark.createDataFrame([(s,)], "text string").select(L.words(L.F.col("text"))).collect()[0][0]
    assert got == L.words_of(s) == re.findall(L.WORD, s.replace("É", "É").replace("Z", "z"))


NOTICES = {
    "Licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl,gpl-3.0",
    "distributed under the GNU General Public License, Version 2 (see COPYING)": "gpl,gpl-2.0",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version": "gpl",
    "License: CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
    "Text under CC-BY 4.0, images not": "cc-by,cc-by-4.0",
    "CC BY 3.0": "cc-by",
    "MIT License\n\nCopyright (c) 2020": "mit",
    "The MIT license applies": "mit",
    "Apache License 2.0": "apache-2.0",
    "Apache License\nVersion 2.0, January 2004": "apache-2.0",
    "Apache License, Version 1.1": "",
    "GNU Lesser General Public License v2.1": "gpl,lgpl",
    "GNU Affero General Public License": "agpl,gpl",
    "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "a permissive licence from MIT; license unknown": "mit",
}


def test_notices_in_other_words(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(df).collect()}
    assert got == dict(enumerate(NOTICES.values()))


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(1, " " * 1_000_000 + "MIT License", "a", 1), (2, "mit " * 250_000 + "license", "a", 1), (3, "x" * 1_000_000, "a", 1), (4, "all rights reserved " * 50_000, "a", 1), (4, None, "a", 1)]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, words string, base int")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in got) == [(1, 2, 0, "mit"), (2, 250_001, 0, "mit"), (3, 1, 0, ""), (4, 0, 0, ""), (4, 150_000, 50_000, "reserved")]
