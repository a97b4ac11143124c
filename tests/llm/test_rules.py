import collections
import random
import re

import duckdb

from quillon.llm import licenses, pii, quality

from .helpers import DOC_SCHEMA, EDGE, docs


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(1)
    rows = EDGE + [(100 + i, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "cc ", "a b c "]) for _ in range(rng.randrange(200)))) for i in range(150)]
    out = quality.verdicts(quality.ledger(docs(spark, rows))).collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in out)
    assert got == sorted(str((i, *brute_quality(t))) for i, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in out)
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert quality.ledger(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    kept = quality.keep_good(docs(spark, rows))
    assert kept.count() == sum(r["kept"] for r in out) and "uid" in kept.columns


def test_ablation(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,), (4,), (0,), (6,)], "failures long")
    got = {r["rule"]: (r["failed"], r["failed_alone"], r["rejected_without"]) for r in quality.ablation(rows).collect()}
    assert got["too_few_words"] == (3, 2, 3) and got["repeated_windows"] == (2, 0, 5) and got["symbols"] == (2, 1, 4)


def test_clean_documents_stay(spark, data):
    con = duckdb.connect()
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM '{data}/labels.parquet' WHERE quality = 1").fetchall()}
    rows = quality.verdicts(quality.ledger(spark.read.parquet(f"{data}/documents.parquet"))).collect()
    assert all(r["kept"] or r["base_failed"] for r in rows if r["doc_id"] in good)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_license(t):
    w, hits = WORD.findall((t or "").translate(UP)), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def suppressed(found):
    """Brute force: inside another of the same or a higher priority."""
    out = []
    for i, (s, e, p, r) in enumerate(found):
        inside = any(j != i and a <= s and e <= b and q >= p and ((a, b) != (s, e) or q > p or (q == p and t < r)) for j, (a, b, q, t) in enumerate(found))
        if not inside:
            out.append((s, e, p, r))
    return sorted(out)


def test_licenses(spark):
    texts = [
        "MIT license; the mit-license mit license apache LICENSE version 2.0, GNU General Public License v3", "Licensed under the Apache License, Version 2.0 (the License)",
        "SPDX-License-Identifier: BSD-3-Clause", "mit dem license K Mité license", "cc by nc sa 4.0 and CC-BY 4.0 license", "mit license " * 3000, "İ license MITK license",
    ]
    rng = random.Random(2)
    parts = ["mit", "license", "apache", "general", "public", "2.0", "gnu", "the", "-", "MIT", "é", "gpl", "v3", "under", "licensed", "cc", "by"]
    rows = EDGE + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(120)]
    out = licenses.scan(docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out) == sorted(str((i, *base_license(t))) for i, t in rows)
    by = {r["doc_id"]: r for r in out}
    assert by[102]["labels"] == "bsd-3-clause" and by[102]["score"] == 1.0 and by[101]["labels"] == "apache,apache-2.0"
    assert "cc-by-nc-sa" in by[104]["labels"].split(",") and by[4]["labels"] == "" and by[4]["score"] == 0
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in out if r["base_labels"])
    assert licenses.scan(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert len(licenses.rule_list()) >= 300
    assert sorted(str((r["doc_id"], r["labels"], round(r["score"], 3))) for r in out if r["doc_id"] != 105) == sorted(str((i, *brute_labels(t))) for i, t in rows if i != 105)
    assert by[105]["labels"] == "mit" and len(by[105]["detections"]) == 5999


#: Compiled once: re's own cache holds fewer.
REGEXES = [re.compile(regex) for *_, regex, _ in licenses.rule_list()]
GATES = {w for *_, gate in licenses.rule_list() for s in gate for w in s}


def brute_labels(t):
    """Labels and score by trying every rule on every text."""
    words = WORD.findall((t or "").translate(UP))
    line, found, base = f" {' '.join(words)} ", [], set()
    if not set(words) & GATES:
        return "", 0.0
    for i, (label, priority, is_base, regex, gate) in enumerate(licenses.rule_list()):
        for m in REGEXES[i].finditer(line):
            assert all(s & set(words) for s in gate), (regex, gate)
            start = line[: m.start()].count(" ")
            if is_base:
                base.add(label)
            else:
                found.append((start, start + m[0].count(" "), priority, i))
    kept = suppressed(found)
    score = max([licenses.CONFIDENCE[p] for _, _, p, _ in kept] + [0.8] * bool(base), default=0.0)
    return ",".join(sorted(base | {licenses.rule_list()[i][0] for *_, i in kept})), score


def examples(regex):
    """A short text for each top alternative that a rule's regex matches, and one with all its options."""

    def build(parsed, option, way):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                out += chr(arg[0][1][0])
            elif op == "SUBPATTERN":
                out += build(arg[-1], option, way)
            elif op == "BRANCH":
                out += build(arg[1][way % len(arg[1])], option, way)
            elif op == "MAX_REPEAT":
                out += build(arg[2], option, way) * max(arg[0], option)
            else:
                assert op in ("ASSERT",), op
        return out

    return [build(re._parser.parse(regex), option, way) for option in (0, 1) for way in range(3)]


BODIES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the Software)": "mit",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that": "bsd",
    "// you may not use this file except in compliance with the License.\n": "apache-2.0",
    "is free software; you can redistribute it and/or modify\n it under the terms of the GNU Lesser General Public License as": "lgpl", "either version 3 of the License, or (at your option) any later version": "gpl-3.0-or-later",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa", "This is free and unencumbered software released into the public domain.": "unlicense", "see FreeBSD for terms": "bsd-2-clause",
    "Released under the MIT": "mit", "distributed under Apache 2.0": "apache-2.0", "Available under the EUPL 1.2": "eupl-1.2", "Released under CDDL 1.0": "cddl-1.0", "released under the zlib": "zlib",
    "available under Creative\nCommons Attribution 4.0": "cc-by", "CC_BY_SA 4.0": "cc-by-sa", "GPLv2": "gpl-2.0", "released under Apache2": "apache-2.0", "This code is under Apache 2.0": "apache-2.0", "mit dem, cc by mail": "",
}


def test_every_rule_is_tried(spark):
    """Each rule's own examples, with other separators and cases, give the labels of trying all rules on all texts."""
    texts = sorted({x for *_, regex, _ in licenses.rule_list() for x in examples(regex)})
    for *_, regex, gate in licenses.rule_list():
        for x in examples(regex):
            assert re.search(regex, f"{x} "), (regex, x)
            assert all(words & set(x.split()) for words in gate), (regex, gate, x)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100_000 + i, t.upper().replace(" ", "_\n")) for i, t in enumerate(texts[::7])] + [(200_000 + i, t) for i, t in enumerate(BODIES)]
    out = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [i for i, r in out.items() if i < 200_000 and (not r["labels"] or r["score"] == 0)] == []
    assert {i: (r["labels"], round(r["score"], 3)) for i, r in out.items()} == {i: brute_labels(t) for i, t in rows}
    for i, label in enumerate(BODIES.values()):
        assert label in out[200_000 + i]["labels"].split(","), (label, out[200_000 + i])


def test_licenses_of_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(str((r["doc_id"], *brute_labels(r["text"]))) for r in table.select("doc_id", "text").collect())
    assert sorted(str((r["doc_id"], r["labels"], round(r["score"], 3))) for r in licenses.scan(table).collect()) == want


def test_suppression(spark):
    rng = random.Random(3)
    rows = []
    for uid in range(60):
        for rule in range(rng.randrange(1, 12)):
            s = rng.randrange(12)
            rows.append((uid, rule, "l", rng.randrange(1, 5), False, s, s + rng.randrange(1, 6)))
    df = spark.createDataFrame(rows, "uid long, rule int, label string, priority int, base boolean, start long, end long")
    got = collections.defaultdict(list)
    for r in licenses.unsuppressed(df).collect():
        got[r["uid"]].append((r["start"], r["end"], r["priority"], r["rule"]))
    for uid in range(60):
        assert sorted(got[uid]) == suppressed([(s, e, p, k) for u, k, _, p, _, s, e in rows if u == uid])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def fine(k, s):
        d = re.sub("[^0-9]", "", s)
        if k == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if k == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return k != "phone" or 10 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, t) if fine(k, m[0])] for k, p in PATTERNS.items()}


def test_base_entities():
    rng = random.Random(5)
    parts = ["a", "b", "@", ".", "-", "1", "2", "25", "0", " ", "+", "_", "%", "(", ")", "x.y", "4111 1111 1111 1111", "é", "\n", "1.2.3.4", "+1 (555) 123-4567", "255", "256"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 18)))
        assert pii.base_entities(t) == brute_pii(t), t
    assert pii.base_entities("9" * 200_000)["card"] == [] and pii.base_entities("a" * 200_000 + "@")["email"] == []


def test_bootstrap_finds_new_identifiers(spark):
    rows = EDGE + [(100 + i, f"some words\nplease call my number: +1 (555) 010-{i:04d} today") for i in range(12)]
    rows += [(200, "words\nplease call my number: 555-0123-99 today"), (201, "the year 2024-2025-26 was long"), (202, "clean text without any of it")]
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert out[200]["spans"] == "phone:29:40" and out[200]["n_phone"] == 0 and out[200]["n_found"] == 1
    assert out[201]["spans"] == "" and out[202]["spans"] == ""
    for i, t in rows:
        if i is not None and i not in (5,):
            assert out[i]["n_phone"] == len(brute_pii(t or "")["phone"])
    assert pii.find(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert len(pii.find(docs(spark, rows)).collect()) == len(rows)


def test_identifiers_as_usually_written(spark):
    for t, want in (
        ("call 017 555 7713", ["017 555 7713"]), ("card 4736 9625 7309 9582", ["4736 9625 7309 9582"]), ("at (017) 555-7713 now", ["(017) 555-7713"]), ("id x1y2z3w4", ["x1y2z3w4"]),
        ("key " + "a1b2" * 20, ["a1b2" * 20]), ("in 1999 of 12 3 4", []), ("tel 017.555.7713, 018 555 7714", ["017.555.7713", "018 555 7714"]),
    ):
        assert [t[a:b] for a, b in pii.looks_personal(t, [])] == want, t
    rows = [(i, f"some words\nplease call my number: +1 (555) 010-{i:04d} today") for i in range(12)]
    new = [(100, "017 555 7713"), (101, "(017) 555-7713"), (102, "x1y2z3w4"), (103, "a1b2" * 20), (104, "017.555.7713")]
    rows += [(i, f"words\nplease call my number: {x} today") for i, x in new]
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert {i: out[i]["spans"] for i, _ in new} == {i: f"phone:29:{29 + len(x)}" for i, x in new}


def test_common_numbers_are_no_patterns(spark):
    """A pattern that mostly precedes unlabelled tokens is not trusted."""
    rows = [(i, f"order ref number: {1000000 + i * 7} done") for i in range(80)] + [(500 + i, f"order ref number: +1 555 010 {i:04d} done") for i in range(4)]
    assert sum(r["n_found"] for r in pii.find(docs(spark, rows)).collect()) == 0


OLD_GROUPED = re.compile(r"(?<![A-Za-z0-9])(?:\+|\(\+?)?[0-9]++(?:[\x20().-]{1,3}[0-9]++)+(?![A-Za-z])")
OLD_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+-]{4,}[A-Za-z0-9]")


def test_candidates_equal_plain_patterns():
    """Starting from runs of digits finds what plain searches over the text find."""
    rng = random.Random(9)
    parts = ["a", "Z", "(", ")", "+", "-", ".", " ", "1", "23", "4567", "/", "_", "é", "555 010", "(+1", "x9"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        assert list(pii.tokens(t)) == [m.span() for m in OLD_TOKEN.finditer(t) if len(pii.digits_of(m[0])) >= 4], t
        assert list(pii.grouped(t)) == [m.span() for m in OLD_GROUPED.finditer(t) if 7 <= len(pii.digits_of(m[0])) <= 19], t
        taken = [s for k in pii.KINDS for s in pii.base_entities(t)[k]]
        assert all(b <= x or a >= y for a, b in pii.looks_personal(t, taken) for x, y in taken), t


def test_found_instances_are_seeds_of_the_next_turn(spark):
    """Base phones teach the first pattern; the unknown numbers it finds teach the second."""
    number = lambda k: f"0170 555 {1000 + k}"
    first, second = [number(k) for k in range(3)], [number(10)]
    rows = [(i, f"please ring my number: +1 (555) 020-{i:04d} today") for i in range(12)] + [(20 + k, f"please ring my number: {x} today") for k, x in enumerate(first)]
    rows += [(30 + k, f"dial the office ({x}) soon") for k, x in enumerate(first)] + [(40 + k, f"dial the office ({x}) soon") for k, x in enumerate(second)]
    rows += [(50 + k, f"fax it over to {x} soon") for k, x in enumerate(second + first[:1])] + [(60 + k, f"fax it over to {number(60 + k)} soon") for k in range(1)]
    rows += [(70 + k, f"order of mine {number(70 + k)} left") for k in range(5)] + [(80, f"order of mine {first[0]} left")]
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert all(out[20 + k]["n_found"] == 1 for k in range(3))
    assert all(out[i]["n_found"] == 1 for i in (30, 31, 32, 40)), "no base phone is in that context"
    assert all(out[i]["n_found"] == 0 for i in (50, 51, 60)), "two labels are too few"
    assert all(out[i]["n_found"] == 0 for i in (70, 71, 72, 73, 74)), "one number of six is too few"
    rows += [(53, f"fax it over to {first[1]} soon"), (54, f"fax it over to {first[2]} soon")]
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert all(out[i]["n_found"] == 1 for i in (50, 53, 60))


def test_secrets_by_their_contexts(spark):
    import hashlib

    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'words here token = "{key(i)}" more') for i in range(6)]
    rows += [(50, 'words here token = "k7x1-9z34q0-pp12" more'), (51, f"see commit {key(51)} for it"), (52, f"see commit {key(52)} for it"), (53, f"see commit {key(53)} for it"), (54, "plain words")]
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert all(out[i]["spans"] == "secret:20:60" and out[i]["n_found"] == 1 for i in range(6))
    assert out[50]["spans"] == "secret:20:36" and all(out[i]["spans"] == "" for i in (51, 52, 53, 54))


def test_recall_in_planted_contexts(spark, data):
    """Contexts planted into the documents: a third of the numbers are base phones, the rest unknown to base rules.
    All of the rest are found, and nothing is added to documents without them."""
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    forms = ["+1 (555) 01{0}-{1:04d}", "017{0} 555 {1:04d}", "(017{0}) 555-{1:04d}"]
    contexts = ["my phone number: {} thanks", "call us at tel: {} or", "mobile no. {} any time"]
    planted, rows = {}, []
    for k, (i, t) in enumerate(table):
        if k % 4 == 0 and t and "\n" in t:
            planted[i] = k // 4 % 5
            form = forms[0] if planted[i] else forms[1 + k // 20 % 2]
            t += "\n" + contexts[k % 3].format(form.format(k % 10, k))
        rows.append((i, t))
    before = {r["doc_id"]: r["n_found"] for r in pii.find(docs(spark, table)).collect()}
    out = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    unknown = [i for i, k in planted.items() if k == 0]
    assert len(unknown) >= 5 and all(out[i]["n_found"] > before[i] for i in unknown)
    assert all(out[i]["n_found"] == before[i] for i in out if i not in unknown)
