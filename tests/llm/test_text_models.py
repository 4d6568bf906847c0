"""Tokenizers, the language model and the trained scorers against libraries, brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoledger.llm import bpe_codec, lattice_lm, licences, pii, quality, token_counts, toxicity

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aaabbcethe nin's't  \n\t\x00\x1c\x85 ▁é中벨\U0001f642<s>=-=--10ÁÁΣİǄ"


def texts(count=150, seed=1):
    r = random.Random(seed)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 5, 60, 300]))) for _ in range(count)]
    return [*made, None, "", " ", "a" * 3000, " " * 500, "=-" * 700, "hahahaha" * 200, "x<|endoftext|>y <|startoftext|>", made[5], made[5]]


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    every = texts()
    got = token_counts.token_counts(docs(every), PIECES, limit=100).collect()
    for r in got:
        t = every[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), (n := len(model.encode(t))), n > 100)
    assert len(got) == len(every)
    assert token_counts.token_counts(docs([]), PIECES).count() == 0


def test_codec_equals_the_library_and_returns(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    every = texts()
    full = {r.doc_id: r for r in bpe_codec.encode(docs(every), WORDS).collect()}
    digests = {r.doc_id: r for r in bpe_codec.encode_digests(docs(every), WORDS).collect()}
    for i, t in enumerate(every):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (full[i].ids, full[i].decoded) == (ids, decoded)
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    again = bpe_codec.decode(bpe_codec.encode(docs(every), WORDS), WORDS).collect()
    assert {r.doc_id: r.decoded for r in again} == {i: r.decoded for i, r in full.items()}
    codec = bpe_codec.codec(WORDS)
    assert codec.words_of(library.encode("Hello big WORLD's 12", add_special_tokens=False).ids) == "hello big world 's 1 2"


def test_lattice_scores(docs):
    r = random.Random(3)
    vocabulary = ["the", "cat", "Éclair", "runs", "internationalization", "\U0001f642"]
    every = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))) for _ in range(60)] + [None, "", "unseen\x0bword", "THE cat", "THE cat"]
    for frequent in (1000, 2, 0):
        got = {r.doc_id: r for r in lattice_lm.lattice_scores(docs(every), PIECES, frequent=frequent).collect()}
        words = [bytes((t or "").encode()).lower().split() + [b""] for t in every]
        held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(every))]
        counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
        total, distinct = sum(counts.values()), len(counts)
        assert len(got) == len(every)
        for i, ws in enumerate(words):
            base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
            assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held[i], len(ws), total)
            assert got[i].n_known == sum(counts[w] > 0 for w in ws)
            assert got[i].base_score == pytest.approx(base)
            assert got[i].score < 0
    assert lattice_lm.lattice_scores(docs([]), PIECES).count() == 0


def test_lattice_sums_are_sums_over_segmentations():
    pieces = [lattice_lm.MARK + b"a", b"a", b"ab", b"b", b"ba", lattice_lm.MARK]
    lattice = lattice_lm.Lattice(pieces)
    log_p = lattice_lm.first_probabilities(lattice)
    number = {p: i for i, p in enumerate(pieces)}

    def total(s):
        if not s:
            return 1.0
        out = math.exp(log_p[lattice.n_pieces + s[0]]) * total(s[1:])
        return out + sum(math.exp(log_p[number[s[:k]]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in number)

    words = [b"ab", b"aba", b"bbab", b"", b"x"]
    assert lattice.log_sums(words, log_p) == pytest.approx([math.log(total(lattice_lm.MARK + w)) for w in words])
    uses = lattice.expected(words, np.ones(len(words)), log_p)
    lengths = np.array([*map(len, pieces), *([1] * 256), 0, 0])
    assert (uses * lengths).sum() == pytest.approx(sum(len(lattice_lm.MARK + w) for w in words))  # every byte is used once


def test_more_rounds_raise_the_likelihood(spark):
    counts = spark.createDataFrame([(bytearray(b"abab"), 50), (bytearray(b"ab"), 30), (bytearray(b""), 10)], "word binary, n long")
    lattice = lattice_lm.Lattice([b"a", b"b", b"ab", lattice_lm.MARK, lattice_lm.MARK + b"ab"])
    scores = [50 * lattice.log_sums([b"abab"], lattice_lm.fit(counts, lattice, rounds))[0] for rounds in (0, 1, 3)]
    assert scores == sorted(scores)


def graded(count=900, seed=5):
    """Sentences of invented words; toxic ones have a marked word in one sentence, bad ones shout."""
    r = random.Random(seed)
    rows = []
    for _ in range(count):
        words = ["".join(r.choice("aeinorstl") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 40))]
        toxic, bad = r.random() < 0.2, r.random() < 0.3
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["zugword", "zugthing", "zugs"]))
        text = " ".join(w + ("." if r.random() < 0.2 else "") for w in words)
        rows.append((text.upper() + "!!" if bad else text, int(toxic), 0 if bad else 1))
    return rows


def test_toxicity_on_held_out_rows(spark, docs):
    rows = graded()
    every = [t for t, _, _ in rows] + [None, "", "zugword"]
    labels = spark.createDataFrame([(i, y, q) for i, (_, y, q) in enumerate(rows)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(every), labels).collect()}
    assert len(got) == len(every) and got[len(rows)].score == 0 == got[len(rows)].predicted
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1} == set(held)
    right = sum(got[i].predicted == rows[i][1] for i in held)
    assert right >= 0.97 * len(held)
    model = toxicity.train(docs(every), labels)
    spans = toxicity.locate(docs(every[:100]), model).collect()
    assert spans and all("zug" in every[s.doc_id][s.begin : s.end].lower() for s in spans)
    clean = toxicity.keep_clean(docs(every), model)
    assert clean.columns == docs([]).columns and clean.count() == sum(r.predicted == 0 for r in got.values())
    assert {r.score for r in toxicity.toxicity(docs(["a"]), labels.limit(0)).collect()} == {0.0}


def test_quality_on_held_out_rows(spark, docs):
    rows = graded(seed=6)
    every = [t for t, _, _ in rows] + [None, ""]
    labels = spark.createDataFrame([(i, q * (2 - y)) for i, (_, y, q) in enumerate(rows)], "doc_id long, grade int")
    got = {r.doc_id: r for r in quality.quality(docs(every), labels, F.col("grade"), 3).collect()}
    assert len(got) == len(every)
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert sum(got[i].kept == bool(rows[i][2]) for i in held) >= 0.97 * len(held)
    assert all(0 <= got[i].tail_probability <= 1 and 0 <= got[i].expected_grade <= 2 for i in got)
    mean = [np.mean([got[i].expected_grade for i in held if rows[i][2] * (2 - rows[i][1]) == g]) for g in range(3)]
    assert mean == sorted(mean)
    assert {r.expected_grade for r in quality.quality(docs(["a"]), labels.limit(0), F.col("grade"), 3).collect()} == {0.0}


def test_pattern_spans_equal_the_plain_patterns():
    import re

    def plain(t):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        cards = [(m, m[0].replace(" ", "").replace("-", "")) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
        out += [(2, m.start(), m.end()) for m, d in cards if 16 <= len(d) <= 19 and pii.luhn(d)]
        return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]

    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice("aA1259..@@-_+ ()é%") for _ in range(r.randint(0, 40)))
        assert pii.pattern_spans(t) == plain(t)
    t = "café 4539 1488 0343 6467 and x.y@a.b.org, 10.0.0.255 10.0.0.256 +1 (212) 555-0100."
    assert pii.written(pii.pattern_spans(t)) == "email:29:40,ip:42:52,card:5:24,phone:64:81"


def test_field_adds_spans_and_keeps_the_patterns(docs):
    field = pii.fit(pii.training_table())
    held = pii.training_table(300, 99)
    said = [" ".join(w for w, _ in s) for s in held]
    words = pii.find_words([s.encode() for s in said], pii.NOT_SPACE)
    classes, active = pii.shapes(words)
    gold = np.concatenate([[y for _, y in s] for s in held])
    assert set(gold[~active]) == {0}  # only active words bear labels, as the field's zeros demand
    every = ["call (212) 555-0100 or mail a@b.org", None, "", "nothing here", "1 2 3", "4539148803436467"]
    got = {r.doc_id: r for r in pii.personal_data(docs(every), field).collect()}
    assert got[0].spans == "email:28:35,phone:5:19" and (got[0].n_email, got[0].n_phone, got[0].n_added) == (1, 0, 1)
    assert [got[i].spans for i in (1, 2, 3, 4)] == [""] * 4 and got[5].spans == "card:0:16"
    assert got[0].base_sha256 == hashlib.sha256(b"email:28:35").hexdigest()
    hits = sum(bool(x) == any(y for _, y in s) for x, s in zip(pii.field_spans(field, [s.encode() for s in said]), held, strict=True))
    assert hits >= 0.9 * len(held)


def test_viterbi_is_the_best_path():
    import itertools

    r = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(np.zeros(1, dtype=np.int64), np.zeros((0, k)), r.normal(size=(k, k)))
    lengths = np.array([1, 3, 2, 4, 3])
    starts = np.cumsum(lengths) - lengths
    scores = r.normal(size=(int(lengths.sum()), k))
    got = field.decode(scores, starts, lengths)
    for s, n in zip(starts, lengths, strict=True):

        def value(path, s=s):
            steps = [0, *path, 0]
            return sum(scores[s + i, y] for i, y in enumerate(path)) + sum(field.transition[a, b] for a, b in zip(steps, steps[1:], strict=False))

        assert tuple(got[s : s + n]) == max(itertools.product(range(k), repeat=int(n)), key=value)


def test_licences(docs):
    model = licences.train()
    every = ["x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 3.", None, "", "the cat may use this file for free\nor not", "a licence of software, version 2", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nReleased under the MIT License."]
    got = {r.doc_id: r for r in licences.licences(docs(every), model).collect()}
    assert [got[i].families for i in range(7)] == ["mit", "gpl-3.0", "", "", "", "", "apache-2.0,mit"]
    assert got[6].n_confirmed == 2 and got[0].probability > 0.9
    for r in licences.paragraphs(docs(every), model).collect():
        p = model.probabilities(re.split(licences.PARTING, every[r.doc_id].lower())[r.paragraph])
        assert model.families[int(p.argmax())] == r.family and r.probability == pytest.approx(float(p.max()))
    plan = licences.licences(docs(every), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licences.licences(docs([]), model).count() == 0


def test_licences_tell_siblings_apart(docs):
    model = licences.train()
    every = {
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "Licensed under CC BY-ND 4.0.": "cc-by-nd",
        "Licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "All rights reserved.": "all-rights-reserved",
        "Proprietary and confidential. All rights reserved.": "proprietary",
        "Released under the non MIT License.": "",
        "Licensed under CC BY-XY 4.0.": "",
    }
    got = {r.doc_id: r.families for r in licences.licences(docs(list(every)), model).collect()}
    assert [got[i] for i in range(len(every))] == list(every.values())


def test_licences_every_template(docs):
    every = [(f, t) for f, texts in licences.TEMPLATES.items() for t in texts]
    got = {r.doc_id: r for r in licences.licences(docs([f"see below. {t} and more of it" for _, t in every])).collect()}
    assert [got[i].families for i in range(len(every))] == [f for f, _ in every]
    assert all(r.n_confirmed == 1 and r.n_unconfirmed == 0 for r in got.values())


def test_licences_wrapped_and_joined(docs):
    mit = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    bsd = """ * Copyright (c) 2020, Somebody. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""
    gpl = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version {} of the License, or
# (at your option) any later version."""
    lgpl = """This library is free software: you can redistribute it
and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation,
either version 3 of the License, or any later version."""
    apache = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at"""
    joined = "Parts are released under the MIT License. Other parts are licensed under the Apache License, Version 2.0."
    every = [mit, bsd, gpl.format(3), gpl.format(2), joined, mit.replace("\n", "\n\n"), lgpl, apache, lgpl.replace("Lesser", "Affero").replace("library", "program"), gpl.format(4)]
    got = {r.doc_id: r for r in licences.licences(docs(every)).collect()}
    assert [got[i].families for i in range(len(every))] == ["mit", "all-rights-reserved,bsd", "gpl-3.0", "gpl-2.0", "apache-2.0,mit", "mit", "lgpl-3.0", "apache-2.0", "agpl-3.0", ""]
    assert [got[i].n_confirmed for i in range(len(every))] == [1, 2, 1, 1, 2, 1, 1, 1, 1, 0]


def brute_families(text, model, confirm=0.7, at_least=0.5):
    """Families of a text's notices: every template at every shift, in plain loops."""
    words = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in licences.STOP]
    have = [(w, i, 0) for i, w in enumerate(words)] + [(f"{a} {b}", i, 1) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    found = []
    for t in licences._templates():
        bands = {}
        for gram, at, pair in have:
            for other, place, kind in t.grams:
                if (gram, pair) == (other, kind):
                    band = (at - place) // max(t.slack, 1)
                    for b in (band,) if t.slack == 0 else (band - 1, band):
                        bands.setdefault(b, []).append((gram, at, pair, place))
        for hits in bands.values():
            held = {(place, pair) for _, _, pair, place in hits}
            start, end = min(at for _, at, _, _ in hits), max(at + pair for _, at, pair, _ in hits)
            foreign = end - start + 1 - len({at for _, at, pair, _ in hits if not pair})
            if len(held) >= confirm * len(t.grams) and {(j, p) for _, j, p in t.keys} <= held and foreign <= t.slack:
                rights = max((at for gram, at, _, _ in hits if gram == "rights reserved"), default=None)
                found.append((t.family, rights, {g for g, *_ in hits}))
    longer = {rights for family, rights, _ in found if family != licences.BARE}
    out = set()
    for family, rights, grams in found:
        if family != licences.BARE or rights not in longer:
            z = (model.bias + sum((model.weights[i] for i, g in enumerate(model.grams) if g in grams), np.zeros_like(model.bias))) / model.temperature
            p = np.exp(z - z.max())
            if (p / p.sum())[model.families.index(family)] >= at_least:
                out.add(family)
    return ",".join(sorted(out))


def test_licences_equal_brute_force(docs):
    r = random.Random(12)
    model = licences.train()
    templates = [t.replace("[", "").replace("]", "") for texts in licences.TEMPLATES.values() for t in texts]
    every = [None, "", "\n\n", "no licence here"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(templates).split()
            for _ in range(r.choice([0, 0, 0, 1, 2, 4])):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1])] = r.choice([[], ["other"], ["version", "2"], [words[at], words[at]]])
            parts.append(" ".join(words))
        every.append(r.choice([" ", "\n", "\n\n", " and then "]).join(parts))
    every += [every[7], every[7]]
    got = {r.doc_id: r.families for r in licences.licences(docs(every), model).collect()}
    assert got == {i: brute_families(t, model) for i, t in enumerate(every)}
    assert sum(bool(f) for f in got.values()) > 60


# ---- cases that every operator of a row must take --------------------------------------------------------------------


def of_rows(name, spark, docs):
    """An operator as a function of documents, trained where it learns, and one of the columns that hold for equal texts."""
    rows = graded(300, 8)
    labels = spark.createDataFrame([(i, y, q * (2 - y)) for i, (_, y, q) in enumerate(rows)], "doc_id long, toxic int, grade int")
    known = docs([t for t, _, _ in rows])
    return {
        "token counts": lambda d: token_counts.token_counts(d, PIECES),
        "toxicity": lambda d, m=[]: toxicity.score(d, m[0] if m else m.append(toxicity.train(known, labels)) or m[0]),
        "lattice": lambda d: lattice_lm.lattice_scores(d, PIECES),
        "licences": lambda d, m=[]: licences.licences(d, m[0] if m else m.append(licences.train()) or m[0]),
        "pii": lambda d, m=[]: pii.personal_data(d, m[0] if m else m.append(pii.fit(pii.training_table())) or m[0]),
        "codec": lambda d: bpe_codec.encode_digests(d, WORDS),
        "quality": lambda d: quality.quality(d, spark.createDataFrame([(i, 1) for i in range(9)] + [(20, 0)], "doc_id long, grade int"), F.col("grade"), 3),
    }[name]


@pytest.mark.parametrize("name", ["token counts", "toxicity", "lattice", "licences", "pii", "codec", "quality"])
def test_nulls_repeats_long_texts_and_empty_tables(spark, docs, name):
    operator = of_rows(name, spark, docs)
    long = "word " * 60_000 + "a.b@c.org +1 (212) 555-0100 " + "x" * 20_000 + "\n" * 3000
    given = [(None, "a cat"), (None, "a cat"), (None, None), (4, "a cat"), (4, "a cat"), (4, "another text"), (5, None), (6, ""), (7, long), (8, "MIT License.\n\n\n" + long)]
    frame = docs([t for _, t in given], ids=[i for i, _ in given])
    got = operator(frame).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in given)
    rest = [tuple(v if not isinstance(v, float) else round(v, 6) for c, v in r.asDict().items() if c not in ("doc_id", "held_out")) for r in got]
    of = {}
    for r, values in zip(got, rest, strict=True):
        of.setdefault(r.doc_id, []).append(values)
    assert max(of[None].count(x) for x in of[4]) >= 2  # equal texts, equal results, whatever the id
    assert len(set(of[4])) <= 2 and of[5] == of[6]
    clashing = frame.select("*", *(F.lit(None).cast("string").alias(c) for c in ("score", "mark2", "_row_number", "_rejected_row", "words", "n", "copies", "hits") if c not in frame.columns))
    again = [tuple(v if not isinstance(v, float) else round(v, 6) for v in r) for r in operator(clashing).collect()]
    assert sorted(again, key=str) == sorted((tuple(v if not isinstance(v, float) else round(v, 6) for v in r) for r in got), key=str)
    assert operator(docs([])).count() == 0


def test_unbroken_text_and_forced_paths(monkeypatch):
    """Long sequences by windows, by the queue and by plain rounds equal the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    from chronoledger.llm import merges

    library, model = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(7)
    for long, slow in ((4, 64), (4, -1), (256, 64)):
        monkeypatch.setattr(merges, "LONG", long)
        monkeypatch.setattr(merges, "SLOW_ROUNDS", slow)
        for _ in range(25):
            letters = r.choice(["abc", "the", "eh", "ation", "aé中벨", "abcdefghijklmnopqrstuvwxyz", "intergo"])
            every = ["".join(r.choice(letters) for _ in range(r.choice([10, 100, 700]))) for _ in range(6)]
            every += [("".join(r.choice(letters) for _ in range(r.randint(1, 7))) * 200)[: r.randint(5, 900)] for _ in range(6)]
            assert token_counts.PieceCounter.counts(_fresh(token_counts.counter(PIECES)), every) == [len(model.encode(t)) for t in every]
            codec = bpe_codec.codec(WORDS)
            codec.forget()
            assert [np.frombuffer(x, dtype="<u4").tolist() for x, _ in codec.encode(every)] == [library.encode(t, add_special_tokens=False).ids for t in every]


def _fresh(counter):
    counter.known.clear()
    return counter


def test_a_megabyte_of_letters_keeps_pace_with_the_libraries():
    import time

    import sentencepiece
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    start = time.perf_counter()
    counted, ids = len(model.encode(text)), library.encode(text, add_special_tokens=False).ids
    theirs = time.perf_counter() - start
    start = time.perf_counter()
    assert token_counts.counter(PIECES).counts([text]) == [counted]
    assert np.frombuffer(bpe_codec.codec(WORDS).encode([text])[0][0], dtype="<u4").tolist() == ids
    assert time.perf_counter() - start < 10 * theirs


def test_long_words_by_stretches(monkeypatch):
    lattice = lattice_lm.Lattice(lattice_lm.vocabulary(PIECES))
    log_p = lattice_lm.first_probabilities(lattice)
    r = random.Random(1)
    words = [bytes(r.choice(b"abcdefgh\xc3") for _ in range(n)) for n in (900, 300, 40, 3)]
    plain = lattice.log_sums(words, log_p), lattice.expected(words, np.arange(1.0, 5.0), log_p)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 10)
    monkeypatch.setattr(lattice_lm, "STRETCH", 37)
    assert lattice.log_sums(words, log_p) == pytest.approx(plain[0])
    assert lattice.expected(words, np.arange(1.0, 5.0), log_p) == pytest.approx(plain[1])


def test_document_scores_are_sums_of_their_words(docs):
    every = ["the cat runs", "THE cat\tcat unseenword", None, "internationalization of the cat"] * 3
    documents = docs(every)
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(documents, PIECES).collect()}
    lattice = lattice_lm.Lattice(lattice_lm.vocabulary(PIECES))
    kept = [t for i, t in enumerate(every) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in kept for w in [*(t or "").lower().encode().split(), b""])
    log_p = lattice_lm.fit(documents.sparkSession.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"), lattice, 2)
    for i, t in enumerate(every):
        words = (t or "").lower().encode().split()
        assert got[i] == pytest.approx((float(lattice.log_sums(words, log_p).sum()) + log_p[lattice.end]) / math.log(10))


def plain_features(sentence):
    out = set()
    for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", sentence):
        words = toxicity.words_of([w])
        out |= set(toxicity.features_of(words)[0].tolist())
    return out


def test_toxicity_equals_a_plain_noisy_or(spark, docs):
    """Scores of whole documents from the model's weights in plain loops, and sentences at their places."""
    rows = graded(500, 9)
    every = [t for t, _, _ in rows] + [" ".join(t for t, _, _ in rows[:80]), None, "..!", "zugword\nzugs? fine"]
    model = toxicity.train(docs([t for t, _, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, toxic int"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score(docs(every), model).collect():
        clean = 1.0
        for sentence in re.split(rb"[\n!.?]", (every[r.doc_id] or "").encode()):
            if re.search(rb"[A-Za-z0-9\x80-\xff]", sentence):
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in plain_features(sentence))))
        assert r.score == pytest.approx(1 - clean, abs=1e-9)


def test_quality_equals_plain_cumulative_links(spark, docs):
    rows = graded(300, 10)
    every = [t for t, _, _ in rows[:60]] + [" ".join(t for t, _, _ in rows)]
    ratings = spark.createDataFrame([(i, q * (2 - y)) for i, (_, y, q) in enumerate(rows)], "doc_id long, grade int")
    model = quality.train(docs([t for t, _, _ in rows]), ratings, F.col("grade"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    for t in every:
        _, feature, value = quality.vectors([t.encode()])
        latent = sum(model.weights[f] * v for f, v in zip(feature.tolist(), value.tolist(), strict=True))
        over = [1 - 1 / (1 + math.exp(-(threshold - latent))) for threshold in model.thresholds]
        expected, tail = model.grades([t.encode()], 2)
        assert expected[0] == pytest.approx(sum(over)) and tail[0] == pytest.approx(over[1])


def test_samples_are_bounded(spark, docs):
    from chronoledger.llm.common import id_and_text, sample_rows
    from chronoledger.llm.words import ALNUM

    every = ["a b c"] * 30 + ["w " * 500, None, "a b c"]
    ids = [*range(30), 30, 31, 3]
    chosen = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, label int")
    rows = sample_rows(id_and_text(docs(every, ids=ids), "doc_id", "text", "binary"), chosen, "label", 60, ALNUM).collect()
    assert len(rows) == 20 and len({r.doc_id for r in rows}) == 20  # 20 texts of 3 words; the long, the empty and the repeated row don't count
    more = sample_rows(id_and_text(docs(every, ids=ids), "doc_id", "text", "binary"), chosen, "label", 6000, ALNUM).collect()
    assert sorted(r.doc_id for r in more) == list(range(31))


def test_odd_digits_stop_nothing(docs):
    r = random.Random(5)
    odd = "0123²³٣४１.@+-() é\u0301\u20dd"
    every = ["192.168.10.25²", "1.2.3.٣", "10.0.0.1", *("".join(r.choice(odd) for _ in range(r.randint(1, 40))) for _ in range(400)), "\u0301", ("word 1.2.3.4 " + "5" * 30 + " ") * 20_000]
    field = pii.fit(pii.training_table())
    got = {r.doc_id: r for r in pii.personal_data(docs(every), field).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        assert got[i].base_sha256 == hashlib.sha256(pii.written(pii.pattern_spans(t)).encode()).hexdigest()
