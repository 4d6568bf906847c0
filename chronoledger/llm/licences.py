"""Operator 7: licence notices by a trained paragraph classifier and a check against templates, in DataFrame functions only.

Paragraphs are parted by lines without words (letters or digits of ASCII), so that the
lines of a wrapped notice are one paragraph. A sparse softmax regression over the set of
the 1-grams and 2-grams of its words, stop words left out, gives the licence family or
"unknown". It is trained on the driver from the fixed templates below, with words dropped
and foreign words around them. The unknown class learns from paragraphs that are no
licence, with words of the templates strewn in, and from near misses: templates in which
a word that sets the family or version apart is another one. A temperature, fitted on
other such paragraphs, calibrates the probabilities.

A notice is a place where a template is found: its grams are held in order, in a narrow
band of shifts; all grams of the words that set its family and version apart are there;
few foreign words (none in a short template) stand inside. All templates are sought
everywhere, so one paragraph may hold notices of several families. A notice's probability
is the classifier's for the grams of the notice.

The grams (some rows for each template) are joined to the exploded n-grams by hash; only
documents with such grams are grouped, and a document's own hits are the most that any
task gathers. The gram table's size is fixed by the templates, which bounds the broadcast.

Null text has no paragraph; null ids group by text; repeated rows each get their row;
an empty table gives an empty result; other columns are ignored. Of equal probabilities
the family first in order counts. Time grows with a text's length, a task's memory with
the longest text.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

UNKNOWN = "unknown"

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU {0}General Public License] as published by the Free Software Foundation, either [version {1}] of the License."


def _cc(name: str, code: str) -> list[str]:
    texts = []
    for v in ("4.0", "3.0"):
        texts += [f"Licensed under [CC {code} {v}].", f"This work is licensed under a Creative [Commons {name} {v}] {'International' if v == '4.0' else 'Unported'} License."]
    return texts


def _gnu(kind: str, version: str) -> list[str]:
    return [f"This work is licensed under the [GNU {kind}General Public License, version {version}].", f"Licensed under the [GNU {kind}General Public License v{version}].", _GPL.format(kind, version)]


#: The family of a bare notice; a longer notice that holds these words is its own family only.
BARE = "all-rights-reserved"
# Public licence notices, by family. Words in brackets set the family or version apart.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": _gnu("Affero ", "3"),
    BARE: ["[All rights reserved]."],
    "apache-2.0": ["Licensed under the [Apache License, Version 2.0].", "Licensed under the [Apache License, Version 2.0] (the License); you may not use this file except in compliance with the License."],
    "bsd": ["[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met.", "Released under the [BSD 3-Clause License].", "Released under the [BSD 2-Clause License].", "Use of this source code is governed by a [BSD-style license]."],
    "cc-by": _cc("Attribution", "BY"),
    "cc-by-nc": _cc("Attribution-NonCommercial", "BY-NC"),
    "cc-by-nc-nd": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "cc-by-nc-sa": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "cc-by-nd": _cc("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-sa": _cc("Attribution-ShareAlike", "BY-SA"),
    "gpl-2.0": _gnu("", "2"),
    "gpl-3.0": _gnu("", "3"),
    "isc": ["[Permission to use, copy, modify, and/or distribute this software] for any purpose with or without fee is hereby granted.", "Released under the [ISC License]."],
    "lgpl-2.1": _gnu("Lesser ", "2.1"),
    "lgpl-3.0": _gnu("Lesser ", "3"),
    "mit": ["Released under the [MIT License].", "[Permission is hereby granted, free of charge], to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the [MIT License]."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0].", "Licensed under the [Mozilla Public License, Version 2.0]."],
    "proprietary": ["All rights reserved. [Unauthorized copying] of this file, via any medium, is [strictly prohibited].", "[Proprietary and confidential]. All rights reserved."],
    "public-domain": ["This is free and [unencumbered software released into the public domain].", "Released into the [public domain under CC0 1.0] Universal."],
}
#: What parts paragraphs: line ends with nothing but lines without words between them.
PARTING = "\\n[^a-z0-9]*\\n"
#: Words that are left out of all grams.
STOP = frozenset("a an and any are as by for from in into is it may not of on or that the this to under use with without you".split())
FILLER = "the of and to in is that it for on was be with as by from are this or at an have not but they which one all were when there can more if out so what time about who get would make like him into see other than then now only come over think also back after two how our work first well way even new want because these give day most us people".split()


def words_of_paragraph(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def placed_grams(words: list[str]) -> list[tuple[str, int, int]]:
    """Each gram with its place among the words that are no stop words, and 1 for a pair, else 0."""
    left = [w for w in words if w not in STOP]
    return [(w, i, 0) for i, w in enumerate(left)] + [(f"{a} {b}", i, 1) for i, (a, b) in enumerate(zip(left, left[1:], strict=False))]


def grams_of(words: list[str]) -> set[str]:
    return {g for g, _, _ in placed_grams(words)}


@dataclass
class Template:
    family: str
    grams: list[tuple[str, int, int]]
    size: int  # words that are no stop words
    keys: list[tuple[str, int, int]]  # grams that must be held

    @property
    def slack(self) -> int:
        """Shift of words that a notice may have against the template, and foreign words inside."""
        return self.size // 6 if self.size >= 10 else 0


def _templates() -> list[Template]:
    found = []
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words, inside = [], []
            for i, part in enumerate(re.split(r"[\[\]]", text)):
                new = [w for w in words_of_paragraph(part) if w not in STOP]
                words += new
                inside += [i if i % 2 else 0] * len(new)
            grams = placed_grams(words)
            keys = [g for g in grams if inside[g[1]] and inside[g[1]] == inside[g[1] + g[2]]]
            found.append(Template(family, grams, len(words), keys))
    return found


@dataclass
class Classifier:
    families: list[str]  # unknown first
    grams: list[str]
    weights: np.ndarray  # one row for each gram
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        """The same model on the driver, for tests."""
        have = grams_of(words_of_paragraph(text))
        z = (self.bias + sum((self.weights[i] for i, g in enumerate(self.grams) if g in have), np.zeros_like(self.bias))) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def _examples(count: int, seed: int) -> list[tuple[set[str], int]]:
    r = random.Random(seed)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    every = sorted({w for t in TEMPLATES.values() for x in t for w in words_of_paragraph(x)})

    def noise(n: int) -> list[str]:
        made = ["".join(r.choice("aeinorstlhdu") for _ in range(r.randint(2, 9))) for _ in range(n)]
        return [r.choice(FILLER) if r.random() < 0.5 else w for w in made]

    def near_miss(text: str) -> list[str]:
        """The template's words, one word that must be there replaced."""
        parts = re.split(r"[\[\]]", text)
        keyed = r.randrange(1, len(parts), 2)
        words = [words_of_paragraph(p) for p in parts]
        at = r.choice([i for i, w in enumerate(words[keyed]) if w not in STOP])
        old = words[keyed][at]
        words[keyed][at] = r.choice([d for d in "123456789" if d != old]) if old.isdigit() else noise(1)[0] + "x"
        return [w for p in words for w in p]

    rows = []
    for _ in range(count):
        kind = r.random()
        around = (noise(r.choice([0, 0, 2, 8, 60])), noise(r.choice([0, 0, 3, 60])))
        if kind < 0.4:
            # no licence: other words, at times with a few of the templates' words out of place
            words = noise(r.choice([r.randint(3, 40), r.randint(40, 300)]))
            for _ in range(r.choice([0, 0, 1, 2, 4, len(words) // 8])):
                words.insert(r.randrange(len(words)), r.choice(every))
            rows.append((grams_of(words), 0))
        elif kind < 0.55:
            rows.append((grams_of(around[0] + near_miss(r.choice(TEMPLATES[r.choice(families[1:])])) + around[1]), 0))
        else:
            k = r.randrange(1, len(families))
            words = [w for w in words_of_paragraph(r.choice(TEMPLATES[families[k]])) if r.random() > 0.04]
            rows.append((grams_of(around[0] + words + around[1]), k))
    return rows


def train(examples: int = 5000, rounds: int = 300, rate: float = 0.1, penalty: float = 1e-4, seed: int = 11) -> Classifier:
    families = [UNKNOWN, *sorted(TEMPLATES)]
    grams = sorted({g for t in TEMPLATES.values() for x in t for g in grams_of(words_of_paragraph(x))})
    number = {g: i for i, g in enumerate(grams)}

    def matrix(rows: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(grams) + 1))
        x[:, -1] = 1
        for i, (have, _) in enumerate(rows):
            x[i, [number[g] for g in have if g in number]] = 1
        return x, np.array([k for _, k in rows])

    x, y = matrix(_examples(examples, seed))
    goal = np.eye(len(families))[y]
    w = np.zeros((len(grams) + 1, len(families)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - goal) / len(x) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    other, truth = matrix(_examples(examples // 2, seed + 1))
    z = other @ w

    def loss(temperature: float) -> float:
        s = z / temperature
        top = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(s)), truth]).mean())

    temperature = min((0.5 + 0.05 * i for i in range(90)), key=loss)
    return Classifier(families, grams, w[:-1], w[-1], temperature)


def _hits(documents: DataFrame, model: Classifier, id_col: str, text_col: str) -> DataFrame:
    """Per document with a gram of a template: doc_id, mark, hits (gram number, word number, 1 for a pair, paragraphs of its first and last word)."""
    table = documents.sparkSession.createDataFrame(list(enumerate(model.grams)), "gram int, name string").select(F.xxhash64("name").alias("hash"), "gram")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.split(ascii_lower(text), PARTING, -1).alias("paragraphs"))

    def left(line: Column) -> Column:
        return F.filter(F.regexp_extract_all(line, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*sorted(STOP)))

    words = F.flatten(F.transform("paragraphs", lambda line, i: F.transform(left(line), lambda w: F.struct(w.alias("word"), i.alias("line")))))
    rows = rows.select("doc_id", "mark", words.alias("words"))
    following = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.zip_with("words", following, lambda a, b: F.struct(F.xxhash64(F.concat(a["word"], F.lit(" "), b["word"])).alias("hash"), a["line"].alias("line"), b["line"].alias("last")))

    def place(hash: Column, i: Column, pair: int, line: Column, last: Column) -> Column:
        return F.struct(hash.alias("hash"), i.alias("at"), F.lit(pair).alias("pair"), line.alias("line"), last.alias("last"))

    single = F.transform("words", lambda w, i: place(F.xxhash64(w["word"]), i, 0, w["line"], w["line"]))
    double = F.transform(pairs, lambda p, i: place(p["hash"], i, 1, p["line"], F.coalesce(p["last"], p["line"])))
    # outer generators: Spark infers no filter from them that would evaluate the arrays twice
    rows = rows.select("doc_id", "mark", F.inline_outer(F.concat(single, double))).join(F.broadcast(table), "hash")
    return rows.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("gram", "at", "pair", "line", "last")).alias("hits"))


def _predicted(rows: DataFrame, model: Classifier, *by: str) -> DataFrame:
    """For each group of rows with distinct grams: the columns by, best (number of the family), p (array of probabilities)."""
    k = len(model.families)
    weights = rows.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(model.weights)], ", ".join(["gram int", *(f"w{i} double" for i in range(k))]))
    summed = rows.join(F.broadcast(weights), "gram").groupBy(*by).agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(k)))
    z = [(F.col(f"w{i}") + F.lit(float(model.bias[i]))) / F.lit(float(model.temperature)) for i in range(k)]
    summed = summed.select(*by, F.array(*z).alias("z"), F.greatest(*z).alias("top"))
    raised = F.transform("z", lambda x: F.exp(x - F.col("top")))
    return summed.select(*by, (F.array_position("z", F.col("top")) - 1).cast("int").alias("best"), raised.alias("e")).select(*by, "best", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def _predictions(hits: DataFrame, model: Classifier) -> DataFrame:
    """Per paragraph with a gram of a template whose best family is not unknown: doc_id, mark, paragraph, family, probability."""
    rows = hits.select("doc_id", "mark", F.inline("hits")).where(F.col("line") == F.col("last")).select("doc_id", "mark", F.col("line").alias("paragraph"), "gram").distinct()
    names = F.array(*map(F.lit, model.families))
    return _predicted(rows, model, "doc_id", "mark", "paragraph").where("best > 0").select("doc_id", "mark", "paragraph", F.get(names, F.col("best")).alias("family"), F.get("p", F.col("best")).alias("probability"))


def _notices(hits: DataFrame, model: Classifier, confirm: float) -> DataFrame:
    """Per notice: doc_id, mark, family, probability (of the template's grams held), first (its first paragraph), lines (all its paragraphs)."""
    templates, number = _templates(), {g: i for i, g in enumerate(model.grams)}
    table = hits.sparkSession.createDataFrame([(t, number[g], j, pair, x.slack) for t, x in enumerate(templates) for g, j, pair in x.grams], "template int, gram int, place int, pair int, slack int")

    def of_template(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("template"))

    def arrays(values: list[list[int]]) -> Column:
        return F.array(*(F.array(*map(F.lit, v)) for v in values))

    # templates whose keys the document holds
    key_grams = arrays([sorted({number[g] for g, _, _ in x.keys}) for x in templates])
    held = F.transform("hits", lambda h: h["gram"])
    able = F.filter(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: F.size(F.array_except(F.get(F.col("key_grams"), t), F.col("grams"))) == 0)
    rows = hits.select("doc_id", "mark", "hits", F.array_distinct(held).alias("grams"), key_grams.alias("key_grams")).select("doc_id", "mark", "hits", F.explode(able).alias("template"))
    rows = rows.select("doc_id", "mark", "template", F.inline("hits")).join(F.broadcast(table), ["template", "gram", "pair"])
    # shifts within the slack share a band: bands are twice as wide and overlap
    shift = F.col("at") - F.col("place")
    band = F.floor(shift / F.greatest(F.col("slack"), F.lit(1))).cast("int")
    rows = rows.withColumn("band", F.explode(F.when(F.col("slack") == 0, F.array(band)).otherwise(F.array(band - 1, band))))
    found = rows.groupBy("doc_id", "mark", "template", "band").agg(
        F.collect_set(2 * F.col("place") + F.col("pair")).alias("held"),
        F.size(F.collect_set(F.when(F.col("pair") == 0, F.col("at")))).alias("own"),
        F.min("at").alias("start"),
        F.max(F.col("at") + F.col("pair")).alias("end"),
        F.max(F.when(F.col("gram") == number["rights reserved"], F.col("at"))).alias("rights"),
        F.collect_set("gram").alias("grams"),
        F.array_distinct(F.flatten(F.collect_set(F.array("line", "last")))).alias("paragraphs"),
    )
    keys = F.get(arrays([[2 * j + pair for _, j, pair in x.keys] for x in templates]), F.col("template"))
    foreign = F.col("end") - F.col("start") + 1 - F.col("own")
    found = found.where((F.size("held") >= of_template([confirm * len(x.grams) for x in templates])) & (F.size(F.array_except(keys, F.col("held"))) == 0) & (foreign <= of_template([x.slack for x in templates])))
    found = found.withColumn("family", of_template([x.family for x in templates]))
    longer = F.max(F.col("family") != BARE).over(Window.partitionBy("doc_id", "mark", "rights"))
    found = found.withColumn("longer", longer).where((F.col("family") != BARE) | ~F.col("longer"))
    by = ["doc_id", "mark", "family", "start", "template", "paragraphs"]
    scored = _predicted(found.select(*by, F.explode("grams").alias("gram")).distinct(), model, *by)
    p = F.get("p", F.array_position(F.array(*map(F.lit, model.families)), F.col("family")).cast("int") - 1)
    return scored.select("doc_id", "mark", "family", p.alias("probability"), F.array_min("paragraphs").alias("first"), "paragraphs")


def paragraphs(documents: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.7) -> DataFrame:
    """Per paragraph whose best family is not unknown: doc_id, mark, paragraph, family, probability, confirmed (a notice of the family has words there)."""
    hits = cut(_hits(documents, model, id_col, text_col))  # read twice; small beside the texts
    noticed = _notices(hits, model, confirm).select("doc_id", "mark", "family", F.explode("paragraphs").alias("paragraph")).distinct().alias("n")
    lines = _predictions(hits, model).alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("doc_id", "mark", "family", "paragraph")]
    return lines.join(noticed, same, "left").select("l.*", F.col("n.mark").isNotNull().alias("confirmed"))


def licences(documents: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, confirm: float = 0.7) -> DataFrame:
    """Per row: doc_id, families (of notices, sorted, comma-joined), n_confirmed (families and paragraphs they begin in), n_unconfirmed (predicted paragraphs without notice), probability (highest of a notice, else 0)."""
    model = model or train()
    hits = cut(_hits(documents, model, id_col, text_col))  # read twice; small beside the texts
    notices = _notices(hits, model, confirm).where(F.col("probability") >= at_least)
    notices = notices.select("doc_id", "mark", F.explode("paragraphs").alias("paragraph"), F.struct("family", "first").alias("notice"), "probability")
    lines = _predictions(hits, model).where(F.col("probability") >= at_least)
    every = notices.unionByName(lines.select("doc_id", "mark", "paragraph"), allowMissingColumns=True)
    found = every.groupBy("doc_id", "mark", "paragraph").agg(F.collect_set("notice").alias("notices"), F.max("probability").alias("probability"))
    found = found.groupBy("doc_id", "mark").agg(
        F.array_distinct(F.flatten(F.collect_set("notices"))).alias("notices"),
        F.count(F.when(F.size("notices") == 0, 1)).alias("n_unconfirmed"),
        F.max("probability").alias("probability"),
    )
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))), ",")
    found = found.select("doc_id", "mark", families.alias("families"), F.size("notices").cast("long").alias("n_confirmed"), "n_unconfirmed", "probability")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.mark") == F.col("f.mark"))
    return docs.join(found.alias("f"), same, "left").select("d.doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
