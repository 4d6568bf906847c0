"""Deduplication, near copies, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoledger.llm import decontamination, exact_dedup, signature_join
from chronoledger.llm.common import checkpoint_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    checkpoint_dir(spark)


def near_copies(count=40, seed=7):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randint(3, 120))] for _ in range(count)]
    shared = [f"s{i}" for i in range(60)]
    out = []
    for words in base:
        out.append(words)
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 3])):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
            out.append(copy)
        if r.random() < 0.4:
            out.append([f"w{r.randrange(400)}" for _ in range(r.randint(3, 60))] + shared)
    chain = [f"c{i}" for i in range(100)]
    for _ in range(12):
        chain = chain[3:] + [f"c{r.randrange(10**6)}" for _ in range(3)]
        out.append(chain)
    return [" ".join(w) for w in out] + ["one two", "ONE  two", None, "", " \t", "a b c d e", "A b\nc d e", "x " * 3000]


def brute_components(every):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(t) for t in every]
    parent = list(range(len(every)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("most", "dealt"), [(2048, 30), (3, 30), (2048, 0)])
def test_near_components(docs, monkeypatch, most, dealt):
    monkeypatch.setattr(signature_join, "DEALT", dealt)
    every = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.near_components(docs(every), most=most).collect()}
    assert got == brute_components(every)


def test_near_components_edges(docs, spark):
    assert signature_join.near_components(docs([])).count() == 0
    got = signature_join.near_components(docs(["a b c d e f", "a b c d e f", "a b c d e f"], ids=[None, 5, 5])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 5), (5, 5), (5, 5)]


def test_signature_tree_loses_no_pair():
    import numpy as np

    r = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        s = np.unique(r.integers(0, 1 << 62, size=int(r.integers(1, 80)), dtype=np.uint64))
        sets.append(s)
        for _ in range(int(r.integers(0, 3))):
            sets.append(np.unique(np.r_[s[r.random(len(s)) > 0.1], r.integers(0, 1 << 62, size=int(r.integers(0, 5)), dtype=np.uint64)]) if len(s) > 3 else s)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found = set()
    for members, tree in signature_join.trees(sizes, [signature_join.bitmap(s) for s in sets], 75):
        found |= {frozenset((int(members[i]), int(members[j]))) for i, j in tree.pairs(lambda *_: False)}
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(np.intersect1d(a, sets[j]))
            if 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                assert frozenset((i, j)) in found


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    got = {r.id: r.component for r in signature_join.components_of(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


@pytest.mark.parametrize("budget", [48_000_000, 2_000])
def test_exact_dedup(docs, budget):
    r = random.Random(9)
    every = ["".join(r.choice("ab \t\né ") for _ in range(r.randint(0, 6))) for _ in range(300)] + [None, "", "x" * 5000, "x " * 5000]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(every), budget=budget).collect()}
    groups = {}
    for i, t in enumerate(every):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(every[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(ids), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    nulls = exact_dedup.exact_dedup(docs(["a", "a ", "a"], ids=[None, 7, 7])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in nulls} == {(None, 7, 3, False), (7, 7, 3, True)}


def brute_hits(text, items):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
def test_decontamination(spark, docs, options):
    r = random.Random(4)
    vocabulary = ["the", "of", "and", "café", "Run", "x1", "to"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([12, 30, 10, 3, 1, 9, 0])] + [(20, None), (21, "the of")]
    items[4] = (4, "rareword")
    every = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(40)]
    for _, body in items[:4]:
        every.append(f"before, {body.upper()}! after")
        words = body.split()
        every.append(" ".join(words[:11]) + " zz " + " ".join(words[-11:]))
    every += [None, "", "a rareword, twice rareword", "x y " * 400]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.decontaminate(docs(every), table, **options)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    for i, t in enumerate(every):
        assert got[i] == brute_hits(t, items), (i, t)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert decontamination.decontaminate(docs([]), table).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(docs(["a b"]), table.limit(0)).collect()} == {0}
    doubled = decontamination.decontaminate(docs(["rareword", "rareword", "no"], ids=[1, 1, None]), table)
    assert sorted((r.doc_id or 0, r.n_hit) for r in doubled.collect()) == [(0, 0), (1, 1), (1, 1)]


def test_pipeline_against_brute_force(spark):
    """Every stage on its own input, sf0.001: brute force from the texts, the tokenizer from its library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(kept) <= set(texts) and len(kept) > 0.6 * len(texts)
    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    kept = {k: kept[k] for ids in groups.values() for k in [min(ids, key=lambda i: (-len(kept[i]), i))]}
    order = sorted(kept)
    components = brute_components([kept[i] for i in order])
    kept = {i: kept[i] for n, i in enumerate(order) if components[n][1] == n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [WORD.findall(t.lower())] for i in range(max(1, len(w) - 9))}

    def dirty(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    kept = {i: t for i, t in kept.items() if not dirty(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where(F.col("doc_id") < 5), sf_dir).columns == docs.columns


def test_pipeline_decides_by_row(spark, docs):
    """Null and repeated ids: one row of a group stays, and no other text under its id goes."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    leak = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    near = " ".join(f"w{i}" for i in range(60))
    rows = {
        corpus_pipeline.drop_exact_copies: ([("a b", None), ("ab", None), ("alone", None), ("same", 5), ("same", 5), ("other", 5), ("x", 9), ("x", 2)], [("a b", None), ("alone", None), ("other", 5), ("same", 5), ("x", 2)]),
        corpus_pipeline.drop_near_copies: ([(near, None), (near + " end", None), ("clean unique text here now", None), (near, 7), ("quite another text under seven", 7)], [("clean unique text here now", None), (near, 7), ("quite another text under seven", 7)]),
        corpus_pipeline.drop_contaminated: ([(leak, None), ("clean", None), (leak, 3), ("clean too", 3)], [("clean", None), ("clean too", 3)]),
    }
    for stage, (given, kept) in rows.items():
        got = stage(spark, docs([t for t, _ in given], ids=[i for _, i in given]), sf_dir)
        assert sorted((r.text, r.doc_id or 0) for r in got.collect()) == sorted((t, i or 0) for t, i in kept), stage


def test_whole_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, equal rows, short benchmark items, columns with the stages' own names: rows as brute force has them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(21)
    base = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randint(20, 60))) for _ in range(12)]
    texts = base + [base[0], base[0].upper(), base[1] + "  ", base[2] + " more", None, "", " ", "says rareitem here", "has two words inside", "x " * 5000, base[3] + " end", base[3]]
    rows = [(r.choice([None, 1, 2, *range(3, 40)]), t, "en", "s", len(t or ""), i, "c") for i, t in enumerate(texts)]
    rows += rows[:3]
    items = [(1, "rareitem"), (2, "two words"), (3, base[5]), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, head string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = sorted((x.doc_id or 0, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [(i, t or "") for i, t, *_ in rows]  # no toxic label: every score is 0
    groups = {}
    for i, t in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((i, t))
    kept = [min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)) for g in groups.values()]
    components = brute_components([t for _, t in kept])
    near = {}
    for n, x in enumerate(kept):
        near.setdefault(components[n][1], []).append(x)
    kept = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in near.values()]
    kept = [(i, t) for i, t in kept if not brute_hits(t, items)[4]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got == sorted((i or 0, len(library.encode(t, add_special_tokens=False).ids)) for i, t in kept)


def test_joins_take_clashing_columns_and_large_mixed_clusters(spark, docs):
    every = near_copies(20, 3)
    odd = docs(every).select("*", *(F.lit("x").alias(c) for c in ("mark2", "size", "id", "block", "bits", "component", "digest", "n", "words", "at", "kind", "slice", "_rejected_row")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.near_components(odd, most=3).collect()}
    assert got == brute_components(every)
    assert exact_dedup.exact_dedup(odd).count() == len(every)
    assert decontamination.decontaminate(odd, spark.createDataFrame([(1, "one two", "y")], "item_id long, text string, words string")).where("contaminated").count() == 2


def test_rows_of_one_gram_come_in_many_batches(spark, docs):
    """One passage in more texts than an Arrow batch holds rows: its gram is taken up whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        passage = " ".join(f"p{i}" for i in range(30))
        every = [f"{passage} own{i}" for i in range(40)] + [f"{passage} " + " ".join(f"o{i}x{j}" for j in range(60)) for i in range(30)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.near_components(docs(every)).collect()}
        assert got == brute_components(every)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
