"""Operator 4: benchmark decontamination by winnowing, in DataFrame functions only.

Every k-gram of words is hashed, and of every ``span - k + 1`` consecutive k-grams,
that is of every window of ``span`` words, the least hash is kept: equal windows keep
equal hashes, so no shared span of ``span`` words can be missed, and neighbouring
windows mostly keep the same one. Training and benchmark fingerprints are joined;
each hit is then extended to the windows that its fingerprint stands for, and these
are compared word for word with the benchmark's windows. An item of fewer words is
one window; it is sought by its first word and then compared likewise.

The benchmark's fingerprints are broadcast only while their counted number is below
``broadcast_rows``; beyond that both joins shuffle, places travel without the words of
their document, and documents with hits are read again for their windows. A document's
own hits are the most that any task gathers.

Null text has no words; null ids group by text; repeated rows each get their row;
empty documents or an empty benchmark give zero hits; an empty table gives an empty
result; other columns are ignored. Time and a task's memory grow with the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark's items that may be broadcast (some 200 bytes each).
BROADCAST_ROWS = 100_000


ITSELF, RUN, BEGUN = 0, 1, 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _positions(count: Column) -> Column:
    """0 .. count - 1, empty if count < 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _with_minima(df: DataFrame, span: int, k: int) -> DataFrame:
    """Adds ``least``: for each window of span words its least k-gram hash."""
    n = F.size("words")
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", F.transform(_positions(n - (k - 1)), lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + j) for j in range(k)))))
    return df.withColumn("least", F.transform(_positions(n - (span - 1)), lambda i: F.least(*(F.get(F.col("grams"), i + j) for j in range(span - k + 1)))))


def _windows(words: Column, at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, span: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: window, length, items (sorted ids)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(span))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - length))
    rows = items.select("item", "words", length.alias("length"), at.alias("at")).select("item", "length", _windows(F.col("words"), F.col("at"), F.col("length")).alias("window"))
    return rows.groupBy("window").agg(F.first("length").alias("length"), F.sort_array(F.collect_set("item")).alias("items"))


def hits(documents: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, spans (array of start, end in words; end exclusive), items (sorted ids), copies."""
    windows = benchmark_windows(benchmark, span, item_col, item_text_col)
    lengths = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.sum(F.size("items")).alias("n")).collect()}  # span rows at most
    small = sum(lengths.values()) <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)
    full = windows.where(F.col("length") == span).select(F.split("window", " ").alias("words"))
    prints = _with_minima(full, span, k).select(F.get("least", F.lit(0)).alias("print")).distinct()

    short = sorted(n for n in lengths if n < span)
    if short:
        first = windows.where(F.col("length") < span).select(F.xxhash64(F.substring_index("window", " ", 1)).alias("print"))
        prints = prints.unionByName(first).distinct()

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words_of(text).alias("words"))
    docs = _with_minima(docs, span, k)
    turns = F.filter(_positions(F.size("least")), lambda i: (i == 0) | (F.get(F.col("least"), i) != F.get(F.col("least"), i - 1)))
    docs = docs.select("doc_id", "mark", "words", "hashes", "least", turns.alias("turns"))

    def place(kind: int, print_: Column, at: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), print_.cast("long").alias("print"), at.cast("int").alias("at"), n.cast("int").alias("n"))

    # what is sought of a document: itself (its own row, which passes every filter), the runs of windows with one
    # fingerprint, and with short items every word, which may begin one
    itself = F.array(place(ITSELF, F.lit(None), F.lit(-1), F.size("words")))
    runs = F.transform(_positions(F.size("turns")), lambda j: place(RUN, F.get(F.col("least"), F.get(F.col("turns"), j)), F.get(F.col("turns"), j), F.coalesce(F.get(F.col("turns"), j + 1), F.size("least")) - F.get(F.col("turns"), j)))
    begun = [F.transform("hashes", lambda h, i: place(BEGUN, h, i, F.lit(0)))] if short else []
    docs = docs.select("doc_id", "mark", "words", F.concat(itself, runs, *begun).alias("sought"))
    # The outer generators keep every row too, but Spark infers no filter from them: pushed down to the scan,
    # such a filter would hold all these arrays' definitions, evaluated anew for every element.
    key = ["doc_id", "mark"]
    if small:
        found = docs.select(*key, "words", F.inline_outer("sought")).join(near(prints.withColumn("known", F.lit(True))), "print", "left").where((F.col("kind") == ITSELF) | F.col("known"))
    else:
        # places travel without their document's words; documents with hits are read again for these
        every = docs.select(*key, F.inline_outer("sought"))
        own = every.where(F.col("kind") == ITSELF).withColumn("words", F.lit(None).cast("array<string>"))
        matched = every.where(F.col("kind") != ITSELF).join(prints, "print", "left_semi").groupBy(*key).agg(F.collect_set(F.struct("kind", "at", "n")).alias("places"))
        again = docs.select(*key, "words").alias("d").join(matched.alias("m"), [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key])
        found = own.select(*key, "words", "kind", "at", "n").unionByName(again.select("d.doc_id", "d.mark", "words", F.inline_outer("places")))
    reach = F.when(F.col("kind") == RUN, F.col("n") + span - 1).when(F.col("kind") == BEGUN, F.lit(span - 1))
    found = found.select(*key, "kind", "at", "n", F.when(reach.isNotNull(), F.slice("words", F.col("at") + 1, reach)).alias("words"))

    # every place becomes its windows; the document's own row bears one that no benchmark has, so that these rows spread too
    def window(at: Column, said: Column) -> Column:
        return F.struct(at.alias("at"), said.alias("window"))

    of_run = F.transform(_positions(F.col("n")), lambda o: window(F.col("at") + o, _windows(F.col("words"), o, span)))
    tried = F.when(F.col("kind") == ITSELF, F.array(window(F.col("at"), F.concat(F.lit(" "), F.col("mark").cast("string"))))).when(F.col("kind") == RUN, of_run)
    if short:
        tried = tried.otherwise(F.filter(F.array(*(window(F.col("at"), F.when(F.size("words") >= n, _windows(F.col("words"), F.lit(0), n))) for n in short)), lambda w: w["window"].isNotNull()))
    found = found.select(*key, F.when(F.col("kind") == ITSELF, F.col("n")).alias("n_words"), F.inline_outer(tried))
    found = found.join(near(windows), "window", "left").where("items is not null or n_words is not null")
    span_of = F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")))
    return found.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(span_of)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count("n_words").cast("int").alias("copies"),
    ).drop("mark")


def covered(spans: Column) -> Column:
    """Words covered by spans that are sorted by start."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach"))
    return F.aggregate(spans, zero, lambda a, s: F.struct((a["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("words"), F.greatest(a["reach"], s["end"]).alias("reach")))["words"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(documents, benchmark, **options)
    n_hit = covered(F.col("spans")).cast("long")
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
