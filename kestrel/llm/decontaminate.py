"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A
benchmark window is 13 consecutive words of an item, or the whole item if it
has fewer.  For windows of L words the hashes of
k-grams (k about L / 2) are winnowed: of every L - k + 1 consecutive grams the minimum is kept.  A
window holds exactly that many grams, so each of its occurrences keeps the
same minimum: the fingerprint under which windows and documents are joined.
Documents that share a fingerprint are then extended: their windows at those
places are compared with the benchmark's word by word.

A null or empty text has no words, is never contaminated, and an item without
words or id is skipped.  Equal windows of several items are matched once and
count for each item.  Item ids are counted once however often a row repeats;
rows of documents with one id are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.blocks import materialize

WINDOW = 13
#: Fingerprints of the benchmark (8 bytes each) that are broadcast.
BROADCAST_PRINTS = 1_000_000
#: Documents that share a fingerprint with the benchmark (about 100 bytes each) that are broadcast.
BROADCAST_DOCS = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, _SPLIT), "")


def _width(length: int) -> int:
    """Grams in a winnowing window of ``length`` words: a power of two, about half."""
    w = 1
    while w * 2 <= min(length, (length + 1) // 2 + 1):
        w *= 2
    return w


def _rolling(df: DataFrame, source: str, length: int, join, out: str) -> DataFrame:
    """``out``[i] = join of ``source``[i .. i + length - 1], by doubling.

    Every step is a column of its own, so Catalyst evaluates it once, as long as no
    filter on the result can be pushed below these columns: that would spell out
    all steps in the filter.  So the result is written before a join, or exploded
    with ``explode_outer``, which infers no filter.
    """
    def pair(frame, left, by, right, name):
        n = F.greatest(F.size(right) - by, F.lit(0))
        return frame.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), join))

    power, size = {1: source}, 1
    while size * 2 <= length:
        df = pair(df, power[size], size, power[size], f"_p{size * 2}")
        power[size * 2] = f"_p{size * 2}"
        size *= 2
    done, have = size, power[size]
    while done < length:
        size = max(p for p in power if p <= length - done)
        df = pair(df, have, done, power[size], f"_a{done + size}")
        done, have = done + size, f"_a{done + size}"
    return df.withColumn(out, F.col(have)).drop(*[c for c in df.columns if c[:2] in ("_p", "_a") and c != out])


def _minima(df: DataFrame, length: int, out: str) -> DataFrame:
    """``out``[i]: the minimum gram hash within the ``length`` words from i on, of ``_h`` (word hashes)."""
    width = _width(length)
    df = _rolling(df, "_h", length - width + 1, lambda a, b: F.xxhash64(a, b), "_grams")
    return _rolling(df, "_grams", width, lambda a, b: F.least(a, b), out).drop("_grams")


def _hashed(df: DataFrame, words: Column) -> DataFrame:
    return df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))


def _windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, len, words, win, fp): each item's windows; equal windows share ``win``."""
    items = (benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("w"))
             .where("item IS NOT NULL AND size(w) > 0"))
    n = F.least(F.size("w"), F.lit(window))
    out = items.select("item", n.alias("len"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.slice("w", s, n))).alias("words")).distinct()
    return out.withColumn("win", F.sha2(F.concat_ws(" ", "words"), 256))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``text_key`` (hash of the text, which tells
    apart rows of one id), n_words, n_hit, n_items, item_ids (array), contaminated."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("k"), F.xxhash64("t").alias("h")]
    windows = materialize(_windows(benchmark, window, item_col, item_text_col), "bench")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # 13 values at most

    # one pass over the texts: the word count and the distinct fingerprints of each length
    prepared = _hashed(source.select("doc_id", *key, words_of(F.col("t")).alias("w")), F.col("w"))
    prepared = prepared.withColumn("n_words", F.size("w").cast("long")).drop("w")
    for n in lengths:
        prepared = _minima(prepared, n, f"_m{n}").withColumn(f"_m{n}", F.array_distinct(f"_m{n}"))
    prepared = materialize(prepared.drop("_h"), "fingerprints")

    found = None
    for n in lengths:
        distinct = _hashed(windows.where(F.col("len") == n).select("win", "words").distinct(), F.col("words"))
        # dealt over tasks by window, and written: a join key must not be a column of hashing steps
        distinct = _minima(distinct.repartition("win"), n, "_m").select("win", F.col("words").alias("_words"), F.col("_m")[0].alias("_fp"))
        distinct = materialize(distinct, "bench-prints")
        prints = distinct.select("_fp").distinct()
        if distinct.count() <= BROADCAST_PRINTS:  # else the documents' fingerprints are shuffled to them
            prints = F.broadcast(prints)
        shared = (prepared.select("k", "h", F.explode(f"_m{n}").alias("_fp")).join(prints, "_fp", "left_semi")
                  .groupBy("k", "h").agg(F.collect_set("_fp").alias("_fps")))
        shared = materialize(shared, "shared")
        if shared.count() <= BROADCAST_DOCS:  # else all texts are shuffled to the few
            shared = F.broadcast(shared)
        near = source.select(*key, words_of(F.col("t")).alias("w")).join(shared, ["k", "h"])
        near = _minima(_hashed(near, F.col("w")), n, "_m")
        # extend: the windows at places whose fingerprint the benchmark has, word by word
        at = F.filter(F.transform("_m", lambda m, p: F.struct(p.alias("p"), m.alias("m"))),
                      lambda x: F.array_contains("_fps", x["m"]))
        places = near.select("k", "h", F.explode_outer(F.transform(at, lambda x: F.struct(
            x["p"].alias("p"), x["m"].alias("fp"), F.slice("w", x["p"] + 1, F.lit(n)).alias("words")))).alias("x"))
        hits = places.join(distinct, (F.col("x.fp") == F.col("_fp")) & (F.col("x.words") == F.col("_words")))
        hits = hits.select("k", "h", F.col("x.p").alias("p"), F.lit(n).alias("len"), "win").distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "k string, h long, p int, len int, win string")
    else:
        found = materialize(found, "hits")

    by_doc = Window.partitionBy("k", "h").orderBy("p", "len")
    reached = F.max(F.col("p") + F.col("len")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("p") + F.col("len") - F.greatest("p", F.coalesce(reached, F.col("p"))))
    covered = (found.select("k", "h", "p", "len").distinct().select("k", "h", fresh.alias("n"))
               .groupBy("k", "h").agg(F.sum("n").cast("long").alias("n_hit")))
    items = (found.select("k", "h", "win").distinct().join(windows.select("win", "item").distinct(), "win")
             .groupBy("k", "h").agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    judged = covered.join(items, ["k", "h"])
    hit = F.coalesce("n_hit", F.lit(0))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (prepared.select("doc_id", "k", "h", "n_words").join(judged, ["k", "h"], "left")
            .select("doc_id", F.col("h").alias("text_key"), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    ids.alias("item_ids"), ((hit > 0) & (hit >= share * F.col("n_words"))).alias("contaminated")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    columns = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # names of the input can't clash with those here
    doc_id, text = docs[f"c{columns.index(id_col)}"], docs[f"c{columns.index(text_col)}"]
    same = doc_id.eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text) == F.col("_bad_key"))
    return docs.join(bad, same, "left_anti").toDF(*columns)
