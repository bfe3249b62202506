"""Language identification by nearest centroid over TF-IDF character n-grams.

A text's features are the hashed letter bigrams and trigrams of its
lower-cased words, edges included.  A bounded sample of labelled documents per
language (``SAMPLE``, taken by a hash) gives the document frequencies and, by
spherical k-means, ``CENTROIDS`` centroids of each language.  A text gets the
language of its nearest centroid; the score is that cosine (0 to 1).  A text
whose nearest centroid is too far is *rejected*; its nearest language stays in
``lang_pred``.  What is too far is learnt: each fold of a language's sample is
scored, whole and in windows of all lengths, by centroids of the other folds.
By number of distinct n-grams, since a clean text of one word has few n-grams in
common with any centroid, the bound is ``MARGIN`` times a low quantile
(``CLEAN``) of those cosines.  It is never below ``LEAST_COSINE``, which alone
holds for languages of fewer than ``CALIBRATED`` texts.

A null text, or one without any letter, is ``und`` with score 0 and rejected.
With nothing to learn from, every text is ``und``.  Only the text is used to predict.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.blocks import materialize
from kestrel.llm.hashing import mix

DIM = 4096
SAMPLE = 300
CENTROIDS = 4
LEAST_COSINE = 0.03
CALIBRATED, FOLDS = 20, 4
CLEAN, MARGIN = 0.01, 0.8
#: Characters whose n-grams are hashed at once.
CODES = 1 << 17
U64 = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x DIM) of hashed n-grams, and whether each text has a letter; about
    ``CODES`` characters at a time, as each takes some 80 bytes on the way."""
    out, some = np.zeros((len(texts), DIM), np.int64), np.zeros(len(texts), bool)
    ends = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CODES, "right")))
        out[at:stop], some[at:stop] = _grams(texts[at:stop])
        at = stop
    return out, some


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    out = np.zeros(len(texts) * DIM, np.int64)
    ends = np.cumsum(size)
    at = np.flatnonzero(letter)  # never the first or the last code
    doc = np.searchsorted(ends, at - 1, "right") * DIM
    before, here, after = code[at - 1], code[at], code[at + 1]
    for key in (here * U64(0x110000) + after, (before * U64(0x110000) + here) * U64(0x110000) + after + U64(1 << 62)):
        out += np.bincount(doc + (mix(key) & U64(DIM - 1)).astype(np.int64), minlength=len(out))
    some = np.bincount(doc // DIM, minlength=len(texts)) > 0
    return out.reshape(len(texts), DIM), some


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(counts) * idf).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _counted(texts, size: int = 128):
    for at in range(0, len(texts), size):
        yield _features(texts[at: at + size])[0]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread starting points; deterministic."""
    centre = [x.mean(0)]
    start = [int(np.argmax(x @ centre[0]))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    c = x[start]
    for _ in range(15):
        of = np.argmax(x @ c.T, 1)
        c = np.stack([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _windows(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The texts and one part of each of every length 4, 8, 16, ... below its own; and whose each is."""
    rng = np.random.default_rng(17)
    out, of = list(texts), list(range(len(texts)))
    for i, t in enumerate(texts):
        size = 4
        while size < min(len(t), 1 << 14):
            at = int(rng.integers(len(t) - size + 1))
            out.append(t[at: at + size])
            of.append(i)
            size *= 2
    return out, np.array(of, int)


def _bin(grams: np.ndarray) -> np.ndarray:
    """Half powers of two of the number of distinct n-grams."""
    return np.floor(2 * np.log2(np.maximum(grams, 1))).astype(int)


def _bounds(texts: list[str], x: np.ndarray, idf: np.ndarray, least: float) -> np.ndarray:
    """Least cosine by bin of the number of n-grams, from texts not learnt from (``x``: vectors of all)."""
    bounds = np.full(_bin(np.array([DIM]))[0] + 1, least)
    if len(texts) < CALIBRATED:
        return bounds
    parts, of = _windows(texts)
    centres = [_cluster(x[np.arange(len(x)) % FOLDS != f], CENTROIDS) for f in range(FOLDS)]
    cos, grams = [], []
    for at, counts in zip(range(0, len(parts), 128), _counted(parts)):
        y, fold = _unit(counts, idf), of[at: at + 128] % FOLDS
        cos.append(np.stack([(y @ c.T).max(1) for c in centres])[fold, np.arange(len(y))])
        grams.append((counts > 0).sum(1))
    cos, grams = np.concatenate(cos), np.concatenate(grams)
    bins = _bin(grams)
    for b in range(len(bounds)):
        own = cos[(bins == b) & (grams > 0)]
        bounds[b] = max(least, MARGIN * np.quantile(own, CLEAN)) if len(own) >= CALIBRATED else bounds[max(b - 1, 0)]
    return bounds


class Model:
    """langs[i], bounds[i]: language of centroid i and its least cosines by ``_bin``."""

    def __init__(self, langs, centroids, idf, bounds):
        self.langs, self.centroids, self.idf, self.bounds = langs, centroids, idf, bounds

    def predict(self, texts: list[str | None]):
        counts, some = _features(["" if t is None else t for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = _unit(counts, self.idf) @ self.centroids.T
        best = np.argmax(cos, 1)
        score = np.where(some, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
        return ([self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], score,
                ~some | (score < self.bounds[best, _bin((counts > 0).sum(1))]))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        least_cosine: float = LEAST_COSINE) -> Model:
    """Learn from at most ``sample`` distinct texts of each language (null texts and languages are left out)."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("o", F.xxhash64("text"))
    # the distinct texts of smallest hash; a cut at the hash under which several times as many
    # distinct ones lie keeps the rest of a frequent language, and copies, out of the shuffle
    sizes = rows.select("lang", "o").distinct().groupBy("lang").count().withColumn("cut", F.lit(2.0**64) * F.least(
        F.lit(1.0), F.lit(4.0 * sample + 64) / F.col("count")) - F.lit(2.0**63))  # a row per language
    rows = rows.join(F.broadcast(sizes.select("lang", "cut")), "lang").where(F.col("o").cast("double") <= F.col("cut"))
    rows = rows.groupBy("lang", "o").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("o")
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
    some = materialize(some.select("lang", "text"), "langid-sample")

    def frequencies(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        seen = sum((c > 0).sum(0) for c in _counted(texts))
        return pa.table({"n": [len(texts)], "df": pa.array([np.asarray(seen, np.int64).tobytes()], pa.binary())})

    found = some.groupBy("lang").applyInArrow(frequencies, "n long, df binary").collect()  # a row per language
    if not found:
        return Model([], None, None, None)
    total = sum(r["n"] for r in found)
    idf = np.log((1 + total) / (1 + sum(np.frombuffer(r["df"], np.int64) for r in found))).astype(np.float32) + 1

    def centroids(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        x = np.concatenate([_unit(c, idf) for c in _counted(texts)])
        some = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
        x, texts = x[some], [texts[i] for i in some.tolist()]
        lang = table.column("lang")[0].as_py()
        c = _cluster(x, CENTROIDS) if len(x) else np.zeros((0, DIM), np.float32)
        return pa.table({"lang": pa.array([lang] * len(c), pa.string()),
                         "centroid": pa.array([r.tobytes() for r in c], pa.binary()),
                         "bounds": pa.array([_bounds(texts, x, idf, least_cosine).tobytes()] * len(c), pa.binary())})

    # bounded: CENTROIDS rows of 16 KB for each language
    found = sorted(some.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, bounds binary").collect(),
                   key=lambda r: (r["lang"], r["centroid"]))
    if not found:
        return Model([], None, None, None)
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]),
                 idf, np.stack([np.frombuffer(r["bounds"]) for r in found]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``rejected`` added (replaced if there)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(F.col(f"`{text_col}`").alias("t"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lang, score, rejected = shared.value.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lang, pa.string()), pa.array(score),
                                                  pa.array(rejected)], names=["r", "lang_pred", "score", "rejected"])

    inner = source.schema["r"].dataType.simpleString()
    out = source.mapInArrow(run, f"r {inner}, lang_pred string, score double, rejected boolean")
    return out.select("r.*", "lang_pred", "score", "rejected")


def held_out(id_col: Column, of: int) -> Column:
    """Whether a row is in the fold that is never learnt from: crc32(id as text) mod ``of`` = 0."""
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % of == 0
