"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (one to three bytes, lower case, runs of anything but letters as one
blank), weighted by TF-IDF and normalised. Each language has several centroids, found by spherical k-means over a
bounded sample of its labelled texts; a text gets the language of the centroid with the largest cosine. A text whose
best cosine is lower than nearly all of the sample's own texts reached is rejected as too distant.

The sample is bounded by ``per_language`` texts of each language, taken in the order of a hash of their ids. Vectors are
made in tasks; k-means runs as one group of bounded size per language; the driver holds the document frequencies
and the centroids only. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import in_small_batches, load, map_rows, needs, own_name, tidy
from larder.llm.registered import query

DIMENSIONS = 4096
LOW = 0.01  # share of a language's sample that may be too unlike the rest to set its floor
_SLICE = 1 << 20  # bytes counted at a time

# Bytes in lower case; everything in ASCII that is no letter is a blank.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _hashed(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram occurs in a text."""
    total = np.zeros(DIMENSIONS, dtype=np.float64)
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    for begin in range(0, len(data), _SLICE):
        b = _FOLD[data[begin : begin + _SLICE + 2]]
        b = np.concatenate(([0x20], b, [0x20])).astype(np.uint8)
        b = b[np.concatenate(([True], (b[1:] != 0x20) | (b[:-1] != 0x20)))].astype(np.uint32)
        pairs = b[:-1] << np.uint32(8) | b[1:]
        triples = pairs[:-1] << np.uint32(8) | b[2:]
        for grams, salt in ((b, 1), (pairs, 2), (triples, 3)):
            if len(grams):
                total += np.bincount(_hashed(grams + np.uint32(salt << 24)), minlength=DIMENSIONS)
    return total


def weighted(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of length 1 (all zeros for a text without n-grams)."""
    vector = np.log1p(total) * idf
    length = np.sqrt((vector * vector).sum())
    return vector / length if length else vector


def _settled(vectors: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids after at most so many rounds of k-means, and how many vectors are nearest to each."""
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        moved = np.array([vectors[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres, np.bincount(np.argmax(vectors @ centres.T, axis=1), minlength=len(centres))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12, least_share: float = 0.05, tries: int = 8) -> np.ndarray:
    """At most k unit centroids, each of at least two vectors and ``least_share`` of them (one centroid if there is no more).

    Starts are drawn as in k-means++ with a fixed seed, so runs on the same rows in the same order are alike. Vectors that end
    in too small a cluster start none in the next try; after the last, such clusters are given up and their vectors join others.
    """
    draw = np.random.default_rng(20240521)
    least = min(max(2, least_share * len(vectors)), len(vectors))
    may = np.ones(len(vectors), dtype=bool)
    kept = None
    for _ in range(tries):
        starts = [int(draw.choice(np.flatnonzero(may)))]
        while len(starts) < k:
            far = np.where(may, 1 - (vectors @ vectors[starts].T).max(axis=1), 0)
            far[far < 1e-9] = 0
            if not far.any():
                break
            starts.append(int(draw.choice(len(vectors), p=far / far.sum())))
        centres, sizes = _settled(vectors, vectors[starts], rounds)
        while len(centres) > 1 and sizes.min() < least:
            alone = np.argmax(vectors @ centres.T, axis=1) == np.argmin(sizes)
            may &= ~alone
            centres, sizes = _settled(vectors, np.delete(centres, np.argmin(sizes), axis=0), rounds)
        if kept is None or len(centres) > len(kept):
            kept = centres
        if len(kept) == len(starts) or not may.any():
            break
    return kept


class NothingToLearn(ValueError):
    """No row has both text and language."""


class Model:
    """Languages and centroids with the idf weights and, per language, the cosine below which a text is too distant."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, floors: dict[str, float]):
        self.languages, self.centroids, self.idf, self.floors = languages, centroids, idf, floors
        self.learned = sorted(set(languages))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine clipped to 0..1, rejected); ties go to the first language in order."""
        total = counts(text)
        cosines = self.centroids @ weighted(total, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(max(cosines[best], 0.0), 1.0))
        return self.languages[best], score, score < self.floors[self.languages[best]]


def fit(
    labelled: DataFrame,
    per_language: int = 600,
    clusters: int = 4,
    slack: float = 0.5,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
) -> Model:
    """Centroids from the labelled rows (those with text and language; texts without a letter teach nothing).

    At most ``per_language`` texts of a language are used: those with the least hash of id and text. A language's floor
    is ``slack`` times the cosine that all but a hundredth of its own texts reach, so that a few odd ones do not lower it and
    only texts unlike nearly all of the sample fall below. Raises NothingToLearn, a ValueError, if no row has both text and language.
    """
    needs(labelled, text_col, lang_col, id_col)
    rows = (
        labelled.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull())
        .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    )
    # Only hash and language are ranked; a limit on row_number cuts every partition before its rows are dealt. A language
    # is ranked in 64 parts first, so that what meets in one task does not grow with the number of partitions.
    part, whole = Window.partitionBy("lang", "salt").orderBy("h"), Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h", F.pmod("h", F.lit(64)).alias("salt"))
    for window in (part, whole):
        chosen = chosen.withColumn("n", F.row_number().over(window)).where(F.col("n") <= per_language)
    least = {r["lang"]: r["top"] for r in chosen.groupBy("lang").agg(F.max("h").alias("top")).collect()}
    if not least:
        raise NothingToLearn("no labelled texts to learn from")
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    sample = rows.where(F.col("h") <= F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "grams": [counts(t) for t in batch["text"]]})

    counted = in_small_batches(sample).mapInPandas(vectors, "lang string, h long, grams array<double>").persist()

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for grams in batch["grams"]:
                seen += np.asarray(grams) > 0
                n += 1
        yield pd.DataFrame({"n": [n], "seen": [seen]})

    try:
        counted.count()  # vectors first and sums afterwards, so that a task never runs two Python workers
        parts = counted.coalesce(8).mapInPandas(frequencies, "n long, seen array<double>").collect()
        n = sum(r["n"] for r in parts)
        idf = np.log((1 + n) / (1 + np.sum([r["seen"] for r in parts], axis=0))) + 1

        def centres(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            own = np.array([weighted(np.asarray(g), idf) for g in group.sort_values("h")["grams"]])
            found = spherical_kmeans(own, clusters)
            floor = float(np.quantile((own @ found.T).max(axis=1), LOW)) * slack
            return pd.DataFrame({"lang": [key[0]] * len(found), "floor": floor, "centre": list(found)})

        learned = counted.groupBy("lang").applyInPandas(centres, "lang string, floor double, centre array<double>").collect()
    finally:
        counted.unpersist()
    learned.sort(key=lambda r: (r["lang"], r["centre"]))
    return Model([r["lang"] for r in learned], np.array([r["centre"] for r in learned]), idf, {r["lang"]: r["floor"] for r in learned})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; other columns pass through, but those three names are replaced.

    lang_pred is a learned language, also for rejected texts, or ``und`` with score 0 if the text is null, empty or has no
    letter; these are rejected too. Every row is judged by its own whole text.
    """
    needs(docs, text_col)
    added = ("lang_pred", "score", "rejected")
    source, letters = own_name(docs, "source"), own_name(docs, "letters")
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = T.StructType(
        [f for f in docs.schema.fields if f.name in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, has = batch.column(len(kept)), batch.column(len(kept) + 1).to_pylist()
            found = [model.predict(t.as_py()) if h else ("und", 0.0, True) for t, h in zip(texts, has)]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *added])

    text = docs[f"`{text_col}`"]
    given = docs.select(*[f"`{c}`" for c in kept], text.alias(source), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letters))
    return map_rows(given, tidy(run), schema)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
