"""Quality scores by Bradley-Terry ranking of document pairs.

Every pair of a preferred and a rejected document says that the first should score higher: the chance is the logistic
function of the difference of the two scores, and a score is a weighted sum of features of the text. The weights come
from the logistic loss on feature differences (Newton steps with a small ridge). The scores are then cut at a quantile:
the share of rejected documents among all labelled ones falls below the cut, and a shift maps the cut to ``threshold``.

All labelled rows take part. Their features are made in tasks; documents are dealt into groups that hold both labels and are paired
there, and a Newton step sums slope and curvature over the groups, so the driver sees numbers of the weights' size only. The cut is
narrowed by counts. Scoring is one pass over the whole texts without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import in_small_batches, load, map_rows, needs, own_name, tidy
from larder.llm.registered import query
from larder.session import written

FEATURES = (
    "log_bytes log_words word_length long_words upper digits marks shouts bars other_marks lines line_words "
    "distinct_words top_word twin_words distinct_lines sentence_words sentences_ended packing short_text"
).split()
_PACK = 1 << 16  # bytes compressed at a time
FEW_IDS = 200_000  # up to so many labelled ids go to all tasks, so that only their texts are read closely
GROUP_RARE, GROUP_COMMON = 1000, 4000  # documents of the rarer and of the other label that are paired together
MOST_VALUES = 10_000  # scores around the cut that are ordered on the driver


def features(text: str | None) -> list[float]:
    """What the score is a weighted sum of; all finite for any text, null counts as empty."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(len, words))
    seen = Counter(words)
    data = text.encode("utf-8", "replace")
    packed = sum(len(zlib.compress(data[i : i + _PACK], 1)) for i in range(0, len(data), _PACK))
    alpha = text.translate(_KINDS)
    upper, digits, shouts, bars, marks = (alpha.count(c) for c in "UD!|M")
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        math.log1p(len(data)),
        math.log1p(len(words)),
        min(letters / m, 40.0),
        sum(len(w) > 14 for w in seen) / max(len(seen), 1),
        upper / n,
        digits / n,
        marks / n,
        shouts / m,
        bars / m,
        sum(not w[-1:].isalnum() for w in words) / m,
        math.log1p(len(lines)),
        math.log1p(m / max(len(lines), 1)),
        len(seen) / m,
        max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(m / max(ends, 1)),
        float(text.rstrip()[-1:] in (".", "!", "?")),
        packed / max(len(data), 1) if data else 0.0,
        1.0 / (1 + len(words)),
    ]


_KINDS = {**{c: "U" for c in range(65, 91)}, **{c: "D" for c in range(48, 58)}, 33: "!", 124: "|"}
_KINDS |= {ord(c): "M" for c in "#$%&*+/<=>@[]^_{}~\\"}


class Ranking:
    """Weights of the features with what centres and scales them, the cut and the value it is mapped to."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, cut: float, threshold: float):
        self.weights, self.centre, self.scale, self.cut, self.threshold = weights, centre, scale, cut, threshold

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return _expanded(rows, self.centre, self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; at the cut exactly ``threshold``."""
        shift = math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut + shift, -30, 30)))


def _expanded(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((rows - centre) / scale, -5, 5)
    return np.hstack([z, z * z])


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float, steps: int) -> np.ndarray:
    """Weights by Newton steps; ``sums`` gives the summed gaps by chance of error, and the summed curvature, for given weights."""
    w = np.zeros(size)
    for _ in range(steps):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(size), ridge * w - slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _slope_and_curve(gaps: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(gaps @ w, -30, 30)))
    return gaps.T @ p, (gaps * (p * (1 - p))[:, None]).T @ gaps


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights w that minimise the sum of log(1 + exp(-w . (better - worse))) and ridge / 2 * |w|^2."""
    gaps = better - worse
    return _newton(lambda w: _slope_and_curve(gaps, w), gaps.shape[1], ridge, steps)


def _values(table: pa.Table) -> np.ndarray:
    return np.array(table.column("f").to_pylist(), dtype=float).reshape(table.num_rows, -1)


def _labelled_features(docs: DataFrame, chosen: DataFrame, few: bool) -> DataFrame:
    """(id, label, f) for the (id, label) of ``chosen`` that have a document. No text is shuffled: short rows meet the labels."""
    if few:
        docs = docs.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), rows], names=["id", "hash", "f"])

    given = in_small_batches(docs.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("hash"), "text"))
    made = given.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, hash long, f array<double>")
    return made.join(chosen, "id").groupBy("id", "label").agg(F.min_by("f", F.struct("hash", "f")).alias("f"))


def _dealt(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` in groups ``part`` of bounded size with both labels: the rarer label stands in as many groups as the other one needs."""
    rare = 0 if counts[0] <= counts[1] else 1
    groups = max(1, counts[rare] // GROUP_RARE)
    times = math.ceil(counts[1 - rare] / (groups * GROUP_COMMON))
    spread = F.pmod(F.xxhash64("id"), F.lit(groups * times))
    own = F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.pmod(spread, F.lit(groups)) + k * groups)
    parts = F.when(F.col("label") == rare, own).otherwise(F.array(spread))
    return rows.withColumn("part", F.explode(parts)).repartition("part")


def _cut(scored: DataFrame, counts: dict[int, int], shares: dict[int, int]) -> float:
    """The middle between the score at which the share of rejected documents is reached, each label weighted as often as it
    occurs, and the next one. Ranges of scores are counted until few scores are left, which are ordered."""

    def reached(bad: int, good: int) -> bool:
        return bad * shares[0] / counts[0] + good * shares[1] / counts[1] >= shares[0] - 1e-9 * (shares[0] + shares[1])

    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    before, n = [0, 0], counts[0] + counts[1]
    r = {"bad": counts[0], "good": counts[1]}
    while n > MOST_VALUES and low < high:
        here = scored.where(F.col("raw").between(low, high))
        bin_ = F.least(F.floor((F.col("raw") - low) * (256 / (high - low))), F.lit(255)).alias("bin")
        found = here.groupBy(bin_).agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("bin").collect()
        for r in found:
            if reached(before[0] + r["bad"], before[1] + r["good"]) or r is found[-1]:
                low, high, n = r["low"], r["high"], r["bad"] + r["good"]
                break
            before = [before[0] + r["bad"], before[1] + r["good"]]
    if n > MOST_VALUES:  # all the same: the next score is another one only if the last of them is what it takes
        raw, last = low, r["good"] > 0
        alone = not reached(before[0] + r["bad"] - (not last), before[1] + r["good"] - last)
    else:
        values = sorted((v["raw"], v["label"]) for v in scored.where(F.col("raw").between(low, high)).collect())
        for at, (raw, label) in enumerate(values):
            before[label] += 1
            if reached(*before):
                break
        alone = at + 1 == len(values)
    following = scored.where(F.col("raw") > high).agg(F.min("raw")).first()[0] if alone else raw if n > MOST_VALUES else values[at + 1][0]
    return float((raw + (raw if following is None else following)) / 2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int | None = None,
    pairs_each: int = 4,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Ranking:
    """A ranking from ``labels`` (id, 0 or 1; other values and nulls are ignored) of ``docs``.

    All labelled documents take part, or those of the ``per_class`` ids of each label with the least hash, if that is given; each
    document of the commoner label in a group is compared with ``pairs_each`` of the other. Ids that are labelled both ways, or more
    than once, count once for each label; of rows that repeat an id, the text with the least hash takes part, so that a repeated fit
    is the same. Raises ValueError unless both labels have documents.
    """
    needs(docs, id_col, text_col)
    needs(labels, id_col, label_col)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    shares = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = marked.distinct()
    if per_class is not None:
        # A sort with a limit keeps its ``per_class`` rows per partition: nothing grows with the labels.
        limited = [chosen.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
        chosen = limited[0].union(limited[1])
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(_labelled_features(given, chosen, sum(shares.values()) <= FEW_IDS), "quality-features")
    each = [F.col("f")[i] for i in range(len(FEATURES))]
    counted = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.array(*map(F.avg, each)), F.array(*map(F.stddev_pop, each))).first()
    counts = {0: counted[0], 1: counted[1]}
    if not all(counts.values()):
        raise ValueError("documents of both labels are needed")
    centre, scale = np.array(counted[2]), np.maximum(np.array(counted[3]), 1e-6)
    size = 2 * len(FEATURES)
    dealt = _dealt(rows, counts).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(table: pa.Table) -> pa.Table:
            ids, labels_ = table.column("id").to_pylist(), table.column("label").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (labels_[i], str(ids[i])))
            z, good = _expanded(_values(table), centre, scale)[order], np.array(labels_)[order] == 1
            better, worse = z[good], z[~good]
            n = max(len(better), len(worse))
            total = np.zeros(size + size * size)
            if len(better) and len(worse):
                draw = np.random.default_rng(11)
                left = np.concatenate([draw.permutation(np.arange(n) % len(better)) for _ in range(pairs_each)])
                slope, curve = _slope_and_curve(better[left] - worse[np.tile(np.arange(n) % len(worse), pairs_each)], w)
                total = np.concatenate([slope, curve.ravel()])
            return pa.table({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

        parts = dealt.groupBy("part").applyInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
        found = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # one number for each weight and pair of weights
        total = np.zeros(size + size * size)
        for r in found:
            total[r["at"]] = r["v"]
        return total[:size], total[size:].reshape(size, size)

    try:
        weights = _newton(sums, size, 1.0, 30)
    finally:
        dealt.unpersist()

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _expanded(_values(batch), centre, scale) @ weights
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw, pa.float64())], names=["label", "raw"])

    scored = rows.select("label", "f").mapInArrow(tidy(raw_scores), "label int, raw double")
    return Ranking(weights, centre, scale, _cut(scored, counts, shares), threshold)


def score(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the ranking's threshold on); columns so named are replaced.

    Every row is scored by its own whole text; a null text scores as an empty one.
    """
    needs(docs, text_col)
    source = own_name(docs, "source")
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            rows = np.array([features(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))
            found = ranking.scores(rows) if len(texts) else np.zeros(0)
            made = [pa.array(found, pa.float64()), pa.array((found >= ranking.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=names)

    given = docs.select(*[f"`{f.name}`" for f in kept], docs[f"`{text_col}`"].alias(source))
    return map_rows(given, tidy(run), schema)


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    ranking = fit(docs, load(spark, sf_dir, "labels").where(~held_out))
    return score(docs.withColumn("held_out", held_out), ranking).select("doc_id", "held_out", "score", "predicted")
