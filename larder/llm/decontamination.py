"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ten consecutive words of an item (a shorter item is one window) and is taken as the set of its shingles of five
words (a shorter window is one shingle). A document contains the window if all the shingles occur at their places.

1. One pass over the texts. A document's words become shingle hashes with their positions; those that occur in no
   window are dropped at once, the rest is written, with one row per document for its word count.
2. Shingles are ordered by rarity in the documents. Containment needs every shingle, so the necessary prefix of a window is
   its single rarest shingle; a window with a shingle that no document has is out.
3. Documents meet windows on prefix shingles only. The position of the shingle fixes where the window would start: it must
   start and end inside the document (positional and length bounds).
4. The remaining shingles of such a place are looked up by (document, position).
5. A place with all of them is confirmed on the words: the distinct texts that have such places are read once more, and a place
   where a text's words are not the window's own is taken out again.

Everything is DataFrame code. A shingle is known by 64 bits of each of its words' hash chain up to step 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.columns import load, needs, own_name
from larder.llm.registered import query
from larder.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and characters beyond ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), _BETWEEN, -1), "")


def _shingles(w: str, size: int) -> Column:
    """Hashes of ``size`` consecutive words, by start; none if there are fewer words."""
    count = F.size(w) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def item_windows(items: DataFrame, window: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, win, span, step, hashes): win is the window's words, span their number, step the shingle size."""
    split = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - window + 1, F.lit(1))
    spread = split.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, window))).alias("w"))
    step = F.least(F.size("w"), F.lit(size))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - step + 1), lambda i: F.xxhash64(F.slice("w", i, step)))
    return spread.select(
        "item", F.concat_ws(" ", "w").alias("win"), F.size("w").alias("span"), step.alias("step"), hashes.alias("hashes")
    ).distinct()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    size: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts document words inside any occurrence of any window; n_items counts items with an occurring window, and
    items_sha256 digests their ids, sorted as strings and joined by commas (of the empty string if there are none). Null
    and empty texts have no words. The windows of an item without an id count for n_hit and contaminated, but the item is neither
    counted nor listed. Items without words match nothing; rows that repeat an item's id add their windows to it. Rows that repeat a document id are answered one by one. Empty tables on either side are
    allowed. Jobs run when called: windows, matching shingles and occurrences are written.
    """
    needs(docs, id_col, text_col)
    needs(items, item_col, item_text_col)
    found = written(item_windows(items, window, size, item_col, item_text_col), "windows")
    windows = found.select("win", "span", "step", "hashes").distinct()
    vocabulary = written(windows.select("step", F.explode("hashes").alias("h")).distinct(), "shingles")
    steps = sorted(r["step"] for r in vocabulary.select("step").distinct().collect())  # at most ``size`` numbers

    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"), digest.alias("digest"))
    kinds = [F.struct(F.lit(s).alias("step"), _shingles("w", s).alias("hashes")) for s in steps]
    none = F.struct(F.lit(0).alias("step"), F.array(F.lit(0).cast("long")).alias("hashes"))  # the document's own row
    spread = split.select("row", "doc", F.size("w").alias("n_words"), "digest", F.explode(F.array(none, *kinds)).alias("k")).select(
        "row", "doc", "n_words", F.when(F.col("k.step") == 0, F.col("digest")).alias("digest"), "k.step", F.posexplode("k.hashes").alias("pos", "h")
    )
    spread = spread.withColumn("key", F.when(F.col("step") == 0, F.col("row")).otherwise(F.col("h")))
    known = vocabulary.select(F.col("h").alias("key"), F.col("step").alias("in_step"))
    matched = written(
        spread.join(known, (spread["key"] == known["key"]) & (F.col("step") == F.col("in_step")), "left")
        .where("step = 0 OR in_step IS NOT NULL")
        .select("row", "doc", "n_words", "digest", "step", F.col("pos"), "h"),
        "matched",
    )
    places = matched.where("step > 0").select("row", "n_words", "step", "pos", "h")

    rarity = places.groupBy("step", "h").agg(F.count("*").alias("held"))
    ordered = (
        windows.select("win", "span", "step", F.size("hashes").alias("parts"), F.posexplode("hashes").alias("offset", "h"))
        .join(rarity, ["step", "h"], "left")
        .groupBy("win", "span", "step", "parts")
        .agg(F.count("held").alias("present"), F.min(F.struct("held", "h", "offset")).alias("rarest"))
        .where("present = parts")
        .select("win", "span", "step", "parts", "rarest.h", "rarest.offset")
    )
    prefixes = written(ordered, "prefixes")
    candidates = (
        places.join(prefixes, ["step", "h"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0 AND start + span <= n_words")
        .select("row", "win", "span", "parts", "step", "start")
    )
    # Each expected shingle of a candidate place is looked up where it should be.
    wanted = candidates.join(windows.select("win", "hashes"), "win").select(
        "row", "win", "span", "parts", "step", "start", F.posexplode("hashes").alias("nth", "h")
    )
    wanted = wanted.withColumn("pos", F.col("start") + F.col("nth"))
    alike = written(
        wanted.join(places.select("row", "step", "pos", "h"), ["row", "step", "pos", "h"])
        .groupBy("row", "win", "span", "start", "parts")
        .agg(F.count("*").alias("there"))
        .where("there = parts")
        .select("row", "win", "span", "start")
        .join(matched.where("step = 0").select("row", "digest"), "row"),
        "occurrences",
    )
    # The words decide: each distinct text with such places is read once, whatever the number of its copies.
    claimed = alike.select("digest", "win", "span", "start").distinct()
    read = docs.select(digest.alias("digest"), text.alias("text")).join(claimed.select("digest").distinct(), "digest", "left_semi")
    said = read.groupBy("digest").agg(F.first("text").alias("text")).select("digest", words(F.col("text")).alias("w"))
    refuted = written(
        claimed.join(said, "digest")
        .where(F.array_join(F.slice("w", F.col("start") + 1, F.col("span")), " ") != F.col("win"))
        .select("digest", "win", "start"),
        "refuted",
    )
    occurring = alike if refuted.isEmpty() else alike.join(refuted, ["digest", "win", "start"], "left_anti")

    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurring.select("row", "start", (F.col("start") + F.col("span")).alias("stop")).distinct()
    hits = (
        spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    )
    of_items = (
        occurring.select("row", "win").distinct()
        .join(found.where("item IS NOT NULL").select("win", F.col("item").cast("string").alias("item")).distinct(), "win")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        matched.where("step = 0")
        .join(hits, "row", "left")
        .join(of_items, "row", "left")
        .select(
            F.col("doc").alias(id_col),
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item; all columns unchanged.

    Whether a text is contaminated depends on the text alone, so rows are told apart by a digest of it, not by their ids.
    """
    needs(docs, text_col)
    key = own_name(docs, "key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    found = decontaminate(keyed.select(key, text_col), items, id_col=key, text_col=text_col, **settings)
    bad = own_name(keyed, "bad")
    listed = written(found.where("contaminated").select(F.col(key).alias(bad)).distinct(), "contaminated")
    return keyed.join(listed, F.col(key) == F.col(bad), "left_anti").drop(key)


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS span, array_to_string(w[i:i + 9], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM wins),
places AS (SELECT doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') AS win
           FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM dw, spans WHERE len(w) >= span)),
occ AS (SELECT p.doc_id, p.i, p.span, v.item_id FROM places p JOIN wins v ON v.win = p.win AND v.span = p.span),
hits AS (SELECT doc_id, count(*) AS n_hit FROM
         (SELECT DISTINCT doc_id, unnest(range(i, i + span)) AS p FROM (SELECT DISTINCT doc_id, i, span FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
