"""Filter interaction audit over failing-id relations.

Each filter has one table of the ids of the records that fail it. What a filter removes after others depends only on which
others came before, not on their order, so the prefixes of all orders are subsets of the filters:

- the survivors of a subset are the records left-anti joined with the id table of each filter in it;
- what a filter removes after a subset is the records left-semi joined with its own id table, then left-anti joined with
  the tables of the subset;
- what it would have removed but finds gone is the rest of its own table; its unique fails are what it removes after all others.

A record stands once per subset while it is joined, and an anti join applies to the subsets that contain its filter. So each
id table is joined once for survivors and once for removals, whatever the number of subsets. Ids are row numbers: records and
tables are dealt evenly by them, and no id, source or text that fills a third of the rows makes a hot key. Counts per part,
subset and filter are combined before they are shuffled; all orders are spelled out from these few rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import load, needs, text_or_empty
from larder.llm.registered import query
from larder.session import written

MOST_FILTERS = 7  # 5040 orders
HOT_GROUPS = 1000  # groups of equal texts that may be broadcast: those with more than a thousandth of all rows


def copies_of_smaller(facts: DataFrame, digest: str = "digest", id_col: str = "id", row: str = "row") -> DataFrame:
    """(row) of the rows whose digest a row with a smaller id has too. Null ids are neither smaller nor larger.

    Groups that hold more than a thousandth of all rows are fewer than a thousand: they are broadcast. The rest is
    joined by shuffles in which no key is hot.
    """
    slim = facts.select(row, F.col(id_col).alias("id"), F.col(digest).alias("digest"))
    groups = written(
        slim.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most"),
        "groups",
    )
    total = slim.count()
    hot = F.broadcast(groups.where(F.col("n") * HOT_GROUPS > total).select("digest", "least"))
    cold = groups.where(F.col("n") * HOT_GROUPS <= total).select("digest", "least")
    in_hot = slim.join(hot, "digest")
    elsewhere = slim.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest")
    return in_hot.unionByName(elsewhere).where("id > least").select(row)


def _mask(names: list[str]) -> dict[str, int]:
    return {name: 1 << i for i, name in enumerate(names)}


def _anti_each(rows: DataFrame, failing: dict[str, DataFrame], row: str) -> DataFrame:
    """``rows`` without those whose subset holds a filter that they fail."""
    for name, bit in _mask(list(failing)).items():
        gone = failing[name].select(F.col(row).alias("gone"))
        rows = rows.join(gone, (F.col(row) == F.col("gone")) & (F.col("subset").bitwiseAND(F.lit(bit)) != 0), "left_anti")
    return rows


def interactions(records: DataFrame, failing: dict[str, DataFrame], part: str = "part", losses: tuple[str, ...] = (), row: str = "row") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``records`` has a unique ``row`` (not null), a ``part`` and, for each name in ``losses``, a boolean column; ``failing`` has a table
    with the rows that fail it for each filter, without repeats. Columns: part, filter_order (names one after another), step (from
    1), kept (records after the step), removed (in it), redundant (failing, removed earlier), unique_fails (failing no other filter),
    <loss>_lost for each loss, shapley (the filter's removed, summed over all orders). Null losses count as false; a null part is a part.
    No records give no rows; a filter that nothing fails removes 0.
    """
    names = list(failing)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    bits, everything = _mask(names), (1 << len(names)) - 1
    slim = records.select(F.col(row).alias("row"), F.col(part).alias("part"), *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(f"loss{i}") for i, c in enumerate(losses)])
    failing = {name: table.select(F.col(row).alias("row")) for name, table in failing.items()}

    subsets = F.explode(F.lit(list(range(everything + 1)))).alias("subset")
    survivors = _anti_each(slim.repartition("row").select("row", "part", subsets), failing, "row").groupBy("part", "subset").agg(F.count("*").alias("kept"))

    failed = reduce(
        DataFrame.unionByName, [slim.join(failing[n], "row", "left_semi").withColumn("bit", F.lit(bits[n])) for n in names]
    )
    others = F.filter(F.lit(list(range(everything + 1))), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    lost = [F.sum(f"loss{i}").alias(f"lost{i}") for i in range(len(losses))]
    removed = (
        _anti_each(failed.repartition("row").select("*", F.explode(others).alias("subset")), failing, "row")
        .groupBy("part", "bit", "subset")
        .agg(F.count("*").alias("removed"), *lost)
    )
    kept, removed = written(survivors, "survivors"), written(removed, "removals")

    # From here on there are at most a few dozen rows per part.
    parts = slim.groupBy("part").agg(F.count("*").alias("records"))
    size = F.bit_count("subset")
    weights = [math.factorial(k) * math.factorial(len(names) - 1 - k) for k in range(len(names))]
    of_filter = removed.groupBy("part", "bit").agg(
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(F.col("subset") == F.lit(everything) - F.col("bit"), F.col("removed"))).alias("alone"),
        F.sum(F.col("removed") * F.element_at(F.lit(weights), size.cast("int") + 1)).alias("shapley"),
    )
    steps = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, bits[name], before))
            before |= bits[name]
    fields = ("filter_order", "step", "bit", "subset")
    spelled = F.arrays_zip(*[F.lit([s[i] for s in steps]).alias(f) for i, f in enumerate(fields)])
    grid = parts.select("part", F.explode(spelled).alias("s")).select("part", *[F.col(f"s.{f}").alias(f) for f in fields])

    def beside(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        renamed = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        return left.join(renamed, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]), "left").drop(
            *[f"right_{k}" for k in keys]
        )

    after = kept.withColumnRenamed("subset", "after")
    table = beside(grid.withColumn("after", F.col("subset").bitwiseOR(F.col("bit"))), after, "part", "after")
    table = beside(beside(table, removed, "part", "bit", "subset"), of_filter, "part", "bit")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return table.select(
        F.col("part").alias(part),
        "filter_order",
        F.col("step").cast("int").alias("step"),
        number("kept").alias("kept"),
        number("removed").alias("removed"),
        (number("failing") - number("removed")).alias("redundant"),
        number("alone").alias("unique_fails"),
        *[number(f"lost{i}").alias(f"{c}_lost") for i, c in enumerate(losses)],
        number("shapley").alias("shapley"),
    )


_BLANKS = r"[\x20\x09-\x0D]+"


def document_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A few words, B few distinct words, C many capitals, D marks of tables and code."""
    words = F.array_remove(F.split(text, _BLANKS, -1), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of filters A to D and E (a copy of a smaller id's text) over ``docs``, per value of ``part_col``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. ``labels`` has
    doc_id, quality and toxic; a document counts as good or toxic if any of its label rows says 1, and as neither without one. Null texts
    are empty and a null part is the empty string. A row with a null id is a record like any other, is no copy and has no
    labels. Rows that repeat an id are records of their own. Other columns are not read. No documents give no rows. Jobs
    run when called: facts and one id table per filter are written.
    """
    needs(docs, id_col, text_col, part_col)
    needs(labels, "doc_id", "quality", "toxic")
    text = text_or_empty(f"`{text_col}`")
    given = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    tests = document_filters(F.col("text"))
    facts = written(
        given.select(
            F.monotonically_increasing_id().alias("row"), "id", "part",
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[fails.alias(f"fails_{n}") for n, fails in tests.items()]
        ),
        "facts",
    )
    failing = {n: written(facts.where(f"fails_{n}").select("row"), f"failing_{n}") for n in tests}
    failing["E"] = written(copies_of_smaller(facts), "failing_E")
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = facts.where("id IS NOT NULL").select("row", "id", "part")
    labelled = known.join(told.where("good OR toxic"), known["id"] == told["doc_id"], "left").select("row", "part", "good", "toxic")
    without = facts.where("id IS NULL").select("row", "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return interactions(written(labelled.unionByName(without), "records"), failing, "part", ("good", "toxic"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least_id AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(told.good, 0) AS good, coalesce(told.toxic, 0) AS toxic,
             (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
           + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
           + (CASE WHEN 100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) THEN 4 ELSE 0 END)
           + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
           + (CASE WHEN w.doc_id > least_id.least THEN 16 ELSE 0 END) AS fails
      FROM w JOIN least_id ON w.t = least_id.t LEFT JOIN told ON w.doc_id = told.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
                 list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS b
          FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(own AS BIGINT) AS own, CAST(coalesce(b, 0) AS BIGINT) AS before FROM steps),
r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails & before <> 0 AND fails & own <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM counted, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
