"""Near-duplicate detection: a signature-coordinate inverted join.

A text's shingle set gets a MinHash signature of ``coordinates`` values. Documents are posted under their (coordinate,
value) pairs, and two documents that agree in at least ``matches`` coordinates are candidates; their full sets decide.

- Documents with equal sets are one class; only one of each class is posted.
- Prefix: with all pairs ordered from the rarest to the most frequent, two documents that agree in ``matches`` of
  ``coordinates`` pairs also share one of their ``coordinates - matches + 1`` rarest. Only those are joined, and a pair
  that a single document holds joins nothing. Frequent pairs, as very common words make them, stay out of the join.
- Skip: the other lists are never merged. The agreements of a pair found by prefix are counted on its two signatures.
- A list of many near copies is not expanded into all its pairs. First each member meets one hub of its list, the
  document that shares most with others (of copies of one text, the text itself). The confirmed links give components;
  pairs inside a component are not needed any more, since its documents are connected.
- Lists whose members are still apart follow. In a list of up to ``long_list`` members the pairs that are apart meet, each
  pair in one of its lists only, where sizes and signatures allow a link. Longer lists that share members form one
  cluster, which is cut into chunks; each pair of chunks is one task that compares the full sets by matrix products and
  puts out only the links that connect components. Pairs inside a cluster's largest component, connected already, are left
  out. No pair of a long list becomes a row.

With similarity 0.8, 64 coordinates and 36 matches, a pair exactly at the threshold is missed with a chance of about
five in a million, a pair at 0.85 with less than one in a thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import in_small_batches, load, needs, own_name, tidy
from larder.llm.components import components
from larder.llm.registered import query
from larder.llm.words import shingle_sets
from larder.session import written

_ROWS = 4096  # of a shingle-by-coordinate block
_CHUNK = 1000  # documents of a cluster compared with as many at a time
_CHUNK_VALUES = 1_000_000  # shingles of such a chunk
_SLAB = 4096  # columns of the matrices compared
_MARKS = (1 << 23) - 15  # marks of the bitmap that picks documents; a prime, a megabyte
_FULL = _MARKS // 4  # with more marks set the bitmap lets too many documents through, and ids are joined instead


def _multipliers(coordinates: int) -> np.ndarray:
    draw = np.random.default_rng(977).integers(0, 1 << 64, coordinates, dtype=np.uint64, endpoint=False)
    return draw | np.uint64(1)


def signature(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least upper half of value * multiplier, for every multiplier."""
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(values), _ROWS):
        block = values[i : i + _ROWS, None] * multipliers
        np.minimum(least, (block >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def _signatures(size: int, coordinates: int):
    multipliers = _multipliers(coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, marks = [], [], []
            for values in shingle_sets(batch.column("text").to_pylist(), size):
                counts.append(len(values))
                keys.append(blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                marks.append(signature(values, multipliers) if len(values) else None)
            flat = [m.view(np.int32) for m in marks if m is not None]
            lengths = np.array([0 if m is None else coordinates for m in marks], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()),
                        pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)),
                    ),
                ],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )

    return run


def _sets(size: int, marked: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marked is None else np.unpackbits(marked, bitorder="little")
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if bits is not None:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                batch = batch.filter(pa.array(bits[ids % _MARKS].astype(bool)))
            found = list(shingle_sets(batch.column("text").to_pylist(), size))
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in found]))).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["node", "members"])

    return run


def _agreements(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def _sizes_allow(percent: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent)


def _prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(node, weight, prefix): the pairs of each class's prefix that others hold too; weight counts how often others hold
    any of its pairs."""
    posted = classes.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node",
        F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair"),
    )
    held = posted.groupBy("pair").agg(F.count("*").alias("held")).where("held > 1")
    alone = F.lit(coordinates) - F.size("shared")  # pairs nobody else holds are the rarest of all
    room = F.greatest(F.lit(coordinates - matches + 1) - alone, F.lit(0))
    return (
        posted.join(held, "pair")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("held", "pair"))).alias("shared"))
        .select(
            "node",
            F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["held"]).alias("weight"),
            F.transform(F.slice("shared", F.lit(1), room), lambda x: x["pair"]).alias("prefix"),
        )
        .where("size(prefix) > 0")
    )


def _sets_of(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, members): full shingle sets of the documents that ``nodes`` (doc_id) names, and of a few others.

    The ids are marked in a bitmap of fixed size (``_MARKS`` bits) that goes to the tasks, so texts are filtered where they are
    read and never shuffled. Where two ids share a mark the other document's set is made, too; the joins drop it. Once more
    than ``_FULL`` marks are set, that would be most documents: then the ids are joined, and only texts they name are shuffled.
    """
    mark = F.pmod(F.col("doc_id"), F.lit(_MARKS)) + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(mark).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits")
    )
    marked = np.zeros(_MARKS // 8 + 4096, dtype=np.uint8)
    for bucket, bits in parts.collect():  # at most _MARKS / 32768 rows of 4 KB
        marked[(bucket - 1) * 4096 : bucket * 4096] |= np.frombuffer(bits, dtype=np.uint8)
    if np.unpackbits(marked).sum(dtype=np.int64) > _FULL:
        docs, marked = docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"), None
    return in_small_batches(docs).mapInArrow(tidy(_sets(size, marked)), "node long, members array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose full shingle sets reach the similarity."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = written(_sets_of(wanted, docs, size), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over slabs of shared values."""
    values, counts = np.unique(np.concatenate([*left, *right]), return_counts=True)
    shared = values[counts > 1]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, len(shared), _SLAB):
        slab = shared[begin : begin + _SLAB]

        def matrix(sets: list[np.ndarray]) -> np.ndarray:
            filled = np.zeros((len(sets), len(slab)), dtype=np.float32)
            for i, s in enumerate(sets):
                part = s[np.searchsorted(s, slab[0]) : np.searchsorted(s, slab[-1], side="right")]
                at = np.searchsorted(slab, part)
                filled[i, at[slab[at] == part]] = 1
            return filled

        total += matrix(left) @ matrix(right).T
    return total


def connecting_links(nodes: list[int], groups: list[int], sets: list[np.ndarray], percent: int, cut: int) -> list[tuple[int, int]]:
    """Links between sets[:cut] and sets[cut:] (or among all, if cut is 0) that connect different ``groups``; of links that
    connect what is already connected none but the first is given."""
    left, right = (sets, sets) if not cut else (sets[:cut], sets[cut:])
    common = _common(left, right).astype(np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    n_left, n_right = (sizes, sizes) if not cut else (sizes[:cut], sizes[cut:])
    rows, columns = np.nonzero((common * 100 >= (n_left[:, None] + n_right[None, :] - common) * percent) & (common > 0))
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x]
        return x

    found = []
    for i, j in zip(rows.tolist(), (columns + cut).tolist()):
        a, b = root(groups[i]), root(groups[j])
        if a != b:
            above[max(a, b)] = min(a, b)
            found.append((nodes[i], nodes[j]))
    return found


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` (node, cluster, component, n) with chunk and others, the chunks that a member's chunk is compared with.

    The largest component of a cluster is connected already: its chunks (of about ``_CHUNK`` documents, fewer if their sets are
    large) meet those of the other members only, which have the lowest numbers and meet all chunks.
    """
    held = members.groupBy("cluster", "component").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    sums = held.groupBy("cluster").agg(
        F.max(F.struct("count", "component", "total")).alias("main"), F.sum("count").alias("count"), F.sum("total").alias("total")
    )

    def chunks(count: Column, total: Column) -> Column:
        return F.ceil(F.greatest(count / _CHUNK, total / _CHUNK_VALUES)).cast("int")

    plan = sums.select(
        "cluster",
        F.col("main.component").alias("largest"),
        chunks(F.col("main.count"), F.col("main.total")).alias("main"),
        chunks(F.col("count") - F.col("main.count"), F.col("total") - F.col("main.total")).alias("rest"),
    )
    connected = F.col("component") == F.col("largest")
    some = F.pmod(F.xxhash64("node"), F.when(connected, F.col("main")).otherwise(F.col("rest"))).cast("int")
    last = F.when(connected, F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1
    return (
        members.join(plan, "cluster")
        .where("rest > 0")
        .select("cluster", "node", "component", (some + F.when(connected, F.col("rest")).otherwise(0)).alias("chunk"), F.sequence(F.lit(0), last).alias("others"))
    )


def _cluster_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): connecting links inside each cluster of ``members`` (node, cluster, component, n); a task gets two chunks."""
    sets = _sets_of(members.select(F.col("node").alias("doc_id")), docs, size)
    blocks = (
        _chunked(members).join(sets, "node")
        .withColumn("other", F.explode("others"))
        .withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
        .select("cluster", "low", "high", "chunk", "node", "component", "members")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("node", "ascending")])
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        cut = 0 if low == high else sum(c == low for c in table.column("chunk").to_pylist())
        links = []
        if low == high or 0 < cut < table.num_rows:
            # Unsigned 64-bit values travel as signed ones; each set is sorted again as signed.
            sets = [np.sort(np.asarray(m.values)) for m in table.column("members")]
            links = connecting_links(table.column("node").to_pylist(), table.column("component").to_pylist(), sets, percent, cut)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return blocks.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def _stars(reached: DataFrame) -> DataFrame:
    """The links that (node, component) stands for: one a node, instead of all that were confirmed."""
    return reached.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    coordinates: int = 64,
    matches: int = 36,
    long_list: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two; component_id is the least id
    that can be reached over links. Texts without words, empty and null ones, have no shingles and no links. Rows without an
    id take no part: their component_id is null and they are kept. Rows that repeat an id are one document, linked
    to whatever any of its texts is linked to; each is reported. An empty table gives an empty table. Runs jobs.
    """
    needs(docs, id_col, text_col)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(
        in_small_batches(given).mapInArrow(
            tidy(_signatures(size, coordinates)), "doc_id long, n_shingles long, set_key binary, sig array<int>"
        ),
        "signatures",
    )
    classes = written(
        marked.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "classes",
    )
    of_rows = marked.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "node"), "set_key", "left")
    rows = written(of_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "rows")
    several = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top")
    same_id = rows.join(several.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")
    prefixes = written(_prefixes(classes, coordinates, matches), "prefixes")
    postings = prefixes.select("node", "weight", F.explode("prefix").alias("pair"))

    signed = classes.select("node", "n", "sig")
    left = signed.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = signed.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    alike = _sizes_allow(percent) & (_agreements("sig_a", "sig_b") >= matches)

    hubs = postings.groupBy("pair").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("hub"))
    met = (
        postings.join(hubs.select("pair", (-F.col("hub.least")).alias("b")), "pair")
        .where("node <> b")
        .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
        .distinct()
    )
    first = written(met.join(left, "a").join(right, "b").where(alike).select("a", "b"), "pairs")
    reached = components(_confirmed(first, given, size, percent).union(same_id))

    # What is left: members of one list that are still apart.
    now = prefixes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    listed = now.select("node", "component", F.explode("prefix").alias("pair"))
    mixed = written(
        listed.groupBy("pair")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("head"), F.count("*").alias("members"))
        .where("low <> high")
        .select("pair", "head", (F.col("members") > long_list).alias("is_long")),
        "mixed",
    )
    short = listed.join(mixed.where("NOT is_long").select("pair"), "pair").join(signed, "node").join(prefixes.select("node", "prefix"), "node")
    one, other = (
        short.select(
            "pair", *[F.col(c).alias(f"{c}_{x}") for c in ("component", "n", "sig", "prefix")], F.col("node").alias(x)
        )
        for x in "ab"
    )
    once = F.array_min(F.array_intersect("prefix_a", "prefix_b")) == F.col("pair")
    apart = written(
        one.join(other, "pair").where("component_a > component_b").where(_sizes_allow(percent)).where(once).where(alike).select("a", "b"),
        "apart",
    )
    if not apart.isEmpty():
        reached = components(_confirmed(apart, given, size, percent).union(_stars(reached)))

    long = mixed.where("is_long").select("pair", "head")
    if not long.isEmpty():
        within = listed.select("node", "pair").join(long, "pair")
        clusters = components(within.select(F.col("node").alias("a"), F.col("head").alias("b")))
        members = (
            clusters.select("node", F.col("component").alias("cluster"))
            .join(reached, "node", "left")
            .withColumn("component", F.coalesce("component", "node"))
            .join(signed.select("node", "n"), "node")
        )
        reached = components(_cluster_links(written(members, "clusters"), given, size, percent).union(_stars(reached)))
    return (
        rows.join(reached, "node", "left")
        .withColumn("component", F.coalesce("component", "node", "doc_id"))
        .select(
            F.col("doc_id").alias(id_col),
            "n_shingles",
            F.col("component").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each group of near copies; all columns unchanged, rows without an id stay."""
    gone = own_name(docs, "gone")
    listed = near_duplicates(docs, id_col=id_col, **settings).where("NOT kept").select(F.col(id_col).alias(gone)).distinct()
    return docs.join(written(listed, "gone"), F.col(id_col).cast("long") == F.col(gone), "left_anti")


# Exact pairs by a prefix filter on the words themselves, then every reachable document.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
rare AS (SELECT h, count(*) AS held FROM e GROUP BY h),
prefixes AS (SELECT doc_id, h, n FROM (SELECT doc_id, e.h, n, row_number() OVER (PARTITION BY doc_id ORDER BY held, e.h) AS place FROM e JOIN rare ON e.h = rare.h)
             WHERE place <= n - (80 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefixes a JOIN prefixes b ON a.h = b.h AND a.doc_id < b.doc_id
        WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common AS (SELECT a, b, na, nb, count(*) AS c FROM met JOIN e x ON x.doc_id = a JOIN e y ON y.doc_id = b AND y.h = x.h GROUP BY a, b, na, nb),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least_id ON s.doc_id = least_id.doc_id
"""


@query("op4_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=2)
