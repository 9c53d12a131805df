"""Exact deduplication through a cuckoo-filter index of live digests.

The index of one bucket of digests is a cuckoo table: two candidate cells per digest, four slots a cell, 16-bit
fingerprints, and for each slot the place of its entry in the bucket's stored content (the full digests). A lookup
compares fingerprints first; a fingerprint hit counts only after the stored digest itself agrees. Entries can be
deleted, and a table that overflows is rebuilt at twice the size from the stored digests.

Over a corpus the index runs twice. Every task first folds its own rows into an index of bounded size and passes on one
row per digest it has seen, so a text that fills a third of the corpus leaves each task once. These partial rows are
dealt into buckets by digest, and each bucket, read in order, is folded the same way. Memory is bounded by a
bucket's share, which is fixed by ``digests_per_bucket`` at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import load, needs, own_name, text_or_empty
from larder.llm.registered import query
from larder.session import written

SLOTS = 4
MAX_KICKS = 200
_MIX = 0x5BD1E995


class CuckooIndex:
    """Live digests of one bucket with a value each: insert, find, delete; exact, since hits are verified."""

    def __init__(self, cells: int = 64):
        self._allot(cells)
        self.digests: list[bytes | None] = []
        self.ids: list = []
        self.counts: list[int] = []
        self._free: list[int] = []
        self.resized = 0

    def _allot(self, cells: int) -> None:
        self._mask = cells - 1
        self._prints = [0] * (cells * SLOTS)
        self._places = [0] * (cells * SLOTS)

    def __len__(self) -> int:
        return len(self.digests) - len(self._free)

    def _cells(self, digest: bytes) -> tuple[int, int, int]:
        head = int.from_bytes(digest[:8], "little")
        mark = (head >> 48) or 1
        first = head & self._mask
        return mark, first, first ^ (mark * _MIX & self._mask)

    def _slot(self, digest: bytes) -> int:
        """The slot whose stored digest is ``digest``, or -1."""
        mark, first, second = self._cells(digest)
        prints, places, digests = self._prints, self._places, self.digests
        for cell in (first, second):
            base = cell * SLOTS
            for s in range(base, base + SLOTS):
                if prints[s] == mark and digests[places[s]] == digest:
                    return s
        return -1

    def find(self, digest: bytes) -> int:
        """The entry's place in the stored content, or -1."""
        slot = self._slot(digest)
        return -1 if slot < 0 else self._places[slot]

    def insert(self, digest: bytes, doc_id, count: int) -> None:
        """A digest that is not in the index."""
        if self._free:
            place = self._free.pop()
            self.digests[place], self.ids[place], self.counts[place] = digest, doc_id, count
        else:
            place = len(self.digests)
            self.digests.append(digest)
            self.ids.append(doc_id)
            self.counts.append(count)
        if not self._put(digest, place):
            self._resize()

    def _put(self, digest: bytes, place: int) -> bool:
        mark, first, second = self._cells(digest)
        prints, places = self._prints, self._places
        for cell in (first, second):
            base = cell * SLOTS
            for s in range(base, base + SLOTS):
                if not prints[s]:
                    prints[s], places[s] = mark, place
                    return True
        cell = second
        for kick in range(MAX_KICKS):
            s = cell * SLOTS + (kick + place) % SLOTS
            prints[s], mark = mark, prints[s]
            places[s], place = place, places[s]
            cell ^= mark * _MIX & self._mask
            base = cell * SLOTS
            for s in range(base, base + SLOTS):
                if not prints[s]:
                    prints[s], places[s] = mark, place
                    return True
        return False

    def _resize(self) -> None:
        """Rebuild at twice the size from the stored digests until each has a slot."""
        cells = self._mask + 1
        while True:
            cells *= 2
            self._allot(cells)
            self.resized += 1
            dead = set(self._free)
            if all(self._put(d, p) for p, d in enumerate(self.digests) if p not in dead):
                return

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        place = self._places[slot]
        self._prints[slot] = 0
        self.digests[place] = None
        self._free.append(place)
        return True

    def fold(self, digest: bytes, doc_id, count: int) -> None:
        """Count a digest; the larger id stays (a missing id is below all others)."""
        place = self.find(digest)
        if place < 0:
            self.insert(digest, doc_id, count)
            return
        self.counts[place] += count
        if doc_id is not None and (self.ids[place] is None or doc_id > self.ids[place]):
            self.ids[place] = doc_id

    def entries(self) -> pa.RecordBatch:
        live = [p for p, d in enumerate(self.digests) if d is not None]
        columns = ((self.digests, pa.binary()), (self.ids, pa.int64()), (self.counts, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([c[p] for p in live], k) for c, k in columns], names=_NAMES)


_NAMES = ["digest", "keep_id", "group_size"]
_ENTRY = "digest binary, keep_id long, group_size long"


def _rows(batch: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _fold_tasks(limit: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id in _rows(batch, "digest", "doc_id"):
                index.fold(digest, doc_id, 1)
                if len(index) >= limit:
                    yield index.entries()
                    index = CuckooIndex()
        yield index.entries()

    return fold


def _fold_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: one bucket's index is held at a time."""
    index, current = CuckooIndex(), None
    for batch in batches:
        for bucket, digest, doc_id, count in _rows(batch, "bucket", *_NAMES):
            if bucket != current:
                if len(index):
                    yield index.entries()
                index, current = CuckooIndex(), bucket
            index.fold(digest, doc_id, count)
    yield index.entries()


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def digest_groups(digests: DataFrame, digests_per_bucket: int = 50_000) -> DataFrame:
    """(digest, keep_id, group_size): one row per distinct digest of ``digests`` (digest binary, doc_id long).

    keep_id is the largest id of the group (null if no row has one). Runs one job that writes the per-task folds.
    """
    partial = written(digests.select("digest", "doc_id").mapInArrow(_fold_tasks(digests_per_bucket), _ENTRY), "folds")
    buckets = 1 + partial.count() // digests_per_bucket
    return (
        partial.withColumn("bucket", _bucket(buckets))
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_fold_buckets, _ENTRY)
    )


def change_index(index: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """The index table (digest, keep_id, group_size) after ``changes`` (digest, doc_id, added boolean).

    Added rows count up their digest, removed rows (added false) count it down; a digest whose last row goes is deleted
    from the live index. Removing the row that stays needs the group's other ids, which the index does not hold: its
    keep_id turns null and the caller folds that group again. Removals of digests that are not live change nothing.
    """

    def apply(old: pa.Table, new: pa.Table) -> pa.Table:
        live = CuckooIndex()
        for digest, keep, count in _rows(old, *_NAMES):
            live.insert(digest, keep, count)
        for digest, doc_id, added in _rows(new, "digest", "doc_id", "added"):
            if added:
                live.fold(digest, doc_id, 1)
                continue
            place = live.find(digest)
            if place < 0:
                continue
            live.counts[place] -= 1
            if live.counts[place] == 0:
                live.delete(digest)
            elif live.ids[place] == doc_id:
                live.ids[place] = None
        return pa.Table.from_batches([live.entries()])

    with_bucket = lambda df: df.withColumn("bucket", _bucket(buckets))
    return (
        with_bucket(index.select("digest", "keep_id", "group_size"))
        .groupBy("bucket")
        .cogroup(with_bucket(changes.select("digest", "doc_id", "added")).groupBy("bucket"))
        .applyInArrow(apply, _ENTRY)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical; a null text counts as empty. The row with the largest id stays; a null id is below
    all others, and a group without any id keeps its rows. Rows that repeat id and text are the same document: each
    is counted in group_size and each says kept. An empty table gives an empty table. Other columns are not read.
    """
    needs(docs, id_col, text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"),
    )
    groups = written(digest_groups(rows), "groups")
    # A hot digest's rows meet one group row; the adaptive skew join splits them.
    return rows.join(groups, "digest").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, one for each distinct text (null counts as empty).

    The join runs on text and id together, so copies of a hot text are spread over the tasks by their ids. Of rows that
    repeat both, one stays.
    """
    needs(docs, id_col, text_col)
    digest, keep = own_name(docs, "digest"), own_name(docs, "keep")
    full = docs.withColumn(digest, F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    rows = full.select(F.col(digest).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
    groups = digest_groups(rows).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    groups = written(groups, "groups")
    stays = full.join(
        groups.withColumnRenamed(digest, f"{digest}_g"),
        (F.col(digest) == F.col(f"{digest}_g")) & F.col(id_col).cast("long").eqNullSafe(F.col(keep)),
    )
    return stays.dropDuplicates([digest, keep]).select(*[F.col(f"`{c}`") for c in docs.columns])


OP6_SQL = """
SELECT d.doc_id, max(d.doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       d.doc_id = max(d.doc_id) OVER same AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
WINDOW same AS (PARTITION BY coalesce(d.text, ''))
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))
