import hashlib
import random

from larder.llm.exact_dedup import CuckooIndex, change_index, digest_groups, drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, digest string, keep_id string, Bucket int"


def _digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_inserts_finds_deletes_and_resizes():
    index = CuckooIndex(cells=2)
    for i in range(5000):
        index.fold(_digest(i), i, 1)
    assert index.resized and len(index) == 5000
    assert all(index.find(_digest(i)) >= 0 for i in range(5000))
    assert all(index.find(_digest(i)) < 0 for i in range(5000, 9000))
    assert all(index.delete(_digest(i)) for i in range(0, 5000, 2)) and not index.delete(_digest(0))
    assert len(index) == 2500 and index.find(_digest(0)) < 0 and index.find(_digest(1)) >= 0
    for i in range(5000, 9000):
        index.fold(_digest(i), i, 1)
    assert len(index) == 6500 and index.entries().num_rows == 6500


def test_fingerprint_hit_with_other_content_is_no_hit():
    index = CuckooIndex(cells=1)
    one, other = b"\x07" * 8 + b"a" * 24, b"\x07" * 8 + b"b" * 24  # same cell, same fingerprint
    index.insert(one, 1, 1)
    assert index.find(other) < 0
    index.fold(other, 2, 1)
    assert index.ids[index.find(one)] == 1 and index.ids[index.find(other)] == 2


def test_rows_of_every_kind(spark):
    rows = [
        (1, "a", "x", "y", 1), (2, "a", None, None, None), (3, None, "x", "y", 1), (4, "", "x", "y", 1),
        (None, "a", "x", "y", 1), (None, "only", "x", "y", 1), (5, "A", "x", "y", 1), (2, "a", "again", "y", 2),
        (6, "long " * 200_000, "x", "y", 1), (2**60 + 1, "big", "x", "y", 1), (2**60, "big", "x", "y", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.text_sha256): r for r in exact_duplicates(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(exact_duplicates(docs).collect()) == len(rows)
    assert got[1, sha("a")].keep_id == 2 and got[1, sha("a")].group_size == 4 and not got[1, sha("a")].kept
    assert got[2, sha("a")].kept and not got[None, sha("a")].kept
    assert got[3, sha("")].keep_id == 4 and got[4, sha("")].kept
    assert got[None, sha("only")].keep_id is None and got[None, sha("only")].kept
    assert got[2**60, sha("big")].keep_id == 2**60 + 1
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 4, None, 5, 6, 2**60 + 1]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0


def test_small_buckets_and_a_hot_text(spark):
    draw = random.Random(3)
    rows = [(i, "hot" if draw.random() < 0.4 else f"t{draw.randrange(900)}") for i in range(3000)]
    digests = spark.createDataFrame([(i, _digest(t)) for i, t in rows], "doc_id long, digest binary").repartition(5)
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in digest_groups(digests, digests_per_bucket=50).collect()}
    want = {}
    for i, t in rows:
        keep, n = want.get(_digest(t), (-1, 0))
        want[_digest(t)] = (max(keep, i), n + 1)
    assert got == want


def test_index_changes(spark):
    entry = "digest binary, keep_id long, group_size long"
    index = spark.createDataFrame([(_digest(0), 9, 2), (_digest(1), 5, 1), (_digest(2), 4, 1)], entry)
    changes = [(_digest(0), 3, False), (_digest(1), 5, False), (_digest(2), 8, True), (_digest(3), 1, True), (_digest(4), 1, False)]
    changed = change_index(index, spark.createDataFrame(changes, "digest binary, doc_id long, added boolean"), 3)
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in changed.collect()}
    assert got == {_digest(0): (9, 1), _digest(2): (8, 2), _digest(3): (1, 1)}
