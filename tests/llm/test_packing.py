import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm.packing import _Chunks, cuts_of, difference, op11, pack, pack_documents, pieces, sequences, windows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def _library():
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 2]


def _check(rows, texts, capacity=4096, piece_tokens=1024):
    """Brute force: every id of every text in exactly one piece, sequences gapless and not too long. Gives the padding share."""
    encode = _library()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    want = sorted(
        ((d, at, min(piece_tokens if at >= len(ids) // capacity * capacity else capacity, len(ids) - at), len(ids)) for d, ids in ((d, encode(t)) for d, t in texts)
         for at in cuts_of(len(ids), capacity, piece_tokens)), key=repr)
    assert sorted(((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows), key=repr) == want
    known = {}
    for d, t in texts:
        known.setdefault(d, []).append(np.array(encode(t), dtype="<u4"))
    for d, own in of_doc.items():
        made = sorted((r.start, r.ids_crc32) for r in own)
        assert made == sorted((r.start, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for ids in known[d] for r in own if len(ids) == r.doc_tokens) or len(known[d]) > 1
    filled = 0
    for own in of_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist()
        filled += sum(r.length for r in own)
        assert sum(r.length for r in own) <= capacity
    return 1 - filled / (capacity * len(of_sequence))


def test_differencing_is_near_equal():
    draw = np.random.default_rng(1)
    for n, k in ((1, 3), (2, 1), (5, 5), (40, 4), (300, 17)):
        sizes = draw.integers(1, 1000, n)
        totals, place = difference(sizes, k)
        assert sorted(np.bincount(place, sizes, k).astype(int).tolist(), reverse=True) == totals.tolist()
        if n >= 8 * k:
            assert totals[0] - totals[-1] <= 0.02 * totals[0]
    assert difference(np.array([8, 7, 6, 5, 4]), 2)[0].tolist() == [16, 14]  # the known example of this method


def test_differencing_against_every_partition():
    draw = np.random.default_rng(2)
    for _ in range(20):
        sizes = draw.integers(1, 50, 7)
        best = min(max(np.bincount(p, sizes, 3)) for p in product(range(3), repeat=7))
        assert best <= difference(sizes, 3)[0][0] <= 1.34 * best


def test_windows_rise_until_all_fits():
    draw = np.random.default_rng(3)
    for sizes in ([], [10], [6, 6, 6], [10] * 7, [4, 4, 4], draw.integers(1, 11, 500), draw.integers(6, 11, 60), [1] * 95):
        sizes = np.array(sizes, dtype=np.int64)
        place = windows_of(sizes, 10)
        held = np.bincount(place, sizes) if len(sizes) else np.zeros(0)
        assert (held <= 10).all() and (held > 0).all()
    assert windows_of(np.array([6, 6, 6]), 10).max() == 2 and windows_of(np.array([4, 4, 4]), 12).max() == 0


def test_ids_are_those_of_the_library():
    draw, encode = random.Random(4), _library()
    parts = ["don't", "I'LL", "''s", "('s", "'", "s", "ve", ".", "#$", " ", "\n", "\x0b", "\x85", "\xa0", "\x1c", "12", "a1", "É", "J̌", "T̈", "İ", "ΣΑΣ", "漢", "ﬁ", "≠", "<|endoftext|>", "x_y", "́", "\x00", "Zz" * 40]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(1500)]
    chunks = _Chunks(PATH)
    for group in (texts[:700], texts[700:], [""], ["", "a", ""], ["x" * 3000 + " y" * 3000]):
        assert [[*ids.tolist(), 2] for ids in chunks.ids([t.encode() for t in group])] == [encode(t) for t in group]


def test_rows_of_every_kind(spark):
    draw = random.Random(6)
    words = "the pack of Wörds 漢字 it's 42 runs, on and on".split()
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(900)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, " \n"), (None, "no id"), (1003, "the " * 30_000), (1004, "x " * 4095), (1005, "x " * 8191), (2**60, "big")]
    rows = [(*t, "clash", None, 5) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id string, `Length` int")
    got = pack_documents(docs, PATH)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    got = got.selectExpr("*", "crc32(ids) AS ids_crc32")
    assert _check(got.collect(), texts) < 0.02
    whole = sequences(got).collect()
    assert all(len(r.ids) == 4 * r.padded and (r.padded == 4096 or r.padded == r.length) for r in whole)
    ids = {r.sequence_id: r.ids for r in whole}
    assert all(bytes(r.ids) == bytes(ids[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) for r in got.collect())


def test_a_third_of_the_rows_with_one_id(spark):
    texts = [(7, "all the same words here")] * 400 + [(i, f"text {i}") for i in range(100, 900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    slim = pieces(docs, PATH).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens")
    got = pack(slim, group_tokens=512)
    assert got.count() == len(texts) and got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
    _check(got.collect(), texts)


def test_empty_table_and_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="length"):
        pack(empty)
    with pytest.raises(Exception, match="1 to 4096"):
        pack(spark.createDataFrame([(5000,)], "length long")).count()


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _check(op11(spark, sf).collect(), texts) < 0.01
