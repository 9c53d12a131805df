import hashlib
import random
import re

import pytest

from larder.llm import decontamination
from larder.llm.decontamination import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return WORD.findall((text or "").translate(UPPER))


def _brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for item, item_text in items:
            w = _words(item_text)
            if not w:
                continue
            span = min(window, len(w))
            wanted = {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
            for i in range(len(words) - span + 1):
                if tuple(words[i : i + span]) in wanted:
                    hit.update(range(i, i + span))
                    found.update([] if item is None else [str(item)])
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, size", [(10, 5), (4, 2), (3, 5)])
def test_against_brute_force(spark, window, size):
    draw = random.Random(window)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 10
    items = [(i % 13, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 7, 12, 25])))) for i in range(30)]
    docs = []
    for i in range(120):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(60))]
        if i % 3 == 0:
            own = _words(draw.choice(items)[1])
            at = draw.randrange(len(words) + 1)
            words[at:at] = own[draw.randrange(len(own)) :] if i % 2 else own
        docs.append((i, " ".join(words)))
    got = decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        window=window,
        size=size,
    )
    assert _rows(got) == _brute(docs, items, window)


def test_rows_of_every_kind(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, f"x {passage.upper()} y", 0, "a"), (1, "nothing here", 0, "a"), (1, f"x {passage.upper()} y", 0, "a"), (None, passage, None, None), (2, None, 0, "a"),
        (3, "", 0, "a"), (4, "tiny", 0, "a"), (5, "filler " * 60_000 + passage + " filler" * 60_000, 0, "a"), (6, "ÉTRE étre", 0, "a"), (7, "Étre", 0, "a"),
    ]
    items = [(10, passage, 1), (2, "eleven ten", 1), (10, "tiny", 1), (None, "nothing", 1), (4, None, 1), (5, "!?", 1), (6, "ÉTRE", 1)]
    given = spark.createDataFrame(docs, "doc_id long, text string, pos int, row string")
    listed = spark.createDataFrame(items, "item_id long, text string, win int")
    assert _rows(decontaminate(given, listed)) == _brute([d[:2] for d in docs], [i[:2] for i in items])
    left = drop_contaminated(given, listed)
    assert left.columns == given.columns
    assert {r.doc_id for r in left.collect()} == {2, 3}  # "nothing" is the window of an item without an id


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "we say nothing here"), (2, "we say all here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "say nothing"), (None, "say all"), (7, "say all")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (2, 0, True) and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (2, 1, True)
    assert drop_contaminated(docs, items).count() == 0


def test_the_words_decide(spark, monkeypatch):
    """With a hash that takes all shingles for the same, every place of a window is claimed, and only the true ones stay."""
    items = [(1, "one two three four five six"), (2, "a b")]
    docs = [(1, "x one two three four five six y"), (2, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (3, "a b a c"), (4, "c a")]
    monkeypatch.setattr(decontamination.F, "xxhash64", lambda *_: decontamination.F.lit(7).cast("long"))
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert _rows(got) == _brute(docs, items)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 1), (2, "d", "x", "y", 2)], "doc_id long, text string, bad string, `a.b` string, digest int")
    items = spark.createDataFrame([(1, "a b", 1)], "item_id long, text string, bad int")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "d", "x", "y", 2)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert _rows(decontaminate(docs, items.limit(0)))[0][:4] == (1, 3, 0, 0)
    assert decontaminate(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs.limit(0), items).count() == 0 and drop_contaminated(docs, items.limit(0)).count() == 1
