import random
import re
from collections import Counter
from itertools import permutations

import pytest

from check import compare, open_tables
from larder.llm.filter_audit import OP13_SQL, audit_documents, interactions, op13


def _fails(docs):
    """The letters each row fails, straight from the conditions."""
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    out = []
    for d, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({letter for letter, fails in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search(r"[#$%&*|]", text)),
            ("E", d is not None and d > least[text])) if fails})
    return out


def _brute(docs, good, toxic):
    """Every order applied to every part row by row."""
    fails, rows, shapley = _fails(docs), {}, Counter()
    parts = {p or "" for _, _, p in docs}
    for part in parts:
        own = [(f, d in good, d in toxic) for f, (d, _, p) in zip(fails, docs) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                shapley[part, letter] += len(gone)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), sum(letter in r[0] for r in own) - len(gone), sum(r[0] == {letter} for r in own),
                    sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def _got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def _texts(draw, n):
    pool = [f"w{i}" for i in range(400)] + ["Über", "A", "#", "|x", "漢字", "\n", "\x0b", "\xa0"]
    return ["".join(w + " " for w in draw.choices(pool[: draw.choice((20, 408))], k=draw.choice((0, 3, 150, 199, 200, 201, 350, 450)))) for _ in range(n)]


def test_against_every_order_row_by_row(spark):
    draw = random.Random(7)
    texts = _texts(draw, 60) + ["", None, "A" * 50 + "a" * 2450, "é" * 49 + "A", "one|two", "BIG " * 300_000]
    docs = [(i, draw.choice(texts), draw.choice(("x", "y", None, "", "rare" if i % 40 == 0 else "z"))) for i in range(400)]
    docs += [(None, texts[0], "x"), (None, None, None), (5, "twice", "x"), (5, "twice", "x"), (5, texts[3], "y"), (2**60, texts[2], "x")]
    docs += [(1000 + i, "one text in a third of all rows", "hot") for i in range(250)]
    good, toxic = {d for d, _, _ in docs if d and d % 3 == 0}, {d for d, _, _ in docs if d and d % 7 == 0}
    labels = [(d, int(d in good), int(d in toxic)) for d in sorted(good | toxic)] + [(2, None, None), (None, 1, 1), (4, 0, 0), (6, 0, 0), (6, 1, 0), (99999, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "row", 2, "subset") for d in docs], "doc_id long, text string, source string, row int, digest string, part int, id string")
    got = audit_documents(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert _got(got) == _brute(docs, good, toxic) and got.count() == 600 * len({p or "" for _, _, p in docs})


def test_empty_tables(spark):
    docs, labels = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    none, some = spark.createDataFrame([], docs), spark.createDataFrame([(1, "a", "s"), (2, "a", "s")], docs)
    assert audit_documents(none, spark.createDataFrame([], labels)).count() == 0
    got = _got(audit_documents(some, spark.createDataFrame([], labels)))
    assert got == _brute([(1, "a", "s"), (2, "a", "s")], set(), set()) and len(got) == 600
    with pytest.raises(ValueError, match="source"):
        audit_documents(none.drop("source"), none)


def test_any_filters_and_parts(spark):
    records = spark.createDataFrame([(1, "p", True), (2, "p", None), (3, None, False), (4, None, True)], "n long, kind string, `dear one` boolean")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "n long")
    got = interactions(records, {"long": ids(1, 2, 4), "old": ids(2)}, "kind", ("dear one",), row="n")
    rows = {(r["kind"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert rows["p", "longold", 1] == (0, 2, 0, 1, 1, 3) and rows["p", "longold", 2] == (0, 0, 1, 0, 0, 1)
    assert rows["p", "oldlong", 2] == (0, 1, 1, 1, 1, 3) and rows[None, "oldlong", 1] == (2, 0, 0, 0, 0, 0)
    assert rows[None, "oldlong", 2] == (1, 1, 0, 1, 1, 2) and len(rows) == 8
    with pytest.raises(ValueError, match="filters"):
        interactions(records, {}, "kind", row="n")


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    state, detail = compare(spark, open_tables(sf), sf, "op13_filter_audit", op13, OP13_SQL)
    assert state == "ok", detail


def test_plan_has_no_cross_join(spark):
    text = op13(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
