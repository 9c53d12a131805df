import hashlib
import random
import re

import numpy as np
import pytest

from check import compare, open_tables
from larder.llm.fill_in_middle import OP12_SQL, ExceptionIndex, fill_in_middle, op12, restore, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LETTERS = "ab \n\t\x0bzé€漢𝄞<PSM>́\x00\xa0\x85 "


def _plain(doc_id, text, seed=42):
    """The contract over code points, without any index."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return text, n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", n, "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", n, "psm", len(prefix), len(middle)


def test_index_converts_both_ways():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(LETTERS) for _ in range(draw.randrange(40)))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        index = ExceptionIndex(data)
        assert len(index.bytes_at) == sum(ord(c) > 127 for c in text)  # ASCII leaves no entry
        for chars in range(len(text) + 1):
            assert index.to_bytes(chars) == len(text[:chars].encode())
            assert index.to_chars(len(text[:chars].encode())) == chars
        ends = [m.end() for m in UNIT.finditer(text)]
        assert index.to_chars(unit_ends(data)).tolist() == ends


def test_rows_of_every_kind(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))), "x", i) for i in range(400)]
    rows += [(1000, None, None, 0), (1001, "", "", 0), (None, "no id at all", "", 0), (None, None, "", 0), (1002, "same text", "a", 1), (1002, "same text", "a", 1)]
    rows += [(2000 + i, ("wörd 漢字\n" * 60_000), "a", 1) for i in range(6)] + [(3000 + i, "x" * 500_000, "b", 1) for i in range(4)]
    rows += [(4000 + i, f"a <{m}> b", "c", 1) for i in range(8) for m in "PSM"] + [(5000 + i, "a< P> <<S >M><P b", "c", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, N long")
    got = restore(fill_in_middle(docs)).collect()
    assert len(got) == len(rows)
    want = sorted(((d, t or "", *_plain(d, t)) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.restored, r.output, r.n, r.form, r.prefix_chars, r.middle_chars) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_missing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert restore(fill_in_middle(empty)).count() == 0
    with pytest.raises(ValueError, match="text"):
        fill_in_middle(empty.select("doc_id"))


def test_settings(spark):
    docs = spark.range(300).selectExpr("cast(id as string) AS `key.of`", "concat(id, ' und dann ', id) AS body")
    forms = lambda **s: {r.form for r in fill_in_middle(docs, "key.of", "body", **s).collect()}
    assert forms(percent=0) == {"plain"} and forms(percent=100, spm_percent=100) == {"spm"} and forms(percent=100, spm_percent=0) == {"psm"}
    assert fill_in_middle(docs, "key.of", "body").columns[0] == "key.of"


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    state, detail = compare(spark, open_tables(sf), sf, "op12_fill_in_middle", op12, OP12_SQL)
    assert state == "ok", detail
