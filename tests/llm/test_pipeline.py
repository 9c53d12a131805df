"""The pipeline against a brute-force version, its stages on tables of every kind, and the registered queries."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from check import compare, open_tables
from larder.llm import bpe, language
from test_decontamination import _brute as contaminated_rows
from test_near_dedup import _brute as near_groups

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _brute(docs, model, items, library):
    letters = lambda t: any(c.isalpha() for c in t or "")
    rows = [(d, t) for d, t in docs if letters(t) and not model.predict(t)[2]]
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, d))
    rows = sorted((d, t) for t, d in last.items())
    group = near_groups(rows, 5)
    rows = [(d, t) for d, t in rows if group[d] == d]
    bad = {r[0] for r in contaminated_rows(rows, items) if r[5]}
    return {d: library.encode_ordinary(t) for d, t in rows if d not in bad}


def test_run_against_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = _brute([tuple(r) for r in docs.select("doc_id", "text").collect()], language.fit(docs), items, library)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want and len(got) == len(want) < docs.count()
    assert all(r.n_tokens == len(want[r.doc_id]) for r in got)


def test_stages_take_tables_of_every_kind(spark, tmp_path):
    plain = "the and of that with this from they have been were said which their will would"
    rows = [(1, plain, "en", "s", 1), (1, plain, "en", "s", 1), (None, plain, None, None, None), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (4, plain + " more", "en", None, 1),
            (5, "der die und das nicht ein eine ist von zu mit sich auch auf", "de", "s", 1), (6, plain.upper() * 3000, "en", "s", 1)]
    for number, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            path = str(tmp_path / f"{number}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.count() == (3 if given else 0)


def test_stages_take_clashing_names(spark, tmp_path):
    plain = "the and of that with this from they have been were said which their will would"
    rows = [(i, plain + f" {i}" * (i % 3), "en", "s", 1, "g", 2, "c", 3, "w") for i in range(1, 9)]
    docs = spark.createDataFrame(rows, SCHEMA + ", gone string, bad int, `a.b` string, `Digest` int, win string")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    assert 0 < docs.count() < len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids"]


@pytest.mark.parametrize("rows", [[], [(1, "the and of that with this", None, "s", 1), (2, None, "en", "s", 1), (3, "12", "en", "s", 1)]])
def test_run_where_no_language_is_taught(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.known_language(spark, spark.createDataFrame(rows, SCHEMA), SF).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() == 0


@pytest.mark.parametrize("name", sorted(corpus_pipeline.ORACLES))
def test_query_matches_sql(spark, name):
    state, detail = compare(spark, open_tables(SF), SF, name, corpus_pipeline.QUERIES[name], corpus_pipeline.ORACLES[name])
    assert state == "ok", detail


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in corpus_pipeline.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in corpus_pipeline.QUERIES
