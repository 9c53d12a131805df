import base64
import random
import string
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from larder.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "'s", "'", "''", "'s's", "x's'll", "  'll", "\n'd", "a" * 3000, "ab" * 700, "=" * 500, "é" * 200, "'r", "I'll we've", " " * 9, "\n\n a", "\x1c ½²", "中文字 text x y", "🙂🙂 × ÷", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    draw = random.Random(2)
    letters = ["ab'stremdvl \n1!éÍ", "aAbst'mdrevl  \n\t\r0123.,!é×÷Éß 中\x1c²½🙂", "etaoinshrdlu"]
    made = ["".join(draw.choice(a) for _ in range(draw.randint(0, 60))) for a in letters for _ in range(700)]
    return TEXTS + made + ["".join(draw.choice("etaoin") for _ in range(n)) for n in (63, 64, 65, 400, 2500)]


def test_ids_and_bytes_are_those_of_the_library(library):
    tool, texts = bpe.tokenizer(PATH, public_tokenizers.PATTERN), _texts()
    ids = tool.encode([t.encode() for t in texts])
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert tool.decode(ids) == [t.encode() for t in texts]


def test_long_pieces_without_blanks(library):
    """100 KB without a cut by the pattern: linear, so each of these takes about a second; the same ids as the library's."""
    draw = random.Random(4)
    kinds = {
        "letters": string.ascii_lowercase, "mixed": string.ascii_letters, "digits": string.digits, "two": "ab", "marks": "=-*#",
        "ideographs": "".join(map(chr, range(0x4E00, 0x6000))), "syllables": "".join(map(chr, range(0x3041, 0x3090))),
    }
    texts = ["".join(draw.choice(letters) for _ in range(100_000 if letters.isascii() else 33_000)) for letters in kinds.values()]
    texts.append(base64.b64encode(draw.randbytes(75_000)).decode())
    words = "the quick brown fox jumps over a lazy dog and some more words stand here without blanks between them".split()
    texts.append("".join(draw.choice(words) for _ in range(20_000)))
    texts += ["=" * 5001, "abc" * 1500, "=-" * 2000 + "-" * 999]
    tool = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
    begin = time.process_time()
    ids = tool.encode([t.encode() for t in texts])
    assert time.process_time() - begin < 60
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert tool.decode(ids) == [t.encode() for t in texts]


def test_seams_of_blocks(library, monkeypatch):
    """Blocks of two and three bytes: every seam has to be mended."""
    draw = random.Random(5)
    texts = ["".join(draw.choice(a) for _ in range(draw.randint(1, 80))) for a in ("etaoin", "ab", "=-", "xyzé中") for _ in range(150)]
    monkeypatch.setattr(bpe, "LONG", 4)
    for size in (2, 3):
        monkeypatch.setattr(bpe, "BLOCK", size)
        tool = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
        assert [i.tolist() for i in tool.encode([t.encode() for t in texts])] == [library.encode_ordinary(t) for t in texts]


def test_groups_inside_a_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 50)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 7)
    tool, texts = bpe.Tokenizer(PATH, public_tokenizers.PATTERN), ["", "a text of several groups " * 20, "x" * 300, "", "end 中文 é"]
    ids = tool.encode([t.encode() for t in texts])
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert tool.decode(ids) == [t.encode() for t in texts]
    for n in range(1, 130):  # a group's end may fall into, before or behind the last piece
        assert tool.encode([b"a " * (n // 9) + b"x" * n])[0].tolist() == library.encode_ordinary("a " * (n // 9) + "x" * n)


def test_another_pattern(library):
    tool = bpe.tokenizer(PATH, r"\w+|\W")
    other = tiktoken.Encoding("o", pat_str=r"\w+|\W", mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert [i.tolist() for i in tool.encode([b"don't stop", b""])] == [other.encode_ordinary("don't stop"), []]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 30)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    tool = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
    for t in _texts()[-300:-250]:
        assert tool.encode([t.encode()])[0].tolist() == library.encode_ordinary(t)


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError):
        bpe.tokenizer(PATH).decode([np.array([999_999])])


def test_rows_of_every_kind(spark, library):
    rows = [(1, "one two", "x", b"1", 5), (1, "one two", None, None, None), (None, None, "x", b"1", 5), (2, "", "x", b"1", 5), (3, "word " * 60_000, "x", b"1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids binary, n_tokens int")
    coded = bpe.encode(docs, PATH, verify=True)
    assert coded.columns == ["doc_id", "text", "source", "n_tokens", "ids"]
    back = bpe.decode(coded, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
    digests = bpe.digests(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in digests) == sorted((str(d), len(library.encode_ordinary(t or ""))) for d, t, *_ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH).count() == 0 and bpe.digests(docs, PATH).count() == 0


def test_a_turn_joins_the_tokens_with_the_merges_alone():
    """A row knows the token after its own, so a turn has one join with the merges and one with the pairs it chose."""
    turn = bpe._ENCODE.split("UNION ALL")[1]
    assert turn.count("JOIN") == 2
    assert "state a JOIN state b" not in turn
    tool = bpe.tokenizer(PATH, public_tokenizers.PATTERN)
    tokens, bounds = tool._contract([b"x", b"the", b"zqzq"])
    assert [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.tolist() for t in tool.encode([b"x", b"the", b"zqzq"])]


def test_values_of_a_slice():
    values = pa.array([b"a", b"", b"xyz", b"bc"], pa.large_binary())
    assert bpe._values(values) == [b"a", b"", b"xyz", b"bc"]
    assert bpe._values(values.slice(1, 2)) == [b"", b"xyz"]
