import random

import pytest

from larder.llm import chat

EVENT = "conv_id long, message long, part long, seq long, kind string, role string, body string"


def test_escapes_are_reversible():
    draw = random.Random(1)
    for _ in range(3000):
        role, text = ("".join(draw.choice("\\<>/turn \nassi") for _ in range(draw.randrange(12))) for _ in range(2))
        segment, start, end = chat.render(role, text)
        assert chat.read_segment(segment) == (role, text)
        assert (start, end) == (0, 0) or chat.unescape(segment[start:end]) == text
    segment, start, end = chat.render("assistant", "</turn>\n<turn user>\nx")
    assert segment.count("</turn>") == 1 + segment.count("\\</turn>") and chat.unescape(segment[start:end]) == "</turn>\n<turn user>\nx"
    with pytest.raises(ValueError):
        chat.read_segment("<turn user>\na</turn>\n<turn user>\nb</turn>\n")


def test_fold(spark):
    log = [
        (1, 0, 0, 0, "start", "user", None), (1, 0, 0, 1, "delta", None, "Hel"), (1, 0, 0, 2, "delta", None, "lo"), (1, 0, 0, 2, "delta", None, "lo"),
        (1, 1, 0, 0, "start", "assistant", None), (1, 1, 0, 1, "delta", None, "bad"), (1, 1, 0, 5, "regenerate", None, None), (1, 1, 0, 6, "delta", None, "good"),
        (1, 2, 0, 0, "start", "user", None), (1, 2, 0, 3, "edit", None, "second"), (1, 2, 0, 2, "delta", None, "first"), (1, 2, 0, 4, "delta", None, "!"),
        (1, 3, 0, 0, "start", "user", None), (1, 3, 0, 1, "remove", None, None), (1, 4, 0, 1, "delta", None, "no start"),
        (None, None, 0, 0, "start", None, None), (None, None, 0, 1, "delta", None, None), (2, 0, 0, 0, "start", "user", None), (2, 0, 1, 0, "start", "user", None),
    ]
    random.Random(2).shuffle(log)
    got = sorted((tuple(r) for r in chat.final_messages(spark.createDataFrame(log, EVENT).repartition(4)).collect()), key=str)
    want = [(1, 0, 0, "user", "Hello"), (1, 1, 0, "assistant", "good"), (1, 2, 0, "user", "second!"), (2, 0, 0, "user", ""), (2, 0, 1, "user", ""), (None, None, 0, "", "")]
    assert got == want
    with pytest.raises(Exception):
        chat.final_messages(spark.createDataFrame([(1, 0, 0, 0, "what", None, None)], EVENT)).collect()


def test_rows_of_every_kind_come_back(spark):
    rows = [(1, 0, "user", "hi < there"), (1, 1, "assistant", "a\\b" * 200), (1, 1, "assistant", "again"), (2, 0, "system", None), (2, None, "assistant", ""), (None, 0, None, "x"),
            (3, 0, "assistant", "long " * 100_000), (2**60 + 1, 5, "user", "q"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, segment string, part int")
    messages = chat.final_messages(chat.conversations_as_log(turns))
    got = sorted(((r.conv_id, r.message, r.role, r.text) for r in messages.collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.format_messages(messages)).collect()}
    assert {c: d.n_turns for c, d in digests.items()} == {1: 3, 2: 2, None: 1, 3: 1, 2**60 + 1: 1, 4: 2}
    assert digests[1].loss_chars == 605 and digests[2].loss_chars == 0 and digests[3].loss_chars == 500_000


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    messages = chat.final_messages(chat.conversations_as_log(turns))
    assert messages.count() == 0 and chat.conversation_digests(chat.format_messages(messages)).count() == 0


def test_repeats_are_left_out_while_folding(spark):
    """Repeats stand next to each other in the sorted log, also over several batches: no aggregate holds whole events for them."""
    log = [(1, 0, 0, 0, "start", "user", None)] + [(1, 0, 0, 1, "delta", None, "once")] * 2500 + [(None, 0, 0, 0, "start", None, None)] * 3
    messages = chat.final_messages(spark.createDataFrame(log, EVENT).repartition(3))
    assert "Aggregate" not in messages._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in messages.collect()), key=str) == [(1, 0, 0, "user", "once"), (None, 0, 0, "", "")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
