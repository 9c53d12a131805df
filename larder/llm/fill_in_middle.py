"""Fill-in-middle transformation with a sparse exception index.

Cuts are made on the UTF-8 bytes of a text, but counted in code points. Only characters of more than one byte make the two
differ, so the index of a text records nothing but their positions and their excess bytes. A cut inside an ASCII stretch is
arithmetic: its byte offset is its code point offset plus the excess bytes of the multibyte characters before it, which one
binary search over the index finds.

A text is taken as units: a word with the white space before it, or white space at the very end. Hashes of the document's id
choose two cuts between units and the form of the output, so a retried task makes the same rows. Documents are worked on
where they are read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import in_small_batches, load, needs, tidy, without_results
from larder.llm.registered import query

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXCESS = np.zeros(256, dtype=np.uint8)  # further bytes that a lead byte announces
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = 1, 2, 3


class ExceptionIndex:
    """The multibyte characters of one text: where they are, in bytes and in code points, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        excess = _EXCESS[data[self.bytes_at]].astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(excess)))
        self.chars_at = self.bytes_at - self.before[:-1]

    def to_chars(self, offset):
        """Code points before a byte offset (a number or an array of them) that lies between characters."""
        return offset - self.before[np.searchsorted(self.bytes_at, offset)]

    def to_bytes(self, chars):
        """The byte offset after so many code points."""
        return chars + self.before[np.searchsorted(self.chars_at, chars)]


def unit_ends(data: np.ndarray) -> np.ndarray:
    """The byte offset at which each unit ends: after every word, and at the end of white space that closes the text."""
    space = _SPACE[data]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and space[-1] else ends


def draws(doc_id, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document's id; a null id counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arrange(text: bytes, doc_id, seed: int, percent: int, spm_percent: int) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, units, form, code points of the prefix, of the middle) of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = unit_ends(data)
    first, second, form, order = draws(doc_id, seed)
    if not text or form % 100 >= percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return text, len(ends), "plain", None, None
    units = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    index, bounds = ExceptionIndex(data), np.concatenate(([0], ends))[units]
    a, b = index.to_chars(bounds).tolist()
    start, stop = index.to_bytes(np.array([a, b])).tolist()
    head, body, tail = text[:start], text[start:stop], text[stop:]
    if order % 100 < spm_percent:
        form, parts = "spm", (SUFFIX.encode(), tail, PREFIX.encode(), head, MIDDLE.encode(), body)
    else:
        form, parts = "psm", (PREFIX.encode(), head, SUFFIX.encode(), tail, MIDDLE.encode(), body)
    return b"".join(parts), len(ends), form, a, b - a


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: id, output, n, form, prefix_chars, middle_chars.

    n is the number of units, form one of plain, psm and spm; plain rows keep their text and have null counts. A text that is
    empty or contains one of the marks stays plain, so every output can be taken apart again. A null text counts as empty, a
    null id as an empty string. Rows that repeat an id and text repeat their output; texts of any length are held one batch
    at a time; an empty table gives an empty one. Other columns are not read.
    """
    needs(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            begin, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text or b"")
                if held >= 1 << 22 or i + 1 == len(texts):  # outputs leave in groups of bounded size
                    made = [arrange(t or b"", d, seed, percent, spm_percent) for d, t in zip(ids[begin : i + 1], texts[begin : i + 1])]
                    output, n, form, prefix, middle = zip(*made)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(made)), pa.array(output, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                         pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())],
                        names=["id", "output", "n", "form", "prefix_chars", "middle_chars"],
                    )
                    begin, held = i + 1, 0

    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    made = in_small_batches(given).mapInArrow(
        tidy(run), f"id {kind}, output string, n long, form string, prefix_chars long, middle_chars long"
    )
    return made.withColumnRenamed("id", id_col)


def original(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form alone: between the marks lie prefix, suffix and middle."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return (
        F.when(F.col(form) == "psm", F.concat(one, middle, two))
        .when(F.col(form) == "spm", F.concat(two, middle, one))
        .otherwise(F.col(output))
    )


def restore(made: DataFrame, restored_col: str = "restored") -> DataFrame:
    """``made`` with the text rebuilt from the columns output and form; a column named ``restored_col`` is replaced."""
    needs(made, "output", "form")
    return without_results(made, restored_col).withColumn(restored_col, original())


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(load(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
