"""License scans by conditional compression.

A text becomes overlapping windows of words, regardless of its lines; windows come in sizes of four times the words of the
templates they serve. A window with all the words that name some template's license (its marks) is a candidate block, and is
compressed with zstandard once alone and once with each template of its size as a raw dictionary: the more of its wording a
template has, the smaller it gets. Templates are taken in the order of these size reductions, down to the last that saves
bytes at all. Each is placed on the words: a stretch of the block is a match if the template's words, compared in order with the
stretch's, differ in at most ``most_different`` of them and the marks are all on the lines of the stretch.

Matches are ranked by the size reduction of their own stretch. Of matches that overlap, one whose words lie inside a better
one's goes, and so does one that shares words with a better one of the same license: two wordings that differ in a word or two,
such as those of a license and its lesser form, are told apart by which compresses the stretch further.

Each text is scanned where it is read. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import in_small_batches, load, needs, tidy
from larder.llm.license_texts import TEMPLATES
from larder.llm.registered import query

LEAST_WINDOW = 64  # words
ROWS_OUT = 1000  # notices that leave a task at a time

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_word(text: str, word: str) -> bool:
    """Whether a lower-cased text has ``word`` with no letter or digit beside it: any text with that word does."""
    at = text.find(word)
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + len(word) : at + len(word) + 1]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            return True
        at = text.find(word, at + 1)
    return False


def placed(template: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in the block (0 to its length): the least different words of a stretch that ends there, and its start.

    Different words are words of the template that the stretch lacks in order, plus words that it adds.
    """
    n = len(block)
    at, one = np.arange(n + 1), n + 2  # a different word outweighs any start
    least = n - at  # of equal stretches the shortest
    for word in template:
        step = least + one
        step[1:] = np.where(block == word, np.minimum(step[1:], least[:-1]), step[1:])
        least = np.minimum.accumulate(step - at * one) + at * one
    return least // one, n - least % one


def different_words(template: list[str], block: list[str]) -> int:
    """Words of the template that the block lacks in order, plus words inside the matched stretch that it adds."""
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    return int(placed(np.array([number[w] for w in template], dtype=np.int64), np.array([number.get(w, -1) for w in block], dtype=np.int64))[0].min())


class Match(NamedTuple):
    """A template found in a text: bytes less for its stretch (negative), share of different words, words start to end (excluded)."""

    less: int
    share: float
    start: int
    end: int
    template: int
    saved: float
    different: int


class _Template(NamedTuple):
    name: str
    wording: list[str]
    marks: frozenset[str]
    coder: object
    coded: np.ndarray
    window: int


class Scanner:
    """The templates of one worker as zstandard dictionaries."""

    def __init__(self, templates=TEMPLATES, most_different: float = 0.15):
        import zstandard

        self._plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self._templates, self._numbers = [], {}
        for name, text, marks in templates:
            wording = words_of(text)
            raw = zstandard.ZstdCompressionDict(" ".join(wording).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=3)
            coder = zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
            coded = np.array([self._numbers.setdefault(w, len(self._numbers)) for w in wording], dtype=np.int64)
            window = max(LEAST_WINDOW, 1 << (4 * max(len(wording), 1) - 1).bit_length())
            self._templates.append(_Template(name, wording, frozenset(marks), coder, coded, window))
        self._most = most_different
        self._longest = max((len(t.wording) for t in self._templates), default=0)
        self._sizes = sorted({t.window for t in self._templates}) or [LEAST_WINDOW]
        self._window = self._sizes[-1]

    def _saved(self, template: _Template, data: bytes, alone: int) -> int:
        """Bytes by which the template's dictionary makes compressed data smaller."""
        return alone - len(template.coder.compress(data))

    def _confirmed(self, number: int, found: list[str], lines: list[int], have: set[str], block: np.ndarray) -> Iterator[Match]:
        """The places of a template whose wording differs little enough and whose own stretch it makes smaller."""
        template = self._templates[number]
        most = self._most * len(template.wording)
        if not template.marks <= have or sum(w not in have for w in template.wording) > most:
            return  # at least so many of its words differ at any place
        off, starts = placed(template.coded, block)
        ends = np.flatnonzero(off <= most)
        taken: list[tuple[int, int]] = []
        for different, start, end in sorted(zip(off[ends].tolist(), starts[ends].tolist(), ends.tolist())):
            if start == end or any(start < e and s < end for s, e in taken):
                continue  # the same words a little further on or less far
            if template.marks <= set(found[bisect_left(lines, lines[start]) : bisect_right(lines, lines[end - 1])]):
                taken.append((start, end))
                stretch = " ".join(found[start:end]).encode()
                alone = len(self._plain.compress(stretch))
                saved = self._saved(template, stretch, alone)
                if saved > 0:
                    yield Match(-saved, different / len(template.wording), start, end, number, round(saved / alone, 4), different)

    def _block(self, size: int, found: list[str], lines: list[int]) -> list[Match]:
        """The matches of the templates of one window size in one block: compressed with each, then confirmed by rank."""
        have, own = set(found), [i for i, t in enumerate(self._templates) if t.window == size]
        if not any(self._templates[i].marks <= have for i in own):
            return []
        data = " ".join(found).encode()
        alone = len(self._plain.compress(data))
        ranked = sorted(((self._saved(self._templates[i], data, alone), i) for i in own), key=lambda r: (-r[0], r[1]))
        block = np.array([self._numbers.get(w, -1) for w in found], dtype=np.int64)
        return [m for saved, i in ranked if saved > 0 for m in self._confirmed(i, found, lines, have, block)]

    def matches(self, found: list[str], lines: list[int]) -> list[Match]:
        """Every confirmed place of every template in a window's words (``lines``: each word's line), also overlapping ones."""
        out, have = [], set(found)
        for size in self._sizes:
            if any(t.window == size and t.marks <= have for t in self._templates):
                for at in range(0, max(len(found) - size // 2, 1), size // 2):
                    part = self._block(size, found[at : at + size], lines[at : at + size])
                    out += [m._replace(start=m.start + at, end=m.end + at) for m in part]
        return out

    def best(self, matches: Iterable[Match]) -> list[Match]:
        """The matches that are not inside a better one's words and share none with a better one of the same license."""
        kept: list[tuple[int, int, str]] = []
        out = []
        for m in sorted(set(matches)):
            name = self._templates[m.template].name
            near = kept[bisect_left(kept, (m.start - 2 * self._longest,)) : bisect_left(kept, (m.end,))]
            if not any(start <= m.start and m.end <= end or name == other and m.start < end for start, end, other in near):
                insort(kept, (m.start, m.end, name))
                out.append(m)
        return out

    def windows(self, text: str) -> Iterator[tuple[int, list[str], list[int], list[tuple[int, int]]]]:
        """(number, words, each word's line, each word's start and end) of a lower-cased text, each window from the last one's middle.

        A window has at least four times the words of the longest template, so that some window holds all of any match.
        """
        number = line = seen = fresh = 0
        words, lines, spans = [], [], []
        for m in _WORD.finditer(text):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            words.append(m.group())
            lines.append(line)
            spans.append(m.span())
            fresh += 1
            if len(words) == self._window:
                yield number, words, lines, spans
                number, fresh, half = number + 1, 0, self._window // 2
                words, lines, spans = words[half:], lines[half:], spans[half:]
        if fresh:
            yield number, words, lines, spans

    def notices(self, text: str) -> Iterator[tuple[int, int, str, str, int, float, int]]:
        """(line, piece, block, license, template number, share of the size saved, different words) of a text, in order."""
        low = text.lower()
        if not any(all(has_word(low, w) for w in t.marks) for t in self._templates):
            return
        places, extent = {}, {}
        for piece, words, lines, spans in self.windows(low):
            first = piece * (self._window // 2)
            for m in self.matches(words, lines):
                places[m._replace(start=first + m.start, end=first + m.end)] = lines[m.start], piece
                extent[piece] = spans[0][0], spans[-1][1]
        shown = text if len(text) == len(low) else low
        for m in sorted(self.best(places), key=lambda m: (m.start, m.end, m.template)):
            line, piece = places[m]
            begin, end = extent[piece]
            yield line, piece, shown[begin:end], self._templates[m.template].name, m.template, m.saved, m.different

    def scan_all(self, block: str) -> list[tuple[str, int, float, int]]:
        """(license, template number, share of the size saved, different words) of each confirmed notice, best first."""
        found = words_of(block)
        return [(self._templates[m.template].name, m.template, m.saved, m.different) for m in self.best(self.matches(found, [0] * len(found)))]

    def scan(self, block: str) -> tuple[str, int, float, int] | None:
        """The best of scan_all, or None."""
        return next(iter(self.scan_all(block)), None)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, most_different: float = 0.15) -> DataFrame:
    """One row per confirmed notice: id, line, piece, license, template, saved, different, block.

    line counts from 0 and is where the matched words start, wherever they end; piece counts the text's windows, and block is
    the window that the notice was confirmed in (neighbouring ones overlap by half, so a notice on a window's edge is whole in
    one of them; it is one row). Empty and null texts, and those without the marks of any template, give no row; repeated rows
    give theirs again; a null id stays null. Other columns are not read.
    """
    needs(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, line int, piece int, block string, license string, template int, saved double, different int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, most_different)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32())
        for batch in batches:
            found = ((i, n) for i, t in enumerate(batch.column("text")) for n in scanner.notices(t.as_py()))
            while some := list(islice(found, ROWS_OUT)):
                ids = batch.column("id").take(pa.array([i for i, _ in some], pa.int64()))
                made = [pa.array([n[k] for _, n in some], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids, *made], names=["id", "line", "piece", "block", "license", "template", "saved", "different"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(given).mapInArrow(tidy(run), columns).select(
        F.col("id").alias(id_col), "line", "piece", "license", "template", "saved", "different", "block"
    )


@query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "piece", "license", "saved", "different")
