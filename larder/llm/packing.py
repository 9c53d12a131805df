"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

1. Each text is tokenized where it is read. As many ids as fill whole windows are sequences of their own; what is left, less
   than a window, is cut at every ``piece_tokens``, since small pieces are what evens out windows. Words repeat, so the distinct
   chunks of a few megabytes of text are tokenized once, cut where the tokenizer's pattern cuts in any case.
2. Slim rows of the pieces are written with a row number and dealt by it into groups of about ``group_tokens`` tokens. The
   row number is not a key of the data, so no hot id, text or source makes a full group.
3. In a group, differencing makes near-equal windows: every piece starts as a partition of the group into windows, all empty
   but one. The two partial partitions with the largest imbalance (fullest less emptiest window) are merged, the fullest window
   of one onto the emptiest of the other, until one is left. If its fullest window exceeds the capacity, the number of windows
   rises: in doubling steps until the pieces fit, then by bisection back to the least number found.

Groups are independent, so the work is spread at any size. A group's memory is its pieces times its windows, two bytes each.
"""

from __future__ import annotations

import heapq
import math
import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.columns import in_small_batches, load, needs, tidy
from larder.llm.registered import query
from larder.session import written

CAPACITY = 4096
END_ID = 2
PIECE_TOKENS = 1024
GROUP_TOKENS = 2 << 20  # about 512 windows
TEXT_AT_ONCE = 4 << 20  # bytes of text whose distinct words are tokenized together
KNOWN_WORDS = 500_000  # chunks remembered by a task, about 200 bytes each
AT_ONCE = 1000  # chunks given to the tokenizer at a time
_WINDOW_BITS = 24


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(each window's total, each piece's window): multiway differencing of pieces into so many windows."""
    n = len(sizes)
    if windows == 1 or n < 2:
        totals = np.zeros(windows, dtype=np.int64)
        totals[0] = sizes.sum()
        return totals, np.zeros(n, dtype=np.int64)
    # A partial partition is known by a number: the pieces' own first, then one for every merge. Its window totals are held
    # in falling order; a merge keeps how that order came about.
    kind = np.int16 if windows <= 1 << 15 else np.int32
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)

    def taken(node: int) -> np.ndarray:
        if node in sums:
            return sums.pop(node)
        alone = np.zeros(windows, dtype=np.int64)
        alone[0] = sizes[node]
        return alone

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = taken(a) + taken(b)[::-1]
        order = np.argsort(-both, kind="stable")
        node = n + len(merges)
        merges.append((a, b, order.astype(kind)))
        sums[node] = both[order]
        heapq.heappush(heap, (int(sums[node][-1] - sums[node][0]), node))
    root = heap[0][1]
    totals, place = sums[root], np.zeros(n, dtype=np.int64)
    final = {root: np.arange(windows)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        at = np.empty(windows, dtype=np.int64)
        at[order] = final.pop(n + i)
        for child, own in ((a, at), (b, at[::-1])):
            if child < n:
                place[child] = own[0]
            else:
                final[child] = own
    return totals, place


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each piece's window, counted from 0 without gaps; no window holds more than ``capacity``."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    least = max(math.ceil(int(sizes.sum()) / capacity), int((2 * sizes > capacity).sum()), 1)
    fits, too_few, count, step = None, least - 1, least, 1
    while fits is None:
        totals, place = difference(sizes, count)
        if totals[0] <= capacity:
            fits = place
        else:
            too_few, count, step = count, min(count + step, len(sizes)), step * 2
    while count - too_few > 1:
        middle = (count + too_few) // 2
        totals, place = difference(sizes, middle)
        if totals[0] <= capacity:
            fits, count = place, middle
        else:
            too_few = middle
    return np.unique(fits, return_inverse=True)[1]  # a window that stayed empty is none


_LETTER, _MARK, _BLANK, _BEYOND = range(4)  # a digit counts as a letter here
_KIND = np.full(256, _MARK, dtype=np.uint8)
for _range in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)):
    _KIND[list(_range)] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x80:] = _BEYOND
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def chunk_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where texts laid end to end (``begins``: where each starts) may be cut without changing their tokens.

    The tokenizer takes letters, digits and marks apart and drops white space, so a cut may lie beside white space, between
    a letter or digit and a mark behind it, and between a mark and a letter or digit behind it, unless that mark is an
    apostrophe: some endings go with it. Characters beyond the letters of Latin-1 stay with what they touch.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    cut = (left == _BLANK) != (right == _BLANK)
    cut |= (left == _LETTER) & (right == _MARK)
    cut |= (left == _MARK) & (right == _LETTER) & (data[:-1] != 0x27)
    first = np.append(True, cut)
    first[begins[begins < len(data)]] = True
    return np.flatnonzero(first[: len(data)])


@lru_cache(1)
def _tool(path: str):
    """The worker's tokenizer, and for each id whether it ends what the tokenizer takes as a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True  # a special token's name inside a text is text
    vocabulary = tool.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tool, ends


def _is_word(chunk: bytes) -> bool:
    """Whether a chunk is nothing but letters, so that the tokenizer takes it as one word."""
    if chunk.isascii():
        return chunk.isalpha()
    text = chunk.decode("utf-8", "replace")
    return text.isalpha() and is_normalized("NFC", text) and text.lower().isalpha()


class _Chunks:
    """Token ids of a task's texts; distinct chunks are tokenized once, and a bounded number of them is remembered."""

    def __init__(self, path: str):
        self._tool, self._ends = _tool(path)
        self._known: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self._tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(chunk, ids) of chunks not seen before. Words are tokenized side by side in one text, which takes a third of the time,
        and told apart where a word ends; should their number not come out, they are tokenized one by one."""
        words, others = [], []
        for c in chunks:
            (words if _is_word(c) else others).append(c)
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            (ids,) = self._encoded([b" ".join(some).decode("utf-8", "replace")])
            stops = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(stops) == len(some) and stops[-1] == 4 * len(ids):
                raw, begin = ids.tobytes(), 0
                for word, stop in zip(some, stops.tolist()):
                    yield word, raw[begin:stop]
                    begin = stop
            else:
                others += some
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            yield from zip(some, (ids.tobytes() for ids in self._encoded([c.decode("utf-8", "replace") for c in some])))

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        given = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # The tokenizer lowers letters too, but composes them with a following accent before that.
        data = np.where(np.append(given[1:] >= 0x80, False)[: len(given)], given, _LOWER[given])
        starts = chunk_starts(data, offsets[:-1]).astype(np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            known = self._known = {w: known[w] for w in words if w in known}  # what this group uses stays
        known.update(self._learned(new))
        of_word = [known[w] for w in words]
        sizes = np.array([len(x) // 4 for x in of_word], dtype=np.int64)
        flat = np.frombuffer(b"".join(of_word), dtype="<u4")
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        tokens = flat[np.repeat(first[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield tokens[a:b]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``TEXT_AT_ONCE`` bytes each."""
    begin, held = 0, 0
    for i, size in enumerate(sizes, 1):
        held += size
        if held >= TEXT_AT_ONCE or i == len(sizes):
            yield begin, i
            begin, held = i, 0


def cuts_of(tokens: int, capacity: int, piece_tokens: int) -> list[int]:
    """Where the pieces of a document start: whole windows first, then pieces of at most ``piece_tokens``."""
    whole = tokens // capacity * capacity
    return [*range(0, whole, capacity), *range(whole, tokens, piece_tokens)]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    piece_tokens: int = PIECE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, start, length, doc_tokens, ids): the pieces of each text's token ids with ``end_id`` behind.

    ids are little-endian unsigned 32-bit integers (binary). A null or empty text has the end id alone. Each row of ``docs`` gives
    its own pieces, also where ids or texts repeat or an id is null; an empty table gives an empty one; other columns are not
    read. The tokenizer file must be at ``tokenizer_path`` on every machine.
    """
    needs(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(tokenizer_path)
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for a, b in _groups([len(t) for t in texts]):
                owner, start, length, whole, ids = [], [], [], [], []
                for i, own in enumerate(chunks.ids(texts[a:b]), a):
                    own = np.append(own, np.array([end_id], dtype="<u4"))
                    begins = cuts_of(len(own), capacity, piece_tokens)
                    for at, stop in zip(begins, [*begins[1:], len(own)]):
                        owner.append(i)
                        start.append(at)
                        length.append(stop - at)
                        whole.append(len(own))
                        ids.append(own[at:stop].tobytes())
                numbers = [pa.array(x, pa.int64()) for x in (start, length, whole)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), *numbers, pa.array(ids, pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "ids"],
                )

    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return in_small_batches(given).mapInArrow(tidy(run), f"id {kind}, start long, length long, doc_tokens long, ids binary").withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``cut`` (pieces with a column length, 1 to ``capacity``) with the columns sequence_id and offset.

    No sequence exceeds ``capacity``; offsets count from 0 without gaps. Sequence ids are unique, not dense: group and window. Other
    columns pass through, but ones named like the results are replaced. An empty table gives an empty one. Jobs run when
    called: the pieces are written, so keep ids and texts out of them unless they are wanted in the result.
    """
    needs(cut, "length")
    names = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    # Own names for what passes through: columns of any name and kind stay apart from the helpers.
    inner = cut.select(*[cut[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("row"))
    length_at = [c.lower() for c in names].index("length")
    rows = written(inner, "pieces")
    total = rows.agg(F.sum(f"c{length_at}")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes = table.column(f"c{length_at}").to_numpy()
        group = table.column("grp")[0].as_py()
        full = sizes == capacity
        if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
            raise ValueError(f"a piece must have 1 to {capacity} tokens")
        window = np.empty(len(sizes), dtype=np.int64)
        window[~full] = windows_of(sizes[~full], capacity)
        used = int(window[~full].max()) + 1 if not full.all() else 0
        window[full] = used + np.arange(full.sum())
        if used + full.sum() >> _WINDOW_BITS:
            raise ValueError("a group has too many windows: choose smaller groups")
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        begins = ends - sizes[order]
        first = np.flatnonzero(np.diff(window[order], prepend=-1))
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = begins - np.repeat(begins[first], np.diff(np.append(first, len(sizes))))
        table = table.drop_columns(["row", "grp"])
        return table.append_column("sequence_id", pa.array((group << _WINDOW_BITS) + window)).append_column("offset", pa.array(offset))

    tasks = min(math.ceil(groups / 4), 20_000)  # a few groups a task
    packed = dealt.repartition(tasks, "grp").groupBy("grp").applyInArrow(run, f"{kinds}, sequence_id long, offset long")
    return packed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, padded, ids): the token ids of each sequence in order, for packed rows that kept their ids.

    A sequence is padded to ``capacity`` with ``pad_id``, unless its length is a power of two. A group is one window, so it is
    small whatever the data.
    """
    needs(packed, "sequence_id", "offset", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"),
    )
    power = F.bit_count("length") == 1
    padded = F.when(power, F.col("length")).otherwise(F.lit(capacity).cast("long"))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), (padded - F.col("length")).cast("int"))
    return whole.select("sequence_id", "length", padded.alias("padded"), F.unhex(F.concat(F.array_join("parts.ids", ""), pad)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, **columns: str) -> DataFrame:
    """The packed pieces of ``docs`` with their token ids; see ``pieces`` and ``pack``, and ``sequences`` for what to train on."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id, min(PIECE_TOKENS, capacity), **columns), capacity)


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    slim = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(slim)
