"""Byte-level BPE encoding and decoding, as DuckDB queries inside each partition.

A text is cut into pieces by the tokenizer's pattern; a piece becomes rows (word, position, token), first one token per
byte. A recursive query joins neighbouring tokens with the merge table, contracts the leftmost pair of least rank of
every word, and repeats until no word has a pair to merge. Decoding joins token rows with the vocabulary and
concatenates their bytes in order.

Contracting one pair a turn costs the square of a word's length, so a long piece is dealt into blocks that are words of
their own, and neighbouring results are joined until the piece is whole again. The tokens around a seam are contracted as
a word; when the first and the last of them come out as they went in, the joined tokens are the piece's own: a contraction that
crossed a boundary between two tokens in the whole piece would also cross it in the two tokens alone, and every two neighbours
have now been contracted together without one. Otherwise the word around the seam is made twice as wide.

Spark partitions the documents; a task works through them in groups of bounded size, also inside one text, so memory depends
neither on the partition nor on the longest text's token count. Distinct pieces are encoded once per group, and a bounded
table of pieces already encoded is kept for the next groups of the task. The cut into pieces is done on whole arrays of bytes
for texts of ASCII and Latin-1 letters, and by the pattern itself for all other texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larder.llm.columns import in_small_batches, load, map_rows, needs, own_name, tidy
from larder.llm.registered import query

GROUP_BYTES = 1 << 20  # of text or tokens worked on at a time
WORDS_AT_ONCE = 20_000  # pieces given to one recursive query
BYTES_AT_ONCE = 400_000  # and their bytes
KNOWN_WORDS = 200_000  # pieces remembered by a task, about 200 bytes each
LONG = 64  # bytes from which a piece is dealt into blocks
BLOCK = 32  # bytes of a block
TOKENS_AT_ONCE = 1 << 18  # of one text that are decoded together
_SHIFT = 1 << 32

# Ranks are positive and below 2**31, so rank * 2**32 + position orders pairs by rank, then from the left. A row knows the token
# after its own (-1: none), so a turn finds its pairs without joining the rows to each other: of the two rows of a pair the right
# one becomes the new token, as it knows what follows, and the row before learns its new neighbour. Positions are counted anew
# each turn. A word without a pair leaves the recursion.
_ENCODE = f"""
WITH RECURSIVE state(word, pos, tok, next_tok, done) AS (
  SELECT word, pos, tok, next_tok, false FROM pieces
  UNION ALL
  (WITH least AS (
     SELECT s.word, min(m.id::BIGINT * {_SHIFT} + s.pos) AS pair
     FROM state s JOIN merges m ON m.l = s.tok AND m.r = s.next_tok
     WHERE NOT s.done
     GROUP BY s.word)
   SELECT s.word, CASE WHEN s.pos > p.pair % {_SHIFT} THEN s.pos - 1 ELSE s.pos END,
          CASE WHEN s.pos = p.pair % {_SHIFT} + 1 THEN (p.pair // {_SHIFT})::INTEGER ELSE s.tok END,
          CASE WHEN s.pos = p.pair % {_SHIFT} - 1 THEN (p.pair // {_SHIFT})::INTEGER ELSE s.next_tok END, p.pair IS NULL
   FROM state s LEFT JOIN least p ON s.word = p.word
   WHERE NOT s.done AND (p.pair IS NULL OR s.pos <> p.pair % {_SHIFT}))
)
SELECT word, pos, tok FROM state WHERE done ORDER BY word, pos
"""

# For words that stay long (texts of one repeated pattern have no seam that holds) one turn contracts every occurrence of the
# least pair, left to right without overlap, where the new token takes part in no merge of a lower rank (alone = false): the
# single steps would come to the same. Turns are bounded per query, so that the turns held at once stay small; the caller
# repeats it until nothing changes.
_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok, turn) AS (
  SELECT word, pos, tok, 0 FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT n.word, n.pos, n.idx, n.next_pos, m.id, m.alone
     FROM (SELECT word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos, row_number() OVER w AS idx
           FROM state WHERE turn < $turns WINDOW w AS (PARTITION BY word ORDER BY pos)) n
     JOIN merges m ON m.l = n.tok AND m.r = n.next_tok),
   least AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY idx) AS k
             FROM (SELECT *, min(id) OVER (PARTITION BY word) AS best FROM pairs) WHERE id = best),
   chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, idx - k ORDER BY idx) AS odd FROM least)
              WHERE CASE WHEN alone THEN k = 1 ELSE odd % 2 = 1 END)
   SELECT s.word, s.pos, coalesce(c.id, s.tok), s.turn + 1
   FROM state s SEMI JOIN chosen a ON s.word = a.word
   LEFT JOIN chosen c ON s.word = c.word AND s.pos = c.pos
   ANTI JOIN chosen g ON s.word = g.word AND s.pos = g.next_pos)
)
SELECT word, pos, tok FROM (SELECT *, max(turn) OVER (PARTITION BY word) AS last FROM state)
WHERE turn = last ORDER BY word, pos
"""

_DECODE = """
SELECT t.doc, string_agg(v.piece, '' ORDER BY t.pos) AS text, count(*) - count(v.piece) AS unknown
FROM tokens t LEFT JOIN vocabulary v ON t.id = v.id GROUP BY t.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_L, _N, _O, _S = range(4)
_KIND = np.full(256, _O, dtype=np.uint8)
for _c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _KIND[_c] = _L
_KIND[0x30:0x3A] = _N
_KIND[[0x20, *range(0x09, 0x0E)]] = _S


def _odd_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of characters other than ASCII and the letters U+00C0 to U+00FF."""
    lead = (data == 0xC3) & (np.append(data[1:], 0) != 0x97) & (np.append(data[1:], 0) != 0xB7)
    return (data >= 0x80) & ~lead & ~np.concatenate(([False], lead[:-1]))


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end (``begins``: where the non-empty texts start), for plain texts."""
    kind, n = _KIND[data], len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    space, blank = kind == _S, data == 0x20
    # The last white space before a word stands alone or, if it is a blank, goes with the word.
    ends = np.flatnonzero(space & run[1:] & ~first[1:])
    start[ends] = True
    start[ends[blank[ends]] + 1] = False
    # An apostrophe that starts a piece takes one of the fixed endings with it.
    marks = np.flatnonzero((data == 0x27) & start[:n])
    padded = np.concatenate((data, np.zeros(2, dtype=np.uint8)))
    one, two = padded[marks + 1], padded[marks + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(marks), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    last = np.append(first, [True, True])
    short &= ~last[marks + 1]
    long &= ~last[marks + 1] & ~last[marks + 2]
    for found, length in ((marks[short], 1), (marks[long], 2)):
        start[found + 1] = False
        start[found + 1 + length] = True
    return np.flatnonzero(start[:n])


class Tokenizer:
    """The merge table and vocabulary of one worker, in an in-process DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self._split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self._fast = pattern == _PLAIN
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        lower = {x for a, b, r in zip(left, right, whole) for x in (a, b) if r < x}
        # A group needs a few dozen megabytes; an executor holds as many of these as it has cores, beside its own heap.
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(whole, pa.int32()), "alone": [r in lower for r in whole]})
        self._pieces = {rank: token for token, rank in ranks.items()}
        vocabulary = pa.table({"id": pa.array(self._pieces, pa.int32()), "piece": [t.decode("latin-1") for t in self._pieces.values()]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self._db.register("given", table)
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self._db.unregister("given")
        self._known: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Let go of the remembered pieces."""
        self._known = {}

    def _query(self, sql: str, name: str, table: pa.Table, **values):
        self._db.register(name, table)
        try:
            return self._db.execute(sql, values or None).to_arrow_table()
        finally:
            self._db.unregister(name)

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The tokens of all words end to end, and where each word's begin and end: short words by one query, others by another."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"word": word, "pos": pos.astype(np.int32), "tok": self._byte[flat]})
        if lengths.max() < LONG:
            after = np.append(self._byte[flat[1:]], np.int32(-1))
            after[np.cumsum(lengths) - 1] = -1
            rows = self._query(_ENCODE, "pieces", rows.append_column("next_tok", pa.array(after, pa.int32())))
        else:
            before = -1
            while before != rows.num_rows:
                before = rows.num_rows
                rows = self._query(_ENCODE_LONG, "pieces", rows, turns=max(1, min(64, 1_000_000 // before)))
        tokens = rows["tok"].to_numpy().astype("<i4")
        ends = np.cumsum(np.bincount(rows["word"].to_numpy(), minlength=len(words))).tolist()
        return tokens, [0, *ends]

    def _in_parts(self, words: Iterable[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, list[int]]]:
        """Distinct words in parts of bounded size, short ones first, each with the tokens of its words and their bounds."""
        part: list[bytes] = []
        held = 0
        for word in sorted(set(words), key=len):
            size = len(word)
            if part and (len(part) == WORDS_AT_ONCE or held + size > BYTES_AT_ONCE or (size >= LONG and len(part[-1]) < LONG)):
                yield part, *self._contract(part)
                part, held = [], 0
            part.append(word)
            held += size
        if part:
            yield part, *self._contract(part)

    def _contract_all(self, words: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        """The tokens of distinct words."""
        return {w: tokens[a:b] for part, tokens, at in self._in_parts(words) for w, (a, b) in zip(part, pairwise(at))}

    def _bytes_of(self, tokens: np.ndarray) -> bytes:
        return b"".join([self._pieces[t] for t in tokens.tolist()])

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The tokens of two neighbouring stretches together, for several pairs of tokens of such stretches at once."""
        out: list = [None] * len(pairs)
        open_, wide = list(range(len(pairs))), 2
        while open_:
            inner = [(pairs[i][0][-wide:], pairs[i][1][:wide]) for i in open_]
            words = [self._bytes_of(np.concatenate(x)) for x in inner]
            made, left = self._contract_all(words), []
            for i, (a, b), word in zip(open_, inner, words):
                whole_a, whole_b = len(a) == len(pairs[i][0]), len(b) == len(pairs[i][1])
                got = made[word]
                if (whole_a or got[0] == a[0]) and (whole_b or got[-1] == b[-1]):
                    out[i] = np.concatenate((pairs[i][0][: len(pairs[i][0]) - len(a)], got, pairs[i][1][len(b) :]))
                else:
                    left.append(i)
            open_, wide = left, 2 * wide
        return out

    def _contract_long(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """The tokens of long words: blocks first, then neighbouring stretches joined two by two."""
        blocks = [[w[i : i + BLOCK] for i in range(0, len(w), BLOCK)] for w in words]
        made = self._contract_all(b for own in blocks for b in own)
        parts = [[made[b] for b in own] for own in blocks]
        while any(len(own) > 1 for own in parts):
            joined = iter(self._joined([(own[i], own[i + 1]) for own in parts for i in range(0, len(own) - 1, 2)]))
            parts = [[next(joined) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)] for own in parts]
        return {w: own[0] for w, own in zip(words, parts)}

    def _learned(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(piece, ids) of distinct pieces not seen before."""
        for part, tokens, at in self._in_parts(w for w in words if len(w) < LONG):
            packed = tokens.tobytes()
            yield from zip(part, [packed[4 * a : 4 * b] for a, b in pairwise(at)])
        for word, tokens in self._contract_long([w for w in words if len(w) >= LONG]).items():
            yield word, tokens.tobytes()

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of texts laid end to end start."""
        begins, ends = offsets[:-1], offsets[1:]
        full = begins < ends
        if self._fast:
            odd = np.concatenate(([0], np.cumsum(_odd_bytes(data))))
            slow = np.flatnonzero(odd[ends] > odd[begins])
            starts = piece_starts(data, begins[full])
            if not len(slow):
                return starts
            owner = np.searchsorted(offsets, starts, side="right") - 1
            starts = [starts[~np.isin(owner, slow)]]
        else:
            slow, starts = np.flatnonzero(full), []
        for i in slow:
            pieces = self._split.findall(data[begins[i] : ends[i]].tobytes().decode("utf-8", "surrogatepass"))
            lengths = np.array([len(p.encode("utf-8", "surrogatepass")) for p in pieces], dtype=np.int64)
            starts.append(begins[i] + np.cumsum(lengths) - lengths)
        return np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The tokens of each text."""
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        joined = b"".join(texts)
        if not joined:
            return [np.zeros(0, np.int32)] * len(texts)
        starts = self._cut(np.frombuffer(joined, dtype=np.uint8), offsets).astype(np.int64)
        bounds = np.append(starts, len(joined))
        tokens, counts = [], []
        turns = np.searchsorted(bounds, np.arange(0, len(joined), GROUP_BYTES)).tolist()
        for a, b in pairwise(dict.fromkeys([*turns, len(starts)])):
            own = bounds[a : b + 1]
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(own), pa.py_buffer(joined)])
            coded = pieces.dictionary_encode()
            words, known = _values(coded.dictionary), self._known
            new = [w for w in words if w not in known]
            if len(known) + len(new) > KNOWN_WORDS:
                known = self._known = {w: known[w] for w in words if w in known}  # what this group uses stays
            known.update(self._learned(new))
            of_word = [known[w] for w in words]
            sizes = np.array([len(x) // 4 for x in of_word], dtype=np.int64)
            flat, first, index = np.frombuffer(b"".join(of_word), dtype="<i4"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
            lengths = sizes[index]
            ends = np.cumsum(lengths)
            tokens.append(flat[np.repeat(first[index] - (ends - lengths), lengths) + np.arange(ends[-1])])
            counts.append(lengths)
        ends = np.cumsum(np.concatenate(counts))
        tokens = np.concatenate(tokens)
        cuts = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, tokens: list[np.ndarray]) -> list[bytes]:
        """The bytes of each token list; long lists go through the query in parts."""
        parts = [(i, t[a : a + TOKENS_AT_ONCE]) for i, t in enumerate(tokens) for a in range(0, len(t), TOKENS_AT_ONCE)]
        texts: list[list[bytes]] = [[] for _ in tokens]
        for a, b in _grouped([4 * len(t) for _, t in parts]):
            lengths = np.array([len(t) for _, t in parts[a:b]], dtype=np.int64)
            doc = np.repeat(np.arange(b - a, dtype=np.int32), lengths)
            ids = np.concatenate([t for _, t in parts[a:b]]).astype(np.int32)
            found = self._query(_DECODE, "tokens", pa.table({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "id": ids}))
            if pc.sum(found["unknown"]).as_py():
                raise ValueError("ids that the vocabulary does not have")
            made = dict(zip(found["doc"].to_pylist(), found["text"].to_pylist()))
            for i in range(b - a):
                texts[parts[a + i][0]].append(made[i].encode("latin-1"))
        return [b"".join(t) for t in texts]


#: The one pattern whose cut is also written as array operations; any other pattern is applied as it is.
_PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MADE: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str = _PLAIN) -> Tokenizer:
    """The worker's tokenizer for a rank file; made once per worker process."""
    key = (path, pattern)
    if key not in _MADE:
        _MADE[key] = Tokenizer(path, pattern)
    return _MADE[key]


def _release() -> None:
    """At a task's end: workers outlive their tasks, and what a task remembered is the next one's memory."""
    for tool in _MADE.values():
        tool.forget()


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``GROUP_BYTES`` each."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= GROUP_BYTES:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _values(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls, cut from one copy of its bytes."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    packed = memoryview(column.buffers()[2])[offsets[0] : offsets[-1]].tobytes()
    return [packed[a:b] for a, b in pairwise((offsets - offsets[0]).tolist())]


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def _mapped(docs: DataFrame, column: str, added: str, kind: T.DataType, read, work) -> DataFrame:
    """``docs`` with a column made from another by ``work`` over groups of rows; the other columns pass through.

    Rows leave group by group, so a task holds the results of one group only.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() != added.lower()] + [T.StructField(added, kind)])
    names = [f.name for f in schema.fields]
    source = own_name(docs, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = read(batch.column(len(batch.schema) - 1))
            for a, b in _grouped([len(v) for v in values]):
                made = pa.array(work(values[a:b]), pa.binary())
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, made], names=names)

    kept = docs.select(*[f"`{n}`" for n in names[:-1]], docs[f"`{column}`"].alias(source))
    return map_rows(kept, tidy(run, _release), schema)


def encode(
    docs: DataFrame,
    ranks_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    pattern: str = _PLAIN,
    verify: bool = False,
) -> DataFrame:
    """``docs`` with ``ids_col``: the text's token ids as little-endian unsigned 32-bit integers (binary).

    No special tokens. A null or empty text has no ids (an empty value). Every row is encoded whole and for itself, so
    repeated rows and ids do not matter; other columns pass through, but one named ``ids_col`` is replaced. The rank
    file must be at ``ranks_path`` on every machine. With ``verify`` the ids are decoded again in the same task, and a text
    that does not come back byte for byte is an error.
    """
    needs(docs, text_col)

    def work(texts: list[bytes]) -> list[bytes]:
        tool = tokenizer(ranks_path, pattern)
        tokens = tool.encode(texts)
        if verify and tool.decode(tokens) != texts:
            raise ValueError("a text does not survive encoding and decoding")
        return [ids.astype("<u4").tobytes() for ids in tokens]

    return _mapped(docs, text_col, ids_col, T.BinaryType(), _texts, work)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", decoded_col: str = "decoded", pattern: str = _PLAIN) -> DataFrame:
    """``docs`` with ``decoded_col``: the bytes that the ids stand for (binary). Null ids count as none."""
    needs(docs, ids_col)

    def work(packed: list[bytes]) -> list[bytes]:
        return tokenizer(ranks_path, pattern).decode([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed])

    return _mapped(docs, ids_col, decoded_col, T.BinaryType(), _texts, work)


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = _PLAIN) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256; encoded and decoded in one pass."""
    needs(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(ranks_path, pattern)
        for batch in batches:
            texts, counts, ids_sha, text_sha = _texts(batch.column(1)), [], [], []
            for a, b in _grouped([len(t) for t in texts]):
                tokens = tool.encode(texts[a:b])
                counts += [len(t) for t in tokens]
                ids_sha += [hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens]
                text_sha += [hashlib.sha256(t).hexdigest() for t in tool.decode(tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return in_small_batches(given).mapInArrow(tidy(run, _release), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
