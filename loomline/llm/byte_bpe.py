"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, one each, so that pyahocorasick, which
works on text, can hold the byte vocabulary.  One pass of the automaton over a
piece gives all tokens in it and with them the longest that begins at each
position.  The encoder takes the longest match that may follow the token before it
and backs up where none can.

Which two tokens may stand side by side is a property of the merges alone: BPE
leaves ``a`` and ``b`` adjacent exactly if encoding the bytes of ``a + b`` gives
``a, b`` again.  An encoding is right if and only if all its adjacent pairs are,
so a search that admits only compatible pairs, and remembers the positions from
which none goes on, yields the merges' own result in time linear in the piece.
Compatibility is memoised.

The splitting pattern and the rank file are parameters.  Special tokens are not
recognised: their strings are ordinary text.  A null text counts as empty.  Rows
that repeat an id are each encoded.  Only id and text are read, so other columns may
have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A generation of memoised pieces; pieces that were not met during the last one are forgotten, to bound a worker's memory.
MAX_PIECES = 200_000
#: Memoised token pairs are forgotten beyond so many.
MAX_PAIRS = 300_000
#: Tokens after which rows are handed on.
FLUSH_TOKENS = 1 << 20
#: Longer pieces aren't memoised.
MAX_PIECE_CHARS = 40

#: Ids are kept as they are digested: little-endian, unsigned, of 32 bits.
ID = np.dtype("<u4")

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces(dict):
    """Encoded pieces as bytes of ids; looking up one that isn't there encodes it."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is None:
            known = np.array(self.encode(piece.encode()), ID).tobytes()
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = known
        return known


class ByteBpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.halves = {rank: self._halves(token) for token, rank in ranks.items()}
        self.shorter = {rank: self._longest_prefix(token) for token, rank in ranks.items()}
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.matches.make_automaton()
        self.pieces = Pieces(self.encode_piece)
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        return cls(ranks, pattern)

    def _merged(self, token: bytes, parts: int) -> list[bytes]:
        """The bytes of ``token`` after the lowest-ranked merges, until so many parts are left."""
        left = [token[i : i + 1] for i in range(len(token))]
        while len(left) > parts:
            options = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a + b in self.ranks]
            if not options:
                break
            i = min(options)[1]
            left[i : i + 2] = [left[i] + left[i + 1]]
        return left

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or what no merge reaches."""
        if len(token) < 2:
            return None
        left = self._merged(token, 2)
        return (self.ranks[left[0]], self.ranks[left[1]]) if len(left) == 2 else None

    def _longest_prefix(self, token: bytes) -> int | None:
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens ``a`` and ``b`` side by side.

        Undo merges across the border from the latest on.  If, while two parts
        face each other there, their merge would have come earlier than the next
        one undone, BPE would have joined them.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        x, y, bound, ok = a, b, None, True
        while True:
            joint = ranks.get(tokens[x] + tokens[y])
            # a merge of rank ``joint`` at the border comes before an equal one to its right, after one to its left
            if joint is not None and (bound is None or joint < bound):
                ok = False
                break
            hx, hy = halves[x], halves[y]
            if hx is None and hy is None:
                break
            if hy is None or (hx is not None and x > y):
                bound, x = x, hx[1]
            else:
                bound, y = y + 1, hy[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[(a, b)] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, length, shorter = len(piece), self.length, self.shorter
        longest = [0] * size
        for end, (back, rank) in self.matches.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends only go up, so the last is the longest
        known, fits, dead = self.pairs.get, self.compatible, set()
        ids: list[int] = []
        at, before, token = 0, None, longest[0]
        while True:
            end = at + length[token]
            if end not in dead:
                ok = before is None or known((before, token))
                if ok is None:
                    ok = fits(before, token)
                if ok:
                    ids.append(token)
                    if end == size:
                        return ids
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token is None:  # nothing goes on from here: give up the token before
                dead.add(at)
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
            before = ids[-1] if ids else None

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), ID)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each file and pattern in a worker process."""
    if (path, pattern) not in _loaded:
        _loaded[(path, pattern)] = ByteBpe.load(path, pattern)
    return _loaded[(path, pattern)]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document, in one pass without a shuffle: ``ENCODED`` and, if asked for, ids array<int>."""
    schema = ENCODED + (", ids array<int>" if with_ids else "")

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(kinds)]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py())
                row = (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                held += len(ids)
                if held >= FLUSH_TOKENS:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
