"""Byte-level BPE of whole texts as a streaming transducer with bounded lookahead, and streaming decoding.

A vocabulary in rank order is a merge list.  Its encodings are the token sequences in which each two
neighbours are *compatible*: encoding the two tokens' bytes together gives the two tokens back.  So the
last token of every prefix of a text is determined by the prefixes before it, and an encoder can run over
the bytes once, holding for each prefix its last token only.

How far a token's right end can still be changed by what follows is bounded by the merge list:
:func:`sufficient_lookahead` computes the bound from it.  A token is emitted once so many bytes lie behind
it; what is held never exceeds the bound and the longest token, however long a piece of text is.

Pieces (words with their leading blank, as the vocabulary's pattern cuts them) repeat, so the transducer's
result for a short piece is kept in a bounded table.  Decoding goes through a byte-to-text state machine
that holds at most three bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public tokenizers' vocabulary files are; a parameter of every function that needs them.
VOCABULARIES = "/opt/tokenizers"

_ANY = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++$|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}")
_PLAIN = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BOUNDARY = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")

#: Pieces kept in the table at most, and their longest length.
KEPT_PIECES, KEPT_LENGTH = 1 << 18, 64
#: Characters that are cut into pieces at a time, about.
BLOCK = 1 << 16


class Merges:
    """A rank-ordered byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}

    def by_merging(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The definition: merge the neighbours of the lowest rank until none is left (ranks under ``below``)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._halves:
            parts = self.by_merging(token, self.ranks[token]) if len(token) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay as they are side by side.

        Follows the right edge of ``a`` and the left edge of ``b`` back in time: some merge across the
        border must come before the merges that made the two edges, else none can take place.
        """
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            known = self._compatible(a, b)
            if len(self._pairs) < 1 << 20:
                self._pairs[key] = known
        return known

    def _compatible(self, a: bytes, b: bytes) -> bool:
        return self.by_merging(a + b) == [a, b]


def sufficient_lookahead(merges: Merges) -> int:
    """Bytes behind a token after which its right border is final, whatever follows.

    A merge (l, r) can be undone from the right only by an earlier merge whose left half lies on the right
    edge of r, and that one only by a still earlier one, and so on; the reach of a merge is the longest
    such chain of right halves.  Computed in rank order in one pass.
    """
    reach_from: dict[bytes, int] = {}
    most = 0
    order = sorted(merges.ranks, key=merges.ranks.__getitem__)

    def edge(token: bytes) -> Iterator[bytes]:
        while True:
            yield token
            parts = merges.halves(token)
            if parts is None:
                return
            token = parts[1]

    for token in order:
        parts = merges.halves(token)
        if parts is None:
            continue
        left, right = parts
        own = max((reach_from.get(x, 0) for x in edge(right)), default=0)
        reach_from[left] = max(reach_from.get(left, 0), len(right) + own)
        most = max(most, reach_from[left])
    return most


class Transducer:
    """Bytes in, tokens out, each as soon as it is stable.  Feed blocks, then finish."""

    def __init__(self, merges: Merges, lookahead: int):
        self.merges, self.lookahead = merges, lookahead
        self._start()

    def _start(self) -> None:
        self.held = b""
        self.last: list[bytes] = []  # the last token of each prefix of ``held``
        self.before = b""  # the token that ends where ``held`` begins

    def _extend(self, data: bytes) -> None:
        ranks, longest, compatible = self.merges.ranks, self.merges.longest, self.merges.compatible
        held = self.held + data
        for end in range(len(self.held) + 1, len(held) + 1):
            for size in range(min(longest, end), 0, -1):
                token = held[end - size : end]
                if token not in ranks:
                    continue
                previous = self.last[end - size - 1] if end > size else self.before
                if not previous or compatible(previous, token):
                    self.last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.held = held

    def _path(self) -> list[bytes]:
        out, end = [], len(self.held)
        while end:
            out.append(self.last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def feed(self, data: bytes) -> list[bytes]:
        """Tokens that are stable now."""
        out: list[bytes] = []
        step = self.lookahead + self.merges.longest
        for at in range(0, len(data), step):
            self._extend(data[at : at + step])
            done, size = [], 0
            for token in self._path():
                if size + len(token) + self.lookahead > len(self.held):
                    break
                done.append(token)
                size += len(token)
            if size:
                self.before = done[-1]
                self.held, self.last = self.held[size:], self.last[size:]
                out += done
        return out

    def finish(self) -> list[bytes]:
        """The rest, and a fresh start."""
        out = self._path()
        self._start()
        return out


class Codec:
    """Encoding and decoding of texts by one vocabulary file."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
        with open(f"{folder}/{name}.tiktoken", "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.merges = Merges(self.ranks)
        self.lookahead = sufficient_lookahead(self.merges)
        self.transducer = Transducer(self.merges, self.lookahead)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.table: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        tokens = self.transducer.feed(data)
        ids = [self.ranks[t] for t in (*tokens, *self.transducer.finish())]
        if len(piece) <= KEPT_LENGTH:
            if len(self.table) >= KEPT_PIECES:
                self.table.clear()
            self.table[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens (their strings are ordinary text).  Null and "" give []."""
        out: list[int] = []
        if not text:
            return out
        known = self.table.__getitem__
        for block in blocks(text):
            cut, n = pieces(block), len(out)
            try:
                out.extend(chain.from_iterable(map(known, cut)))
            except KeyError:  # a piece that is not in the table (or too long to keep)
                del out[n:]
                for piece in cut:
                    out += self.table.get(piece) or self._piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join([*(machine.feed(self.tokens[i]) for i in ids), machine.finish()])


def blocks(text: str) -> Iterator[str]:
    """The text cut at borders that the pattern always cuts at, in blocks of about :data:`BLOCK`."""
    at = 0
    while len(text) - at > BLOCK:
        m = _BOUNDARY.search(text, at + BLOCK)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def pieces(block: str) -> list[str]:
    """A block's pieces by the vocabulary's pattern."""
    return _PLAIN.findall(block) if block.isascii() else _ANY.findall(block)


class Utf8Machine:
    """UTF-8 bytes in, text out; holds the bytes of one unfinished character.  Bad bytes give U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:  # continuation: look further back
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            if need > back:
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Codec:
    """The codec of a worker process, loaded once."""
    return Codec(name, folder)


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids): the token ids of each text; null and empty texts have the empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)
        for batch in _batches(batches, 500):
            offsets, flat = [0], []
            for t in batch.column(1).to_pylist():
                flat += own.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, n_tokens): the number of tokens of each text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)
        for batch in _batches(batches, 500):
            n = [len(own.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text): the texts of lists of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)
        for batch in _batches(batches, 500):
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
