"""Byte-level BPE as a streaming transducer with bounded lookahead (problem 8).

A tokenizer file of ranks gives the merge list. A text is read in blocks; a pre-token is encoded once its end can't
change any more, and a pre-token that outgrows the block is itself encoded as a stream: of the bytes held, those
tokens are emitted that lie further from the end than the merge list's sufficient lookahead, and encoding resumes at
the last emitted token. Memory is bounded by the block and the lookahead, whatever the length of the text.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# The pre-token pattern and the vocabulary file of the public byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: No pre-token boundary depends on more characters after it than this (an apostrophe and two letters).
BOUNDARY_LOOKAHEAD = 3


class ByteBPE:
    """The merge list of a rank file, with a cache of whole pre-tokens of at most `cache` entries."""

    def __init__(self, path: str, cache: int = 1 << 17):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        import regex

        self.find = regex.compile(PATTERN)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.known: dict[str, list[int]] = {}
        self.cache = cache
        self._lookahead = 0

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token: the pair of least rank merges first, the leftmost of equal ones."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._merge_short(data) if len(data) < 48 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 for none
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(data[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a token that can still change it. A merge (x, y) is undone by a merge (y, z) of less
        rank, which needs z, and that in turn by one of z with what follows; ranks fall along such a chain, so one pass
        by rising rank finds the longest, also for merges deeper in y. The longest token is added for the part of z
        that is not yet whole."""
        if not self._lookahead:
            reach: dict[bytes, int] = {}  # of the last merge that makes a token
            stolen: dict[bytes, int] = {}  # most bytes that a merge with this left part brings in
            for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) < 2:
                    continue
                parts = self._split(token)
                if parts is None:
                    continue
                left, right = parts
                reach[token] = max(reach.get(right, 0), stolen.get(right, 0))
                stolen[left] = max(stolen.get(left, 0), len(right) + reach[token])
            self._lookahead = max(reach.values(), default=0) + self.longest
        return self._lookahead

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one: what merging by lower ranks leaves of it."""
        rank = self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def word(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                if len(self.known) >= self.cache:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str | None, block: int = 1 << 16) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        if not text:
            return []
        if len(text) <= block:
            out: list[int] = []
            known, word = self.known, self.word
            for piece in self.find.findall(text):
                ids = known.get(piece)
                out.extend(word(piece) if ids is None else ids)
            return out
        stream = Encoder(self, block)
        out = []
        for at in range(0, len(text), block):
            out.extend(stream.feed(text[at : at + block]))
        out.extend(stream.finish())
        return out


class Encoder:
    """feed() blocks of a text and get the ids that are settled; finish() gives the rest."""

    def __init__(self, bpe: ByteBPE, block: int = 1 << 16):
        self.bpe, self.block = bpe, block
        self.held = ""  # characters whose pre-token isn't settled
        self.inside = b""  # bytes of a pre-token that is being streamed
        self.streaming = None  # the pattern of that pre-token's further characters

    def _stable(self, more: bytes, last: bool) -> list[int]:
        self.inside += more
        if last:
            out, self.inside = self.bpe.merge(self.inside) if self.inside else [], b""
            return out
        if len(self.inside) < self.bpe.lookahead + self.block:
            return []
        out, at, until = [], 0, len(self.inside) - self.bpe.lookahead
        for token in self.bpe.merge(self.inside):
            size = len(self.bpe.bytes_of[token])
            if at + size > until:
                break
            out.append(token)
            at += size
        self.inside = self.inside[at:]
        return out

    def feed(self, text: str) -> list[int]:
        import regex

        self.held += text
        out: list[int] = []
        if self.streaming is not None:
            m = self.streaming.match(self.held)
            if m.end() == len(self.held):  # the last character waits, as a run of blanks may leave it to the next word
                out += self._stable(self.held[:-1].encode("utf-8", "surrogatepass"), False)
                self.held = self.held[-1:]
                return out
            blank = self.held[:1].isspace() if m.end() else False
            stop = m.end() - (1 if blank and m.end() else 0)
            out += self._stable(self.held[:stop].encode("utf-8", "surrogatepass"), True)
            self.held, self.streaming = self.held[stop:], None
        at, n = 0, len(self.held)
        for m in self.bpe.find.finditer(self.held):
            if m.end() + BOUNDARY_LOOKAHEAD > n:
                break
            out += self.bpe.word(m.group())
            at = m.end()
        self.held = self.held[at:]
        if len(self.held) > max(self.block, 8) and self.bpe.find.match(self.held).end() == len(self.held):  # one pre-token fills the block
            last = self.held[-1]
            kind = r"\s" if last.isspace() else r"\p{L}" if regex.match(r"\p{L}", last) else r"\p{N}" if regex.match(r"\p{N}", last) else r"[^\s\p{L}\p{N}]"
            self.streaming = regex.compile(f"{kind}*")
            out += self._stable(self.held[:-1].encode("utf-8", "surrogatepass"), False)
            self.held = self.held[-1:]
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.streaming is not None:
            m = self.streaming.match(self.held)
            out += self._stable(self.held[: m.end()].encode("utf-8", "surrogatepass"), True)
            self.held, self.streaming = self.held[m.end() :], None
        for piece in self.bpe.find.findall(self.held):
            out += self.bpe.word(piece)
        self.held = ""
        return out


class Decoder:
    """Ids to text as they come: bytes of a character that isn't whole yet are held back."""

    def __init__(self, bpe: ByteBPE):
        self.bytes_of = bpe.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(self.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): every row with the ids of its whole text, no special tokens; an empty list for an empty or null text.
    One pass without a shuffle; the file is read once a worker."""
    path = path or os.environ.get("MINUTEBOOK_TOKENIZER", DEFAULT_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids = pa.array([bpe.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    slim = documents.select(key, text)
    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, key: str, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(key, keep, tokens): the number of tokens of each row's whole text."""
    path = path or os.environ.get("MINUTEBOOK_TOKENIZER", DEFAULT_FILE)
    slim = documents.select(key, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(key, *keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                tokens = pa.array([len(bpe.encode(t)) for t in part.column(len(keep) + 1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep) + 1)], tokens], [key, *keep, "tokens"])

    return slim.mapInArrow(run, f"{schema}, tokens long")
