"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

Each text is split by the vocabulary's published pattern, and every split runs
through a left-to-right transducer: the last token of every prefix is the one
suffix token that may follow the last token of what stands before it. Whatever
is read later, the tokens to come begin at one of the last ``longest token``
positions, so a token is emitted as soon as the paths back from all of these
meet behind it. The merge list bounds how far that can be
(``sufficient_lookahead``), so memory stays constant however long the split is.
Results of short splits are remembered.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; the vocabulary folder is a parameter.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import table

VOCABULARY_DIR = "/opt/tokenizers"
# Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered splits of at most so many characters; the memory is emptied when full.
REMEMBER, SHORT = 200_000, 192
#: Bytes read between two attempts to emit.
STRIDE = 64
#: Bytes handed to the transducer at once.
CHUNK = 4_096


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_NEVER = 1 << 60


def merge_bytes(piece: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[bytes]:
    """Plain byte-pair merging, lowest rank first, leftmost first among equals; only ranks under ``below``."""
    get = ranks.get
    at = list(range(len(piece) + 1))  # the parts' starts, then the end
    order = [get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]  # rank of each part joined with the next
    while order:
        low = min(order)
        if low >= below:
            break
        i = order.index(low)
        del at[i + 1], order[i]
        if i < len(order):
            order[i] = get(piece[at[i] : at[i + 2]], _NEVER)
        if i:
            order[i - 1] = get(piece[at[i - 1] : at[i + 1]], _NEVER)
    return [piece[a:b] for a, b in zip(at, at[1:])]


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which a token can no longer change.

    Text to the right moves a boundary to its left only by a cascade: a merge
    takes a token that a later merge wanted, which sets free that merge's left
    part for a still later one, and so on. Ranks along a cascade rise, so its
    length is at most the longest chain of merges (a, b), (c, a), (d, c), ... of
    rising rank, found in one pass over the merge list. Times the longest token
    this bounds what must be read.
    """
    longest: dict[bytes, int] = {}
    most = 1
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = merge_bytes(token, ranks, below=rank)
            if len(parts) == 2:
                left, right = parts
                n = 1 + longest.get(right, 0)
                if n > longest.get(left, 0):
                    longest[left] = n
                    most = max(most, n)
    return (most + 1) * max(map(len, ranks))


class Transducer:
    """Encodes a split of any length in one pass and bounded memory.

    ``pending`` is the most bytes that one call held back, for comparison with the lookahead.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tails: dict[bytes, set[int]] = {}
        for t in ranks:
            tails.setdefault(t[-2:], set()).add(len(t))
        self.by_tail = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pending = 0

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether token b can stand right after token a: merging both as one text gives them back."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > REMEMBER:
                self.pairs.clear()
            known = self.pairs[key] = merge_bytes(a + b, self.ranks) == [a, b]
        return known

    def encode(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of the concatenated chunks, each emitted once no byte to come can change it."""
        ranks, by_tail, pairs = self.ranks, self.by_tail, self.pairs
        last: list[bytes] = [b""]  # last[i]: last token of the prefix that ends i bytes after the emitted ones
        tail = b""
        for chunk in chunks:
            at = 0
            while at < len(chunk):
                piece = chunk[at : at + STRIDE]
                at += len(piece)
                tail += piece
                for i in range(len(last), len(tail) + 1):
                    found = None
                    for n in by_tail.get(tail[max(0, i - 2) : i], ()) if i > 1 else ():
                        if n <= i and (t := tail[i - n : i]) in ranks:
                            before = last[i - n]
                            if not before or pairs.get((before, t)) or self.follows(before, t):
                                found = t
                                break
                    if found is None:
                        found = tail[i - 1 : i]
                        if found not in ranks:
                            raise ValueError("the vocabulary lacks a byte")
                    last.append(found)
                if len(tail) > self.longest:
                    cut = self._meeting(last, len(tail))
                    if cut:
                        yield from (ranks[t] for t in self._trace(last, cut))
                        tail, last = tail[cut:], last[cut:]
                    self.pending = max(self.pending, len(tail))
        yield from (ranks[t] for t in self._trace(last, len(tail)))

    def _meeting(self, last: list[bytes], i: int) -> int:
        """The position through which the paths back from all of the last ``longest`` positions go."""
        heads = list(range(max(0, i - self.longest + 1), i + 1))
        on = bytearray(i + 1)
        for h in heads:
            on[h] = 1
        left, p = len(heads), i
        while left > 1:
            while not on[p]:
                p -= 1
            on[p] = 0
            q = p - len(last[p]) if p else 0
            if p == 0:
                return 0
            if on[q]:
                left -= 1
            else:
                on[q] = 1
        while not on[p]:
            p -= 1
        return p

    @staticmethod
    def _trace(last: list[bytes], i: int) -> list[bytes]:
        out = []
        while i > 0:
            t = last[i]
            out.append(t)
            i -= len(t)
        return out[::-1]


class Encoder:
    """Text to ids by one vocabulary; remembers splits it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.seen: dict[str, tuple[int, ...]] = {}

    def piece(self, s: str) -> Iterable[int]:
        b = s.encode("utf-8", "replace")
        if b in self.ranks:
            return (self.ranks[b],)
        return self.transducer.encode(b[i : i + CHUNK] for i in range(0, len(b), CHUNK))

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        seen = self.seen
        for s in self.split(text or ""):
            if (got := seen.get(s)) is None:
                got = self.piece(s)
                if len(s) <= SHORT:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    got = seen[s] = tuple(got)
            ids.extend(got)
        return ids


class Decoder:
    """Ids to text, a few at a time: the state is the bytes of a code point begun but not ended."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {v: k for k, v in ranks.items()}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(self.token[i] for i in ids), final)

    def decode(self, ids: Iterable[int]) -> str:
        self.machine.reset()
        return self.feed(ids, True)


def _prepared(spark, vocabulary: str):
    """The vocabulary's bytes, for all tasks (under 1 MB, whatever the corpus)."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids array<int>): one row per row of documents, without a shuffle."""
    shared = _prepared(documents.sparkSession, vocabulary)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = Encoder(parse_ranks(shared.value))
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(1):
                flat += enc.encode(t.as_py())
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["k", "ids"])

    d = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decoded(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, text): the text of each list of ids; null ids give an empty text."""
    shared = _prepared(tokens.sparkSession, vocabulary)

    def run(batches):
        import pyarrow as pa

        dec = Decoder(parse_ranks(shared.value))
        for b in batches:
            out = [dec.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "text"])

    d = tokens.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
