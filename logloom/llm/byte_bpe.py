"""Byte-level BPE encoding and decoding by a rank file, in time linear in the text.

A text is split by the vocabulary's pattern, and each match (piece) is encoded by itself. The bytes of a piece are read as
Latin-1 characters by an Aho-Corasick automaton of all tokens, which gives the longest token from each place. The piece is
walked from left to right with these longest tokens; a token may stand behind another only if merging the two tokens' bytes
would leave exactly these two (`fits`, remembered by pair). Where no token fits, the walk takes a shorter token or goes one
token back and closes the place, as a beginning of a piece has one encoding only: no place is closed twice. What is left is the
sequence that merging by rank gives.

The characters that count as letters, numbers or white space depend on the Unicode version of a library. Where the tables of
the regex module and of the library to be matched differ for a character, a stand-in of the library's class takes its place
while the text is split (`Splitter`).

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows and null ids are
returned as they are; texts of any length are coded whole; an empty table gives an empty one; other columns are ignored whatever
their names. The ranks must hold all 256 bytes, and each token after its parts, as training makes them; a token that merging can
never reach is used only where it is a whole piece, as the tiktoken library does.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, in_workers, slices

#: Pieces, and pairs of tokens, that a task remembers at most; characters of the longest piece that is remembered.
MEMORY, LONGEST = 400_000, 64
#: Text bytes that are coded at once; from so many characters on, a text's pieces are not listed but walked through.
SLICE, LONG = 1 << 19, 1 << 20

#: A stand-in of each class: letter, number, white space, other.
STAND_INS = {"L": "ª", "N": "²", "S": " ", "O": "§"}


def library_class(pattern: str) -> Callable[[str], str]:
    """The class (L, N, S, O) that the tiktoken library gives to a character beyond ASCII.

    Seen from outside: a letter, digit or full stop is merged with the first byte of the character only if both are in one piece.
    """
    plain = {bytes([i]): i for i in range(256)}

    def encoding(lead: bytes) -> tiktoken.Encoding:
        pairs = {lead + bytes([x]): 256 + x for x in range(128, 256)}
        return tiktoken.Encoding("class of a character", pat_str=pattern, mergeable_ranks=plain | pairs, special_tokens={})

    probes = {kind: (lead, encoding(lead.encode())) for kind, lead in (("L", "A"), ("N", "1"), ("O", "."))}
    return lambda char: next((kind for kind, (lead, probe) in probes.items() if probe.encode_ordinary(lead + char)[0] >= 256), "S")


class Splitter:
    """Pieces of texts by a pattern over letters, numbers and white space, with the classes of another library."""

    def __init__(self, pattern: str, classify: Callable[[str], str]):
        self.pattern, self.classify = regex.compile(pattern), classify
        self.own = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s"), "O": regex.compile("")}
        self.seen: set[str] = set()
        self.changed: dict[str, str] = {}

    def _look(self, chars: Iterable[str]) -> None:
        """Compare the classes of characters that are met for the first time."""
        for c in chars:
            if (kind := self.classify(c)) != next(k for k, p in self.own.items() if p.match(c)):
                self.changed[c] = STAND_INS[kind]
            self.seen.add(c)

    def __call__(self, text: str) -> Iterable[str]:
        if not text.isascii():
            chars = set(text)
            self._look(c for c in chars - self.seen if c >= "\x80")
            if not self.changed.keys().isdisjoint(chars):
                other = text.translate(str.maketrans(self.changed))
                return (text[m.start() : m.end()] for m in self.pattern.finditer(other))
        if len(text) > LONG:
            return (m.group() for m in self.pattern.finditer(text))
        return self.pattern.findall(text)


class Known(dict):
    """The ids of pieces, found when first asked for. When half of MEMORY is full it becomes the old half, from which used pieces return."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.find(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(file: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


class BytePairs:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must hold every byte")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.size, self.bytes_of = size, [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        #: A token's parts in its last merge; single bytes have none and come before all merges.
        self.left, self.right, self.age = [-1] * size, [-1] * size, [-1] * size
        #: The longest token that a token begins with.
        self.shorter = [-1] * size
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and not self._parts(token, rank):
                continue
            self.automaton.add_word(token.decode("latin-1"), rank)
        reached = set(self.automaton.values())
        for token, rank in ranks.items():
            prefixes = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((p for p in prefixes if p in reached), -1)
        self.automaton.make_automaton()
        self.known = Known(lambda piece: self.merge(piece.encode()))

    def _parts(self, token: bytes, rank: int) -> bool:
        """Find the two older tokens whose merge makes this one; False where merging never comes to it."""
        for n in range(1, len(token)):
            a, b = self.ranks.get(token[:n], rank), self.ranks.get(token[n:], rank)
            if a < rank and b < rank and all(self.length[x] == 1 or self.age[x] >= 0 for x in (a, b)) and self._fits(a, b, rank):
                self.left[rank], self.right[rank], self.age[rank] = a, b, rank
                return True
        return False

    def _fits(self, a: int, b: int, before: int) -> bool:
        """Whether merging by ranks under `before` the bytes of a and b ends in a and b.

        The last merges are undone one by one, the younger one of the two tokens at the seam first (of equal ones the right one: merges go
        from left to right). Two tokens that stand at the seam at the same time would have been merged, if their union came before the
        merges in which they went on to be parts of a and b.
        """
        a_until = b_until = before
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < a_until and joined < before and joined <= b_until:
                return False
            if self.age[a] > self.age[b]:
                a_until, a = a, self.right[a]
            elif self.age[b] >= 0:
                b_until, b = b, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b may be neighbours in an encoding."""
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[key] = self._fits(a, b, self.size)
        return found

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        longest = [-1] * n
        # Ends come in order, so of the tokens from one place the longest is written last.
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        is_open = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            before = ids[-1] if ids else -1
            while token >= 0 and not (is_open[at + length[token]] and (before < 0 or fits(before, token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                is_open[at] = 0
                token = ids.pop()
                at -= length[token]
        return tuple(ids)

    def encode(self, pieces: Iterable[str]) -> array:
        """Ids of a text's pieces, one behind the other."""
        return array("i", chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: The codec of this Python worker, which lives on between tasks.
_own: dict[str, tuple[BytePairs, Splitter]] = {}


def _codec(file: bytes, pattern: str) -> tuple[BytePairs, Splitter]:
    name = hashlib.sha256(file).hexdigest() + pattern
    if name not in _own:
        _own.clear()
        _own[name] = BytePairs(read_ranks(file)), Splitter(pattern, library_class(pattern))
    return _own[name]


def encode_documents(docs: DataFrame, file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row: the ids of its text by the rank file, and the bytes that they decode to.

    The file is sent to executors once; its size is that of a vocabulary. Equal to tiktoken's encode_ordinary with the same ranks and pattern.
    """
    sent = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = _codec(sent.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                coded = [own.encode(split(text)) for text in part.column("text").to_pylist()]
                bounds = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.frombuffer(c, np.int32) for c in coded])))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, pa.array(map(own.decode, coded), pa.binary())], names=["id", "ids", "decoded"])
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return in_workers(rows, run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
