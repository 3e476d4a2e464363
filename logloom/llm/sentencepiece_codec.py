"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A text is escaped (a leading mark, marks for spaces) and starts as one symbol for each character. An agenda holds the
adjacent pairs whose union is a piece, best score first, ties leftmost; the best pair is merged and its new
neighbours join the agenda until none is left. Symbols outside the vocabulary fall back to byte pieces.

Two neighbours that no piece holds side by side are never merged, nor anything across them. Texts are cut at all such
places, which leaves merges and their order as they are, and each distinct cut is merged once and remembered (a bounded
memory for each task, by a 64-bit hash).

Short cuts go through the agenda together: one row of a matrix for each cut holds the scores of its adjacent pairs, and
each step takes the best pair of every row. Long ones have a heap of their own. Both give the same ids.

The sentencepiece library checks all of it in the same Arrow batch: the ids of every whole text, however long, and the decoded text of
all ids of every text. A row with a difference gets the library's ids and text, and `agrees` is false.
Defined results: a null text counts as empty; an empty text has only the begin and end ids and decodes to "";
repeated rows and null ids are returned as they are; other columns are ignored whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, in_workers, slices
from .textkernel import BASE, mix

MARK = "▁"
#: Cuts that a task remembers at most; the longest cut that is remembered; widths of the matrices.
MEMORY, LONGEST, WIDTHS = 200_000, 256, (8, 12, 20, 32)
#: Text bytes that are coded at once; a text of more than LONG characters is coded in pieces.
SLICE, LONG = 1 << 18, 1 << 20
NEVER = np.iinfo(np.int32).max

SCHEMA = "id long, ids array<int>, decoded string, agrees boolean"


class Table:
    """Row numbers by 64-bit key: open addressing, all keys of a call together. Empty places hold row -1."""

    def __init__(self, room: int):
        self.slots = 1 << max(4, int(np.ceil(np.log2(max(room, 1) * 2.5))))
        self.keys, self.rows = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> np.uint64(32)).astype(np.int64) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 where there is none."""
        at = self._slot(keys)
        rows = self.rows[at]
        moved = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        while len(moved):
            at[moved] = on = (at[moved] + 1) & (self.slots - 1)
            rows[moved] = self.rows[on]
            moved = moved[(rows[moved] >= 0) & (self.keys[on] != keys[moved])]
        return rows

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            # Of those that ask for one free place, one gets it.
            free = left[self.rows[at[left]] < 0]
            self.rows[at[free]] = rows[free]
            won = free[self.rows[at[free]] == rows[free]]
            self.keys[at[won]] = keys[won]
            left = left[self.rows[at[left]] != rows[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary file (the bytes of a .model file of merge type)."""

    model: bytes

    def __post_init__(self) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.rank = {p: (-lib.get_score(i), i) for i, p in enumerate(pieces) if not special[i]}
        self.byte = {int(pieces[i][3:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self._tabulate()
        # What each id decodes to, as bytes; bytes of byte pieces are put together before they are read.
        surface = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(p[3:-1], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.surface, self.surfaces = surface, np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_length) - self.surface_length
        self.is_byte = np.array([lib.is_byte(i) for i in range(size)])
        self.is_control = np.array([lib.is_control(i) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Remember only two cuts: the begin id and the end id."""
        self.known = Table(MEMORY)
        self.ids = np.array([i for i in (self.begin, self.end) if i >= 0], np.int32)
        self.lengths = np.array([self.begin >= 0, self.end >= 0], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of an escaped text, by the agenda."""
        rank = self.rank
        if (whole := rank.get(text)) is not None and len(text) <= 2:
            return (whole[1],)
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            if pair in rank:
                agenda.append((rank[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue  # one of its symbols has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (joined := pair + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[joined][0], i, joined))
            if (h := before[i]) >= 0 and (joined := symbols[h] + pair) in rank:
                heapq.heappush(agenda, (rank[joined][0], h, joined))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if s in rank:
                    ids.append(rank[s][1])
                elif self.byte:
                    ids += [self.byte[b] for b in s.encode()]
                else:
                    ids.append(self.unknown)
        return tuple(ids)

    def _tabulate(self) -> None:
        """Pairs of symbols whose union is a piece, with their place in the order of scores; pairs of characters that some piece holds."""
        ordered = sorted(self.rank, key=lambda p: self.rank[p][0])
        place, last = {}, None
        for p in ordered:  # equal scores have equal places
            place[p] = len(place) if last is None or self.rank[p][0] != last[0] else last[1]
            last = (self.rank[p][0], place[p])
        # Characters come first.
        own = {c: i for i, c in enumerate(dict.fromkeys("".join(self.rank)))}
        self.n_chars = len(own)
        for p in self.rank:
            own.setdefault(p, len(own))
        self.n_symbols = len(own)
        self.symbol_id = np.full(len(own), -1, np.int32)
        for p, i in own.items():
            if p in self.rank:
                self.symbol_id[i] = self.rank[p][1]
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in list(own)[: self.n_chars]]] = np.arange(self.n_chars)
        pairs = [(own[p[:k]] * self.n_symbols + own[p[k:]], place[p], own[p]) for p in self.rank for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        keys, self.pair_place, self.pair_joined = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (np.uint64, np.int32, np.int32), strict=True))
        self.pair_table = Table(len(keys))
        self.pair_table.add(keys, np.arange(len(keys), dtype=np.int32))
        beside = np.zeros((self.n_chars, self.n_chars), bool)
        for p in self.rank:
            if len(p) > 1:
                chars = [own[c] for c in p]
                beside[chars[:-1], chars[1:]] = True
        self.beside = np.packbits(beside.ravel(), bitorder="little")

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of pairs of symbols; NEVER where the union is no piece."""
        row = self.pair_table.find(left.astype(np.uint64) * np.uint64(self.n_symbols) + right.astype(np.uint64))
        return np.where(row >= 0, self.pair_place[row], NEVER), self.pair_joined[row]

    def _starts(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where cuts start: at the given starts of texts, and between neighbours that no piece holds side by side."""
        chars = self.char[codes]
        left, right = chars[:-1].astype(np.int64), chars[1:]
        at = np.maximum(left * self.n_chars + right, 0)
        start = np.ones(len(codes), bool)
        start[1:] = ((self.beside[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0) | (left < 0) | (right < 0)
        start[texts[texts < len(codes)]] = True
        return np.flatnonzero(start)

    def merge_many(self, cuts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts of `width` characters at most, merged together: all ids, and the number of each cut's."""
        n = len(cuts)
        lengths = np.fromiter(map(len, cuts), np.int64, n)
        chars = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(n), lengths)
        # A place more than the width stands for the end of every row.
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[row, np.arange(len(chars)) - np.repeat(first, lengths)] = self.char[chars]
        odd = np.zeros(n, bool)
        odd[row[self.char[chars] < 0]] = True
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        after = np.where(after >= lengths[:, None], width, after)
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        places = np.full((n, width + 1), NEVER, np.int32)
        joined = np.zeros((n, width + 1), np.int32)
        r, c = np.nonzero((symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0))
        places[r, c], joined[r, c] = self._pair(symbols[r, c], symbols[r, c + 1])
        there = np.arange(width + 1) < lengths[:, None]
        rows = np.flatnonzero(~odd)
        while len(rows):
            i = places[rows].argmin(1)
            more = places[rows, i] != NEVER
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            j = after[rows, i]
            symbols[rows, i] = joined[rows, i]
            there[rows, j], places[rows, j] = False, NEVER
            k = after[rows, j]
            after[rows, i] = k
            places[rows, i] = NEVER
            on = k < width
            rk, ik, kk = rows[on], i[on], k[on]
            before[rk, kk] = ik
            places[rk, ik], joined[rk, ik] = self._pair(symbols[rk, ik], symbols[rk, kk])
            h = before[rows, i]
            on = h >= 0
            rh, ih, hh = rows[on], i[on], h[on]
            places[rh, hh], joined[rh, hh] = self._pair(symbols[rh, hh], symbols[rh, ih])
        found, counts = self.symbol_id[symbols[there]], there.sum(1)
        odd[np.nonzero(there)[0][found < 0]] = True
        if odd.any():
            # Characters outside the vocabulary fall back to bytes, whose number differs.
            parts = np.split(found, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd).tolist():
                parts[k] = np.array(self.merge(cuts[k]), np.int32)
                counts[k] = len(parts[k])
            found = np.concatenate(parts)
        return found, counts

    def _learn(self, cuts: list[str]) -> np.ndarray:
        """Put the ids of new cuts behind the others; the row of each."""
        widths = np.array([*WIDTHS, 0])[np.searchsorted(WIDTHS, np.fromiter(map(len, cuts), np.int64, len(cuts)))]
        rows, ids, lengths = np.zeros(len(cuts), np.int32), [self.ids], [self.lengths]
        n = len(self.lengths)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            some = [cuts[k] for k in own.tolist()]
            if width:
                found, counts = self.merge_many(some, width)
            else:
                each = [self.merge(c) for c in some]
                found, counts = np.array(list(chain.from_iterable(each)), np.int32), np.array([len(x) for x in each])
            rows[own] = np.arange(n, n + len(own))
            n += len(own)
            ids.append(found)
            lengths.append(counts)
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        self.places = np.cumsum(self.lengths) - self.lengths
        return rows

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with begin and end ids, one text behind the other, and the bounds of each text."""
        escaped = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(escaped)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, escaped), np.int64, len(texts)))))
        starts = self._starts(codes, bounds[:-1]) if len(codes) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(codes)))
        rows = np.zeros(0, np.int32)
        if len(starts):
            within = np.arange(len(codes)) - np.repeat(starts, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), BASE))
            keys = mix(np.add.reduceat((codes + np.uint64(1)) * powers[within], starts) + lengths.astype(np.uint64))
            rows = self.known.find(keys)
            fresh = np.flatnonzero(rows < 0)
            if len(fresh):
                new, first, which = np.unique(keys[fresh], return_index=True, return_inverse=True)
                if len(self.lengths) + len(new) > MEMORY:
                    self.forget()
                    rows = np.full(len(keys), -1, np.int32)
                    new, cut, which = np.unique(keys, return_index=True, return_inverse=True)
                    where = np.arange(len(keys))
                else:
                    cut, where = fresh[first], fresh
                found = self._learn([joined[a : a + n] for a, n in zip(starts[cut].tolist(), lengths[cut].tolist(), strict=True)])
                rows[where] = found[which]
                if len(self.lengths) <= MEMORY:
                    short = lengths[cut] <= LONGEST
                    self.known.add(new[short], found[short])
        # Each text's cuts between the begin id (row 0) and the end id (row 1).
        cuts = np.searchsorted(starts, bounds)
        every = np.zeros(len(rows) + 2 * len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
        every[np.arange(len(rows)) + 2 * owner + 1] = rows
        every[cuts[1:] + 2 * np.arange(len(texts)) + 1] = 1
        counts = self.lengths[every]
        ends = np.cumsum(counts)
        at = np.repeat(self.places[every] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[at]
        text_ends = np.concatenate(([0], ends[cuts[1:] + 2 * np.arange(len(texts)) + 1])) if len(texts) else np.zeros(1, np.int64)
        if len(self.lengths) > MEMORY or len(self.ids) > 20 * MEMORY:
            self.forget()
        return ids, text_ends

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts with begin and end ids."""
        ids, bounds = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: the space of the leading mark goes, runs of byte pieces are read as UTF-8 and their bad bytes replaced."""
        ids, parts, start = np.asarray(ids, np.int64), [], 0
        # A control id ends a run of byte pieces.
        for k in [*np.flatnonzero(self.is_control[ids]).tolist(), len(ids)]:
            if k > start:
                raw = b"".join(map(self.surface.__getitem__, ids[start:k].tolist()))
                if not parts and raw.startswith(b" ") and not self.is_byte[ids[start]] and ids[start] != self.unknown:
                    raw = raw[1:]
                parts.append(raw.decode(errors="each-byte"))
            start = k + 1
        return "".join(parts)

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids one behind the other. Control ids stand at the ends of a text; texts with others go through `decode`."""
        lengths = self.surface_length[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        raw = self.surfaces[np.repeat(self.surface_at[ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        inner = np.concatenate(([0], np.cumsum(~self.is_control[ids])))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first, last = a, b
            while first < last and self.is_control[ids[first]]:
                first += 1
            while last > first and self.is_control[ids[last - 1]]:
                last -= 1
            if inner[last] - inner[first] < last - first:
                out.append(self.decode(ids[a:b]))
                continue
            start, stop = ends[first], ends[last]
            if first < last and raw[start : start + 1] == b" " and not self.is_byte[ids[first]] and ids[first] != self.unknown:
                start += 1
            out.append(raw[start:stop].decode(errors="each-byte"))
        return out


def pack(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))


def pieces(text: str, size: int) -> list[str]:
    """Texts of about `size` characters whose ids make up those of the text.

    A text is cut at a space after another character: the mark of that space is the one that leads the next piece.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) > 0 and text[at - 1] in (" ", MARK):
            at += 1
        # The library puts no mark before an empty text.
        if at < 0 or at + 1 == len(text):
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


#: The codec of this Python worker, which lives on between tasks.
_own: dict[str, Codec] = {}


def _codec(model: bytes) -> Codec:
    name = hashlib.sha256(model).hexdigest()
    if name not in _own:
        _own.clear()
        _own[name] = Codec(model)
    return _own[name]


def encode_pieced(own: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the bounds of each text's, by the agenda; a text of more than LONG characters in pieces, which changes nothing."""
    if max(map(len, texts), default=0) <= LONG:
        return own.encode_flat(texts)
    found = []
    for text in texts:
        inner = [own.encode_flat([piece])[0][int(own.begin >= 0) :] for piece in pieces(text, LONG)]
        inner = [ids[: len(ids) - int(own.end >= 0)] for ids in inner]
        found.append(np.concatenate([[i for i in (own.begin,) if i >= 0], *inner, [i for i in (own.end,) if i >= 0]]).astype(np.int32))
    return np.concatenate(found), np.concatenate(([0], np.cumsum([len(x) for x in found])))


def _coded(model: bytes):
    """For slices of rows: the rows, all ids, the bounds of each row's, the decoded texts, and whether the library gives the same of the whole text.

    A row of which it does not gets what the library gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str], np.ndarray]]:
        own = _codec(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                ids, bounds = encode_pieced(own, texts)
                there = own.library.encode(texts, add_bos=own.begin >= 0, add_eos=own.end >= 0, num_threads=1)
                counts = np.fromiter(map(len, there), np.int64, len(there))
                theirs = np.fromiter(chain.from_iterable(there), np.int32, int(counts.sum()))
                agree = np.ones(len(texts), bool)
                if not np.array_equal(counts, np.diff(bounds)) or not np.array_equal(theirs, ids):
                    agree = np.array([x == ids[a:b].tolist() for x, a, b in zip(there, bounds[:-1], bounds[1:], strict=True)])
                    ids, bounds = theirs, np.concatenate(([0], np.cumsum(counts)))
                decoded = own.decode_flat(ids, bounds)
                if (said := own.library.decode(there, num_threads=1)) != decoded:
                    agree &= np.array([x == y for x, y in zip(said, decoded, strict=True)])
                    decoded = said
                yield part, ids, bounds, decoded, agree
        own.forget()
        give_back()

    return run


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded, agrees) of every row: its ids with begin and end, what they decode to, and whether the library gave the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds, decoded, agree in _coded(model)(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string()), pa.array(agree)], names=["id", "ids", "decoded", "agrees"])

    return _texts(docs, id_col, text_col).transform(in_workers, run, SCHEMA).withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, agrees) of every row, without shipping ids and texts out of the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds, decoded, agree in _coded(model)(batches):
            packed = ids.astype("<u4").tobytes()
            digests = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            texts = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(agree)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return _texts(docs, id_col, text_col).transform(in_workers, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean").withColumnRenamed("id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
