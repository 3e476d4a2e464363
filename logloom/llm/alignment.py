"""Alignment of the tokens of two tokenizers over the same text, and corpus-wide counts of linked ids.

A is a byte-level BPE file of the tokenizers library, which encodes a space and the text; B is a SentencePiece model, which puts
that space there itself. Both give the same bytes, cut at different places. The tokens of B are a static interval index: their starts
and ends, in order. The tokens of B that overlap a token of A are listed by two bisections (the first one that ends after its start, the last one
that starts before its end). A gap between bytes that no token of either side spans is the boundary of a group; a group is the
smallest stretch of both sides' tokens with the same bytes. All texts of a slice are one line of bytes, as both sides end where a text ends.

Pieces of A are encoded by the library once and remembered. The classes of characters that decide where a text is split are compared
with those of the library (see byte_bpe.Splitter).

Links between ids are counted over the corpus in three steps: each text's distinct id pairs with their numbers are written to a table;
pairs are summed up, first within each task; the sums are joined back, those of the most frequent pairs by broadcast
(BROADCAST_ROWS at most), and those of rare pairs, which few texts hold, by a shuffle.

Defined results: a text that is null, empty, or whose tokens of one side do not give its bytes has no tokens: all its numbers are 0
and its groups are ""; a rare text of more than LONG characters is encoded in pieces by B, which changes nothing; repeated rows count
each by themselves, rows with null ids as well; an empty table gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Known, Splitter
from .sentencepiece_codec import LONG, MARK, Codec, pieces
from .shared import BROADCAST_ROWS, Scratch, give_back, in_workers, slices

#: Text bytes that are aligned at once.
SLICE = 1 << 19

# The pattern of byte-level tokenizer files that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level files: itself if it is printed, else the next one from 256 on."""
    printed = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Encoder of a byte-level BPE file of the tokenizers library; special tokens in a text are plain text."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        described = json.loads(file)
        steps = described["pre_tokenizer"]
        if described["normalizer"] or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        self.library = Tokenizer.from_buffer(file)
        self.library.encode_special_tokens = True
        chars = byte_characters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(chars.__getitem__, token)) if chars.keys() >= set(token) else b""
        self.split = Splitter(BYTE_LEVEL, self._class)
        self.known = Known(lambda piece: tuple(self.library.encode(piece, add_special_tokens=False).ids))

    def _class(self, char: str) -> str:
        """The class (L, N, S, O) of a character: that of the letter, digit or full stop with which it is one piece."""
        one = self.library.pre_tokenizer.pre_tokenize_str
        return next((kind for kind, lead in (("L", "A"), ("N", "1"), ("O", ".")) if len(one(lead + char)) == 1), "S")

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))


class Pieces:
    """Encoder of a SentencePiece model without begin and end ids."""

    def __init__(self, model: bytes):
        self.codec = codec = Codec(model)
        lib = codec.library
        self.bytes_of = [b"" if lib.is_control(i) or lib.is_unknown(i) else bytes([int(p[3:-1], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(lib.id_to_piece, range(lib.get_piece_size())))]
        self.ends = (codec.begin >= 0, codec.end >= 0)

    def _inner(self, ids: np.ndarray) -> np.ndarray:
        return ids[int(self.ends[0]) : len(ids) - int(self.ends[1])]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if max(map(len, texts), default=0) > LONG:
            return [np.concatenate([self._inner(self.codec.encode_flat([p])[0]) for p in pieces(t, LONG)]) for t in texts]
        ids, bounds = self.codec.encode_flat(texts)
        return [self._inner(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@dataclass
class Aligned:
    """Alignment of some texts: for each, the bounds of its tokens, groups and links in the arrays of all."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    #: Places of the linked tokens in a and b, in order.
    link_a: np.ndarray
    link_b: np.ndarray
    #: The group of each token of a and of b.
    group_a: np.ndarray
    group_b: np.ndarray


def align_ids(a: list[np.ndarray], b: list[np.ndarray], a_length: np.ndarray, b_length: np.ndarray) -> Aligned:
    """Align tokens of both sides, text by text; each text's tokens have the same number of bytes on both sides."""
    a_bounds, b_bounds = (np.concatenate(([0], np.cumsum([len(x) for x in side]))).astype(np.int64) for side in (a, b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]).astype(np.int64) for side in (a, b))
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    a_start, b_start = a_end - a_length[a], b_end - b_length[b]
    # The index over B: bisect for the first token that ends after a start, and for the end of those that start before an end.
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_start, a_end, side="left")
    number = last - first
    link_a = np.repeat(np.arange(len(a)), number)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    # A place where tokens of both sides end is a gap that nothing spans.
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    return Aligned(a, b, a_bounds, b_bounds, link_a, link_b, np.searchsorted(cuts, a_start, side="right"), np.searchsorted(cuts, b_start, side="right"))


class Aligner:
    """Both encoders, and the tables that say what their ids stand for."""

    def __init__(self, file: bytes, model: bytes):
        self.a, self.b = ByteLevel(file), Pieces(model)
        self.a_length, self.b_length = (np.array([len(x) for x in side.bytes_of], np.int64) for side in (self.a, self.b))
        # Ids with what follows them: another id of the side, or the end of the side's part of the group.
        self.texts = [np.array([f"{i}{end}" for i in range(len(side.bytes_of))], object) for side, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The tokens of both sides; none on both where those of one do not give the bytes of the text, or hold one without bytes."""
        none = np.zeros(0, np.int64)
        a_ids, b_ids = [np.array(self.a.encode(" " + t), np.int64) if t else none for t in texts], self.b.encode_many(texts)
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or any(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != whole or not length[ids].all() for side, ids, length in ((self.a, a_ids[k], self.a_length), (self.b, b_ids[k], self.b_length))):
                a_ids[k] = b_ids[k] = none
        return a_ids, b_ids

    def groups(self, found: Aligned) -> list[str]:
        """Each text's groups as text: ids of A, `|`, ids of B; groups are divided by `;`, ids by `,`."""
        n_a, n_b = len(found.a), len(found.b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (found.group_a, found.group_b))
        # The tokens of both sides in one line: a token stands behind all tokens of both sides' earlier groups, and B's behind A's of the group.
        at_a = np.arange(n_a) + np.searchsorted(found.group_b, found.group_a, side="left")
        at_b = np.arange(n_b) + np.searchsorted(found.group_a, found.group_b, side="right")
        parts = np.empty(n_a + n_b, object)
        for at, ids, last, (inner, final) in ((at_a, found.a, last_a, self.texts[:2]), (at_b, found.b, last_b, self.texts[2:])):
            parts[at[~last]] = inner[ids[~last]]
            parts[at[last]] = final[ids[last]]
        bounds = (found.a_bounds + found.b_bounds).tolist()
        return ["".join(parts[x:y].tolist())[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _aligner(name: str, file: bytes, model: bytes) -> Aligner:
    """The aligner of this Python worker, which lives on between tasks."""
    return Aligner(file, model)


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<pair: long, number: int>>"


def align(docs: DataFrame, file: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs) of every row, and the number of ids of B.

    groups: see Aligner.groups. pairs: the distinct linked ids of the text as id of A times the number of ids of B plus id of B, with the
    number of links that hold them. file and model are sent to executors once; their size is that of vocabularies.
    """
    sent = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(file + model).hexdigest(), file, model))
    size = Codec(model).library.get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*sent.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = align_ids(*own.tokens(part.column("text").to_pylist()), own.a_length, own.b_length)
                n = part.num_rows
                # Links are in the order of texts, so texts times pairs sort into runs of equal pairs of a text.
                owner = np.searchsorted(found.a_bounds, found.link_a, side="right") - 1
                pair = found.a[found.link_a] * size + found.b[found.link_b]
                order = np.lexsort((pair, owner))
                owner, pair = owner[order], pair[order]
                new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))[: len(pair)])
                bounds = np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32)
                number = np.diff(np.append(new, len(pair))).astype(np.int32)
                pairs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(pair[new]), pa.array(number)], names=["pair", "number"]))
                group = np.concatenate((found.group_a, [found.group_a[-1] + 1 if len(found.group_a) else 0]))[found.a_bounds]
                columns = [np.diff(found.a_bounds), np.diff(found.b_bounds), np.diff(group), np.bincount(owner, minlength=n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(own.groups(found), pa.string()), pairs], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])
        own.b.codec.forget()
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return in_workers(rows, run, ALIGNED).withColumnRenamed("id", id_col), size


def pair_counts(pairs: DataFrame, size: int) -> DataFrame:
    """(pair, links, best) of rows (pair, number): the links of each id pair, and whether no pair with the same id of B has more."""
    counts = pairs.groupBy("pair").agg(F.sum("number").alias("links"))
    most = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("links").alias("most"))
    # At most one row for each id of B.
    return counts.join(F.broadcast(most), F.col("pair") % size == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _with_counts(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pairs with the columns of counts (a written table): frequent pairs by broadcast, the others by a shuffle."""
    sizes = counts.groupBy(F.floor(F.log2("links")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()  # 63 rows at most
    total, least = 0, (1 << 63) - 1
    for row in sizes:
        if (total := total + row["count"]) > BROADCAST_ROWS:
            break
        least = 1 << row["size"]
    else:
        return pairs.join(F.broadcast(counts), "pair")
    frequent = F.broadcast(counts.where(F.col("links") >= least))
    found = pairs.join(frequent, "pair", "left")
    rare = found.where("links IS NULL").drop("links", "best").join(counts, "pair")
    return found.where("links IS NOT NULL").unionByName(rare)


def linked_counts(docs: DataFrame, file: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best: links whose pair has the most links that any pair with its id of B has in the corpus; count_sum: the sum over links of their
    pairs' links in the corpus. The hash of a text without tokens is "".
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    found, size = align(docs, file, model, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    texts = scratch.keep(found.select(F.monotonically_increasing_id().alias("row"), id_col, "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs"), "texts", as_it_is=True)
    counts = scratch.keep(pair_counts(texts.select(F.inline("pairs")), size), "counts")
    each = _with_counts(texts.select("row", F.inline("pairs")), counts)
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("number")).otherwise(0)).alias("n_best"), F.sum(F.col("number") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return texts.drop("pairs").join(sums, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
