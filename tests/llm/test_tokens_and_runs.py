"""Operators 11 to 13: byte-level BPE, alignment of tokenizers, periodic runs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import alignment, byte_bpe, periodic_runs, queries

SYLLABLES = ["the", "ing", "tion", " and", "'s", "  ", "\n", "\t \n", "é", "ß", "año", "日本", "🎉", "123", "¼", ".", "<|endoftext|>", "<0x41>", "▁", "\x00", "՘", "\U00016ea7", "\x85", "aaaa", "ab"]


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(SYLLABLES) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts += ["", None, " ", "a" * 5000, "the cat " * 300, "\n\n\n", texts[0], texts[0]]
    rows = [(i if i % 50 else None, t, 0, "k", [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, pair string, runs array<int>").repartition(5)


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks_file():
    return queries.vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks_file):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks_file), special_tokens={})


@pytest.fixture(scope="module")
def pairs(ranks_file):
    return byte_bpe.BytePairs(byte_bpe.read_ranks(ranks_file))


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Brute force: merge the leftmost pair of least rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"e", b"in", b"the", b" ", b"tion", b"\xc3", b"\xa9", b"\xe2\x96", b"aa", b"0", b"_"]), max_size=25).map(b"".join))
def test_pieces_equal_merges(pairs, piece):
    assert list(pairs.merge(piece)) == merged(pairs.ranks, piece)
    assert pairs.decode(pairs.merge(piece)) == piece


def test_small_vocabularies_equal_merges():
    """Vocabularies trained on few letters, in which walks go back and equal tokens meet."""
    r = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        letters = [bytes([r.choice(b"abc")]) for _ in range(300)]
        for _ in range(r.randint(1, 25)):
            found = collections.Counter(a + b for a, b in zip(letters, letters[1:], strict=False) if a + b not in ranks)
            if not found:
                break
            new = found.most_common(1)[0][0]
            ranks[new] = len(ranks)
            out, i = [], 0
            while i < len(letters):
                two = i + 1 < len(letters) and letters[i] + letters[i + 1] == new
                out.append(new if two else letters[i])
                i += 1 + two
            letters = out
        own = byte_bpe.BytePairs(ranks)
        for _ in range(100):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(0, 30)))
            assert list(own.merge(piece)) == merged(ranks, piece), (ranks, piece)


def test_unreachable_tokens_are_whole_pieces_only():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    own = byte_bpe.BytePairs(ranks)
    for piece in (b"abcd", b"abcda", b"xabcd", b"ab", b""):
        assert list(own.merge(piece)) == (merged(ranks, piece) if piece else [])
    with pytest.raises(ValueError):
        byte_bpe.BytePairs({b"a": 0})


def test_pieces_as_the_library_splits(pairs, library):
    """All classes of characters, those of newer Unicode versions included."""
    split = byte_bpe.Splitter(public.PATTERN, byte_bpe.library_class(public.PATTERN))
    chars = [c for c in [*range(0x300), *range(0x300, 0x30000, 37), *range(0x16E90, 0x16EE0), *range(0x11DE0, 0x11DEA)] if not 0xD800 <= c < 0xE000]
    for c in chars:
        text = f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}\n"
        assert list(pairs.encode(split(text))) == library.encode_ordinary(text), hex(c)


def test_very_long_pieces_and_little_memory(pairs, library, monkeypatch):
    text = "a" * 70_000 + "the" * 10_000 + " \n" * 5_000 + "ab" * 9_000
    split = byte_bpe.Splitter(public.PATTERN, byte_bpe.library_class(public.PATTERN))
    expected = library.encode_ordinary(text)
    assert list(pairs.encode(split(text))) == expected
    monkeypatch.setattr(byte_bpe, "LONG", 10)
    monkeypatch.setattr(byte_bpe, "MEMORY", 4)
    assert list(pairs.encode(split(text + " the cat's 12 hats"))) == library.encode_ordinary(text + " the cat's 12 hats")


def test_encoded_documents_equal_the_library(docs, ranks_file, library):
    coded = byte_bpe.encode_documents(docs, ranks_file, public.PATTERN)
    found = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(coded).collect())
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id is None, r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert found == sorted(expected)
    assert byte_bpe.digests(byte_bpe.encode_documents(docs.limit(0), ranks_file, public.PATTERN)).count() == 0


# Alignment


@pytest.fixture(scope="module")
def files():
    return queries.vocabulary("byte_bpe_50k.json"), queries.piece_model()


def plain_alignment(rows):
    """Brute force over all pairs of tokens of each text, by the libraries."""
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    chars = alignment.byte_characters()

    def piece(i):
        p = lib.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode()

    texts, counts = [], collections.Counter()
    for row, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = lib.encode(text)
            sides = [[bytes(chars[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]]
            if any(b"".join(s) != (" " + text).encode() for s in sides):
                a, b = [], []
        if a:
            spans = []
            for s in sides:
                ends = np.cumsum([len(x) for x in s]).tolist()
                spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
            links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
            last = 0
            for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, span, strict=True) if last <= s and e <= cut) for ids, span in zip((a, b), spans, strict=True)))
                last = cut
        counts.update(links)
        texts.append((row, len(a), len(b), links, groups))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(row, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(groups)) if n_a else "") for row, n_a, n_b, links, groups in texts]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("few", [400_000, 300, 0])
def test_alignment_equals_brute_force(docs, files, few, monkeypatch):
    """With all counts sent by broadcast, with some, and with none."""
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", few)
    some = docs.where("length(text) < 3000 OR text IS NULL")
    found = [tuple(r) for r in alignment.linked_counts(some, *files).collect()]
    assert in_order(found) == in_order(plain_alignment([(r.doc_id, r.text) for r in some.collect()]))
    assert sum(r[1] == 0 for r in found) > 2


def test_groups_and_pairs_of_a_text(spark, files):
    found, size = alignment.align(spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string"), *files)
    row, none = found.orderBy("doc_id").collect()
    a, b = (side.split(",") for side in row.groups.replace(";", "|").split("|")[:2])
    assert row.n_groups == row.groups.count(";") + 1
    assert int(a[0]) * size + int(b[0]) in {p.pair for p in row.pairs}
    assert sum(p.number for p in row.pairs) == row.n_links
    assert (none.n_a, none.n_b, none.n_groups, none.n_links, none.groups, none.pairs) == (0, 0, 0, 0, "", [])


def test_alignment_of_long_texts_and_no_rows(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 40)
    docs = spark.createDataFrame([(1, "the  cats and  the dogs \n are thinking of  " * 5), (2, "x" * 500)], "doc_id long, text string")
    found = [tuple(r) for r in alignment.linked_counts(docs, *files).collect()]
    assert in_order(found) == in_order(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    assert alignment.linked_counts(docs.limit(0), *files).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        alignment.ByteLevel(queries.vocabulary("word_bpe_49k.json"))


# Periodic runs


def plain_runs(words, least=4, shortest=6):
    """Brute force: extend from every start and period, keep smallest periods of maximal stretches."""
    found = {}
    n = len(words)
    for p in range(1, n // least + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, least * p):
                found.setdefault((i, j + p), p)
            i = j
    return [(s, e - s, p) for (s, e), p in sorted(found.items(), key=lambda x: (x[0][0], x[1]))]


def plain_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_words(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=6))
def test_runs_equal_brute_force(texts):
    texts = [[w.encode() for w in t] for t in texts]
    rows, bounds = periodic_runs.find_runs(texts, 4, 6)
    for k, words in enumerate(texts):
        assert [tuple(r) for r in rows[bounds[k] : bounds[k + 1], 1:].tolist()] == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=7), st.integers(1, 9)), max_size=8), st.integers(3, 5))
def test_runs_of_repeated_blocks_equal_brute_force(blocks, least):
    words = [w.encode() for block, n in blocks for w in block * n]
    rows, _ = periodic_runs.find_runs([words, words], least, 3)
    own = [tuple(r) for r in rows[rows[:, 0] == 1, 1:].tolist()]
    assert own == plain_runs(words, least, 3)
    assert periodic_runs.collapsed(words, np.array(own, np.int64).reshape(-1, 3)).decode() == plain_collapsed([w.decode() for w in words], own)


def test_few_queries_at_once(monkeypatch):
    monkeypatch.setattr(periodic_runs, "QUERIES", 3)
    words = [b"a"] * 50 + [b"b", b"c"] * 20 + [b"a"] * 9
    rows, _ = periodic_runs.find_runs([words], 4, 6)
    assert [tuple(r) for r in rows[:, 1:].tolist()] == plain_runs(words)


def test_extensions_equal_brute_force():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 60):
        values = r.integers(0, 2, n)
        own = periodic_runs.Extensions(values)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        keep = i != j
        i, j = i[keep], j[keep]
        expected = [next((k for k in range(n + 1) if max(a, b) + k >= n or values[a + k] != values[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert own.common(i, j).tolist() == expected


def test_documents_with_runs(spark, docs):
    r = random.Random(4)
    more = [(1000 + k, " ".join(r.choice("abc") for _ in range(r.randint(0, 80)))) for k in range(300)] + [(7, "x y\tz " * 5 + "\x0b\x1cw"), (None, "a " * 30), (7, "x y\tz " * 5 + "\x0b\x1cw"), (5, "b " * 40_000)]
    every = docs.select("doc_id", "text", "id", "pair", "runs").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = [tuple(x) for x in periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(every))).collect()]
    expected, planted = [], 0
    for row in every.collect():
        words = plain_words(row.doc_id, row.text)
        planted += words != plain_words(None, row.text)
        runs = plain_runs(words) if len(words) < 3000 else [(0, len(words), 1)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.append((row.doc_id, len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapsed(words, runs))))
    assert in_order(found) == in_order(expected)
    assert planted > 10 and sum(x[1] > 0 for x in found) > 50
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least=2)


# Joins that shuffle only what finds something


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sieved_joins_equal_joins(spark, monkeypatch, how):
    from pyspark.sql import functions as F

    from logloom.llm import shared

    rows = spark.range(5000).select((F.col("id") % 3000).alias("a"), F.concat(F.lit("x"), F.col("id") % 7).alias("b"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("sieve_bit"))
    rows = rows.union(rows.limit(1).select(F.lit(None).cast("long"), F.lit("x1"), F.lit(1).cast("long")))
    table = spark.range(0, 900, 2).select(F.col("id").alias("a"), F.concat(F.lit("x"), F.col("id") % 7).alias("b"), (F.col("id") * 10).alias("value"))
    plain = sorted(map(str, rows.join(table, ["a", "b"], how).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    found = shared.wanted(rows, table, ["a", "b"], how)
    assert sorted(map(str, found.collect())) == plain and len(plain) > 0
    joined, may = shared._sieved(rows, table, ["a", "b"], 450)
    assert joined.where(may).count() < 1500


def test_later_updates_shuffle_no_old_texts(spark, monkeypatch, tmp_path):
    """Of a second update with few new texts, only these may move, even with nothing broadcast."""
    from logloom.llm import secrets, shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    scanned, let_through = [], []
    own, sieved = secrets.scan_blobs, shared._sieved
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: scanned.append(blobs.count()) or own(blobs, rules))

    def spied(rows, *args):
        joined, may = sieved(rows, *args)
        let_through.append(joined.where(may).count())
        return joined, may

    monkeypatch.setattr(shared, "_sieved", spied)
    old = [(i, f"text {i} " + "lorem " * 200) for i in range(800)]
    new = [(1000 + i, f"password = abcdefghijkl{i}") for i in range(5)] + [(1000, "password = abcdefghijkl0")]
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ledger.update(frame(old)) == 800
    let_through.clear()
    assert ledger.update(frame(old + new)) == 5 and ledger.update(frame(old + new)) == 0
    found = {r.doc_id: len(r.spans) for r in ledger.findings(frame(old + new)).collect()}
    assert all(found[d] == (d >= 1000) for d in found) and len(found) == 805
    # The sieve lets the new texts and a few others through to the join.
    assert scanned == [800, 5] and let_through and max(let_through) < 80


def test_scratch_on_local_disks_of_a_cluster_is_refused():
    from types import SimpleNamespace

    from logloom.llm.shared import shared_folder

    def session(master, warehouse, **given):
        held = {"spark.sql.warehouse.dir": warehouse, **given}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__), sparkContext=SimpleNamespace(master=master))

    for master, warehouse in (("yarn", "file:/x"), ("local-cluster[2,1,512]", "spark-warehouse")):
        with pytest.raises(ValueError):
            shared_folder(session(master, warehouse))
    assert shared_folder(session("local[4]", "file:/x/")) == "file:/x/_checkpoints" and shared_folder(session("yarn", "hdfs://n/w")) == "hdfs://n/w/_checkpoints"
    assert shared_folder(session("yarn", "file:/x", **{"spark.checkpoint.dir": "s3a://b/c"})) == "s3a://b/c"


def test_an_id_with_different_texts_joins_their_links(spark):
    from logloom.llm.ngram_join import Jaccard, jaccard_components

    a, b = ("one two three four five six seven eight nine ten " * 3, "red green blue cyan pink gold grey teal lime navy " * 3)
    docs = spark.createDataFrame([(8, a), (8, b), (9, a + "end"), (10, b + "end"), (11, "other words alone are these five")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in jaccard_components(docs, Jaccard(width=4, num=80, den=100)).collect()}
    assert found == {(8, 8), (9, 8), (10, 8), (11, 11)}
