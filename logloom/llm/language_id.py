"""Language identification of whole texts, with spans of mixed-language text.

Script ranges narrow the candidates of each word: a language is a candidate where its learned share of letters in the
word's script reaches SCRIPT_SHARE. Candidates get a score for the word: the sum of log-probabilities of its hashed
character n-grams (with word ends) and of the word itself. Viterbi over the words of a text, with a penalty for each
switch, labels spans; the text's language is the one whose spans hold most letters.

A text whose best single language no excursion can beat (no run of words gains more than half the penalty for another
language) is labelled at once; the others go through the full recursion. Both give the best path.

Defined results: a null text, or one without a letter, is `und` with score 0; words in scripts of no learned language have
all languages as candidates; a text's score is the share of its letters in spans of its language times the confidence in that
language; ties go to the first language in alphabetical order. Without learned rows every text is `und`. Rows that repeat an id, and
null ids, are each returned; a null id is in no fold (`fold` is null, so it is not learned from); other columns are ignored whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import free_name, in_workers, slices
from .textkernel import BASE, mix

UND = "und"
#: Buckets of character n-grams and of words, longest n-gram, additive smoothing, and the weight of a whole word.
GRAM_BITS, WORD_BITS, LONGEST, SMOOTH = 16, 16, 3, 0.5
#: Cost of a switch, in units of log-probability.
PENALTY = 12.0
#: Least share of a language's letters that makes it a candidate for a script.
SCRIPT_SHARE = 0.002
#: Rows on which the model is fitted at most; a larger set is thinned evenly by hash of the id.
FIT_ROWS = 40_000
#: Code points of text expanded at once; a text of more than LONG is read in pieces, cut at white space.
SLICE, LONG = 1 << 18, 1 << 20

# First code point of each run of letters of a script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_NUMBERS = np.array([NAMES.index(name) for _, name in SCRIPTS])


def _letters() -> np.ndarray:
    """For each code point of the basic plane: whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _marks() -> np.ndarray:
    """For each code point of the basic plane: whether it is a mark that may stand within a word."""
    return np.array([unicodedata.category(chr(c)).startswith("M") for c in range(0x10000)])


def _lower() -> np.ndarray:
    return np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x10000)], np.uint32)


@dataclass
class Words:
    """Words (runs of letters) of a slice of texts, with the hashes of their n-grams."""

    text: np.ndarray  #: the text of each word
    letters: np.ndarray  #: the number of its letters
    script: np.ndarray
    start: np.ndarray  #: its place in the text
    grams: list[np.ndarray]  #: for each size the bucket of each n-gram, in order of words
    starts: list[np.ndarray]  #: for each size the place of each word's first
    whole: np.ndarray  #: bucket of the word


class Reader:
    """Cuts texts into words; holds the tables of letters."""

    def __init__(self) -> None:
        self.letters, self.marks, self.lower = _letters(), _marks(), _lower()

    def words(self, texts: list[str]) -> Words:
        # A zero parts the texts; it is no letter.
        joined = "\0".join(texts) + "\0"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        low = np.minimum(raw, 0xFFFF)
        letter, high = self.letters[low], np.flatnonzero(raw > 0xFFFF)
        if len(high):
            seen, at = np.unique(raw[high], return_inverse=True)
            letter[high] = np.array([chr(c).isalpha() for c in seen])[at]
        inside = letter | self.marks[low] & (raw <= 0xFFFF)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        # A run of marks alone is no word.
        total = np.concatenate(([0], np.cumsum(letter)))
        some = total[stops] > total[starts]
        starts, stops = starts[some], stops[some]
        text = np.searchsorted(ends, starts, side="right")
        n = stops - starts
        if not len(starts):
            none = np.zeros(0, np.int64)
            return Words(none, none, none, none, [none] * LONGEST, [none] * LONGEST, none)
        # Each word between two ends (0): length + 2 places.
        padded = n + 2
        first = np.concatenate(([0], np.cumsum(padded)))
        places = np.arange(first[-1]) - np.repeat(first[:-1], padded)
        source = np.repeat(starts, padded) + places - 1
        edge = (places == 0) | (places == np.repeat(padded, padded) - 1)
        chars = np.where(edge, 0, raw[np.clip(source, 0, len(raw) - 1)])
        chars = np.where(chars <= 0xFFFF, self.lower[np.minimum(chars, 0xFFFF)], chars).astype(np.uint64)
        left = np.repeat(padded, padded) - places
        grams, firsts = [], []
        h = chars + np.uint64(1)
        for size in range(1, LONGEST + 1):
            if size > 1:
                h = h[:-1] * BASE + chars[size - 1 :] + np.uint64(size)
            within = ~edge if size == 1 else left[: len(h)] >= size
            grams.append((mix(h[within]) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            counts = n if size == 1 else padded - size + 1
            firsts.append(np.concatenate(([0], np.cumsum(counts)[:-1])))
        weights = np.cumprod(np.full(int(padded.max()), BASE))[places]
        whole = mix(np.add.reduceat(chars * weights, first[:-1])) >> np.uint64(64 - WORD_BITS)
        middle = raw[starts + n // 2]
        script = _NUMBERS[np.searchsorted(_STARTS, middle, side="right") - 1]
        return Words(text, n, script, starts - (ends - lengths)[text], grams, firsts, whole.astype(np.int64))


@dataclass
class Model:
    """Log-probabilities by bucket and language, and the languages of each script."""

    languages: list[str]
    gram: np.ndarray
    word: np.ndarray
    scripts: np.ndarray  #: script by language: is a candidate

    def word_scores(self, words: Words) -> np.ndarray:
        """Word by language; -inf for no candidate. All are candidates where the script has none."""
        if not len(words.text):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = self.word[words.whole]
        for grams, starts in zip(words.grams, words.starts, strict=True):
            scores += np.add.reduceat(self.gram[grams], starts, axis=0)
        allowed = self.scripts[words.script]
        return np.where(allowed | ~allowed.any(1, keepdims=True), scores, -np.inf)


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word that maximises the sum of scores less `penalty` for each switch."""
    total = scores.sum(0)
    best = int(total.argmax())
    if np.isfinite(total[best]):
        gain = scores - scores[:, [best]]
        sums = np.vstack((np.zeros(scores.shape[1]), np.cumsum(np.maximum(gain, -1e6), axis=0)))
        if (sums - np.minimum.accumulate(sums, axis=0)).max() <= penalty / 2:
            return np.full(len(scores), best)
    n = scores.shape[1]
    rows = scores.tolist()
    reached, came = rows[0], []
    for row in rows[1:]:
        top = max(reached)
        switch, at = top - penalty, reached.index(top)
        came.append([k if reached[k] >= switch else at for k in range(n)])
        reached = [(r if r >= switch else switch) + s for r, s in zip(reached, row, strict=True)]
    path = [reached.index(max(reached))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def _fit_counts(languages: list[str]):
    """Counts of n-grams, words and scripts by language, of one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, width = Reader(), len(languages)
        gram, word, script = (np.zeros((size, width)) for size in (1 << GRAM_BITS, 1 << WORD_BITS, len(NAMES)))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, names = part.column("text").to_pylist(), [languages.index(x) for x in part.column("lang").to_pylist()]
                for own, langs_of in [(texts, names)] if max(map(len, texts)) <= LONG else [([x], [k]) for t, k in zip(texts, names, strict=True) for _, x in pieces(t, LONG)]:
                    words = reader.words(own)
                    if not len(words.text):
                        continue
                    lang = np.array(langs_of)[words.text]
                    sizes = [np.diff(np.append(starts, len(grams))) for grams, starts in zip(words.grams, words.starts, strict=True)]
                    for table, keys, langs in (*((gram, g, np.repeat(lang, k)) for g, k in zip(words.grams, sizes, strict=True)), (word, words.whole, lang)):
                        table += np.bincount(keys * np.int64(width) + langs, minlength=table.size).reshape(table.shape)
                    script += np.bincount(words.script * width + lang, weights=words.letters, minlength=script.size).reshape(script.shape)
        for kind, table in enumerate((gram, word, script)):
            keys, langs = np.nonzero(table)
            for at in range(0, len(keys), 50_000):
                some = slice(at, at + 50_000)
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(keys[some]), kind), "k": keys[some], "lang": langs[some], "count": table[keys[some], langs[some]]})

    return run


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of rows (key, text, lang), all with a language; key is only hashed, to thin more than `fit_rows` rows evenly.

    What comes to the driver has the size of the model.
    """
    sizes = labelled.groupBy("lang").count().collect()
    languages, rows = sorted(r["lang"] for r in sizes), sum(r["count"] for r in sizes)
    k = len(languages)
    share = min(1.0, fit_rows / max(rows, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    counts = chosen.transform(in_workers, _fit_counts(languages), "kind long, k long, lang long, count double").groupBy("kind", "k", "lang").agg(F.sum("count").alias("count")).toPandas()
    tables = []
    for kind, size in enumerate((1 << GRAM_BITS, 1 << WORD_BITS, len(NAMES))):
        table, some = np.zeros((size, k)), counts[counts["kind"] == kind]
        table[some["k"].to_numpy(int), some["lang"].to_numpy(int)] = some["count"].to_numpy(float)
        tables.append(table)
    gram, word = (np.log((t + SMOOTH) / (t.sum(0) + SMOOTH * len(t))).astype(np.float32) for t in tables[:2])
    letters = tables[2]
    return Model(languages, gram, word, letters > SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


def pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """Start and text of pieces of about `size` code points, cut behind white space; a run without any stays whole."""
    start = 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            back = max(text.rfind(c, start, stop) for c in " \n\t") + 1
            ahead = min((i for c in " \n\t" if (i := text.find(c, stop)) >= 0), default=len(text) - 1) + 1
            stop = back if back > start else ahead
        yield start, text[start:stop]
        start = stop


def _scored(texts: list[str], reader: Reader, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its text, letters and start, and its scores."""
    if max(map(len, texts), default=0) <= LONG:
        words = reader.words(texts)
        return words.text, words.letters, words.start, model.word_scores(words)
    out = []
    for number, text in enumerate(texts):
        for start, piece in pieces(text, LONG):
            words = reader.words([piece])
            out.append((np.full(len(words.text), number), words.letters, words.start + start, model.word_scores(words)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def label(texts: list[str], reader: Reader, model: Model) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start and end in code points, language) of each text."""
    text, word_letters, word_starts, scores = _scored(texts, reader, model)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b or not model.languages:
            yield UND, 0.0, []
            continue
        own, letters = scores[a:b], word_letters[a:b]
        path = best_path(own)
        held = np.bincount(path, weights=letters, minlength=len(model.languages))
        lang = int(held.argmax())
        inside = path == lang
        # Confidence: a softmax over the mean word score in the spans, sharper with more words.
        sums = own[inside].astype(float).sum(0)
        sums = np.where(np.isfinite(sums), sums, -1e9) / np.sqrt(inside.sum())
        confidence = 1 / np.exp(np.clip(sums - sums[lang], -700, 50)).sum()
        cuts = np.flatnonzero(np.diff(path)) + 1
        starts, ends = word_starts[a:b], word_starts[a:b] + letters
        spans = [(int(starts[i]), int(ends[j - 1]), model.languages[path[i]]) for i, j in zip([0, *cuts], [*cuts, b - a], strict=True)]
        yield model.languages[lang], float(held[lang] / letters.sum() * min(confidence, 1.0)), spans


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row; spans are (start, end, lang) in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _labelled(batches, model, "text"):
            spans = pa.array([[{"start": s, "end": e, "lang": n} for s, e, n in x[2]] for x in found], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "lang": pa.string()})))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), **_verdicts(found), "spans": spans})

    schema = "id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return texts.transform(in_workers, run, schema).withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The rows as they are with their language and score, and the names of these two columns: lang_pred and score, with underscores behind them where a column is called so."""
    names = [free_name(c, docs.columns) for c in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _labelled(batches, model, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns, *_verdicts(found).values()], names=[*part.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.transform(in_workers, run, schema), *names


def _labelled(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    reader = Reader()
    for batch in batches:
        for part in slices(batch, text, SLICE):
            yield part, list(label([t or "" for t in part.column(text).to_pylist()], reader, model))


def _verdicts(found: list) -> dict[str, pa.Array]:
    return {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())}


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def fit_documents(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the documents that have a language and are not held out (fold 2 of 4)."""
    return fit(docs.where(docs["lang"].isNotNull() & (fold(docs["doc_id"], 4) != 2)).select(docs["doc_id"].alias("key"), docs["text"], docs["lang"]), fit_rows)
