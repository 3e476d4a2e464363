"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the distinct buckets of its words, pairs of neighbours and pairs with one word between them
(words are runs of letters, lower-cased in ASCII). Each coordinate has its own learning rate; L1 keeps most weights
at zero, so that the rest is small enough to go to every task.

The fit takes labelled rows, thinned evenly by hash of the id beyond FIT_ROWS rows or FIT_FEATURES features, in an order that
depends only on them; one task learns, what it holds is bounded by FIT_FEATURES. All texts are scored whole.

Defined results: a null, empty or letterless text is scored by the bias alone; without labelled rows all scores are
0.5; rows that repeat an id, and null ids, are each returned (a null id has no label and is in no fold); a row with a null label is not learned from; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_workers, slices, text_buffers
from .textkernel import LOWER, ORDER, hashed_runs, mix, sigmoid

#: Rows and features of rows learned from at most (about), passes over them, and buckets of features (the last is the bias).
FIT_ROWS, FIT_FEATURES, PASSES, BITS = 20_000, 60_000_000, 4, 20

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Ftrl:
    """Rates of FTRL-proximal."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0


def features(data: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and each text's bounds in them. `only`: the buckets that are asked for."""
    n = len(offsets) - 1
    words, text = hashed_runs(LETTER, LOWER, data, offsets)
    hashes, owners = [words], [text]
    for gap in (1, 2):
        same = text[:-gap] == text[gap:]
        hashes.append(mix(words[:-gap] * ORDER[0] + words[gap:] * ORDER[1] + np.uint64(gap))[same])
        owners.append(text[gap:][same])
    buckets, owner = np.concatenate(hashes) >> np.uint64(64 - BITS), np.concatenate(owners)
    buckets = np.minimum(buckets.astype(np.int64), (1 << BITS) - 2)
    if only is not None:
        asked = only[buckets]
        buckets, owner = buckets[asked], owner[asked]
    keys = np.unique(owner << BITS | buckets)
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(n + 1))


def learn(rows: list[np.ndarray], labels: np.ndarray, rates: Ftrl = Ftrl(), passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and their weights."""
    bias = (1 << BITS) - 1
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        own, l1 = z[at], np.where(at == bias, 0.0, rates.l1)
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2))

    for _ in range(passes):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, bias)
            w = weights(at)
            g = sigmoid(w.sum()) - label
            old = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - old) / rates.alpha * w
    every = weights(np.arange(1 << BITS))
    return np.flatnonzero(every), every[every != 0]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found, bounds = features(*text_buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))], names=["key", "label", "features"])


def _learned(rates: Ftrl, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            rows += [x.values.to_numpy() for x in batch.column("features")]
        if rows:
            at, w = learn(rows, np.array(labels, float), rates, passes)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["bucket", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rates: Ftrl = Ftrl(), passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights from docs (key long, text) and labels (key long, label 0 or 1).

    The labels learned from are few (about `fit_rows`), so they go to the documents, which are not shuffled.
    """
    labels = labels.where("key IS NOT NULL AND label IS NOT NULL").select("key", F.col("label").cast("int").alias("label"))
    share = min(1.0, fit_rows / max(labels.count(), 1))
    hashed = F.xxhash64("key")
    chosen = labels.where(F.pmod(hashed, F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    texts = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(texts.transform(in_workers, _featured, "key long, label int, features array<int>"), "features")
    # Very long texts have many features: rows are thinned further, by another hash, where they are too many in all.
    every = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    if every > FIT_FEATURES:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 20)) < F.lit(int(FIT_FEATURES / every * (1 << 20))))
    rows = rows.repartition(1).sortWithinPartitions(hashed, "key", "label", F.hash("features"))
    found = rows.transform(in_workers, _learned(rates, passes), "bucket long, weight double").toPandas()
    scratch.drop_all_but()
    return found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[model[0]] = model[1]
        only = dense != 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, bounds = features(*text_buffers(part.column("text")), only)
                total = np.concatenate(([0.0], np.cumsum(dense[found])))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sigmoid(total[bounds[1:]] - total[bounds[:-1]] + dense[-1]))], names=["id", "score"])

    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return texts.transform(in_workers, run, "id long, score double").withColumnRenamed("id", id_col)
