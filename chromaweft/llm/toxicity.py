"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 6-character n-grams of the folded text (hashed to 2 ** BITS buckets), as presence and as
density (occurrences per DENSITY characters, 3 at most), each scaled by the log ratio of the n-gram's smoothed document
frequencies in toxic and other texts. A logistic regression on
the scaled features is trained on a bounded sample (`per_class` documents of each label, chosen by a hash of
the id); the frequencies come from the same sample. The model is two tables of 2 ** BITS floats, whatever the corpus. Penalty,
number of features and least frequency were chosen by cross-validation within the folds that are learned from. Of equally strong
features those with the smaller buckets are taken.

Defined results: null text scores as empty text, that is by the intercept; null ids are held out of
training and held_out is null; labels that disagree count as toxic; labels of unknown documents are ignored;
without labels every score is the smoothed rate 0.25, without one of the classes a constant below or above 0.5; ids may be of any
type; repeated rows get repeated scores; a column named toxicity is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import crc_mod, materialize, stratified_sample

BITS = 20
ORDERS = (3, 4, 5, 6)
#: Bound on the training sample: documents of each label.
PER_CLASS = 4000
MAX_FEATURES = 1 << 12
DENSITY = 300.0
FOLDS = 5


def _presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    found = []
    for bucket, doc in textvec.ngram_buckets(texts, ORDERS, BITS):
        real = np.flatnonzero(bucket != 1 << BITS)
        found.append(textvec.distinct(doc[real].astype(np.int64) << BITS | bucket[real])[0])
    pair = textvec.distinct(np.concatenate(found))[0] if found else np.zeros(0, np.int64)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _features(texts: list[str], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and density of each distinct pair with a bucket in mask."""
    found = [np.zeros(0, np.int64)]
    for bucket, doc in textvec.ngram_buckets(texts, ORDERS, BITS):
        hit = np.flatnonzero(mask[bucket])
        found.append(doc[hit].astype(np.int64) << BITS | bucket[hit])
    pair, count = textvec.distinct(np.concatenate(found))
    doc = pair >> BITS
    size = np.array([len(x) for x in texts], float)[doc] if len(texts) else np.zeros(0)
    return doc, pair & ((1 << BITS) - 1), np.minimum(count * DENSITY / np.maximum(size, 1), 3.0)


def _toxicity(texts: list[str], model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    present, dense, intercept = model
    doc, bucket, density = _features(texts, (present != 0) | (dense != 0))
    total = np.bincount(doc, present[bucket] + dense[bucket] * density, len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _frequencies(batches):
    for batch in batches:
        for piece in textvec.pieces(batch):
            doc, bucket = _presence(textvec.strings(piece.column("text")))
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False)[doc] == 1
            pos = np.bincount(bucket[toxic], minlength=1 << BITS)
            neg = np.bincount(bucket[~toxic], minlength=1 << BITS)
            at = np.flatnonzero(pos + neg)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(neg[at])], names=["bucket", "pos", "neg"])


def _rows(mask: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                doc, bucket, density = _features(textvec.strings(piece.column("text")), mask)
                cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                blobs = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
                sizes = [density[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "toxic", "features", "density"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by bucket of presence and of density, and the intercept."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = stratified_sample(known, "toxic", "doc_id", per_class)  # bounded: small enough to send to every task
    sample = materialize(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    present, dense = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)
    if not n_pos or not n_neg:
        rate = (n_pos + 0.5) / (n_pos + n_neg + 2)
        return present, dense, float(np.log(rate / (1 - rate)))
    least = max(2, min(4, n_pos // 10), int(1e-3 * (n_pos + n_neg)))
    counts = sample.mapInArrow(_frequencies, "bucket int, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most 2 ** BITS rows of three numbers
    counts = counts.filter(F.col("pos") + F.col("neg") >= least).toArrow().to_pandas()
    ratio = np.log((counts["pos"] + 0.5) / (n_pos + 1)) - np.log((counts["neg"] + 0.5) / (n_neg + 1))
    strength = (np.abs(ratio) * np.sqrt(counts["pos"] + counts["neg"])).to_numpy()
    strength[np.abs(ratio) < 1.0] = 0
    chosen = np.argsort(-strength, kind="stable")[: min(MAX_FEATURES, int((strength > 0).sum()))]
    bucket, ratio = counts["bucket"].to_numpy()[chosen], ratio.to_numpy()[chosen]
    if not len(bucket):
        return present, dense, float(np.log(n_pos / n_neg))
    mask = np.zeros((1 << BITS) + 1, bool)
    mask[bucket] = True
    place = np.zeros((1 << BITS) + 1, np.int32)
    place[bucket] = np.arange(len(bucket))
    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(_rows(mask), f"doc_id {id_type}, toxic int, features binary, density binary").toArrow().to_pandas().sort_values(["doc_id", "toxic"], kind="stable")
    parts = [place[np.frombuffer(x, np.int32)] for x in rows["features"]]
    density = np.concatenate([np.frombuffer(x, np.float32) for x in rows["density"]])
    w, b = _logistic(parts, density, (rows["toxic"] == 1).to_numpy(np.float64), ratio)
    present[bucket], dense[bucket] = w[: len(bucket)] * ratio, w[len(bucket) :] * ratio
    return present, dense, b


def _logistic(parts: list[np.ndarray], density: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 0.03, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of the scaled presences, then of the scaled densities, by Adam on the whole sample; classes weigh alike."""
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    col = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    n = len(ratio)
    here, much = ratio[col], ratio[col] * density
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(2 * n), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        score = np.bincount(row, here * w[col] + much * w[n + col], len(parts)) + b
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * weight
        at = error[row]
        g = np.concatenate([np.bincount(col, here * at, n), np.bincount(col, much * at, n)]) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 / (1 + t / 50)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of docs, if None) and `toxicity`, a probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the corpus
    names = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]

    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                score = _toxicity(textvec.strings(piece.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(score)], names=[*names, "toxicity"])

    schema = docs.select(*names).schema.add("toxicity", "double")
    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], least: float = 0.5) -> DataFrame:
    """The rows of docs that score under `least`, their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                yield piece.filter(pa.array(_toxicity(textvec.strings(piece.column("text")), shared.value) < least))

    return docs.mapInArrow(run, docs.schema)
