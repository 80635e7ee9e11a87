"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-character n-grams of the folded text, hashed to 2 ** BITS buckets; term frequency is the
share of the text's n-grams, so that a score is one sum over the text. Trained with follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties) on a bounded sample of labelled documents, at most `max_rows` over all
languages, and calibrated by one temperature on every fifth of them.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if there is no
labelled document; null languages are not learned; an empty language name is a name as any other; with one
language every text with letters is of it, with score 1; ids may be of any type; repeated rows get repeated results; of equal scores the
language that comes first by name is taken; columns named lang_pred and score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import crc_mod, materialize, stratified_sample

BITS = 16
ORDERS = (1, 2, 3)
#: Bound on the training sample, over all languages together.
MAX_ROWS = 6000
FOLDS = 4
HELD_OUT = 2
UNKNOWN = "und"
SCALE = 100.0  # relative frequencies times this


def _counts(batches):
    for batch in batches:
        for piece in textvec.pieces(batch):
            found = [(doc.astype(np.int64) << BITS | x)[x != 1 << BITS] for x, doc in textvec.ngram_buckets(textvec.strings(piece.column("text")), ORDERS, BITS)]
            pair, count = textvec.distinct(np.concatenate(found))
            cut = np.searchsorted(pair >> BITS, np.arange(piece.num_rows + 1))
            bucket = (pair & ((1 << BITS) - 1)).astype(np.int32)
            blobs = [bucket[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            sizes = [count[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "lang", "bucket", "count"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_lang: int, alpha=0.5, beta=1.0, l1=0.5, l2=0.1, epochs=3, seed=0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by FTRL-proximal, one language a column."""
    z, n = np.zeros(((1 << BITS) + 1, n_lang)), np.zeros(((1 << BITS) + 1, n_lang))
    last = 1 << BITS  # the intercept's coordinate

    def weights(at):
        zz, nn = z[at], n[at]
        penalty = np.where(np.asarray(at)[:, None] == last, 0.0, l1)
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    w = np.concatenate([weights(np.arange(a, min(a + 4096, last + 1))) for a in range(0, last + 1, 4096)])
    return w[:last], w[last]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 3) -> dict:
    """{"langs", "weights" (inverse document frequency and temperature multiplied in), "bias"}."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())  # names of languages: a short list
    if not langs:
        return {"langs": [], "weights": np.zeros(((1 << BITS) + 1, 1), np.float32), "bias": np.zeros(1)}
    sample = materialize(stratified_sample(known.select("doc_id", "lang", "text"), "lang", "doc_id", max(1, max_rows // len(langs))), "lang-sample")
    id_type = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(_counts, f"doc_id {id_type}, lang string, bucket binary, count binary").toArrow().to_pandas().sort_values(["doc_id", "lang"], kind="stable")
    buckets = [np.frombuffer(x, np.int32) for x in table["bucket"]]
    counts = [np.frombuffer(x, np.float32) for x in table["count"]]
    y = np.searchsorted(np.array(langs, object), table["lang"].to_numpy(object))
    df = np.bincount(np.concatenate(buckets), minlength=1 << BITS)[: 1 << BITS]
    idf = np.log((1 + len(buckets)) / (1 + df)) + 1.0
    last = 1 << BITS
    rows = [(np.append(b, last), np.append(c / max(c.sum(), 1) * SCALE * idf[b], 1.0), k) for b, c, k in zip(buckets, counts, y)]
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    w, bias = _ftrl([r for i, r in enumerate(rows) if i % 5] or rows, len(langs), epochs=epochs)
    full = np.vstack([w, bias])
    logits = np.array([x @ full[at] for at, x, _ in held])
    gold = np.array([k for _, _, k in held])

    def loss(t):
        return -np.log(_softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean()

    temperature = min(np.exp(np.linspace(-3, 3, 121)), key=loss)
    scaled = np.zeros((last + 1, len(langs)), np.float32)
    scaled[:last] = w * idf[:, None] * (SCALE / temperature)
    return {"langs": langs, "weights": scaled, "bias": bias / temperature, "temperature": float(temperature)}


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all, if None), `lang_pred` and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of a number per language
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def run(batches):
        m = shared.value
        weights, langs = m["weights"], np.array([*m["langs"], UNKNOWN], object)
        columns = [np.ascontiguousarray(weights[:, k]) for k in range(weights.shape[1])]
        for batch in batches:
            for piece in textvec.pieces(batch):
                texts, n = textvec.strings(piece.column("text")), piece.num_rows
                total, size = np.zeros((n, len(columns))), np.zeros(n)
                for bucket, doc in textvec.ngram_buckets(texts, ORDERS, BITS):
                    if not len(doc):
                        continue
                    low, high = int(doc[0]), int(doc[-1]) + 1
                    size[low:high] += np.bincount(doc - low, bucket != 1 << BITS, high - low)
                    for k, column in enumerate(columns):
                        total[low:high, k] += np.bincount(doc - low, column[bucket], high - low)
                p = _softmax(total / np.maximum(size, 1)[:, None] + m["bias"])
                best = p.argmax(axis=1)
                known = textvec.has_letter(texts) & bool(m["langs"])
                pred = langs[np.where(known, best, len(langs) - 1)]
                score = np.where(known, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("lang_pred", "string").add("score", "double"))
