"""Katz backoff bigram model with Good-Turing discounts.

Tokens are words (runs of anything but blank, tab, LF, VT, FF, CR; A-Z in lower case) and one end per text. Counts
of one to five are discounted by Good-Turing ratios (see `discounts`); what
a history's discounts leave goes to the words not seen behind it, in proportion to their discounted unigram
probability, so that each history's probabilities, the class of unknown words included, sum to one. A history without
discounted counts reserves one count more. The model's log probability of a text is the sum over its tokens:
seen bigrams directly, others by the history's backoff weight times the unigram probability, unknown words by the
unigrams' remaining mass.

Histories are one word: trigrams would be asked and answered in the same way, but by a measurement of their packed questions and answers they
take 3.6 times the input of disk more (see the README).

Layout. Texts become batches of token numbers, stored once in the shared folder. Batches ask word shards (ranges of a
64-bit hash) for number and training count of their distinct words, then ask bigram shards for the counts of
their distinct bigrams and what backoff weights need; shards are tables partitioned by number. Both
questions are distinct per batch before they are shuffled, so a frequent word costs a row per batch and not per
occurrence. Bigrams are sharded by history; a history with more than 1 / HOT of all tokens is spread by both
words, and the at most HOT + 1 sums of such histories pass through the driver. Nothing else but counts of counts does.

Words are told apart by 64-bit hashes. Defined results: null texts are empty (one end token); null ids are not learned from
and have held_out null; ids may be of any type; repeated rows count repeatedly; with no training text every token is unknown;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import crc_mod, materialize, shuffle_width

FOLDS = 10
K = 5
HOT = 1000
BATCH_BYTES = 12 << 20
#: Tokens per shard.
SHARD_TOKENS = 2_000_000
#: Tokens per task of a shuffle.
TASK_TOKENS = 4_000_000
END = np.uint64(0x0123456789ABCDEF)
BOS = np.uint64(0xFFFFFFFFFFFFFFFF)
_codec = pa.Codec("zstd", 3)


def pack(x: np.ndarray) -> bytes:
    """Bytes by significance, compressed: small numbers cost little."""
    if not len(x):
        return b""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return _codec.compress(raw, asbytes=True)


def unpack(blob: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = _codec.decompress(blob, n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes, n: int, dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, n, dtype), dtype=dtype)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes have sorted shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


#: One shape for all that travels: what it is and up to five packed arrays with their lengths.
_FIELDS = [("batch", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), *[(c, pa.binary()) for c in "abcde"]]
_SCHEMA = pa.schema(_FIELDS)
DDL = "batch bigint, kind int, shard bigint, n bigint, m bigint, a binary, b binary, c binary, d binary, e binary"
BATCH, WORDS, WORD_REPLY, BIGRAMS, BIGRAM_REPLY, HISTORY_REPLY, COUNTS, HOT_SUMS = range(8)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (*r, *[None] * (len(_FIELDS) - len(r))))) for r in rows], _SCHEMA)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)], _SCHEMA)


def _batches(rows):
    """Texts to batches. a: lengths, b: training flags, c: sorted distinct hashes, d: token numbers in the batch, e: ids."""
    for batch in rows:
        for piece in textvec.pieces(batch, limit=BATCH_BYTES):
            n = piece.num_rows
            word, doc = textvec.words(textvec.strings(piece.column("text")), "plain")
            count = np.bincount(doc, minlength=n)
            token = np.full(len(word) + n, END, np.uint64)
            token[np.arange(len(word)) + doc] = word
            order = np.argsort(token, kind="stable")
            ordered = token[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            local = np.empty(len(token), np.uint32)
            local[order] = np.cumsum(new) - 1
            vocabulary = ordered[new]
            sink = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([piece.column("doc_id")], names=["doc_id"])
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            learn = pa.compute.fill_null(piece.column("learn"), False).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield _rows([(uuid.uuid4().int >> 65, BATCH, n, len(token), len(vocabulary), pack((count + 1).astype(np.uint32)), pack(learn), pack_sorted(vocabulary), pack(local), sink.getvalue().to_pybytes())])


def _open(row: dict) -> tuple:
    """Lengths, training flags per token, and token numbers of a stored batch."""
    length = unpack(row["a"], row["shard"], np.uint32).astype(np.int64)
    learn = np.repeat(unpack(row["b"], row["shard"], np.uint8).astype(bool), length)
    return length, learn, unpack(row["d"], row["n"], np.uint32)


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, learn, local = _open(row)
                word = unpack_sorted(row["c"], row["m"], np.uint64)
                count = np.bincount(local[learn], minlength=len(word)).astype(np.uint32)
                cut = np.searchsorted(shard_of(word, shards), np.arange(shards + 1))
                yield _rows([(row["batch"], WORDS, s, b - a, 0, pack_sorted(word[a:b]), pack(count[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    return run


def _counts_of_counts(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2].astype(np.int64)


def _answer_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unpack_sorted(r["a"], r["n"], np.uint64) for r in rows]
        flat = np.concatenate(parts)
        word, place = np.unique(flat, return_inverse=True) if len(flat) < 1000 else _unique(flat)
        count = np.bincount(place, np.concatenate([unpack(r["b"], r["n"], np.uint32) for r in rows]), len(word)).astype(np.int64)
        shard = rows[0]["shard"]
        number = np.arange(len(word), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard)
        out, at = [], 0
        for r in rows:
            mine = place[at : at + r["n"]]
            at += r["n"]
            out.append((r["batch"], WORD_REPLY, shard, r["n"], 0, pack(number[mine]), pack(count[mine])))
        tally = np.concatenate([_counts_of_counts(count), [(count > 0).sum(), count.sum()]]).astype(np.int64)
        out.append((0, COUNTS, shard, len(tally), 0, tally.tobytes()))
        return _table(out)

    return run


def _unique(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing ratios d_0 = 1, d_1 .. d_K from the counts of counts n_1 .. n_(K+1).

    Where the raw counts of counts give a ratio outside (0, 1], all come from their log-linear fit n_r = c * r ** b instead; where
    that falls no faster than 1 / r, or a count of counts is zero, nothing is discounted.
    """
    d = np.ones(K + 1)
    if (n <= 0).any():
        return d
    r = np.arange(1, K + 1)
    slope = np.polyfit(np.log(np.arange(1, K + 2)), np.log(n), 1)[0]
    for a, ratio in (((K + 1) * n[K] / n[0], (r + 1) * n[1:] / (r * n[:-1])), ((K + 1.0) ** (slope + 1), ((r + 1) / r) ** (slope + 1))):
        if a < 1:
            ratio = (ratio - a) / (1 - a)
            if ((ratio > 0) & (ratio <= 1)).all():
                d[1:] = ratio
                break
    return d


class Unigrams:
    def __init__(self, tally: np.ndarray):
        self.n, self.v = int(tally[K + 2]), int(tally[K + 1])
        self.d = discounts(tally[: K + 1].astype(float))
        lost = sum((1 - self.d[r]) * r * tally[r - 1] for r in range(1, K + 1))
        self.total = self.n if lost > 0 else self.n + 1  # without discounts one count is kept for unknown words
        self.unknown = (lost if lost > 0 else 1.0) / self.total

    def probability(self, count: np.ndarray) -> np.ndarray:
        c = np.asarray(count, float)
        return np.where(c > 0, self.d[np.where(c <= K, c, 0).astype(int)] * c / self.total, self.unknown)


def _words_of(rows: list[dict]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The batch row, and number and training count of its words, in order."""
    batch = next(r for r in rows if r["kind"] == BATCH)
    replies = sorted((r for r in rows if r["kind"] == WORD_REPLY), key=lambda r: r["shard"])
    number = np.concatenate([unpack(r["a"], r["n"], np.uint64) for r in replies])
    count = np.concatenate([unpack(r["b"], r["n"], np.int64) for r in replies])
    return batch, number, count


def _bigrams(batch: dict, number: np.ndarray, count: np.ndarray, starts: int, unigrams: Unigrams, shards: int):
    """Texts' lengths, training flags, tokens' words and their histories' counts; histories and words of the distinct bigrams (sorted by
    shard and bigram), each token's bigram, the cuts of the shards."""
    length, learn, local = _open(batch)
    token = number[local]
    history = np.empty_like(token)
    history[1:] = token[:-1]
    first = np.cumsum(length) - length
    history[first] = BOS
    times = np.empty(len(local), np.int64)
    times[1:] = count[local[:-1]]
    times[first] = starts
    shard = shard_of(textvec.mix(np.where(times * HOT > unigrams.n, textvec.mix(history) + token, history)), shards).astype(np.int32)
    order = np.lexsort((token, history, shard))
    token, history, shard = token[order], history[order], shard[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (history[1:] != history[:-1])])  # a bigram has one shard
    place = np.empty(len(local), np.int64)
    place[order] = np.cumsum(new) - 1
    return length, learn, local, times, history[new], token[new], place, np.searchsorted(shard[new], np.arange(shards + 1))


def _ask_bigrams(starts: int, unigrams: Unigrams, shards: int):
    def run(table: pa.Table) -> pa.Table:
        batch, number, count = _words_of(table.to_pylist())
        _, learn, local, _, history, word, place, cut = _bigrams(batch, number, count, starts, unigrams, shards)
        times = np.bincount(place[learn], minlength=len(word)).astype(np.uint32)
        word_count = np.empty(len(word), np.int64)
        word_count[place] = count[local]
        rows = []
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                rows.append((batch["batch"], BIGRAMS, s, b - a, 0, pack_sorted(history[a:b]), pack(word[a:b]), pack(times[a:b]), pack(word_count[a:b])))
        return _table(rows)

    return run


def _answer_bigrams(unigrams: Unigrams, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        history = np.concatenate([unpack_sorted(r["a"], r["n"], np.uint64) for r in rows])
        word = np.concatenate([unpack(r["b"], r["n"], np.uint64) for r in rows])
        order = np.lexsort((word, history))
        history, word = history[order], word[order]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (history[1:] != history[:-1])])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        history, n = history[new], int(new.sum())
        del word, order
        count = np.bincount(place, np.concatenate([unpack(r["c"], r["n"], np.uint32) for r in rows]), n).astype(np.int64)
        word_count = np.empty(n, np.int64)
        word_count[place] = np.concatenate([unpack(r["d"], r["n"], np.int64) for r in rows])
        new = np.concatenate([[True], history[1:] != history[:-1]])
        of, owners = np.cumsum(new) - 1, history[new]
        seen = count > 0
        sums = np.zeros((len(owners), K + 2))  # bigrams seen 1 .. K times, tokens of the others, unigram mass of the seen words
        for r in range(1, K + 1):
            sums[:, r - 1] = np.bincount(of, count == r, len(owners))
        sums[:, K] = np.bincount(of, np.where(count > K, count, 0), len(owners))
        sums[:, K + 1] = np.bincount(of, np.where(seen, unigrams.probability(word_count), 0.0), len(owners))
        shard = rows[0]["shard"]
        out, at = [], 0
        for r in rows:
            mine = place[at : at + r["n"]]
            at += r["n"]
            wanted = of[mine][np.concatenate([[True], np.diff(of[mine]) != 0])]
            blob = pack(sums[wanted, : K + 1].astype(np.int64).ravel()), pack(sums[wanted, K + 1])
            out.append((r["batch"], BIGRAM_REPLY, shard, r["n"], len(wanted), pack(count[mine]), *blob))
        out.append((0, COUNTS, shard, K + 1, 0, _counts_of_counts(count).tobytes()))
        is_hot = np.flatnonzero(np.isin(owners, hot))
        if len(is_hot):
            out.append((0, HOT_SUMS, shard, len(is_hot), 0, owners[is_hot].tobytes(), sums[is_hot].tobytes()))
        return _table(out)

    return run


def _score(starts: int, unigrams: Unigrams, d: np.ndarray, hot: dict, shards: int):
    hot_numbers = np.array(sorted(hot), np.uint64)
    hot_sums = np.array([hot[h] for h in hot_numbers.tolist()]).reshape(-1, K + 2)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        batch, number, count = _words_of(rows)
        length, _, local, times, history, _, place, _ = _bigrams(batch, number, count, starts, unigrams, shards)
        replies = sorted((r for r in rows if r["kind"] == BIGRAM_REPLY), key=lambda r: r["shard"])
        seen = np.concatenate([unpack(r["a"], r["n"], np.int64) for r in replies])
        sums = np.concatenate([np.column_stack([unpack(r["b"], r["m"] * (K + 1), np.int64).reshape(-1, K + 1), unpack(r["c"], r["m"], np.float64)]) for r in replies])
        # a history's bigrams of one shard are neighbours, and each run has its sums
        shard_of_key = np.repeat(np.arange(len(replies)), [r["n"] for r in replies])
        run_of = np.cumsum(np.concatenate([[True], (history[1:] != history[:-1]) | (shard_of_key[1:] != shard_of_key[:-1])])) - 1
        sums = sums[run_of]
        if len(hot_numbers):
            at = np.minimum(np.searchsorted(hot_numbers, history), len(hot_numbers) - 1)
            sums = np.where((hot_numbers[at] == history)[:, None], hot_sums[at], sums)
        total = np.zeros(len(history))
        total[place] = times
        kept = sums[:, K] + sum(d[r] * r * sums[:, r - 1] for r in range(1, K + 1))
        full = np.where(total - kept > 1e-9 * np.maximum(total, 1), total, total + 1)
        c = seen.astype(float)
        left = np.where(total > 0, (full - kept) / full / np.maximum(1 - sums[:, K + 1], 1e-300), 1.0)
        word_count = np.zeros(len(history), np.int64)
        word_count[place] = count[local]
        ratio = d[np.where(seen <= K, seen, 0)]
        p = np.where(seen > 0, ratio * c / np.maximum(full, 1), left * unigrams.probability(word_count))
        end = np.cumsum(length)
        score = np.add.reduceat(np.log10(p)[place], end - length)
        base = np.log10((count + 0.1) / (unigrams.n + 0.1 * (unigrams.v + 1)))
        base = np.add.reduceat(base[local], end - length)
        known = np.add.reduceat((count[local] > 0).astype(np.int64), end - length)
        ids = pa.ipc.open_stream(batch["e"]).read_all().column(0).combine_chunks()
        return pa.table({"doc_id": ids, "n_tokens": length, "n_known": known, "train_tokens": np.full(len(length), unigrams.n), "base_score": base, "score": score})

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), (crc_mod(F.col("doc_id"), folds) != 0).alias("learn"))
    stored = materialize(texts.mapInArrow(_batches, DDL), "katz-batches")
    tokens = stored.agg(F.sum("n")).first()[0] or 0
    starts = texts.agg(F.count_if("learn")).first()[0]
    shards = max(shuffle_width(spark), -(-tokens // SHARD_TOKENS))

    tasks = max(shuffle_width(spark), -(-tokens // TASK_TOKENS))
    asked = stored.mapInArrow(_ask_words(shards), DDL).repartition(tasks, "shard")
    words = materialize(asked.groupBy("shard").applyInArrow(_answer_words(shards), DDL), "katz-words")
    unigrams = Unigrams(_tally(words, K + 3))

    # the words' hashes have been asked for; what is shuffled from here on are numbers
    batches = stored.withColumn("c", F.lit(None).cast("binary")).unionByName(words.filter(F.col("kind") == WORD_REPLY))
    asked = batches.repartition(tasks, "batch").groupBy("batch").applyInArrow(_ask_bigrams(starts, unigrams, shards), DDL).repartition(tasks, "shard")
    hot = _hot_words(words, unigrams, starts)
    bigrams = materialize(asked.groupBy("shard").applyInArrow(_answer_bigrams(unigrams, hot), DDL), "katz-bigrams")
    d = discounts(_tally(bigrams, K + 1).astype(float))
    sums = _hot_sums(bigrams)
    schema = f"doc_id {id_field}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    told = batches.unionByName(bigrams.filter(F.col("kind") == BIGRAM_REPLY))
    scored = told.repartition(tasks, "batch").groupBy("batch").applyInArrow(_score(starts, unigrams, d, sums, shards), schema)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _tally(rows: DataFrame, n: int) -> np.ndarray:
    """The shards' counts, summed before they come to the driver."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.frombuffer(r["a"], np.int64))], names=["i", "v"])

    out = np.zeros(n, np.int64)
    for i, v in rows.filter(F.col("kind") == COUNTS).select("a").mapInArrow(run, "i bigint, v bigint").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def _hot_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the at most HOT + 1 hot histories over their shards."""
    names = [f"s{i}" for i in range(K + 2)]

    def run(batches):  # sums of counts beyond 2 ** 53 would be rounded
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.frombuffer(r["b"], np.float64).reshape(-1, K + 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["a"], np.int64)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(K + 2)]], names=["h", *names])

    summed = rows.filter(F.col("kind") == HOT_SUMS).select("a", "b").mapInArrow(run, "h bigint, " + ", ".join(f"{x} double" for x in names)).groupBy("h").agg(*[F.sum(x) for x in names])
    return {int(np.array(h).view(np.uint64)): np.array(s) for h, *s in summed.collect()}


def _hot_words(words: DataFrame, unigrams: Unigrams, starts: int) -> np.ndarray:
    """Numbers of the at most HOT words with more than 1 / HOT of all training tokens, and of the start."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                count = unpack(r["b"], r["n"], np.int64)
                high = np.flatnonzero(count * HOT > unigrams.n)
                if len(high):
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(r["a"], r["n"], np.uint64)[high].view(np.int64))], names=["number"])

    found = words.filter(F.col("kind") == WORD_REPLY).mapInArrow(run, "number bigint").distinct().collect()
    numbers = [r["number"] for r in found]
    if starts * HOT > unigrams.n:
        numbers.append(int(BOS))
    return np.array(sorted(numbers), np.uint64)
