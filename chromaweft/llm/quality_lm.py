"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are three words (64-bit hashes; runs of anything but blank, tab, LF, VT, FF, CR; A-Z in lower case; one end per
text). Behind the single word stands a spelling model, of four symbols of text (32 symbols: blank, a to z with accents dropped,
digits, other letters, common punctuation, other signs, and the edge of a text), which gives unknown words and the blanks before
them their probability. Perplexity is per symbol, so that texts of any kind of words compare.

Counts, continuation counts, counts of counts and context totals of words are tables that grow with the corpus: packed sorted
hashes by shard (a range of the hash). Texts become batches; a batch asks shards for its distinct n-grams and contexts, and is scored
with the answers. A key is asked for once per batch, so that frequent words cost no more than others. The spelling model has
at most 32 ** 4 rows (4 MB) and is sent to every task.

Disk. What is asked and counted takes several times the input, so both are done in passes, and what a pass has written is
deleted before the next: n-grams are learned by ranges of their middle word (all counts that a trigram adds to belong to that word, but for
those of the end of a text), documents are scored by ranges of a hash of their id. Trusted texts are kept as numbers of words, about as long as the
texts, until all is learned; every pass of scoring reads the texts anew. There are up to 24 and 12 passes, fewer for small tables, whatever their size beyond. The model is written in buckets of shards, so that no pass shuffles it.

A tenth of the trusted documents, by a hash of the id, is not learned from: the quantile of their perplexity is the threshold
of their language, since texts that were learned look better than others.

Defined results: null and empty texts have the perplexity of an immediate end; null languages are one language of
their own; a language without held-out documents has the threshold of all held-out ones, or, without any, of all trusted ones; without
trusted documents the model is uniform, every perplexity is 32 and all are kept; null ids are never trusted; labels that disagree count as
good; repeated rows get repeated results; a perplexity equal to the threshold is kept; a threshold is the upper edge of a bin of 4,096, so equal
perplexities lie on the same side; columns other than doc_id, lang and text are not read.
"""

from __future__ import annotations

import gc
import unicodedata
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import crc_mod, discard, materialize, remove, scratch_path, shuffle_width
from chromaweft.llm.katz import _unique, pack, pack_sorted, shard_of, unpack, unpack_sorted

SYMBOLS, ORDER = 32, 4
EDGE = 31
QUANTILE = 0.99
END, BOS = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: One in so many trusted documents is held out for the thresholds.
HELD_OUT = 10
BATCH_BYTES = 8 << 20
#: Bytes of all text per shard.
SHARD_BYTES = 24 << 20
#: Passes at most, over the documents to find the trusted ones, over the middle words that are learned and over the documents that are scored,
#: and the bytes of text that make one.
SELECT_PASSES, LEARN_PASSES, SCORE_PASSES, PASS_BYTES = 4, 24, 12, 8 << 20
#: Parts in which what the passes have learned is merged.
MERGES = 8
#: Perplexities are binned by their logarithm for the quantiles: 1 to 32 ** 2 in this many steps.
BINS = 4096


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of every code point of the basic plane."""
    out = np.empty(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = unicodedata.normalize("NFD", chr(i).lower())[:1] or " "
        out[i] = EDGE if i == 0 else 0 if c.isspace() else ord(c) - 96 if "a" <= c <= "z" else 27 if c.isdigit() else 28 if c.isalpha() else 29 if c in ".,;:!?'\"()-" else 30
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all symbols and ends, and n + 1 bounds of the texts' runs."""
    edge = "\x00" * (ORDER - 1)
    cp, bounds = textvec.points([f"{edge}{x.replace(chr(0), ' ')}\x00" for x in texts])
    sym = textvec.look_up(symbols(), cp, np.uint32(28))
    code = np.zeros(len(sym), np.uint32)
    for k in range(ORDER):
        code[ORDER - 1 :] = code[ORDER - 1 :] * np.uint32(SYMBOLS) + sym[k : len(sym) - ORDER + 1 + k]
    counted = np.ones(len(sym), bool)
    for k in range(ORDER - 1):
        counted[bounds[:-1] + k] = False
    return code[counted], bounds - np.arange(len(bounds)) * (ORDER - 1)


def _count(batches):
    for batch in batches:
        for piece in textvec.pieces(batch, limit=4 << 20):
            code, times = textvec.distinct(codes(textvec.strings(piece.column("text")))[0])
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(times)], names=["code", "times"])


def _cuts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken from counts of one, two and more, by the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [y if not (n1 and n2) else min(1.0, max(1e-3, 1 - 2 * y * n2 / n1)), min(2.0, max(1e-3, 2 - 3 * y * n3 / n2)) if n2 and n3 else 0.75, min(3.0, max(1e-3, 3 - 4 * y * n4 / n3)) if n3 and n4 else 1.0]


def fit(trusted: DataFrame) -> np.ndarray:
    """log10 probability of each n-gram's last symbol after the others: the spelling model, made on the driver of at most SYMBOLS ** ORDER counts."""
    return _fit(trusted.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_count, "code int, times bigint"))


def _fit(counts: DataFrame) -> np.ndarray:
    grams = counts.groupBy("code").agg(F.sum("times").alias("c")).toArrow()
    levels = [np.zeros(SYMBOLS**ORDER, np.int64)]
    levels[0][grams.column("code").to_numpy()] = grams.column("c").to_numpy()
    for order in range(ORDER - 1, 0, -1):  # distinct left neighbours
        levels.append(np.bincount(np.flatnonzero(levels[-1]) % SYMBOLS**order, minlength=SYMBOLS**order))
    p = np.full(1, 1 / SYMBOLS)
    for order, level in zip(range(1, ORDER + 1), reversed(levels)):
        cut = _cuts(*[int((level == k).sum()) for k in (1, 2, 3, 4)])
        less = np.array([0.0, *cut])[np.minimum(level, 3)]
        total, lost = level.reshape(-1, SYMBOLS).sum(axis=1), less.reshape(-1, SYMBOLS).sum(axis=1)
        rest = np.where(total > 0, lost / np.maximum(total, 1), 1.0)
        shorter = np.tile(p, SYMBOLS) if order > 1 else np.full(SYMBOLS, 1 / SYMBOLS)
        p = (level - less) / np.repeat(np.maximum(total, 1), SYMBOLS) + np.repeat(rest, SYMBOLS) * shorter
    return np.log10(p).astype(np.float32)


def _key(*words: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = textvec.mix((h + w) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words and ends, the word before and the word before that, and each text's number of tokens."""
    word, doc = textvec.words(texts, "plain")
    count = np.bincount(doc, minlength=len(texts)) + 1
    token = np.full(len(word) + len(texts), END, np.uint64)
    token[np.arange(len(word)) + doc] = word
    return token, *_before(token, count), count


def _before(token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(count) - count
    one, two = np.empty_like(token), np.empty_like(token)
    one[1:] = token[:-1]
    one[first] = BOS
    two[1:] = one[:-1]
    two[first] = BOS
    return one, two


def _keys(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Of each token: its trigram, bigram, word; the contexts of trigram and bigram."""
    return [_key(two, one, token), _key(one, token), _key(token), _key(two, one), _key(one)]


def spelling(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token's symbols and of the blanks before it, and each text's number of symbols."""
    code, bounds = codes(texts)
    cp, _ = textvec.points([x + "\n" for x in texts])  # an end stands where codes has it
    inside = textvec.look_up(textvec._letters("plain")[1], cp, True)
    ends = np.sort(np.concatenate([np.flatnonzero(np.diff(inside.astype(np.int8)) == -1) + 1, bounds[1:]]))
    total = np.concatenate([[0.0], np.cumsum(model[code].astype(np.float64))])
    return np.diff(total[ends], prepend=0.0), np.diff(bounds)


#: Rows of the model and of what it is summed from. GRAMS: sorted keys and counts. CONTEXTS: sorted keys, and for each VALUES of it.
#: SUMS and BIGRAMS: middle words (sorted) and the words before and behind them, with what contexts have so far or how many words were seen before.
#: WORDS: sorted keys, VALUES so far. TALLY: n-grams counted 1 .. 4 times and more than twice, sum of all counts; on level 0 the words before an end.
#: TOKENS: texts (shard, level and n: how many texts, distinct words and tokens) by sorted distinct words, numbers of them, tokens of each text. SPELLING: sorted codes and counts.
GRAMS, CONTEXTS, SUMS, BIGRAMS, WORDS, TALLY, TOKENS, SPELLING = range(8)
#: The n-gram's count; as a context: the total count of what follows, and how many n-grams follow that are counted once, twice, more often.
VALUES = 5
_MODEL = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])
_MODEL_DDL = "shard bigint, kind int, level int, n bigint, a binary, b binary, c binary, d binary"


def _packed(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_MODEL.names, (*r, *[None] * (len(_MODEL) - len(r))))) for r in rows], _MODEL)


def _cut(key: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Shards of sorted keys, and the bounds of each."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)).tolist()
    return [(s, a, b) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _dealt(kind: int, level: int, shards: int, key: np.ndarray, middle: np.ndarray, *others: np.ndarray) -> list[tuple]:
    """Rows by the shard of the sorted keys, each in the order of its middle words, which makes them short."""
    out = []
    for s, a, b in _cut(key, shards):
        order = np.argsort(middle[a:b])
        out.append((s, kind, level, b - a, pack_sorted(middle[a:b][order]), *[pack(x[..., a:b][..., order].ravel()) for x in others]))
    return out


def _merged(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the sums of their values (the last axis is that of the keys)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], order[first], np.add.reduceat(values[..., order], first, axis=-1) if len(first) else values


def _joined(rows: list[dict], column: str, dtype=np.int64, each: int = 1, how=unpack) -> np.ndarray:
    out = np.concatenate([np.zeros((each, 0), dtype), *[how(r[column], each * r["n"], dtype).reshape(each, -1) for r in rows]], axis=1)
    return out if each > 1 else out[0]


def _keys_of(rows: list[dict]) -> np.ndarray:
    return _joined(rows, "a", np.uint64, how=unpack_sorted)


def _few(c: np.ndarray) -> np.ndarray:
    """What n-grams of these counts add to their context."""
    return np.array([c, c == 1, c == 2, c > 2], np.int64)


def _tokens(batches):
    """What every pass over the trusted texts starts from; as long as the texts themselves."""
    for batch in batches:
        for piece in textvec.pieces(batch, limit=4 << 20):
            texts = textvec.strings(piece.column("text"))
            token, _, _, count = tokens(texts)
            word, place = _unique(token)
            code, times = textvec.distinct(codes(texts)[0])
            row = len(texts), TOKENS, len(word), len(token), pack_sorted(word), pack(place.astype(np.uint32)), pack(count.astype(np.uint32))
            yield from _packed([row, (0, SPELLING, 0, len(code), pack_sorted(code), pack(times.astype(np.int64)))]).to_batches()


def _spelled(batches):
    for batch in batches:
        for r in batch.to_pylist():
            code = unpack_sorted(r["a"], r["n"], np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(unpack(r["b"], r["n"], np.int64))], names=["code", "times"])


def _trigrams(shards: int, passes: int, at: int):
    """Trigrams whose middle word is of the pass, by shard."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                token = unpack_sorted(r["a"], r["level"], np.uint64)[unpack(r["b"], r["n"], np.uint32)]
                one, two = _before(token, unpack(r["c"], r["shard"], np.uint32).astype(np.int64))
                mine = np.flatnonzero(one % np.uint64(passes) == at)
                token, one, two = token[mine], one[mine], two[mine]
                key, place, times = _merged(_key(two, one, token), np.ones(len(mine), np.int64))
                yield from _packed(_dealt(GRAMS, 3, shards, key, one[place], two[place], token[place], times)).to_batches()

    return run


def _tally(shard: int, level: int, c: np.ndarray) -> tuple:
    return shard, TALLY, level, 6, np.array([*np.bincount(np.minimum(c, 5), minlength=6)[1:5], (c > 2).sum(), c.sum()], np.int64).tobytes()


def _count_trigrams(shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard, middle, first, last = rows[0]["shard"], _keys_of(rows), _joined(rows, "b", np.uint64), _joined(rows, "c", np.uint64)
        key, place, c = _merged(_key(first, middle, last), _joined(rows, "d"))
        middle, first, last = middle[place], first[place], last[place]
        out = [(shard, GRAMS, 3, len(key), pack_sorted(key), pack(c)), _tally(shard, 3, c)]
        key, place, few = _merged(_key(first, middle), _few(c))
        out += _dealt(SUMS, 3, shards, key, middle[place], first[place], few)
        key, place, before = _merged(_key(middle, last), np.ones(len(last), np.int64))
        return _packed(out + _dealt(BIGRAMS, 2, shards, key, middle[place], last[place], before))

    return run


def _count_bigrams(shards: int):
    """Bigrams as contexts and as n-grams, and what they add to their middle words."""

    def run(table: pa.Table) -> pa.Table:
        rows, out, words, values = table.to_pylist(), [], [np.zeros(0, np.uint64)], [np.zeros((VALUES, 0), np.int64)]
        shard = rows[0]["shard"]
        if part := [r for r in rows if r["kind"] == SUMS]:
            middle = _keys_of(part)
            key, place, few = _merged(_key(_joined(part, "b", np.uint64), middle), _joined(part, "c", each=4))
            out.append((shard, CONTEXTS, 3, len(key), pack_sorted(key), pack(np.concatenate([np.zeros((1, len(key)), np.int64), few]).ravel())))
            inside = place[middle[place] != BOS]  # a bigram is the context of what follows it, so these are all that end in the middle word
            words.append(middle[inside])
            values.append(np.concatenate([np.ones((1, len(inside)), np.int64), np.zeros((4, len(inside)), np.int64)]))
        if part := [r for r in rows if r["kind"] == BIGRAMS]:
            middle, last = _keys_of(part), _joined(part, "b", np.uint64)
            key, place, c = _merged(_key(middle, last), _joined(part, "c"))
            out += [(shard, GRAMS, 2, len(key), pack_sorted(key), pack(c)), _tally(shard, 2, c)]
            out.append((shard, TALLY, 0, 6, np.array([(last[place] == END).sum(), 0, 0, 0, 0, 0], np.int64).tobytes()))
            words.append(middle[place])
            values.append(np.concatenate([np.zeros((1, len(c)), np.int64), _few(c)]))
        key, _, value = _merged(_key(np.concatenate(words)), np.concatenate(values, axis=1))
        return _packed(out + [(s, WORDS, 1, b - a, pack_sorted(key[a:b]), pack(value[:, a:b].ravel())) for s, a, b in _cut(key, shards)])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    key, _, value = _merged(_keys_of(rows), _joined(rows, "b", each=VALUES))
    return _packed([(rows[0]["shard"], CONTEXTS, 2, len(key), pack_sorted(key), pack(value.ravel())), _tally(rows[0]["shard"], 1, value[0])])


def _merge(table: pa.Table) -> pa.Table:
    """What all passes have learned of a shard: trigrams, and shorter n-grams that are contexts too."""
    rows, out = table.to_pylist(), []
    shard = rows[0]["shard"]
    if part := [r for r in rows if r["level"] == 3 and r["kind"] == GRAMS]:
        key, _, c = _merged(_keys_of(part), _joined(part, "b"))
        out.append((shard, GRAMS, 3, len(key), pack_sorted(key), pack(c)))
    grams, contexts = [r for r in rows if r["level"] < 3 and r["kind"] == GRAMS], [r for r in rows if r["kind"] == CONTEXTS]
    if grams or contexts:
        c = _joined(grams, "b")
        values = np.concatenate([np.concatenate([c[None], np.zeros((VALUES - 1, len(c)), np.int64)]), _joined(contexts, "b", each=VALUES)], axis=1)
        key, _, values = _merged(np.concatenate([_keys_of(grams), _keys_of(contexts)]), values)
        out.append((shard, CONTEXTS, 0, len(key), pack_sorted(key), pack(values.ravel())))
    return _packed(out)


def _tallies(rows: DataFrame) -> np.ndarray:
    """A row of six sums per level, summed before they come to the driver."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(6, r["level"])), pa.array(np.arange(6)), pa.array(np.frombuffer(r["a"], np.int64))], names=["level", "i", "v"])

    out = np.zeros((4, 6), np.int64)
    for level, i, v in rows.filter(F.col("kind") == TALLY).select("level", "a").mapInArrow(run, "level bigint, i bigint, v bigint").groupBy("level", "i").agg(F.sum("v")).collect():
        out[level, i] = v
    return out


def _free(spark: SparkSession) -> None:
    """Shuffle files go when the driver's garbage is collected; a pass does not wait for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _in_pass(passes: int, at: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == at


def fit_words(texts: DataFrame, table: str, path: str, shards: int, tasks: int, passes: int) -> np.ndarray:
    """Writes a table, in buckets of shards, of the n-grams and contexts seen; returns the tallies of its levels."""
    spark, tallies, parts = texts.sparkSession, np.zeros((4, 6), np.int64), scratch_path(texts.sparkSession, "kn-parts")
    of = F.col("kind")
    texts = texts.filter(of == TOKENS)

    def by_shard(rows: DataFrame, run) -> DataFrame:
        return rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, _MODEL_DDL)

    def put(rows: DataFrame) -> None:
        rows.filter(of.isin(GRAMS, CONTEXTS)).withColumn("part", F.col("shard") % MERGES).write.mode("append").option("compression", "uncompressed").partitionBy("part").parquet(parts)

    for at in range(passes):
        three = materialize(by_shard(texts.mapInArrow(_trigrams(shards, passes, at), _MODEL_DDL), _count_trigrams(shards)), "kn-trigrams")
        _free(spark)
        two = materialize(by_shard(three.filter(of.isin(SUMS, BIGRAMS)), _count_bigrams(shards)), "kn-bigrams")
        _free(spark)
        put(three)
        tallies += _tallies(three)
        discard(three)
        one = materialize(by_shard(two.filter(of == WORDS), _count_words), "kn-words")
        put(two.unionByName(one))
        tallies += _tallies(two.unionByName(one))
        discard(two)
        discard(one)
        _free(spark)
    if ends := int(tallies[0, 0]):  # an end is nobody's context; the words before it belong to all passes
        key, c = _key(np.array([END])), np.array([ends])
        shard = int(shard_of(key, shards)[0])
        put(spark.createDataFrame([(shard, GRAMS, 1, 1, pack_sorted(key), pack(c), None, None)], _MODEL_DDL))
        tallies[1] += np.frombuffer(_tally(shard, 1, c)[-1], np.int64)
    for at in range(MERGES):
        rows = spark.read.schema(f"{_MODEL_DDL}, part bigint").parquet(parts).filter(F.col("part") == at).drop("part")
        by_shard(rows, _merge).write.mode("append").option("path", path).option("compression", "uncompressed").bucketBy(tasks, "shard").saveAsTable(table)
        remove(spark, f"{parts}/part={at}")
        _free(spark)
    remove(spark, parts)
    return tallies


_REPLY = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("n_own", pa.int64()), ("n_rest", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])
_REPLY_DDL = "batch bigint, shard bigint, n bigint, n_own bigint, n_rest bigint, a binary, b binary, c binary, d binary"


def _batches(batches):
    for batch in batches:
        for piece in textvec.pieces(batch, limit=BATCH_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_pylist([{"batch": uuid.uuid4().int >> 65, "shard": -1, "n": piece.num_rows, "a": sink.getvalue().to_pybytes()}], _REPLY)


def _texts(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _ask(shards: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                token, one, two, _ = tokens(textvec.strings(_texts(row["a"]).column("text")))
                key = textvec.distinct(np.concatenate(_keys(token, one, two)))[0]
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "shard": s, "n": b - a, "a": pack_sorted(key[a:b])} for s, a, b in _cut(key, shards)], _REPLY)

    return run


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """a, b: places of the trigrams that were seen, and their counts; c, d: places of the shorter n-grams and contexts, and their VALUES."""
    questions = asked.to_pylist()
    if not questions:
        return _REPLY.empty_table()
    rows, sides = model.to_pylist(), []
    for kind, each in ((GRAMS, 1), (CONTEXTS, VALUES)):
        part = [r for r in rows if r["kind"] == kind]  # one at most
        sides.append((_keys_of(part), _joined(part, "b", each=each)))
    out = []
    for r in questions:
        wanted = unpack_sorted(r["a"], r["n"], np.uint64)
        found = []
        for key, values in sides:
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = np.flatnonzero(key[at] == wanted) if len(key) else np.zeros(0, np.int64)
            found.append((len(hit), pack_sorted(hit.astype(np.uint32)), pack(values[..., at[hit]].ravel())))
        (n_own, a, b), (n_rest, c, d) = found
        out.append({"batch": r["batch"], "shard": r["shard"], "n": r["n"], "n_own": n_own, "n_rest": n_rest, "a": a, "b": b, "c": c, "d": d})
    return pa.Table.from_pylist(out, _REPLY)


def _score(shared, tallies: np.ndarray):
    cuts = np.array([[0.0, *_cuts(*row[:4].tolist())] for row in tallies])
    total_words = int(tallies[1, 5])
    rest_of_words = float(cuts[1, 1:] @ tallies[1, [0, 1, 4]]) / total_words if total_words else 1.0

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        piece, replies = _texts(rows[0]["a"]), rows[1:]
        texts = textvec.strings(piece.column("text"))
        token, one, two, n_tokens = tokens(texts)
        keys = _keys(token, one, two)
        distinct, place = _unique(np.concatenate(keys))
        seen, at = np.zeros((VALUES, len(distinct)), np.int64), 0
        for r in replies:  # shards in order have sorted keys
            seen[0, at + unpack_sorted(r["a"], r["n_own"], np.uint32).astype(np.int64)] = unpack(r["b"], r["n_own"], np.int64)
            seen[:, at + unpack_sorted(r["c"], r["n_rest"], np.uint32).astype(np.int64)] = unpack(r["d"], VALUES * r["n_rest"], np.int64).reshape(VALUES, -1)
            at += r["n"]
        three, two_, one_, context, history = np.split(place, len(keys))

        def share(level, gram, total):  # what an n-gram has of its own
            c = seen[0, gram]
            return (c - cuts[level][np.minimum(c, 3)]) / np.maximum(total, 1)

        def rest(level, place):  # what a context leaves to the shorter n-gram
            total = seen[1, place]
            return np.where(total > 0, cuts[level, 1:] @ seen[2:, place] / np.maximum(total, 1), 1.0)

        spelled, symbols_of = spelling(texts, shared.value)
        left3 = rest(3, context)
        left2 = left3 * rest(2, history)
        own = share(3, three, seen[1, context]) + left3 * share(2, two_, seen[1, history]) + left2 * share(1, one_, total_words)
        with np.errstate(divide="ignore"):
            log_p = np.logaddexp(np.log(own), np.log(left2 * rest_of_words) + spelled * np.log(10))
        total = np.add.reduceat(log_p, np.cumsum(n_tokens) - n_tokens)
        return pa.table({"doc_id": piece.column("doc_id"), "lang": piece.column("lang"), "perplexity": np.maximum(1.0, np.exp(-total / symbols_of))})

    return run


def word_perplexity(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity) of docs under the word model of trusted."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = tasks = max(shuffle_width(spark), -(-size // SHARD_BYTES))
    learn, score = [max(1, min(most, size // PASS_BYTES)) for most in (LEARN_PASSES, SCORE_PASSES)]
    texts = []
    select = min(score, SELECT_PASSES)
    for at in range(select):
        texts.append(materialize(trusted.filter(_in_pass(select, at)).select("text").mapInArrow(_tokens, _MODEL_DDL), "kn-texts"))
        _free(spark)
    spelled = _union(texts).filter(F.col("kind") == SPELLING).mapInArrow(_spelled, "code int, times bigint")
    shared = spark.sparkContext.broadcast(_fit(spelled))  # SYMBOLS ** ORDER floats
    table, path = f"chromaweft_kn_{uuid.uuid4().hex}", scratch_path(spark, "kn-model")
    tallies = fit_words(_union(texts), table, path, shards, tasks, learn)
    for df in texts:
        discard(df)
    schema, scored = docs.select("doc_id", "lang").schema.add("perplexity", "double"), []
    for at in range(score):
        stored = materialize(docs.select("doc_id", "lang", "text").filter(_in_pass(score, at)).mapInArrow(_batches, _REPLY_DDL), "kn-batches")
        asked = stored.mapInArrow(_ask(shards), _REPLY_DDL).repartition(tasks, "shard")
        replies = asked.groupBy("shard").cogroup(spark.table(table).groupBy("shard")).applyInArrow(_answer, _REPLY_DDL)
        scored.append(materialize(stored.unionByName(replies).repartition(tasks, "batch").groupBy("batch").applyInArrow(_score(shared, tallies), schema), "kn-perplexity"))
        discard(stored)
        _free(spark)
    spark.sql(f"DROP TABLE {table}")
    remove(spark, path)
    return _union(scored)


def perplexity(docs: DataFrame, model: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all, if None) and perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS ** ORDER floats
    names = list(docs.columns if keep is None else keep)

    def run(batches):
        for batch in batches:
            for piece in textvec.pieces(batch):
                code, bounds = codes(textvec.strings(piece.column("text")))
                total = np.add.reduceat(shared.value[code].astype(np.float64), bounds[:-1])
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(10 ** (-total / np.diff(bounds)))], names=[*names, "perplexity"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("perplexity", "double"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the upper edge of the bin in which each language's quantile lies; lang '*' is all together.

    scored: lang (not null) and perplexity of trusted documents.
    """
    width = 2 * np.log(SYMBOLS) / BINS
    bins = scored.groupBy("lang", F.least(F.lit(BINS - 1), F.floor(F.log("perplexity") / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    both = bins.withColumn("lang", F.explode(F.array("lang", F.lit("*")))).groupBy("lang", "bin").agg(F.sum("n").alias("n"))

    def cut(rows):  # at most BINS bins of a language
        out = F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("bin")), lambda a, x: F.when(a["bin"] >= 0, a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), F.when(a["sum"] + x["n"] >= F.col("need"), x["bin"]).otherwise(-1).alias("bin"))))
        return out["bin"]

    lists = both.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("rows"), F.ceil(F.sum("n") * quantile).alias("need"))
    return lists.select("lang", F.exp((cut("rows") + 1) * width).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept), one row per row of docs."""
    ids = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select("doc_id")
    ids = materialize(ids, "kn-trusted").hint("merge")  # trusted ids grow with the corpus: always joined by shuffle
    docs = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    held_out = crc_mod(F.col("doc_id"), HELD_OUT) == 0
    scored = word_perplexity(docs, docs.select("doc_id", "text").filter(~held_out).join(ids, "doc_id", "left_semi"))
    trusted = scored.join(ids, "doc_id", "left_semi")
    cuts = {r["lang"]: r["threshold"] for r in thresholds(trusted.filter(held_out), quantile).collect()}  # a number per language
    if not cuts:
        cuts = {r["lang"]: r["threshold"] for r in thresholds(trusted, quantile).collect()}
    threshold = F.lit(cuts.get("*", float("inf")))
    for lang, value in cuts.items():
        threshold = F.when(F.col("lang") == lang, F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("kept", F.col("perplexity") <= F.col("threshold"))
