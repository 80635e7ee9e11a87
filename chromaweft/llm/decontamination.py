"""Benchmark decontamination: which short test items stand inside which documents.

Containment of an item in a document is the share of the item's distinct five-word shingles (words: runs of
letters and digits, in lower case) that the document has. Candidates come from a size-partitioned MinHash search:
items fall into size classes of at most 2 ** c shingles; for each class in use, documents are read as windows of
2 ** (c + 1) shingles, one starting every 2 ** c, so that an item in a row lies wholly in one window and their
sizes differ by a factor of four at most. A window and an item that agree in one of `N_HASHES` minima make
(document, item) a candidate: of items 80 % contained in a row about one in a million is missed. Candidates
are verified by exact containment over the whole document.

Items are the query set: they are sent to the tasks in blocks of at most `BLOCK_BYTES` of text, each block
against all documents in one scan without a shuffle.

Defined results: null texts are empty; items of fewer than five words have no shingles and are found nowhere;
repeated rows and items give repeated pairs; null ids stay null; columns other than doc_id, item_id and text are
not read, and drop_contaminated hands them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.llm import textvec

THRESHOLD = 0.8
N_WORDS = 5
N_HASHES = 64
BLOCK_BYTES = 32 << 20


def ordered_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in reading order, repeats included, and each one's text."""
    word, doc = textvec.words(texts)
    k = len(word) - N_WORDS + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = doc[:k] == doc[N_WORDS - 1 :]
    h = np.zeros(k, np.uint64)
    for i in range(N_WORDS):
        h += word[i : i + k] * np.uint64(pow(0xA0761D6478BD642F, i, 1 << 64))
    return textvec.mix(h[same]), doc[:k][same]


class Items:
    """A block of items as arrays."""

    def __init__(self, ids: list, texts: list[str]):
        h, d = ordered_shingles(texts)
        sets = [textvec.distinct(h[a:b])[0] for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(d, np.arange(len(texts) + 1))))]
        self.used = [i for i, s in enumerate(sets) if len(s)]
        self.ids = [ids[i] for i in self.used]
        self.sets = [sets[i] for i in self.used]
        self.classes, self.prefix = {}, {}
        level = np.array([max(0, int(np.ceil(np.log2(len(s))))) for s in self.sets], int)
        for c in sorted(set(level.tolist())):
            members = np.flatnonzero(level == c)
            minima = np.array([[textvec.permuted((self.sets[i] >> np.uint64(32)).astype(np.uint32), k).min() for i in members] for k in range(N_HASHES)], np.uint32)
            order = np.argsort(minima, axis=1, kind="stable")
            self.classes[c] = (np.take_along_axis(minima, order, 1), members[order])
            self.prefix[c] = np.zeros((N_HASHES, 1 << 16), bool)  # which high halves of a minimum occur
            for k in range(N_HASHES):
                self.prefix[c][k][minima[k] >> np.uint32(16)] = True

    def candidates(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs, as rows."""
        if not len(h) or not self.classes:
            return np.zeros((0, 2), np.int64)
        x = (h >> np.uint64(32)).astype(np.uint32)
        place = np.arange(len(d)) - np.searchsorted(d, d)  # of each shingle within its document
        # blocks of each class, as runs of the blocks of the class before
        starts, docs, inner, last = {}, {}, {}, np.arange(len(d))
        for c in self.classes:
            begin = np.flatnonzero((place[last] & ((1 << c) - 1)) == 0)
            inner[c], last = begin, last[begin]
            docs[c] = d[last]
            starts[c] = np.append(docs[c][1:] == docs[c][:-1], False)
        found = []
        for k in range(N_HASHES):
            low = textvec.permuted(x, k)
            for c, (minima, member) in self.classes.items():
                low = np.minimum.reduceat(low, inner[c])
                window = np.where(starts[c], np.minimum(low, np.append(low[1:], low[-1])), low)
                maybe = np.flatnonzero(self.prefix[c][k][window >> np.uint32(16)])
                window = window[maybe]
                a = np.searchsorted(minima[k], window, side="left")
                n = np.searchsorted(minima[k], window, side="right") - a
                if n.any():
                    at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(textvec.distinct(np.repeat(docs[c][maybe], n) << 32 | member[k][at])[0])
        if not found:
            return np.zeros((0, 2), np.int64)
        pair = textvec.distinct(np.concatenate(found))[0]
        return np.stack([pair >> 32, pair & 0xFFFFFFFF], axis=1)

    def search(self, texts: list[str], threshold: float) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all pairs at the threshold."""
        h, d = ordered_shingles(texts)
        out, of, own = [], -1, None
        for doc, item in self.candidates(h, d).tolist():
            if doc != of:
                a, b = np.searchsorted(d, [doc, doc + 1])
                of, own = doc, np.sort(h[a:b])
            mine = self.sets[item]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            shared = int((own[at] == mine).sum())
            if shared >= threshold * len(mine) - 1e-9:
                out.append((doc, item, shared))
        return out


def _blocks(items: DataFrame, block_bytes: int):
    items = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = rows.toArrow()  # of bounded size: about block_bytes
        yield Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def find_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all pairs at the threshold."""
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, shared bigint, item_shingles bigint, containment double"
    out = None
    for block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            query = shared.value
            for batch in batches:
                for piece in textvec.pieces(batch):
                    found = query.search(textvec.strings(piece.column("text")), threshold)
                    if found:
                        doc, item, common = (np.array(x) for x in zip(*found))
                        size = np.array([len(query.sets[i]) for i in item])
                        ids = pa.array([query.ids[i] for i in item])
                        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(doc)), ids.cast(pa.int64()) if pa.types.is_null(ids.type) else ids, pa.array(common), pa.array(size), pa.array(common / size)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(run, types)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item is contained."""
    for block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for piece in textvec.pieces(batch):
                    bad = {doc for doc, _, _ in shared.value.search(textvec.strings(piece.column("text")), threshold)}
                    yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)])) if bad else piece

        docs = docs.mapInArrow(run, docs.schema)
    return docs
