"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (words: runs of letters and digits, in lower case; a text of one to
four words has one shingle of all of them). Two documents are linked if their sets' Jaccard similarity is at least
the threshold.

1. Documents with equal sets share a node (a 128-bit digest of the set); copies are counted, not paired.
2. Nodes whose MinHash signatures agree in one of `BANDS` bands of `ROWS` values are candidates. A band's bucket is
   a star around its smallest node, so edges grow with the buckets' members, not with their squares; the
   stars' components hold every candidate pair.
3. Within a component, pairs are compared by `N_BAYES` further MinHash values, 16 at a time: a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below `TOLERANCE`; the rest
   is verified on the exact sets. Small components are packed into tasks. Components of more than `BLOCK` nodes or `BLOCK_BYTES` are
   cut into blocks, one or more for each smallest star of their nodes, and only pairs of blocks that some band holds together are
   compared, packed into tasks of about `BLOCK_BYTES`: a long chain of similar texts costs tasks in proportion to its nodes, and only a group in which all resemble all costs the
   square of its blocks, which counting its links needs.
4. A task returns, per node, its number of links and one edge of a spanning forest: the output grows with the
   nodes however many links there are.

Result per row: class_id, the smallest id of the documents connected by links, and n_links, the number of other
documents (distinct ids) that the document is linked to, copies included.

Defined results: null and empty texts, and texts without words, have no links and are their own class; null ids
take no part: class_id null, 0 links; repeated rows (same id and text) are one document and get the same result; ids may be of
any type that has an order; columns other than doc_id and text are not read, and drop_near_duplicates hands them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import discard, materialize
from chromaweft.operators.components import connected_components

THRESHOLD = 0.8
#: A pair at similarity 0.8 shares a band with probability 0.9999.
BANDS, ROWS = 30, 6
N_BAYES = 128
STEP = 16
TOLERANCE = 1e-4
#: Nodes of one block and about its bytes of shingles and signatures (a single text may have more); a task holds two blocks at most.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Rows of one key are spread over so many tasks in joins.
SALTS = 8


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    word, doc = textvec.words(texts)
    return textvec.shingles(word, doc, len(texts), short=True)


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set, null for the empty set."""
    size = np.diff(bounds)
    parts = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        parts.append(textvec.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)))
    both = np.ascontiguousarray(np.stack(parts, axis=1))
    return [both[i].tobytes() if n else None for i, n in enumerate(size)]


def _nodes(batches):
    for batch in batches:
        for piece in textvec.pieces(batch):
            h, bounds = _sets(textvec.strings(piece.column("text")))
            sig = textvec.minima(h, bounds, range(BANDS * ROWS)).astype(np.uint64)
            band = np.zeros((len(sig), BANDS), np.uint64)
            for r in range(ROWS):
                band = textvec.mix(band + sig[:, r::ROWS] + np.uint64(r + 1))
            band = textvec.mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * BANDS, pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_digests(h, bounds), pa.binary()), lists], names=["doc_id", "node", "bands"])


def _signatures(batches):
    for batch in batches:
        for piece in textvec.pieces(batch):
            h, bounds = _sets(textvec.strings(piece.column("text")))
            same = np.array([a == b for a, b in zip(_digests(h, bounds), piece.column("node").to_pylist())], bool)
            sig = textvec.minima(h, bounds, range(BANDS * ROWS, BANDS * ROWS + N_BAYES))
            blobs = pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
            sigs = pa.array([np.ascontiguousarray(s).tobytes() for s in sig], pa.binary())
            out = pa.RecordBatch.from_arrays([piece.column("node"), piece.column("component"), piece.column("centre"), piece.column("copies"), blobs, sigs], names=["node", "component", "centre", "copies", "shingles", "signature"])
            yield out.filter(pa.array(same))


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair is kept.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), so P(J >= t) = P(Bin(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, N_BAYES + 1, STEP):
        log = [0.0]
        for i in range(1, n + 2):
            log.append(log[-1] + np.log((n + 2 - i) / i))
        tail = np.cumsum([np.exp(log[i] + i * np.log(threshold) + (n + 1 - i) * np.log1p(-threshold)) for i in range(n + 2)])
        out[n] = int(np.argmax(tail >= tolerance))
    return out


def similar_pairs(shingles: list[np.ndarray], signature: np.ndarray, groups: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j at the threshold; with groups, only pairs of different groups."""
    n = len(shingles)
    least = least_matches(threshold, tolerance)
    size = np.array([len(s) for s in shingles])
    left, right = [], []
    for a in range(0, n, 256):  # 256 rows against all later ones
        match = np.zeros((min(256, n - a), n - a), np.int16)
        for k in range(STEP):
            match += signature[a : a + 256, k][:, None] == signature[a:, k][None, :]
        i, j = np.nonzero(match >= least[STEP])
        keep = i < j
        i, j = i[keep], j[keep]
        count = match[i, j].astype(np.int32)
        i, j = i + a, j + a
        if groups is not None:
            keep = groups[i] != groups[j]
            i, j, count = i[keep], j[keep], count[keep]
        keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j, count = i[keep], j[keep], count[keep]
        for at in range(STEP, N_BAYES, STEP):
            if not len(i):
                break
            count = count + (signature[i, at : at + STEP] == signature[j, at : at + STEP]).sum(axis=1)
            keep = count >= least[at + STEP]
            i, j, count = i[keep], j[keep], count[keep]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return i, j
    if len(i) <= 4 * n:
        shared = np.empty(len(i), np.int64)
        for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
            a, b = (shingles[p], shingles[q]) if size[p] <= size[q] else (shingles[q], shingles[p])
            shared[k] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
    else:  # many pairs: all intersections at once, over the shingles that two or more have
        flat = np.concatenate(shingles)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
        often = np.bincount(column)[column] > 1
        owner, column = owner[often], column[often]
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        total = np.zeros((n, n), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            low, high = np.searchsorted(column, [a, a + 4096])
            dense = np.zeros((n, 4096), np.float32)
            dense[owner[low:high], column[low:high] - a] = 1
            total += dense @ dense.T
        shared = total[i, j].astype(np.int64)
    keep = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest connected index of each of n points."""
    root = np.arange(n)
    while len(i):  # hook the larger root under the smaller, then shorten
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short
    return root


_TASK = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("links", pa.int64()), ("cut", pa.bool_())])


def _verify(threshold: float, tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        out = {"node": [], "parent": [], "links": [], "cut": []}
        rows = table.select(["unit", "block", "node", "copies", "cut", "shingles", "signature"]).to_pydict()
        order = sorted(range(table.num_rows), key=lambda r: (rows["unit"][r], rows["node"][r]))
        at = 0
        while at < len(order):
            to = at
            while to < len(order) and rows["unit"][order[to]] == rows["unit"][order[at]]:
                to += 1
            mine = order[at:to]
            at = to
            shingles = [np.frombuffer(rows["shingles"][r], np.uint64) for r in mine]
            signature = np.frombuffer(b"".join(rows["signature"][r] for r in mine), np.uint32).reshape(len(mine), N_BAYES)
            block = np.array([rows["block"][r] for r in mine])
            i, j = similar_pairs(shingles, signature, block if len(set(block.tolist())) > 1 else None, threshold, tolerance)
            if not len(i):
                continue
            copies = np.array([rows["copies"][r] for r in mine], np.int64)
            links = (np.bincount(i, copies[j], len(mine)) + np.bincount(j, copies[i], len(mine))).astype(np.int64)
            root = _forest(i, j, len(mine))
            for k in np.flatnonzero(links):
                out["node"].append(rows["node"][mine[k]])
                out["parent"].append(rows["node"][mine[root[k]]])
                out["links"].append(int(links[k]))
                out["cut"].append(rows["cut"][mine[k]])
        return pa.Table.from_pydict(out, _TASK)

    return run


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _spread(df: DataFrame, name: str) -> DataFrame:
    """Each row under SALTS numbers, so that the many rows of one key that it is joined to go to as many tasks."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _deal(signed: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of signed with the tasks they belong to: (task, unit, block) besides the rest; see step 3 above."""
    size = F.octet_length("shingles") + F.octet_length("signature")

    def parts(n, total):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(total / BLOCK_BYTES)).cast("bigint")

    slim = signed.select("node", "component", "centre", size.alias("size"), _salt("node").alias("salt"))
    whole = slim.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).select("c", parts(F.col("n"), F.col("total")).alias("blocks"))
    large = slim.join(_spread(whole.filter("blocks > 1"), "s"), (F.col("component") == F.col("c")) & (F.col("salt") == F.col("s"))).drop("s")
    keys = large.groupBy(F.col("c").alias("kc"), F.col("centre").alias("kk")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).select("kc", "kk", parts(F.col("n"), F.col("total")).alias("cuts"))
    block = F.xxhash64("c", "centre", F.pmod(F.xxhash64("node"), F.col("cuts")))
    blocks = large.join(_spread(keys, "s"), (F.col("c") == F.col("kc")) & (F.col("centre") == F.col("kk")) & (F.col("salt") == F.col("s"))).select(F.col("node").alias("bn"), "size", block.alias("block"))
    blocks = materialize(blocks, "jaccard-blocks")
    # blocks that some band holds together
    held = members.join(blocks, F.col("node") == F.col("bn")).select("band", "block").distinct()
    pairs = held.select("band", F.col("block").alias("x")).join(held.select(F.col("band").alias("other"), F.col("block").alias("y")), (F.col("band") == F.col("other")) & (F.col("x") <= F.col("y"))).select("x", "y").distinct()
    pairs = materialize(pairs, "jaccard-block-pairs")
    wanted = pairs.select(F.col("x").alias("b"), "x", "y").union(pairs.filter("x < y").select(F.col("y").alias("b"), "x", "y"))
    units = blocks.join(wanted, F.col("block") == F.col("b")).select("bn", "size", "block", F.xxhash64("x", "y").alias("unit"))

    def task(unit, total):  # units are packed into tasks of about BLOCK_BYTES
        return F.pmod(F.xxhash64(unit), F.lit(max(1, (total or 0) // BLOCK_BYTES)))

    shape = ["node", "copies", "shingles", "signature", "cut", "block", "unit", "task"]
    cut = signed.join(units.drop("size"), F.col("node") == F.col("bn")).withColumn("cut", F.lit(True)).withColumn("task", -1 - task("unit", units.agg(F.sum("size")).first()[0]))
    small = signed.join(whole.filter("blocks = 1"), F.col("component") == F.col("c")).withColumn("unit", F.xxhash64("component"))
    small = small.withColumn("task", task("unit", slim.agg(F.sum("size")).first()[0])).withColumn("cut", F.lit(False)).withColumn("block", F.lit(0).cast("bigint"))
    return small.select(*shape).unionByName(cut.select(*shape))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    nodes = materialize(docs.select("doc_id", "text").mapInArrow(_nodes, f"doc_id {id_type}, node binary, bands array<bigint>"), "jaccard-nodes")
    known = nodes.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    reps = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("bands").alias("bands"))
    reps = materialize(reps, "jaccard-reps")
    # ids of copies counted once each, should rows repeat
    repeated = known.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("node").agg(F.sum(F.col("n") - 1).alias("surplus"))
    copies = reps.select("node", "rep", "rows").join(repeated, "node", "left").select("node", "rep", (F.col("rows") - F.coalesce("surplus", F.lit(0))).alias("copies"))
    copies = materialize(copies, "jaccard-copies")

    rows = reps.select("node", F.explode("bands").alias("band"), _salt("node").alias("salt"))
    stars = rows.groupBy(F.col("band").alias("b")).agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = rows.join(_spread(stars, "s"), (F.col("band") == F.col("b")) & (F.col("salt") == F.col("s"))).select("band", "node", "centre")
    members = materialize(members, "jaccard-members")
    discard(reps)
    candidates = connected_components(members.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    first = members.groupBy(F.col("node").alias("member")).agg(F.min("centre").alias("centre"))
    candidates = candidates.join(first, F.col("node") == F.col("member")).drop("member").join(copies, "node")
    # texts move at most once here, whatever the number of candidates
    wanted = docs.select(F.col("doc_id").alias("d"), "text").join(candidates.hint("merge"), F.col("d") == F.col("rep"))
    wanted = wanted.select("text", "node", "component", "centre", "copies")
    signed = wanted.mapInArrow(_signatures, "node binary, component binary, centre binary, copies bigint, shingles binary, signature binary").dropDuplicates(["node"])
    signed = materialize(signed, "jaccard-signed")
    found = _deal(signed, members).groupBy("task").applyInArrow(_verify(threshold, tolerance), "node binary, parent binary, links bigint, cut boolean")
    found = materialize(found, "jaccard-links")
    discard(signed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = found.filter("not cut").select("node", F.col("parent").alias("root"))
    merged = connected_components(found.filter("cut").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    whole = whole.union(merged.select("node", F.col("component").alias("root")))
    linked = whole.join(copies.select("node", "rep"), "node").select("node", "root", "rep")
    lowest = linked.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("lowest"))
    linked = linked.withColumn("salt", _salt("node")).join(_spread(lowest, "s"), (F.col("root") == F.col("r")) & (F.col("salt") == F.col("s"))).join(links, "node").select("node", "lowest", "links")
    # what documents need to know: of nodes with copies or links only
    facts = copies.filter("copies > 1").select("node", "rep", "copies").join(linked, "node", "full").join(copies.select(F.col("node").alias("n2"), F.col("rep").alias("own_rep"), F.col("copies").alias("own_copies")), F.col("node") == F.col("n2"))
    facts = facts.select(F.col("n2").alias("fact"), F.coalesce("lowest", "own_rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("own_copies") - 1).alias("n"))
    facts = materialize(facts, "jaccard-facts")
    discard(members)
    slim = nodes.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), _salt("doc_id").alias("salt"))
    joined = slim.join(_spread(facts, "s"), (F.col("node") == F.col("fact")) & (F.col("salt") == F.col("s")), "left")
    return joined.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: that with the smallest id. Rows without an id stay; of rows with equal id and text one stays."""
    found = materialize(classes(docs, threshold), "jaccard-classes")
    gone = found.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    # always by shuffle: the dropped ids grow with the corpus
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    repeats = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeats.take(1):  # the same id in several rows: one of each id and text stays
        first = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
        kept = first.unionByName(kept.filter(F.col("doc_id").isNull()))
    return kept
