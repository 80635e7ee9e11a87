"""The corpus pipeline and its stages, on odd rows, on an empty table, and against plain versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chromaweft.llm import secret_scan, sp_codec, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\W_]+")


def _shingles(text, short):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w and short else set())


def _first_of_each_class(rows):
    sets = {i: _shingles(t, True) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for r in rows if find(r[0]) == r[0]]


def _blanked(text, spans):
    cuts = sorted((secret_scan.ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, k, b in spans)
    out, at = "", 0
    for a, b in cuts:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a secret of each kind, copies, and a document with a benchmark item
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    texts = {i: t for i, t, *_ in rows}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in rows if toxicity._toxicity([r[1] or ""], model)[0] < 0.5]
    kept = _first_of_each_class(kept)
    items = [s for s in (_shingles(r["text"], False) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if s]
    kept = [r for r in kept if not any(len(s & _shingles(r[1], False)) >= 0.8 * len(s) for s in items)]
    assert 0 < len(kept) < len(rows) and item
    left = docs.filter(F.col("doc_id").isin([r[0] for r in kept]))
    field = secret_scan.fit(left)
    codec, want = sp_codec.Codec(sp_codec.load_vocabulary()), {}
    for i, t, lang, source, _ in kept:
        clean = _blanked(t, secret_scan.scan([t], field)[0]) if t else ""
        packed = codec.encode(clean, i)
        want[i] = (lang, source, len(packed) // 2, hashlib.sha256(packed).hexdigest(), True)
    got = {r["doc_id"]: (r["lang"], r["source"], r["n_pieces"], r["pieces_sha256"], r["lossless"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and set(got) <= set(texts)


def test_planted_rows_of_every_stage(spark):
    """Each stage's decision on rows made for it; the stage before keeps them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    words = [f"harbour{i} lantern{i * 7 % 50}" for i in range(60)]
    made = [(9001, " ".join(words)), (9002, " ".join([*words[:58], "changed end"])), (9003, " ".join([*(f"meadow{i} orchard{i}" for i in range(40)), item, *(f"summer{i}" for i in range(30))])), (9004, 'my token = "0123456789abcdef0123456789abcdef01234567" here')]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, planted, SF).collect()} == {9001, 9003, 9004}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, planted, SF).collect()} == {9001, 9002, 9004}
    clean = {r["doc_id"]: r for r in corpus_pipeline.blank_secrets(spark, planted, SF).collect()}
    assert clean[9004]["text"] == 'my token = "[SECRET]" here' and clean[9004]["n_chars"] == len(clean[9004]["text"])
    assert all(clean[i]["text"] == t for i, t in made[:2])
    assert corpus_pipeline.encode(spark, planted, SF).filter("lossless and n_pieces > 0").count() == 4


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    n = {"near_duplicates": odd.count() - 2}.get(name, odd.count())  # one copy of "one" and one repeated row go
    assert got.count() == n
    if name != "encoding":
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
        assert stage(spark, none, SF).count() == 0 and stage(spark, none, SF).columns == odd.columns
    else:
        assert stage(spark, none, SF).count() == 0
