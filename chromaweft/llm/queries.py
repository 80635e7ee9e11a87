"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaweft.llm import decontamination, jaccard_join, katz, language_id, quality_lm, quality_rules, secret_scan, sp_codec, toxicity, warc
from chromaweft.llm.common import crc_mod, scratch_path, table


def op1_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest_rows(docs, secret_scan.fit(docs))


def op2_decontamination(spark, sf_dir):
    return decontamination.find_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_codec.encode_documents(docs, keep=["doc_id"], pieces=False)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = crc_mod(F.col("doc_id"), toxicity.FOLDS) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digest_rows(spark, path)


def op7_quality_rules(spark, sf_dir):
    scored = quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_rules")


def op8_katz(spark, sf_dir):
    return katz.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    predicted = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs.select("doc_id", "lang", "text")), keep=["doc_id"])
    return predicted.select("doc_id", (crc_mod(F.col("doc_id"), language_id.FOLDS) == language_id.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op10_quality_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_lm.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "kept")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_katz": op8_katz,
    "op9_language_id": op9_language_id,
    "op10_quality_lm": op10_quality_lm,
}

_SHINGLES = """
toks AS (SELECT kind, id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT kind, id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM src)),
sh AS (SELECT DISTINCT kind, id, s FROM (SELECT kind, id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM toks WINDOW o AS (PARTITION BY kind, id ORDER BY p)) WHERE s IS NOT NULL)
"""

_OP2 = f"""
WITH src AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
{_SHINGLES},
n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 'b' GROUP BY id),
pairs AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM sh d JOIN sh b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment FROM pairs JOIN n ON n.id = item_id WHERE shared >= 0.8 * n - 1e-9
"""

_OP3 = f"""
WITH RECURSIVE src AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents),
toks0 AS (SELECT id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM src),
{_SHINGLES},
sets AS (SELECT id, s FROM sh UNION ALL SELECT id, array_to_string(w, ' ') FROM toks0 WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
e AS (SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
      GROUP BY a.id, b.id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
r AS (SELECT id, id AS c FROM src UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT r.id AS doc_id, min(r.c) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.id) AS n_links FROM r GROUP BY r.id
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS b, sha1(h) AS s, sha256(h) AS k FROM p),
g AS (SELECT k, max(page_id) AS r FROM s WHERE b >= 1000 GROUP BY k)
SELECT s.page_id, s.b AS payload_bytes, s.s AS payload_digest,
       CASE WHEN g.r <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.r <> s.page_id THEN g.r END AS refers_to
FROM s LEFT JOIN g ON s.k = g.k AND s.b >= 1000
"""


def _op7_sql() -> str:
    def hit(rule, cut):
        a, b, way, _ = quality_rules.RULES[rule]
        return f"({b} > 0 AND {a} / {b} {'>' if way == 'above' else '<'} {cut})"

    risk, delta, n_rules = quality_rules.RISK / len(quality_rules.RULES), quality_rules.DELTA, len(quality_rules.RULES)
    cuts = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, {i} AS step, {cut} AS cut, count(*) AS n, count(*) FILTER ({hit(rule, cut)}) AS k FROM good GROUP BY stratum"
        for rule, (_, _, _, grid) in quality_rules.RULES.items()
        for i, cut in enumerate(grid)
    )
    rejected = " || ".join(
        f"CASE WHEN coalesce({hit(rule, f'(SELECT cut FROM chosen c WHERE c.rule = {chr(39)}{rule}{chr(39)} AND c.stratum = m.stratum)')}, false) THEN ',{rule}' ELSE '' END"
        for rule in quality_rules.RULES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM e),
tri AS (SELECT rid, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
dup AS (SELECT rid, g FROM tri WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT p + o) AS n FROM tri JOIN dup USING (rid, g) CROSS JOIN (VALUES (0), (1), (2)) x(o) GROUP BY rid),
m AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM e LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
cuts AS ({cuts}),
tested AS (SELECT *, CASE WHEN k <= n * {risk} THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) FROM range(k + 1) r(i)) ELSE 1 END <= {delta} / ((SELECT count(DISTINCT stratum) FROM good) * {n_rules}) AS ok FROM cuts),
chosen AS (SELECT a.stratum, a.rule, arg_max(a.cut, a.step) AS cut FROM tested a WHERE NOT EXISTS (SELECT 1 FROM tested z WHERE z.stratum = a.stratum AND z.rule = a.rule AND z.step <= a.step AND NOT z.ok) GROUP BY 1, 2),
v AS (SELECT m.*, {rejected} AS rej FROM b m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rej = '' AS kept, ltrim(rej, ',') AS rejected_rules FROM v
"""


#: The others are models: the tests compare them with plain versions.
ORACLE = {
    "op2_decontamination": _OP2,
    "op3_jaccard_join": _OP3,
    "op6_warc": _OP6,
    "op7_quality_rules": _op7_sql(),
}
