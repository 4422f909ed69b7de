"""The registered queries: each runs its operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import backoff_lm, decontaminate, fill_middle, hard_negatives, html_text, license_scan, merge_dropout, pii, simhash, substring_dedup, token_files, toxicity, weak_quality
from attesta.plans.registry import registrar
from attesta.session import table

QUERIES, query = registrar()


@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(manifest)


@query()
def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(list_slice(ws, i, i + 19), ' ')))) AS h, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        d AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM k) WHERE rn > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
        p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT p.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(x, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY 1)
       SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    # A default argument would count as the filter's second parameter, the index; a closure binds the kind.
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def _crc_table() -> list[int]:
    """The 256 steps of CRC-32, by its rule."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


@query(
    f"""WITH x AS (SELECT {_crc_table()}::BIGINT[] AS tab),
        dt AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 2 AS held_out,
               list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' end') AS ws FROM documents, x),
        t AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_prepend(' start', ws[:-2])) AS h FROM dt),
        u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM u),
        b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2), hh AS (SELECT h, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
        p AS (SELECT t.doc_id, held_out, n, u.c, (coalesce(u.c, 0) + 1) / (n + v + 1) AS pu, coalesce(b.c, 0) AS bc, coalesce(hh.c, 0) AS hc
              FROM t CROSS JOIN n LEFT JOIN u ON t.w = u.w LEFT JOIN b ON t.h = b.h AND t.w = b.w LEFT JOIN hh ON t.h = hh.h)
       SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, round(sum(log10(pu)), 6) AS base_score,
              round(sum(log10((bc + 10 * pu) / (hc + 10))), 6) AS score FROM p GROUP BY 1, 2"""
)
def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query()
def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        license_scan.joined("base_labels").alias("base_labels"), license_scan.joined("labels").alias("labels"), "score",
        F.array_join("expressions", "; ").alias("expressions"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
        g AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM t),
        c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
              CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT *, array_to_string(u[:a], '') AS head, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS tail FROM c)
       SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(coalesce(head, '')) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(mid, '')) END AS middle_chars,
              sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || coalesce(head, '') || '<S>' || coalesce(tail, '') || '<M>' || coalesce(mid, '')
                     ELSE '<S>' || coalesce(tail, '') || '<P>' || coalesce(head, '') || '<M>' || coalesce(mid, '') END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""
)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
       SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
       FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
       QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5"""
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)
