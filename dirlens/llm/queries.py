"""The registered queries of the operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlens.llm import align, bytebpe, decontaminate, digests, idfile, licenses, linededup, negatives, pii, quality, secrets, simhash, tokencount
from dirlens.llm.common import table
from dirlens.llm.span_sql import spans_sql
from dirlens.session import work_folder
from dirlens.llm.topk import exact_topk


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.zipf_scores(ranks))


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{work_folder(spark, 'id-files')}/ids"
    # a part per piece of the scan, so that parts keep their size as the input grows
    idfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, parts=max(1, docs.rdd.getNumPartitions()))

    def digest(doc_id, start, ids) -> dict:
        return {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids)}

    return idfile.read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decode = bytebpe.decoder(path)
    decimal = list(map(str, range(1 + max(bytebpe.read_ranks(path).values()))))

    def digest(doc_id, ids) -> dict:
        return {
            "doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest(),
            "decoded_sha256": sha256(decode(ids)).hexdigest(),
        }

    return bytebpe.documents(table(spark, sf_dir, "documents"), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), [r.kind for r in secrets.RULES if r.base]
    return secrets.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *(digests.count_of(spans, kind).alias(f"n_{kind}") for kind in base),
        digests.digest(digests.of_kinds(spans, base)).alias("base_sha256"), digests.as_text(spans).alias("spans"),
    )


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), length=4, most=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    terms = digests.of_kinds(spans, [pii.TERM])
    removed = F.size(F.filter(terms, lambda s: s["hit"] == "removed")).cast("long")
    return pii.found(table(spark, sf_dir, "documents")).select(
        "doc_id", *(digests.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS),
        digests.digest(digests.of_kinds(spans, pii.KINDS)).alias("base_sha256"), digests.as_text(spans).alias("spans"), removed.alias("n_removed"), (F.size(terms) - removed).alias("n_generalised"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mined(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label_col=label)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return align.alignment(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_id_files": op2_id_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op4_secret_scan": spans_sql(
        [(r.kind, r.pattern, f"length(regexp_extract(hit, $${r.pattern}$$, {r.group})) >= {r.least}") for r in secrets.RULES],
        [r.kind for r in secrets.RULES if r.base], "first, nth",
    ),
    "op5_exact_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.c, x.c)::BIGINT AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT a.vec_id AS anchor_id, a.label, a.c, x.vec_id AS positive_id, list_inner_product(a.c, x.c)::BIGINT AS positive_score
            FROM v a JOIN v x ON a.label = x.label AND a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, x.vec_id) <= 5
        ), s AS (
            SELECT a.vec_id AS anchor_id, x.vec_id AS negative_id, list_inner_product(a.c, x.c)::BIGINT AS negative_score
            FROM v a JOIN v x ON a.label <> x.label WHERE a.vec_id % 50 = 0
        )
        SELECT anchor_id, positive_id,
            (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INTEGER AS rank,
            negative_id, positive_score, negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
}
