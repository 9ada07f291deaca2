"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.lang_id import fit, held_out_rows, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, held_out_rows())
    rows = docs.select("doc_id", "text", held_out_rows().alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.packing import pack, piece_digests

    return piece_digests(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.blob_ledger import digest, findings, update

    return digest(findings(*update(table(spark, sf_dir, "documents"))))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.lang_id import held_out_rows
    from maskwright.llm.toxicity import fit, score

    docs, held_out = table(spark, sf_dir, "documents"), held_out_rows(5, 0)
    model = fit(docs, table(spark, sf_dir, "labels"), held_out)
    rows = score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return rows.selectExpr("doc_id", "held_out", "toxicity AS score", "CAST(toxicity >= 0.5 AS INT) AS predicted")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.jpeg import features, media

    return features(media(table(spark, sf_dir, "documents"))).drop("width", "height")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_packing, op3_benchmark_decontamination, op4_secret_scan, op5_html_extraction,
    op6_toxicity, op7_simhash_near_dedup, op8_media_columns, op9_suffix_array_dedup,
    op10_quality_classifier,
)}

def _oracles() -> dict[str, str]:
    from maskwright.llm import blob_ledger, decontam

    return {"op3_benchmark_decontamination": decontam.ORACLE_SQL, "op4_secret_scan": blob_ledger.ORACLE_SQL}


ORACLE_SQL: dict[str, str] = _oracles()
