"""The queries of this subpackage: op1 to op13, each over its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, audit, chat, digest, langid, media, packing, pieces, pii, search, secrets, simhash, warc
from .common import table


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(pii.find_spans(table(spark, sf_dir, "documents")))


def op2_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_collapsed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_table(table(spark, sf_dir, "documents")))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("version"), "text")
    return secrets.digest_findings(secrets.scan_history(docs, secrets.new_ledger(spark)))


def op13_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_collapsed_chat": chat.SQL, "op11_filter_replay": audit.SQL, "op12_blob_ledger": secrets.SQL, "op13_clustered_search": search.SQL}
