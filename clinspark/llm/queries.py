"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinspark.llm import bpe
from clinspark.llm.alignment import Alignment, align_tokenizers
from clinspark.llm.divergence import audit_sources
from clinspark.llm.files import run_folder
from clinspark.llm.language import fit_languages, identify, training_texts
from clinspark.llm.minhash import NearDuplicates, near_duplicates
from clinspark.llm.neighbours import near_vectors
from clinspark.llm.packing import Packing, pack
from clinspark.llm.quality import fit_quality, score_quality
from clinspark.llm.records import RecordFormat, fetch, read_index, write_records
from clinspark.llm.search import search
from clinspark.llm.text import table, tuned
from clinspark.llm.token_counts import Attribution, count_section_tokens
from clinspark.llm.toxicity import fit_toxicity, score_toxicity, training_labels
from clinspark.llm.warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def query(fn: Query) -> Query:
    """Register under the function's name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tuned(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_counts(spark, d):
    return count_section_tokens(table(spark, d, "documents"), Attribution(BYTE_TOKENIZER))


@query
def op2_toxicity(spark, d):
    documents = table(spark, d, "documents")
    return score_toxicity(documents, fit_toxicity(documents, training_labels(table(spark, d, "labels"))))


@query
def op3_near_dedup(spark, d):
    return near_duplicates(table(spark, d, "documents"), NearDuplicates(words=4, percent=80))


@query
def op4_warc(spark, d):
    read = read_warc(write_warc(table(spark, d, "pages"), run_folder(spark, "warc")))
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_quality(spark, d):
    documents = table(spark, d, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, d, "labels")))


@query
def op6_packing(spark, d):
    packed = pack(table(spark, d, "documents"), Packing(WORD_TOKENIZER, END_ID))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost"
    )


@query
def op7_language(spark, d):
    documents = table(spark, d, "documents")
    return identify(documents, fit_languages(training_texts(documents)))


@query
def op8_token_records(spark, d):
    manifest = write_records(table(spark, d, "documents"), run_folder(spark, "records"), RecordFormat(WORD_TOKENIZER, END_ID))
    read = fetch(read_index(manifest))
    return read.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op9_search(spark, d):
    documents = table(spark, d, "documents")
    queries = documents.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(documents, queries)


@query
def op10_bpe(spark, d):
    coded = bpe.decode(bpe.encode(table(spark, d, "documents"), WORD_TOKENIZER), WORD_TOKENIZER)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_alignment(spark, d):
    aligned = align_tokenizers(table(spark, d, "documents"), Alignment(BYTE_TOKENIZER, PIECE_TOKENIZER))
    digest = F.when(F.length("groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query
def op12_divergence(spark, d):
    return audit_sources(table(spark, d, "documents"))


@query
def op13_near_vectors(spark, d):
    return near_vectors(table(spark, d, "embeddings"))
