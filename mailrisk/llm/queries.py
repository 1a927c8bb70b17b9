"""The operators' registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import (
    alignment, bpe, flac, language, neighbours, packing, periodic, quality, secrets, simhash, substring, toxicity, url_filter,
)
from mailrisk.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_fingerprint(), "component_id")


@query("op2_neighbours")
def op2_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_substring", substring.sql())
def op4_substring(spark, sf_dir):
    return substring.report(table(spark, sf_dir, "documents"))


@query("op5_url_filter", url_filter.sql())
def op5_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_tables(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op7_secrets")
def op7_secrets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(documents, secrets.fit_tables(documents))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_tables(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "clauses")


@query("op9_packing")
def op9_packing(spark, sf_dir):
    cut = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_flac")
def op10_flac(spark, sf_dir):
    return flac.digests(flac.write_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op11_periodic")
def op11_periodic(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_language")
def op12_language(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    return alignment.report(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
