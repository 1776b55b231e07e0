"""Queries of the corpus operators, one an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import chat_format, conversation_trie, embedding_dedup, exact_dedup, fm_dedup, language, main_text, mixing, near_dedup, sentencepiece, suffix_dedup, toxicity, vector_codes
from contactlake.llm.common import read
from contactlake.llm.oracles import ASKED, ORACLES  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", (~language.learned(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).drop(*exact_dedup.CLASS)


@query
def op4_source_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "n_copies")


@query
def op5_substring_dedup(spark, sf_dir):
    result = fm_dedup.remove_repeated_words(read(spark, sf_dir, "documents"))
    return result.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (~toxicity.learned(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query
def op8_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece.encode(docs, sentencepiece.load(), check=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip"
    )


@query
def op9_html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return main_text.main_text(pages, main_text.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_suffix_array_dedup(spark, sf_dir):
    result = suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"))
    return result.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query
def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(read(spark, sf_dir, "embeddings")).drop("n_tried")


@query
def op12_chat_format(spark, sf_dir):
    """Also a conversation whose texts look like the template's marks."""
    schema = "conv_id long, turn long, role string, text string"
    more = spark.createDataFrame([(-1, 0, "user", ASKED), (-1, 1, "assistant", ASKED)], schema)
    talks = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    ranks = chat_format.load()
    return chat_format.read_back(chat_format.format_conversations(talks, ranks), ranks)


@query
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.rebuilt_trie(read(spark, sf_dir, "conversations")).drop("key")
