"""One query for each operator, over its whole table."""

from pyspark.sql import functions as F

from lagfield.llm import language_id, lexical_search, pii, toxicity
from lagfield.llm.common import read_table, scratch
from lagfield.llm.exact_dedup import exact_dedup_files
from lagfield.llm.hard_negatives import mine_hard_negatives
from lagfield.llm.html_text import extract
from lagfield.llm.mixing import mix_sources
from lagfield.llm.ngram_join import near_components
from lagfield.llm.packing import pack
from lagfield.llm.quality import quality_rules
from lagfield.llm.token_shards import token_table
from lagfield.llm.warc import archive_table


def op1_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_lines_removed",
        "chars_removed",
    )


def op3_ngram_join(spark, sf_dir):
    return near_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_personal_data(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find_personal_data(docs, pii.train(docs))


def op5_mixing(spark, sf_dir):
    mixed = mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup_files(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.predict(docs, language_id.train(docs))


def op8_html_text(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return archive_table(pages, scratch(spark, "warc"))


def op10_token_shards(spark, sf_dir):
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_table(docs, scratch(spark, "shards"), tokenizer).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("double"))
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return mine_hard_negatives(
        rows.select("vec_id", moved.alias("label"), F.when(sound, whole).alias("embedding")), F.col("id") % 100 == 0
    )


def op12_lexical_search(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return lexical_search.search(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.predict(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_personal_data": op4_personal_data,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_html_text": op8_html_text,
    "op9_warc": op9_warc,
    "op10_token_shards": op10_token_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}
