"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import common, decontamination, language_id, line_dedup, near_dedup, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of 0.3 or more of their letters, go."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or alike lines one occurrence stays; documents that lose all their text go."""
    out = line_dedup.without_repeated_lines(docs)
    return out.where("text is null or trim(text) <> ''")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of which they are half or more go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset): the places of the tokens in sequences of 4096."""
    import public_tokenizers

    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
    return packing.placed(common.written(pieces, "pieces"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir. What a stage kept is deleted once the next one's is written. Null and empty texts have no language and go with
    the first stage; no documents give no rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(*before)
        before = [docs]
    return docs


#: Tokenising, MinHash and language models aren't SQL: the pipeline is tested against brute force.
ORACLE_SQL = None
