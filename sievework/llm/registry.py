"""Queries of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import embeddings, fmindex, idfile, language, mixture, multiset, packing, periodic, quality, repeats, simhash, sql, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut at 1024 ids where longer, packed into as few sequences as can be."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from the archives written from them."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from the files written from them."""
    return idfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by weight takes of every document."""
    return mixture.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings with a cosine of 0.95 or more."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under a 200-byte string that also starts elsewhere."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the class of near copies it is in."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("mark")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fold."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return multiset.fingerprints(_table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under a window of ten benchmark words, and the items they are from."""
    return fmindex.hit_digests(fmindex.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt on the first of their family of five."""
    return trie.family_trie(_table(spark, sf_dir, "conversations"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them given a periodic end, and digests of what is left."""
    return periodic.run_digests(periodic.find_runs(periodic.with_periodic_ends(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_warc, op3_idfile, op4_mixture, op5_embeddings, op6_repeats, op7_simhash, op8_quality, op9_language, op10_multiset,
    op11_decontaminate, op12_trie, op13_periods)}
#: The others learn, encode or search beyond SQL; tests compare them with plain versions.
SQL: dict[str, str] = {"op2_warc": sql.OP2, "op5_embeddings": sql.OP5, "op11_decontaminate": sql.OP11, "op12_trie": sql.OP12}
