"""Mixing sources to target shares of the total size (problem 9).

Token counts per document come from the public tokenizer of ``quern.llm.bpe``. Per source they
are added up with map-side partial sums, so a source holding most of the rows costs one number
per task. A source's repetition rate is its share of the mix divided by its own tokens, capped
at max_repeats; every document is emitted floor(rate) times plus once more with the fractional
probability, decided by a hash of seed and document id, so a rerun gives the same mix.

Source names count without regard to letter case and outer white space. Null and empty texts
have zero tokens; a target whose source has no tokens gets rate 0 and cannot reach a positive
share. Documents of sources without a target count towards the size of the corpus, but are not
emitted; nor are those with a null source. Tied and repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.bpe import encode
from quern.llm.common import checkpointed, table

HASH_STEPS = 1 << 53


def source_key(name: Column) -> Column:
    """Case folded, outer white space (also the non-breaking kinds) removed."""
    return F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def source_rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tokens, total, target_share, max_repeats, needed, rate, reachable) per target.

    ``counted`` has source and n_tokens. ``needed`` is target_share of a mix as large as the
    whole corpus."""
    per_source = checkpointed(counted.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("tokens")))  # read twice
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = wanted.join(per_source, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["tokens"])  # total is one row
    needed = F.col("target_share") * F.col("total")
    return joined.withColumn("needed", needed).withColumn(
        "rate", F.when(F.col("tokens") > 0, F.least(needed / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    ).withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= needed)


def copies_of(counted: DataFrame, rates: DataFrame, key: str, seed: int = 17) -> DataFrame:
    """(key, source, n_tokens, copies) of each document that is taken at least once. The rates
    are one row per target, which is a small stated list."""
    docs = counted.select(key, source_key(F.col("source")).alias("source"), "n_tokens")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(HASH_STEPS)) / F.lit(float(HASH_STEPS))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return docs.join(rates.select("source", "rate"), "source").select(key, "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def emit_copies(taken: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The source travels as part of the key through the encoder, which saves a join.
    keyed = docs.select(F.struct("doc_id", "source").alias("k"), "text")
    return encode(keyed, key="k", count_only=True).select("k.doc_id", "k.source", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = source_rates(counted_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return rates.where(~F.col("reachable")).select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy taken."""
    counted = checkpointed(counted_documents(spark, sf_dir))  # read for the rates and for the copies
    taken = copies_of(counted, source_rates(counted, table(spark, sf_dir, "mix_targets")), "doc_id")
    return emit_copies(taken).select("doc_id", "source", "copy_no")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share reached by each source of the mix, beside its target."""
    counted = checkpointed(counted_documents(spark, sf_dir))
    rates = source_rates(counted, table(spark, sf_dir, "mix_targets"))
    taken = checkpointed(copies_of(counted, rates, "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")))
    report = rates.join(taken, "source", "left").fillna(0, ["mixed_tokens"])
    size = taken.agg(F.sum("mixed_tokens").alias("mix_total"))  # one row
    return report.crossJoin(F.broadcast(size)).select(
        "source", "target_share", F.round("rate", 6).alias("rate"), "mixed_tokens",
        F.round(F.col("mixed_tokens") / F.col("mix_total"), 6).alias("share"), "reachable",
    )
