"""Verification of hash-chained logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = ""


def chain_hash(seq: Column, previous_hash: Column, body: Column) -> Column:
    """Hash of a row: over its number, the hash before it and its body, as one compact JSON text."""
    return F.sha2(F.concat(F.lit('{"payload":'), body, F.lit(',"previous_hash":"'), previous_hash, F.lit('","seq":'), seq.cast("string"), F.lit("}")), 256)


def verify_chain(log: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """Rows that break a log: (log, seq, problem); empty for an intact log.

    log: log, seq, body (canonical text), hash, previous_hash. The row before is found by joining on its number,
    not by ordering the log, so one huge log spreads over all tasks.
    """
    before = log.select("log", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    joined = log.join(before, ["log", "seq"], "left")
    first = F.col("seq") == 1
    problems = F.filter(F.array(
        F.when(~first & F.col("_before").isNull(), "gap"),
        F.when(~chain_hash(F.col("seq"), F.col("previous_hash"), F.col("body")).eqNullSafe(F.col("hash")) | F.col("hash").isNull(), "hash"),
        F.when(first & ~F.col("previous_hash").eqNullSafe(F.lit(genesis)), "genesis"),
        F.when(~first & F.col("_before").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("_before")), "previous_hash"),
        F.when(F.col("seq") < 1, "sequence")), lambda p: p.isNotNull())
    broken = joined.select("log", "seq", F.explode(problems).alias("problem"))
    twice = log.groupBy("log", "seq").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("log", "seq", F.lit("duplicate").alias("problem"))
    return broken.unionByName(twice)
