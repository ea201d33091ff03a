"""A sieve for large tables: drops most rows that cannot match a join's other side, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the broadcast table, whatever the tables' sizes.
_WORDS = 1 << 18


def sieve(rows: DataFrame, hashed: Column, wanted: DataFrame) -> DataFrame:
    """rows whose 64-bit hash may be among wanted (one column of hashes). Others can pass: a join has to follow."""
    word = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(_WORDS - 1))
    bits = wanted.toDF("sieve_h").select(word(F.col("sieve_h")).alias("sieve_word"), F.expr("shiftleft(1L, CAST(sieve_h & 63 AS INT))").alias("bit"))
    table = bits.groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    marked = rows.withColumn("sieve_h", hashed).withColumn("sieve_word", word(F.col("sieve_h")))
    kept = marked.join(F.broadcast(table), "sieve_word").filter(F.expr("bit_get(sieve_bits, CAST(sieve_h & 63 AS INT)) = 1"))
    return kept.select(*rows.columns)
