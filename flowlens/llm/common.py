"""What several of the operators share: fold of ASCII case, the training split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_path, shared_dir, written  # noqa: F401

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate: A-Z to a-z, all else as it is.
ASCII_LOWER = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


#: Rows and bytes of an Arrow batch of texts, which bound what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session hand whole texts to Python in small batches; smaller ones that it has set stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", spark.conf.get(key).lower()).groups()
        now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed.

    lower() is much the faster of the two, and the same where the text is pure ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the rows that models never learn from: crc32 of the id's text leaves 1 when divided by 3.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, to carry a value beside its own columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of a sieve for each hash in it, and the power of two that it doesn't exceed: 16 MB.
EACH_HASH, SIEVE = 16, 27


def sieve(rows: DataFrame, hashed: Column, found: DataFrame, name: str = "sieve") -> tuple[DataFrame, DataFrame]:
    """(those of rows whose hash may be in found, those whose hash surely isn't): found is a written table of one column of hashes.

    found is laid out as a bitmap that is broadcast, so rows of the second kind needn't be shuffled to a join. Above
    SIEVE the bitmap no longer grows, and more rows are of the first kind: each is yet to be joined with found.
    """
    bits = (1 << min(SIEVE, max(15, (EACH_HASH * found.count()).bit_length()))) - 1
    place = F.col(found.columns[0]).bitwiseAND(F.lit(bits))
    own, part, held = (fresh(rows, n) for n in ("__place", "__part", "__held"))
    maps = found.groupBy(F.shiftright(place, 15).alias(part)).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias(held))
    marked = rows.withColumn(own, hashed.bitwiseAND(F.lit(bits))).join(F.broadcast(written(maps, name)), F.shiftright(own, 15) == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(F.col(own).bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.col(own).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
