"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators.storage import shared_folder, stored

__all__ = ["crc_part", "fresh", "row_hash", "shared_folder", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind it as tell it from every column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def row_hash(docs: DataFrame) -> Column:
    """One number of a row's columns and of which are null; maps, which have no order, are left out."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])
