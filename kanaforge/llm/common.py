"""Helpers shared by the operators: scratch tables, free column names, document checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame once to the cluster's shared checkpoint folder and read it back:
    lineage ends there, a lost executor re-reads files instead of redoing the work, and
    column pruning and size statistics hold for what follows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (a scratch folder of its own only where a
    local session names none)."""
    folder = ensure_checkpoint_dir(spark)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder all executors share")
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(col) -> F.Column:
    """64-bit hash of a text, the same for null and empty."""
    return F.xxhash64(F.coalesce(col, F.lit("")))


# --- DuckDB SQL -------------------------------------------------------------------------

#: CTE with the 256 remainders that crc32 looks up, made by its rule.
CRC32_CTE = """crc AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
    ELSE c >> 1 END) ORDER BY b) AS remainders FROM range(256) r(b))"""


def crc32_sql(x: str) -> str:
    """crc32 of a string's UTF-8 bytes in DuckDB, which has none; needs ``CRC32_CTE`` in FROM."""
    byte = f"CAST('0x' || substr(hex(encode({x})), 2 * i - 1, 2) AS BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, 1 + strlen({x})), lambda i: {byte})), "
            "lambda c, b: xor(c >> 8, remainders[1 + (xor(c, b) & 255)])), 4294967295)")
