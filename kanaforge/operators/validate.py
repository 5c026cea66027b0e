"""Dataset validation (VAL-1).

The split dataset is one DataFrame with a ``split`` column and a
``translation STRUCT<source, target>`` column. Every row is checked (not one sampled
row), in one aggregate over the data; the result is a small report DataFrame with
columns ``check``, ``ok``, ``detail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema_rows(df: DataFrame, translation: str) -> list[tuple[str, bool, str]]:
    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    t = fields.get(translation)
    rows.append((f"field:{translation}", t is not None, "present" if t is not None else "missing"))
    sub = {f.name for f in t.fields} if isinstance(t, StructType) else set()
    for name in ("source", "target"):
        rows.append((f"field:{translation}.{name}", name in sub, "present" if name in sub else "missing"))
    return rows


def validate_dataset(df: DataFrame, split: str = "split", translation: str = "translation") -> DataFrame:
    """VAL-1: 'train' must hold rows and 'validation' must be present; 'test' is
    optional and may be empty; ``translation.source`` and ``.target`` must exist and be
    non-NULL on every row. One report row per check plus an ``overall`` row."""
    schema_rows = _schema_rows(df, translation)
    schema_ok = all(r[1] for r in schema_rows)

    if schema_ok:
        nulls = (F.col(f"{translation}.source").isNull() | F.col(f"{translation}.target").isNull())
    else:
        nulls = F.lit(False)
    stats = df.agg(
        F.count_if(F.col(split) == "train").cast("long").alias("n_train"),
        F.count_if(F.col(split) == "validation").cast("long").alias("n_validation"),
        F.count_if(F.col(split) == "test").cast("long").alias("n_test"),
        F.count_if(nulls).cast("long").alias("n_null"),
    )
    count = lambda c: F.concat(F.lit("rows="), F.col(c).cast("string"))
    row = lambda check, ok, detail: F.struct(F.lit(check).alias("check"), ok.alias("ok"), detail.alias("detail"))
    measured = [
        row("split:train", F.col("n_train") > 0, count("n_train")),
        row("split:validation", F.col("n_validation") > 0, count("n_validation")),
        row("split:test", F.lit(True), F.when(F.col("n_test") > 0, count("n_test")).otherwise(
            F.lit("rows=0 (optional split is empty or absent)"))),
        row("values:non_null", F.col("n_null") == 0, F.concat(F.lit("null_rows="), F.col("n_null").cast("string"))),
    ]
    checks = F.array(*[row(c, F.lit(ok), F.lit(detail)) for c, ok, detail in schema_rows], *measured)
    # All rows, the overall one too, come from the one row of statistics.
    report = stats.select(checks.alias("c")).select("c", F.size(F.filter("c", lambda x: ~x["ok"])).alias("bad"))
    overall = row("overall", F.col("bad") == 0, F.concat(F.lit("failed="), F.col("bad").cast("string")))
    return report.select(F.explode(F.concat("c", F.array(overall))).alias("r")).select("r.*")


def dataset_is_valid(df: DataFrame, split: str = "split", translation: str = "translation") -> bool:
    """The pass/fail answer of VAL-1 (one small action)."""
    row = validate_dataset(df, split, translation).filter(F.col("check") == "overall").first()
    return bool(row["ok"])
