"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Bytes up to which a checked side may be broadcast.
MAX_BYTES = 256 << 20


def bounded(df: DataFrame, max_rows: int = 10_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows of at most ``max_bytes``
    in all, else unchanged.

    The check stops after ``max_rows + 1`` rows, so it stays cheap on any size; a larger side
    takes the shuffle join that Catalyst plans.
    """
    parts = [F.lit(8)]
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)))
        else:
            parts.append(F.lit(16))
    size = sum(parts[1:], parts[0]).cast("bigint")
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and seen["bytes"] <= max_bytes else df
