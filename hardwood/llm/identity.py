"""Numbers for documents whose ids do not tell their texts apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

#: The number's column.
ROW = "__row"


def numbered(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """The documents with a long ``ROW`` that goes with one id and one text, and the table ``(ROW, id)`` if it is not the id itself.

    Whole-number ids that have one text each are their own numbers. Else numbers follow the order of (id, hash of the text), so a smaller
    number never goes with a larger id; rows alike in both share one. A null id gets a null.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if isinstance(documents.schema[id_col].dataType, T.IntegralType):
        h = F.xxhash64(body)
        several = documents.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x < y")
        if several.isEmpty():
            return documents.withColumn(ROW, F.col(id_col).cast("long")), None
    keyed = documents.withColumn("__hash", F.xxhash64(body))
    order = keyed.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col("__hash").alias("__h")).distinct().sort("__id", "__h")
    names = materialize(order.withColumn(ROW, F.monotonically_increasing_id()))
    rows = keyed.join(names, (F.col(id_col) == F.col("__id")) & (F.col("__hash") == F.col("__h")), "left").select(*documents.columns, ROW)
    return rows, names
