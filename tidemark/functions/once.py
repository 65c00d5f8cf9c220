"""Computing an expensive expression once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`withColumns`, evaluated exactly once per row.

    A filter on a plain column is moved below the projection that defines it and repeats its
    expression at every use: a JSON text would be parsed half a dozen times. A filter does not move
    below a generator, and a one-element array gives one row for one row.
    """
    values = F.struct(*(value.alias(name) for name, value in columns.items()))
    return rows.select("*", F.inline(F.array(values)))
