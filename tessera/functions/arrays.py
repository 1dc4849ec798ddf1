"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def sums_before(sizes: Column) -> Column:
    """For each element of an array of numbers the sum of those before it, as array<bigint>. Sums are gathered in blocks
    that are joined at the end, so that no step copies all of them; refer to the result once, outside of lambdas."""
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<array<bigint>>").alias("done"), empty.alias("cur"))

    def step(a: Column, x: Column) -> Column:
        full = F.size(a["cur"]) == _BLOCK
        return F.struct(
            (a["sum"] + x).cast("bigint").alias("sum"),
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(a["sum"])).otherwise(F.concat(a["cur"], F.array(a["sum"]))).alias("cur"),
        )

    return F.aggregate(sizes, start, step, lambda a: F.concat(F.flatten(a["done"]), a["cur"]))
