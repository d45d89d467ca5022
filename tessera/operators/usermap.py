"""A batched map by a user's function whose output rows need not match its input rows in number.

The function is a class of a Python UDTF: Spark deals the rows by ``PARTITION BY`` and hands each group over in
``ORDER BY`` order, a row at a time, so the class holds what it chooses to hold and no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from tessera.session import ship_package


def map_ordered(df: DataFrame, cls: type, schema: str, partition_by, order_by) -> DataFrame:
    """Rows yielded by ``cls`` (``eval(row)`` for each row, ``terminate()`` after a group's last) over ordered groups."""
    ship_package(df.sparkSession)
    table = df.asTable().partitionBy(*partition_by).orderBy(*order_by)
    return udtf(cls, returnType=schema)(table)


def packer(block_size: int, keys: list[str], ids_col: str = "input_ids") -> type:
    """The packing rule as a user would write it: whole blocks, a batch's tail dropped unless it is all there is."""

    class Pack:
        def __init__(self):
            self.tail, self.no, self.key = [], 0, None

        def eval(self, row):
            self.key = tuple(row[k] for k in keys)
            self.tail += row[ids_col] or []
            while len(self.tail) >= block_size:
                block, self.tail = self.tail[:block_size], self.tail[block_size:]
                yield (*self.key, self.no, block)
                self.no += 1

        def terminate(self):
            if self.no == 0 and self.tail:
                yield (*self.key, 0, self.tail)

    return Pack
