"""Batched packing as a polymorphic table function.

``pack_batch(TABLE(t) PARTITION BY batch ORDER BY ..., block)`` takes any table with
an array of token ids and gives the blocks of each partition: the ids of its rows
end to end, cut into blocks of ``block``; a rest shorter than a block is dropped,
but a partition that has no whole block keeps its rest as one short block.  Blocks
leave as they fill, so a partition needs one block of memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, IntegralType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

IDS = "input_ids"


class PackBatch:
    @staticmethod
    def analyze(rows: AnalyzeArgument, block: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("pack_batch: the first argument must be a table")
        kind = next((f.dataType for f in rows.dataType.fields if f.name == IDS), None)
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, IntegralType):
            raise ValueError(f"pack_batch: the table needs {IDS}, an array of whole numbers")
        if not isinstance(block.dataType, IntegralType) or not block.value or block.value < 1:
            raise ValueError("pack_batch: block must be a positive constant")
        return AnalyzeResult(StructType([StructField("block_no", LongType()), StructField(IDS, ArrayType(IntegerType()))]))

    def __init__(self):
        self.held, self.block_no = [], 0

    def eval(self, rows, block: int):
        self.held.extend(rows[IDS] or [])
        at = 0
        while len(self.held) - at >= block:
            yield self.block_no, self.held[at:at + block]
            at, self.block_no = at + block, self.block_no + 1
        del self.held[:at]

    def terminate(self):
        if self.held and not self.block_no:
            yield 0, self.held


def pack_batches(rows: DataFrame, batch: str, order: str, block: int) -> DataFrame:
    """``batch, block_no, input_ids`` of ``rows`` (``batch``, ``order``, ``input_ids``)."""
    # the table function sees its own columns only: the batch comes back by its number
    function = udtf(PackBatchOf)
    return function(rows.select(F.col(batch).cast("long").alias("batch"), F.col(order).alias("place"), IDS).asTable().partitionBy("batch").orderBy("place"), F.lit(block))


class PackBatchOf(PackBatch):
    """The same, with the number of the partition (column ``batch``) in front."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, block: AnalyzeArgument) -> AnalyzeResult:
        own = PackBatch.analyze(rows, block).schema
        return AnalyzeResult(StructType([StructField("batch", LongType()), *own.fields]))

    def eval(self, rows, block: int):
        self.batch = rows["batch"]
        for out in super().eval(rows, block):
            yield self.batch, *out

    def terminate(self):
        for out in super().terminate():
            yield self.batch, *out


def register(spark: SparkSession, name: str = "pack_batch") -> None:
    """Make the table function callable from SQL."""
    spark.udtf.register(name, udtf(PackBatch))
