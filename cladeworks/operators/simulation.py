"""Simulated families: the number of replicates is the parallelism."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..kernels import simulate
from ..kernels.model import Model
from .counting import Tree


def families(spark: SparkSession, replicates: int, model: Model, tree: Tree, root_length: int = 100, seed: int = 1) -> DataFrame:
    """(ds, node, gapped): replicate histories; the draws depend on seed and replicate only, not on partitions."""
    shared = spark.sparkContext.broadcast((model.with_eigen(), tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, t = shared.value
        for b in batches:
            for r in b.column(0).to_pylist():
                rows = simulate.history(m, list(t.parent), list(t.blen), root_length, seed * 1_000_003 + r)
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows)], ["ds", "node", "gapped"])

    return spark.range(replicates).mapInArrow(run, "ds long, node int, gapped string")
