"""Helpers shared by the training-data operators.

* ``read`` -- one input table, only the columns an operator names.
* ``arrow_rows`` -- row generator over the Arrow batches of ``mapInArrow``.
* ``save`` -- write once to the shared checkpoint folder and read back.
* ``connected_components`` -- large-star / small-star contraction
  (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.session import materialize
from pagefold.sources.tables import table_path

#: Rows handed to one inner loop of a Python stage; bounds what a worker holds
#: beside the Arrow batch itself.
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task: the last thing asked for.

    A worker serves one stage after another; keeping one thing bounds its memory
    by the largest of them instead of by their sum."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a written table survives lost executors."""
    return materialize(df, name)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: pa.Schema):
    """A ``mapInArrow`` function that applies ``fn`` to slices of each batch.

    ``fn`` gets at most ``SLICE_ROWS`` rows and returns columns by name.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if out is not None:
                    arrays = [pa.array(out[f.name], type=f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
    return run


def text_column(fn: Callable[[list], list], kind: str, arrow: pa.DataType):
    """A column function of one text column: ``fn`` gets a list of at most
    ``SLICE_ROWS`` texts and returns as many values (tuples for a struct), so that
    beside the Arrow batch itself only a slice is ever held as Python objects."""
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(fn(texts.slice(at, SLICE_ROWS).to_pylist()), type=arrow) for at in range(0, len(texts), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=arrow)
    return run


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``.

    ``component`` is the smallest node reachable.  Only edges move: each round
    is two keyed aggregations and joins whose hot side AQE can split, written
    to the shared folder; rounds grow with the logarithm of the longest chain.
    Self edges keep single nodes; an empty edge table gives an empty result.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: src > dst.  Large star looks both ways, small star down only.
        seen = pairs
        if large:
            seen = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = seen.groupBy("src").agg(F.min("dst").alias("low"))
        low = low.withColumn("low", F.least("low", "src"))
        out = seen.join(low, "src")
        if large:
            out = out.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            out = (out.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
                   .unionByName(low.select("src", F.col("low").alias("dst"))))
        return out.where("src <> dst").distinct()

    def stamp(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = save(edges.select("src", "dst").distinct(), f"{name}-edges")
    pairs = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    before = None
    now = stamp(pairs)
    while now[0] and now != before:
        pairs = save(stars(stars(pairs, True), False), name)
        before, now = now, stamp(pairs)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    root = pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
