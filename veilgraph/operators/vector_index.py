"""An inverted file over vectors: cells around fitted centroids, stored by permission key, searched by probing the nearest cells.

Centroids are fitted by Spark's own k-means on at most SAMPLE vectors of unit length, chosen by a hash of their id over
all rows; every row is then assigned to its nearest centroid and written into partitions of
filter_key, sorted by cell.  A search reads only the partitions whose key the context may read, takes the rows of
each probe's nearest cells and scores them exactly.  With all cells probed it is top_k_many().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.vector import _first, _matrix, _normal, _scored, blocks_of
from veilgraph.plans.context import Context, secure
from veilgraph.sources.held import held

SAMPLE = 100_000
CELLS = 64
SEED = 42
#: Parts of the sample while centroids are fitted.
PARTS = 16


def fit(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit vectors, at most `cells` of them; vectors(vec_id, embedding)."""
    usable = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    chosen = held(usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("x")), "index-sample")  # the documented bound
    first = chosen.first()
    if first is None:
        return np.zeros((0, 0))
    whole = chosen.where(F.size("x") == len(first["x"])).repartition(PARTS).select(array_to_vector("x").alias("whole"))
    unit = Normalizer(inputCol="whole", outputCol="features").transform(whole).select("features")
    model = KMeans(k=max(2, cells), seed=SEED, maxIter=10, initMode="random").fit(unit)
    return _normal(np.array(model.clusterCenters()))


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _matrix(batch.column(batch.schema.get_field_index("embedding")), centroids.shape[1])
            cell = np.full(len(batch), -1, np.int32)
            cell[at] = np.nan_to_num(_normal(rows) @ centroids.T, nan=-2.0).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def write(vectors: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """Index every row of vectors(vec_id, namespace, filter_key, embedding) into path; rows without a usable vector are in cell -1.  Returns the index as read back."""
    rows = vectors.select("vec_id", "namespace", "filter_key", "embedding")
    if not centroids.size:
        centroids = np.ones((1, 1))
    placed = rows.mapInArrow(_assigned(centroids), "vec_id long, namespace string, filter_key string, embedding array<float>, cell int")
    # a hot key is spread over tasks by cell and id; a file holds a run of cells
    placed.repartitionByRange("filter_key", "cell", "vec_id").sortWithinPartitions("filter_key", "cell").write.partitionBy("filter_key").parquet(path)
    return vectors.sparkSession.read.schema("vec_id long, namespace string, embedding array<float>, cell int, filter_key string").parquet(path)


def search(index: DataFrame, centroids: np.ndarray, probes: DataFrame, context: Context, namespace: str, k: int, probed: int, threshold: float) -> DataFrame:
    """(probe_id, vec_id, score, rank): the k best rows of the `probed` cells nearest to each probe, scored exactly.

    Probes go to the tasks in blocks, as in top_k_many(); the rows of a cell meet only the probes that look into it, as one product.
    """
    parts = index.sparkSession.createDataFrame([], "probe_id long, vec_id long, score double")
    if not centroids.size:
        return _first(parts, k)
    own = secure(index, context, namespace).where((F.col("namespace") == namespace) & (F.size("embedding") == centroids.shape[1]) & (F.col("cell") >= 0)).select("vec_id", "embedding", "cell")
    for ids, matrix in blocks_of(probes, centroids.shape[1]):
        near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probed]
        asked = {cell: np.flatnonzero((near == cell).any(axis=1)) for cell in np.unique(near).tolist()}
        parts = parts.union(own.mapInArrow(_scored(ids, matrix, k, threshold, asked), "probe_id long, vec_id long, score double"))
    return _first(parts, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(probe_id, n_exact, n_found): how many of each probe's exact neighbours (probe_id, vec_id) were found."""
    hits = found.select("probe_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hits, ["probe_id", "vec_id"], "left").groupBy("probe_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
