"""Approximate dense retrieval over a stored, cell-partitioned table.

Vectors are assigned to cells by k-means and written partitioned by cell. A search reads only the
cells nearest to its queries, by partition pruning, and each query is exact within its own; probing every cell
gives the exact result. The default search of the library stays the exact one.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.vectors import l2_normalise
from factloom.operators.dense import dense_search
from factloom.session import cut_lineage


def write_vector_index(vectors: DataFrame, path: str, cells: int, id_col: str = "id", seed: int = 1, max_iter: int = 10,
                       tasks_per_cell: int = 16) -> None:
    """Cells and their vectors under `path`. Files are capped in rows, so a crowded cell is still
    read by many tasks. The number of cells is a parameter, so the centroid table is bounded."""
    unit = vectors.filter("embedding is not null").withColumn("_unit", array_to_vector(l2_normalise(F.col("embedding"))))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="_unit", predictionCol="cell").fit(unit)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark = vectors.sparkSession
    spark.createDataFrame(centres, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    placed = model.transform(unit).drop("_unit")
    # several tasks per cell: a cell that holds a large share is not written by one task
    spread = placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(tasks_per_cell)))
    spread.write.mode("overwrite").partitionBy("cell").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/vectors")


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, top_k: int, probes: int, id_col: str = "id", **filters) -> DataFrame:
    """Top k of each query within its own ``probes`` nearest cells: query_id, rank, id, score.

    Only cells that some query probes are read; a query's answer does not depend on the others."""
    if probes < 1:
        raise ValueError("probes must be at least 1")
    centres = spark.read.parquet(f"{path}/centres").select(F.col("cell").alias("id"), F.col("centre").alias("embedding"))
    near = cut_lineage(dense_search(centres, queries, probes).groupBy("query_id").agg(F.collect_list("id").alias("probed_cells")))
    cells = sorted(r.cell for r in near.select(F.explode("probed_cells").alias("cell")).distinct().collect())  # bounded by the cells
    stored = spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(*cells))
    return dense_search(stored, queries.join(near, "query_id"), top_k, id_col=id_col, within={"cell": "probed_cells"}, **filters)
