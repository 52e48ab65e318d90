"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

import uuid

from pyspark.sql import SparkSession

# Runtime settings that keep hot keys apart. The forced skew join accepts one more shuffle
# after the join when a skewed partition was really found, and costs nothing otherwise.
# Arithmetic that overflows fails instead of giving null.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Such files are about 1.4 times smaller than by default: what is broadcast stays as it was.
    "spark.sql.sources.fileCompressionFactor": "1.4",
}

# Joins to some of the orders drop most other rows before these are shuffled. The filter has
# 8 MB and lets a sixth of the others through at 18 million orders; much larger selections,
# by their estimated size, are joined without one.
FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "4m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "16000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "16000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "67108864",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on; sizes and partition counts stay the cluster's."""
    for key, value in (SETTINGS | FILTERS).items():
        spark.conf.set(key, value)
    return spark


def use_filters(spark: SparkSession, on: bool) -> None:
    """Whether what the session plans next may have runtime filters."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", str(on).lower())


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name below the cluster's shared ``spark.checkpoint.dir``.

    Where none is named it lies in the warehouse, which executors share as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{shared.rstrip('/')}/tradewind-{uuid.uuid4().hex}"
