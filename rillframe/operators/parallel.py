"""Parallelism is Spark's own: these options set the number of partitions and Arrow batch sizes, and change no result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from rillframe.ordered import Ordered
from rillframe.session import shuffle_partitions


@dataclass(frozen=True)
class ParallelConfig:
    concurrency: int
    ordered: bool = True
    buffer_size: int = 0
    chunk_size: int = 0


def default_parallel_config(spark: SparkSession) -> ParallelConfig:
    n = spark.sparkContext.defaultParallelism
    return ParallelConfig(n, True, 2 * n, 0)


def with_concurrency(config: ParallelConfig, n: int) -> ParallelConfig:
    return replace(config, concurrency=n) if n > 0 else config


def with_ordered(config: ParallelConfig, ordered: bool) -> ParallelConfig:
    return replace(config, ordered=ordered)


def with_buffer_size(config: ParallelConfig, size: int) -> ParallelConfig:
    return replace(config, buffer_size=size) if size > 0 else config


def with_chunk_size(config: ParallelConfig, size: int) -> ParallelConfig:
    return replace(config, chunk_size=size) if size > 0 else config


def spread(s: Ordered, config: ParallelConfig) -> Ordered:
    """Rows over as many partitions as the config names, or Spark's own number."""
    return s.with_df(s.df.repartition(config.concurrency or shuffle_partitions(s.df.sparkSession)))


def prefetch(s: Ordered, n: int = 1) -> Ordered:
    """Nothing to do: a scan reads ahead by itself."""
    return s
