"""Train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def random_split(df: DataFrame, test_fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Random train and test parts, in that order."""
    train, test = df.randomSplit([1.0 - test_fraction, test_fraction], seed=seed)
    return train, test


def key_fold(key: Column | str, num_folds: int) -> Column:
    """Fold number from an integer key; the same row always lands in the same fold."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(key, F.lit(num_folds)).cast("int")


def key_split(df: DataFrame, key: Column | str, num_folds: int, held_out: int) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by key; neither depends on partitioning or on a seed."""
    fold = key_fold(key, num_folds)
    return df.where(fold != held_out), df.where(fold == held_out)


def hash_fold(columns: list[Column | str], num_folds: int, seed: int = 0) -> Column:
    """Evenly spread fold number for keys that are not integers."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(num_folds)).cast("int")
