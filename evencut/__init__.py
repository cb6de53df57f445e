"""Balanced graph partitioning on Spark DataFrames."""

from evencut.config import PartitionConfig

__all__ = ["PartitionConfig"]
