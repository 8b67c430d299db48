"""Relational operators of the dialect on DataFrames."""

from .reshape import pivot, unpivot
from .rows import qualify, sample_percent, sample_rows, top_k
from .table_functions import lateral_flatten

__all__ = ["lateral_flatten", "pivot", "qualify", "sample_percent", "sample_rows", "top_k", "unpivot"]
