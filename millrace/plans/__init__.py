"""Registered queries: each a DataFrame plan over the given tables, with the equivalent SQL."""

from .dialect import DIALECT
from .relational import RELATIONAL
from .statements import STATEMENTS

ALL = RELATIONAL | DIALECT | STATEMENTS

__all__ = ["ALL"]
