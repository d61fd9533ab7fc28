"""Input tables."""

from .tables import read_table

__all__ = ["read_table"]
