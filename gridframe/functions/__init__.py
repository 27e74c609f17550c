"""Column functions: arithmetic with documented edge cases, types, and ``F`` untouched."""

from pyspark.sql import functions as F

from gridframe.functions.scalar import divide, row_hash
from gridframe.functions.types import from_arrow_schema, resolve_type, storable_arrow

__all__ = ["F", "divide", "from_arrow_schema", "resolve_type", "row_hash", "storable_arrow"]
