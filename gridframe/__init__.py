"""gridframe: a dataframe and table library whose operators are lazy Spark plans."""

from gridframe.frame import CategoricalIndex, ColumnIndex, DataFrame, GroupBy, Index, IntegerIndex, NumericIndex, RangeIndex, Series, concat, merge_tables, read_csv, read_csv_dist, read_json, read_json_dist, read_parquet, read_parquet_dist, view
from gridframe.session import Env, discard, local_session
from gridframe.table import SortOptions, Table

__all__ = ["CategoricalIndex", "ColumnIndex", "DataFrame", "Env", "GroupBy", "Index", "IntegerIndex", "NumericIndex", "RangeIndex", "Series", "SortOptions", "Table", "concat", "discard", "local_session", "merge_tables", "read_csv", "read_csv_dist", "read_json", "read_json_dist", "read_parquet", "read_parquet_dist", "view"]
