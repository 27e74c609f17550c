"""Sources and sinks."""

from gridframe.sources.files import read_csv, read_csv_many, read_json, read_parquet, read_parquet_many
from gridframe.sources.memory import empty, from_arrow, from_columns, from_list, from_numpy, from_pandas, from_pydict
from gridframe.sources.options import CSVReadOptions, CSVWriteOptions, ParquetOptions
from gridframe.sources.sinks import to_arrow, to_dict, to_numpy, to_pandas, write_csv, write_json, write_parquet

__all__ = ["CSVReadOptions", "CSVWriteOptions", "ParquetOptions", "empty", "from_arrow", "from_columns", "from_list", "from_numpy", "from_pandas", "from_pydict", "read_csv", "read_csv_many", "read_json", "read_parquet", "read_parquet_many", "to_arrow", "to_dict", "to_numpy", "to_pandas", "write_csv", "write_json", "write_parquet"]
