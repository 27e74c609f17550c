"""How files are read and written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass
class CSVReadOptions:
    """Settings of a CSV file. Methods set one each and return the options, so that calls can be chained.

    ``use_threads``, ``block_size``, ``slice`` and ``concurrent_file_reads`` are accepted and ignored: Spark splits files
    among tasks by itself.
    """

    delimiter: str = ","
    header: bool = True
    column_names: Sequence[str] = ()
    ignore_empty_lines: bool = True
    use_quoting: bool = True
    quote: str = '"'
    double_quote: bool = True
    use_escaping: bool = False
    escape: str = "\\"
    newlines_in_values: bool = False
    skip_rows: int = 0
    column_types: Mapping[str, object] = field(default_factory=dict)
    null_values: Sequence[str] = ("", "NULL", "null", "NaN", "nan", "NA", "N/A", "#N/A")
    true_values: Sequence[str] = ("true", "True", "TRUE")
    false_values: Sequence[str] = ("false", "False", "FALSE")
    strings_can_be_null: bool = False
    include_columns: Sequence[str] = ()
    include_missing_columns: bool = False

    def _set(self, **x) -> CSVReadOptions:
        for k, v in x.items():
            setattr(self, k, v)
        return self

    def use_threads(self, on: bool = True) -> CSVReadOptions:
        return self

    def block_size(self, n: int) -> CSVReadOptions:
        return self

    def slice(self, on: bool = True) -> CSVReadOptions:
        return self

    def concurrent_file_reads(self, on: bool = True) -> CSVReadOptions:
        return self

    def with_delimiter(self, x: str) -> CSVReadOptions:
        return self._set(delimiter=x)

    def auto_generate_column_names(self) -> CSVReadOptions:
        """The file has no header; columns are named 0, 1, 2 ..."""
        return self._set(header=False, column_names=())

    def use_cols(self, names: Sequence[str]) -> CSVReadOptions:
        return self._set(include_columns=list(names))

    def skip(self, n: int) -> CSVReadOptions:
        return self._set(skip_rows=n)

    def na_values(self, values: Sequence[str]) -> CSVReadOptions:
        return self._set(null_values=list(values), strings_can_be_null=True)

    def with_column_types(self, kinds: Mapping[str, object]) -> CSVReadOptions:
        return self._set(column_types=dict(kinds))


@dataclass
class CSVWriteOptions:
    """``column_names`` replace the frame's; their number is checked."""

    delimiter: str = ","
    column_names: Sequence[str] = ()


@dataclass
class ParquetOptions:
    """``chunk_size`` bounds rows in a file; ``metadata_file`` adds a summary of all footers; ``writer`` are further options of Spark's writer."""

    chunk_size: int | None = None
    metadata_file: bool = False
    writer: Mapping[str, str] = field(default_factory=dict)
