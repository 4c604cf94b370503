"""Lead records as CSV, with every cell safe to open in a spreadsheet."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.records import protect_cell

BOM = "﻿"


def protected(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[protect_cell(F.col(c)).alias(c) for c in columns])


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CSV parts: header, CRLF, quotes doubled and only where needed. Scales with the partitions."""
    protected(df, columns).write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").option("encoding", "UTF-8").csv(path)


def render(df: DataFrame, columns: list[str]) -> Iterator[str]:
    """One CSV document, a line at a time in the order of ``df``, with a byte order mark; for a download, partition by partition."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\r\n", quoting=csv.QUOTE_MINIMAL)

    def line(cells: list[str]) -> str:
        buffer.seek(0)
        buffer.truncate()
        writer.writerow(cells)
        return buffer.getvalue()

    yield BOM + line(columns)
    for row in protected(df, columns).toLocalIterator():
        yield line(list(row))
