"""Connectors: sources that are asked page by page, as Spark data sources for batches and streams.

A connector finds references (``discover``) and fetches each (``fetch``). The references are planned into partitions on
the driver, which holds names only; payloads are fetched in the tasks. A stream's offset is the number of references taken, in the
order of their names, so a restart goes on where the last finished batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RAW = "source string, ref string, position int, payload string, error string"
#: References that a task fetches.
EACH = 16


class Connector(Protocol):
    """What Spark needs to know of a source. ``discover`` gives references in a fixed order; ``fetch`` gives raw documents, as JSON."""

    def discover(self) -> list[str]: ...

    def fetch(self, ref: str) -> Iterator[str]: ...


_CONNECTORS: dict[str, Callable[[dict[str, str]], Connector]] = {}


def register(name: str):
    """Name a connector: a factory of the reader's options (keys in small letters)."""

    def add(factory: Callable[[dict[str, str]], Connector]) -> Callable[[dict[str, str]], Connector]:
        if name in _CONNECTORS:
            raise ValueError(f"connector {name} is registered")
        _CONNECTORS[name] = factory
        return factory

    return add


def names() -> list[str]:
    return sorted(_CONNECTORS)


@register("recorded")
class Recorded:
    """Recorded result pages ``{places: [...], nextPageToken}`` in a folder that driver and executors share, a file for each page."""

    def __init__(self, options: dict[str, str]):
        self.folder = Path(options["path"].removeprefix("file://"))

    def discover(self) -> list[str]:
        return sorted(p.name for p in self.folder.iterdir() if p.suffix == ".json" and not p.name.startswith((".", "_")))

    def fetch(self, ref: str) -> Iterator[str]:
        for place in json.loads((self.folder / ref).read_text(encoding="utf-8")).get("places") or []:
            yield json.dumps(place, ensure_ascii=False)


@dataclass
class Share(InputPartition):
    """References that one task fetches."""

    refs: tuple[str, ...]


class _Fetching:
    def __init__(self, options: dict[str, str]):
        self.name = options.get("connector", "recorded")
        if self.name not in _CONNECTORS:
            raise ValueError(f"no connector is named {self.name}; there are {', '.join(names())}")
        self.options = dict(options)
        self.each = int(options.get("each", EACH))
        self.factory = _CONNECTORS[self.name]

    def shares(self, refs: list[str]) -> list[Share]:
        return [Share(tuple(refs[i : i + self.each])) for i in range(0, len(refs), self.each)] or [Share(())]

    def read(self, share: Share) -> Iterator[tuple]:
        """Rows of a share; a reference that cannot be fetched is a row with an error, and does not fail the others."""
        connector = self.factory(self.options)
        for ref in share.refs:
            at = -1
            try:
                for at, payload in enumerate(connector.fetch(ref)):
                    yield self.name, ref, at, payload, None
            except (OSError, ValueError) as exc:
                yield self.name, ref, at + 1, None, f"{type(exc).__name__}: {exc}"[:300]


class BatchReader(_Fetching, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.shares(self.factory(self.options).discover())


class StreamReader(_Fetching, DataSourceStreamReader):
    """Offsets count references; ``perbatch`` bounds those that come in at once."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.per_batch = int(options.get("perbatch", 1 << 30))
        self.taken = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"refs": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.taken = min(len(self.factory(self.options).discover()), self.taken + self.per_batch)
        return {"refs": self.taken}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.taken = max(self.taken, end["refs"])
        return self.shares(self.factory(self.options).discover()[start["refs"] : end["refs"]])

    def commit(self, end: dict) -> None:
        self.taken = max(self.taken, end["refs"])


class ConnectorSource(DataSource):
    """``spark.read.format("connector").option("connector", name)``, and the same with ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "connector"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader({k.lower(): v for k, v in self.options.items()})


def install(spark: SparkSession) -> None:
    """Make the format known to a session; executors get this package as well."""
    from tamarack.session import ship

    ship(spark)
    spark.dataSource.register(ConnectorSource)
