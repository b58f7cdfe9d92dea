"""Readers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sondera.sources import candles, files

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {"corpus": files.read_corpus, "spans": files.read_spans, "claims": files.read_claims, "steps": files.read_steps, "candles_csv": candles.read_candles_csv, "candles_json": candles.read_candles_json}


def register(name: str, reader: Reader) -> None:
    """Make ``reader(spark, path, **options)`` known under ``name``; a name that is taken is an error."""
    if name in _READERS and _READERS[name] is not reader:
        raise ValueError(f"{name!r} is registered already")
    _READERS[name] = reader


def names() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, name: str, path: str, **options: object) -> DataFrame:
    """What the reader of that name makes of ``path``."""
    if name not in _READERS:
        raise KeyError(f"no reader {name!r}; there are {', '.join(names())}")
    return _READERS[name](spark, path, **options)
