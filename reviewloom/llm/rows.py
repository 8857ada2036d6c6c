"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: str) -> Column:
    """UTF-8 bytes of a text column; NULL counts as an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; a NULL id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def struct_udf(fn: Callable[..., pa.Array], ddl: str):
    """Arrow UDF whose result the optimizer neither repeats nor moves below a filter."""
    return F.arrow_udf(fn, ddl, ArrowUDFType.SCALAR).asNondeterministic()


def structs(names: Iterable[str], columns: Iterable[pa.Array | np.ndarray | list]) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], list(names))


def share(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object by value: workers need no copy of its class. Bound its size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def loaded(shared: Broadcast) -> object:
    """The object behind share(), built once in each worker."""
    if not hasattr(shared, "_loaded"):
        shared._loaded = pickle.loads(shared.value)
        vars(shared).pop("_value", None)  # the bytes are no longer needed
    return shared._loaded


def values(column: pa.Array, at_once: int = 256) -> Iterator:
    """Python values of an Arrow column, a few rows at a time, so that no batch is held twice."""
    for start in range(0, len(column), at_once):
        yield from column.slice(start, at_once).to_pylist()


def with_fields(df: DataFrame, result: Column, names: Iterable[str], carrier: str = "_llm") -> DataFrame:
    """Add the fields of a struct result as columns; a column of the same name is replaced."""
    return df.withColumn(carrier, result).withColumns({n: F.col(f"{carrier}.{n}") for n in names}).drop(carrier)
