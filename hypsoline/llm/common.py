"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that have one of the names, whatever the case."""
    drop = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in drop])


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, maps left out: rows that are told apart by nothing else agree in it."""
    return F.xxhash64(*[col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)])


#: Bits of a sieve: at least 32 times the keys, up to this many (32 MB); beyond, it lets more rows through.
SIEVE_BITS = 1 << 28


def sieved(df: DataFrame, hashed: str, keys: DataFrame, out: str) -> DataFrame:
    """df with `out` boolean: false where the long `hashed` is surely not in keys' one long column.

    The keys' bitmap, of a size that SIEVE_BITS bounds, is broadcast, so no row of df moves. Null: false.
    """
    bits = 1 << 16
    while bits < min(SIEVE_BITS, 32 * keys.count()):
        bits *= 2
    place = F.pmod(col(hashed), F.lit(bits))
    own = keys.select(F.pmod(col(keys.columns[0]), F.lit(bits)).alias("at")).where("at is not null")
    b, m = unused(df, "_b", "_m")
    chunks = own.groupBy(F.shiftright("at", 15).alias(b)).agg(F.expr("bitmap_construct_agg(at % 32768)").alias(m))
    both = df.join(F.broadcast(chunks), F.shiftright(place, 15) == col(b), "left")
    bit = place % 32768
    byte = F.conv(F.hex(F.substr(col(m), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.select(*[col(c) for c in df.columns], F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(out))


def sieve(df: DataFrame, hashed: str, keys: DataFrame) -> DataFrame:
    """df's rows whose `hashed` is among keys, and few others."""
    (flag,) = unused(df, "_flag")
    return sieved(df, hashed, keys, flag).where(col(flag)).select(*[col(c) for c in df.columns])


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few driver-side rows as a DataFrame, by JSON in the plan instead of an RDD."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


#: Rows of an Arrow batch: texts are long, and a batch stands in the executor and in its Python worker at once.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS where it allows more. Spark reads this setting when a plan runs, and
    has none for a single plan, so it stays lowered for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their task, and the next one needs its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, kept: list[str], inputs: list[Column], outputs: list[T.StructField], make: Callable[[pa.RecordBatch, list[pa.Array]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """df's columns `kept` and new ones, made in Arrow batches.

    make(rows, arrays) gets the kept columns of a batch and its input expressions, and yields batches of kept columns
    with the arrays of `outputs`. Columns go through by place, so that any name will do.
    """
    n = len(kept)
    fed = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], *[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    types = [df.schema[c].dataType for c in kept] + [f.dataType for f in outputs]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, made in make(b.select(range(n)), b.columns[n:]):
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=schema.names)
        give_back()

    bounded_batches(df.sparkSession)
    return fed.mapInArrow(run, schema).toDF(*kept, *[f.name for f in outputs])
