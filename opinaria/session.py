"""Session defaults, scratch locations and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only when a count proves that it has at most so many rows and bytes.
MAX_BROADCAST_ROWS = 200_000
# The driver holds such a side several times at once: as collected rows, as a hash table that doubles as it grows, and as blocks to send.
MAX_BROADCAST_BYTES = 8_000_000
# Replicas of the lookup side when a large lookup has to be shuffled on a skewed key.
LOOKUP_SALTS = 16


def build_session(app: str = "opinaria", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_base() -> tempfile.TemporaryDirectory:
    """One temporary folder per driver process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="opinaria-")


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_base().name
    return f"{base.rstrip('/')}/opinaria/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, ``spark.checkpoint.dir`` of the session.

    Only a session on a local master may leave it unset; it then gets a temporary folder. On a cluster that would
    be a folder of each machine's own, so it is an error. The setting itself is never changed.
    """
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def worker_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the Python workers open it, if Spark writes there to a file system that is mounted on every machine; else None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def remove_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives the loss of executors and is evaluated once, however many branches of
    a plan read it.
    """
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``dim`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more than one row beyond that."""
    def width(field) -> Column:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            return F.octet_length(column) + 16
        if kind in ("array", "map", "struct", "variant"):
            return F.octet_length(F.to_json(F.struct(column)))
        return F.lit(8)

    size = sum((F.coalesce(width(f), F.lit(8)) for f in dim.schema.fields), F.lit(0))
    rows, held = dim.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of an equi-join that is shuffled. Without the hint Spark goes by the size of the compressed files that a plan reads, which
    an ``explode`` in between does not raise: it would send replicas and deletion keys to the driver as a broadcast."""
    return df.hint("merge")


def sized(dim: DataFrame) -> DataFrame:
    """``dim`` as a side of a join: broadcast if :func:`fits_broadcast` says so, else shuffled."""
    return F.broadcast(dim) if fits_broadcast(dim) else shuffled(dim)


def lookup(
    stream: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "left",
    *,
    salt: Column,
    bounded: bool | None = None,
) -> DataFrame:
    """Join ``dim`` (unique on ``on``) to a large stream whose keys may be badly skewed.

    A dimension with a proven row bound is broadcast, so the stream is not shuffled. A larger
    one is replicated ``LOOKUP_SALTS`` times and equi-joined on (key, salt), which splits every
    hot key over that many tasks; no row is dropped either way. ``salt`` must differ between the rows of a key and
    be the same when a task is run again, so an id of the row. ``bounded`` passes on the outcome
    of :func:`fits_broadcast` when the caller has already counted.
    """
    if fits_broadcast(dim) if bounded is None else bounded:
        return stream.join(F.broadcast(dim), on, how)
    spread = F.pmod(F.xxhash64(salt), F.lit(LOOKUP_SALTS))
    salted = stream.withColumn("_salt", spread.cast("int"))
    replicas = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    return salted.join(shuffled(replicas), [on, "_salt"], how).drop("_salt")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``; keeps shared sub-expressions single."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are costly to evaluate, so that each is evaluated once per row.

    A filter or a second expression over a projected column makes the optimizer copy the column's
    expression into every place that uses it. A one-row generator is a boundary it does not cross,
    while the work stays in the same stage.
    """
    keep = [c for c in df.columns if c not in columns]
    cells = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(cells)))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when a small input arrives in fewer splits than there are cores.
    Large inputs have more splits than cores and are returned unchanged, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
