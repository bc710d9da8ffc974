"""A set of tables that is replaced as a whole, and whose large tables are bucketed by their join key.

A load writes every table into folders of its own version and, when all are
written and counted, appends one small file to the manifest: from then on
readers see the new tables, until then the old ones, whatever fails in
between. Readers take the newest version in the manifest. Bucketed tables are
read through the session's catalogue, so that joins and groupings on the
bucket key need no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercata.session import delete_folder
from mercata.sources.ingest import MALFORMED, Transform, read_source, stored_counts

_MANIFEST = ("version long, load string, table_name string, path string, row_count long, bad_rows long, bucket_key string, buckets int, "
             "ddl string")

#: Bucketing of the commerce tables: what joins on the order is stored by the order.
ORDER_BUCKETS = {n: "order_id" for n in ("orders", "order_items", "order_payments", "order_reviews")}

#: Bytes of a source file set that one bucket, and so one sorting task, gets on average at most.
BUCKET_BYTES = 64 << 20


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{root}/_manifest")


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's rows of the newest version: one row a table (loads that tie: the greater load id)."""
    rows = _manifest(spark, root)
    newest = rows.agg(F.max(F.struct("version", "load")).alias("m")).scalar()
    return rows.filter(F.struct("version", "load") == newest)


def _enough_buckets(spark: SparkSession, paths: Iterable[str], least: int) -> int:
    """``least``, doubled until no source has more than ``BUCKET_BYTES`` a bucket (sizes from the listing, no file is read)."""
    sizes = [spark.read.format("binaryFile").load(p).agg(F.sum("length")).first()[0] or 0 for p in paths]
    n = least
    while max(sizes, default=0) > n * BUCKET_BYTES:
        n *= 2
    return n


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _write(df: DataFrame, path: str, key: str | None, buckets: int) -> None:
    if not key:
        df.write.parquet(path)
        return
    # One file a bucket: rows are dealt to tasks as the buckets will be.
    name = f"mercata_write_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def load_tables(spark: SparkSession, src_dir: str, root: str, registry: Mapping[str, tuple[str, StructType]],
                transforms: Mapping[str, Transform] | None = None, header: bool = True, mode: str = "PERMISSIVE",
                multi_line: Collection[str] = ("order_reviews",), bucket_by: Mapping[str, str] = ORDER_BUCKETS, buckets: int = 64) -> DataFrame:
    """Replace the tables under ``root`` by those of ``registry`` (name -> (csv file, schema)), all or none.

    Tables named in ``bucket_by`` are stored in buckets of that column, the
    same number for all, sorted by it: ``buckets`` of them, or as many times
    two as the largest source needs at ``BUCKET_BYTES`` a bucket. Returns (table_name,
    row_count, bad_rows) of the written tables. A load that fails leaves the
    manifest, and so every reader, as it was.
    """
    load = uuid.uuid4().hex
    buckets = _enough_buckets(spark, [f"{src_dir}/{f}" for n, (f, _) in registry.items() if n in bucket_by], buckets)
    done = []
    for name, (filename, schema) in registry.items():
        path, key = f"{root}/data/{load}/{name}", bucket_by.get(name)
        df = read_source(spark, f"{src_dir}/{filename}", schema, header, mode, name in multi_line, (transforms or {}).get(name))
        _write(df, path, key, buckets)
        c = stored_counts(spark.read.parquet(path), name).first()
        done.append((name, path, c["row_count"], c["bad_rows"], key, buckets if key else None, _ddl(df.schema)))
    last = _manifest(spark, root).agg(F.max("version")).first()[0] if _exists(spark, root) else None
    version = (last or 0) + 1
    # One file, put in place by the writer's commit: the switch.
    spark.createDataFrame([(version, load, *d) for d in done], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_manifest")
    return spark.createDataFrame([(d[0], d[2], d[3]) for d in done], "table_name string, row_count long, bad_rows long")


def read_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The newest version's tables by name (all of them by default), without the flag column.

    Each reader keeps the version it opened, also while another load runs.
    """
    rows = {r["table_name"]: r for r in current(spark, root).collect()}
    out = {}
    for name in names if names is not None else sorted(rows):
        r = rows[name]
        if r["bucket_key"]:
            table = f"mercata_{r['load']}_{name}"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({r['ddl']}) USING parquet CLUSTERED BY (`{r['bucket_key']}`) "
                      f"SORTED BY (`{r['bucket_key']}`) INTO {r['buckets']} BUCKETS LOCATION '{r['path']}'")
            df = spark.table(table)
        else:
            df = spark.read.schema(r["ddl"]).parquet(r["path"])
        out[name] = df.drop(MALFORMED)
    return out


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the data of all but the ``keep`` newest versions that no reader needs any more; returns their load ids."""
    loads = [r["load"] for r in _manifest(spark, root).select("version", "load").distinct().orderBy(F.desc("version"), F.desc("load")).collect()]
    for load in loads[keep:]:
        delete_folder(spark, f"{root}/data/{load}")
    return loads[keep:]
