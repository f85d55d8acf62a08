"""Readers of sources and data files, and writers.

Everything reads through Spark, so any store that Spark knows works.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import extract as X
from ..operators.reports import latest

#: A file is EBCDIC if it holds that blank more often than the ASCII one, and in a twentieth of its bytes.
EBCDIC, EBCDIC_BLANK = "cp037", 0x40


def source_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, modified, length and content (bytes) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")


def decode(data: bytes) -> str:
    """Text of unknown coding: EBCDIC, UTF-16 with a mark, UTF-8 if that is valid, else Windows-1252, what that lacks being dropped."""
    foreign = data.count(EBCDIC_BLANK)
    if foreign > data.count(b" ") and foreign * 20 > len(data):
        return data.decode(EBCDIC)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", errors="ignore")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="ignore")


def decoded(files: DataFrame) -> DataFrame:
    """Files (path, name, modified, length, content) with their text instead of the content; Spark has no EBCDIC, hence the Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a file a batch: files can be large
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([decode(one.column("content")[0].as_py() or b"")], pa.string())], [*one.schema.names[:-1], "text"])

    return files.select("path", "name", "modified", "length", "content").mapInArrow(run, "path string, name string, modified timestamp, length long, text string")


def file_key(name: Column, text: Column) -> Column:
    """By what a file is known again: its name and all of its text."""
    return F.sha2(F.concat_ws(":", name, text), 256)


def ingest(spark: SparkSession, path: str, known: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """Sources with text, kind and key, without those whose key is in ``known`` (file_hash), each once."""
    rows = decoded(source_files(spark, path, pattern))
    rows = rows.withColumns({"file_hash": file_key(F.col("name"), F.col("text")), "kind": X.source_kind(F.col("text"), F.col("name"))}).dropDuplicates(["file_hash"])
    return rows.join(known.select("file_hash"), "file_hash", "left_anti") if known is not None else rows


def read_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV file with its delimiter found from the first lines and its header cleaned; rows: read only so many (a preview)."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())
    mark = spark.range(1).select(X.delimiter(F.lit(head)).alias("d")).first()["d"]
    df = spark.read.csv(path, header=True, inferSchema=True, sep=mark)
    cleaned = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, c string").select("i", N.clean_column(F.col("c")).alias("c")).orderBy("i").collect() if df.columns else []
    df = df.toDF(*[r["c"] or f"col_{r['i']}" for r in cleaned])
    return df.limit(rows) if rows else df


def profile(df: DataFrame) -> DataFrame:
    """For each column: SQL type, nulls, distinct values, longest text; one pass over the rows."""
    one = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct"), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias("longest")).alias(c) for c in df.columns])
    def sql_type(name: str, kind: str) -> Column:
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return F.lit("INTEGER")
        if kind in ("float", "double") or kind.startswith("decimal"):
            return F.lit("REAL")
        if kind.startswith("timestamp") or kind == "date":
            return F.lit("TIMESTAMP")
        return F.concat(F.lit("VARCHAR("), F.least(F.floor(F.col(f"`{name}`.longest") * 1.2), F.lit(1000)), F.lit(")"))

    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), sql_type(c, k).alias("sql_type"), F.col(f"`{c}`.n_null").alias("n_null"), F.col(f"`{c}`.n_distinct").alias("n_distinct"), (F.col(f"`{c}`.n_null") > 0).alias("nullable")) for i, (c, k) in enumerate(df.dtypes)])
    return one.select(F.explode(each).alias("p")).select("p.*")


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Record layouts out of JSON files with a list record_layouts."""
    return spark.read.json(path, multiLine=True).select(F.explode("record_layouts").alias("l")).select("l.*")


def archive_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """archive, member and content of ZIP and TAR files (compressed or not); a broken archive gives one row with error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                data = content.as_py()
                try:
                    if zipfile.is_zipfile(io.BytesIO(data)):
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            out = [(name, m.filename, z.read(m), None) for m in z.infolist() if not m.is_dir()]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(data)) as t:
                            out = [(name, m.name, t.extractfile(m).read(), None) for m in t.getmembers() if m.isfile()]
                except (tarfile.TarError, zipfile.BadZipFile, EOFError) as e:
                    out = [(name, None, None, str(e))]
                for row in out:  # one member a batch: members can be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["archive", "member", "content", "error"])

    return source_files(spark, path, pattern).select("path", "content").mapInArrow(run, "archive string, member string, content binary, error string")


def read_database(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, **options: str) -> DataFrame:
    """A table over JDBC; columns, condition and limit are pushed down by Spark.  The driver's jar has to be on the class path."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownLimit="true", **options).load()
    return restricted(df, columns, where, limit)


def restricted(df: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Named columns (any case; unknown ones are an error), a condition, a limit.  The condition is parsed as one expression, so it cannot hold statements."""
    if columns:
        known = {c.lower(): c for c in df.columns}
        if missing := [c for c in columns if c.lower() not in known]:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        df = df if not where else df.where(F.expr(where))
        df = df.select(*[known[c.lower()] for c in columns])
    elif where:
        df = df.where(F.expr(where))
    return df.limit(limit) if limit else df


def _swap(df: DataFrame, path: str) -> None:
    """Puts df, which may read the folder, in the place of a folder: written beside it, then the old one steps aside, the new one in, and the old one goes.

    A crash between the steps leaves a whole folder under one of the names path, path.old and path.new; ``recovered`` puts it back.
    """
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    here, aside, beside = (hadoop.Path(path.rstrip("/") + end) for end in ("", ".old", ".new"))
    store = here.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(str(beside))
    store.delete(aside, True)
    if store.exists(here):
        store.rename(here, aside)
    store.rename(beside, here)
    store.delete(aside, True)


def recovered(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in a folder that ``_swap`` writes, None if there is none; a swap that broke off is undone first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, aside = hadoop.Path(path), hadoop.Path(path.rstrip("/") + ".old")
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(here) and store.exists(aside):
        store.rename(aside, here)
    return spark.read.parquet(path) if store.exists(here) else None


def save_latest(df: DataFrame, path: str, keys: list[str], order: list[Column]) -> None:
    """An upsert into a Parquet folder: of old and new rows with the same keys the first by order stays."""
    old = recovered(df.sparkSession, path)
    _swap(latest(df.unionByName(old, allowMissingColumns=True) if old is not None else df, keys, order), path)


def save_without_old(df: DataFrame, path: str, ts: str, days: int) -> int:
    """Writes the rows of the last days before the newest and returns how many were dropped; df may be what the folder holds."""
    from ..operators.reports import since

    before = df.count()
    _swap(since(df, ts, f"{days} days"), path)
    return before - df.sparkSession.read.parquet(path).count()


def append(df: DataFrame, path: str) -> None:
    """Rows to the end of a log or sample table."""
    df.write.mode("append").parquet(path)


def create_table(spark: SparkSession, path: str, columns: DataFrame) -> None:
    """An empty table from a layout (at, column, sql_type), as ``profile`` and layouts give it; names are cleaned and made unique."""
    kinds = F.when(F.col("sql_type") == "INTEGER", "int").when(F.col("sql_type") == "BIGINT", "bigint").when(F.col("sql_type") == "REAL", "double").when(F.col("sql_type").startswith("DECIMAL"), F.lower("sql_type")).when(F.col("sql_type") == "TIMESTAMP", "timestamp").otherwise("string")
    rows = columns.select("at", N.clean_column(F.col("column")).alias("column"), kinds.alias("kind")).orderBy("at").collect()  # a row for each column
    seen: dict[str, int] = {}
    names = []
    for r in rows:
        n = seen[r["column"].lower()] = seen.get(r["column"].lower(), -1) + 1
        names.append(f"`{r['column']}{f'_{n}' if n else ''}` {r['kind']}")
    spark.createDataFrame([], ", ".join(names)).write.mode("errorifexists").parquet(path)


def save_schema(spark: SparkSession, catalogue: str, table: str, columns: DataFrame, version: int) -> None:
    """An entry of the schema catalogue for each column of a table; of entries with the same name the latest version stays."""
    save_latest(columns.withColumns({"table": F.lit(table), "version": F.lit(version)}), catalogue, ["table", "column"], [F.desc("version")])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_chunks(fields: DataFrame, key: str, name: str) -> DataFrame:
    """A layout as chunks: one for the whole record and one for each field; ids are hashes of what they hold."""
    whole = fields.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("content")).select(key, F.lit("record").alias("chunk_type"), "content")
    each = fields.select(key, F.lit("field").alias("chunk_type"), F.col(name).alias("content"))
    return whole.unionByName(each).withColumn("chunk_id", F.md5(F.concat_ws("|", key, "chunk_type", "content")))


#: Where uploaded files of each ending go.
TARGETS = {"cbl": "cobol", "cob": "cobol", "jcl": "jcl", "cpy": "copybooks", "copy": "copybooks", "bms": "bms", "sql": "db2", "ddl": "ddl", "dcl": "dclgen", "csv": "data", "json": "layouts", "zip": "archives"}


def target_folder(name: Column) -> Column:
    from ..functions.scoring import mapped

    return mapped(F.lower(F.regexp_extract(name, "[.]([A-Za-z0-9]+)$", 1)), TARGETS, "other")
