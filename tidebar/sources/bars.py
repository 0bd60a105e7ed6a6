"""Bar files in and out: `<root>/<MARKET>/<YEAR>.parquet` and the engine's own partitioned layout."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebar.plans.checkpoints import checkpointed

FILE_PATTERN = r"([^/]+)/(\d{4})\.parquet$"
BAR_COLUMNS = ("ts_event", "open", "high", "low", "close", "volume")


def utc_timestamp(df: DataFrame, column: str = "ts_event") -> Column:
    """UTC wall-clock values without a zone become timestamps; the session time zone must be UTC."""
    return F.col(column).cast("timestamp")


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"set spark.sql.session.timeZone to UTC, not {zone}")


def symbol_from_path(path: Column) -> Column:
    return F.regexp_extract(path, FILE_PATTERN, 1)


def year_from_path(path: Column) -> Column:
    return F.try_to_number(F.regexp_extract(path, FILE_PATTERN, 2), F.lit("9999")).cast("int")


def read_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, years: Sequence[int] | None = None,
              row_index: bool = False) -> DataFrame:
    """Bars with `symbol` and `file_year` from the path; the six bar columns are all that is read.

    Markets and years narrow the glob itself, so other files are not opened.
    """
    require_utc(spark)
    markets = "{" + ",".join(symbols) + "}" if symbols else "*"
    stems = "{" + ",".join(str(y) for y in years) + "}" if years else "[0-9][0-9][0-9][0-9]"
    raw = spark.read.parquet(f"{root}/{markets}/{stems}.parquet")
    path = F.col("_metadata.file_path")
    extra = [F.col("_metadata.row_index").alias("row_index")] if row_index else []
    return raw.select(symbol_from_path(path).alias("symbol"), year_from_path(path).alias("file_year"),
                      utc_timestamp(raw).alias("ts_event"), *BAR_COLUMNS[1:], *extra)


def list_files(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, start_year: int | None = None,
               end_year: int | None = None, max_files: int | None = None) -> DataFrame:
    """Matching files with market, year, size and modification time; content is not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].parquet").load(f"{root}/*")
             .select("path", symbol_from_path(F.col("path")).alias("symbol"), year_from_path(F.col("path")).alias("file_year"),
                     "length", "modificationTime"))
    if symbols:
        files = files.filter(F.upper("symbol").isin([s.upper() for s in symbols]))
    if start_year is not None:
        files = files.filter(F.col("file_year") >= start_year)
    if end_year is not None:
        files = files.filter(F.col("file_year") <= end_year)
    return files.orderBy("symbol", "file_year").limit(max_files) if max_files else files


def zero_length_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of files without a byte, which Spark's own listing leaves out; the driver lists names and sizes only."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/*/[0-9][0-9][0-9][0-9].parquet")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [f.getPath().toString() for f in found if f.getLen() == 0]


#: A larger file is not inspected as one value.
INSPECTED_BYTES = 1 << 30
_ISSUES = "symbol string, file_year int, severity string, check string, detail string"


def file_issues(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, file_year, severity, check, detail) of files that cannot be audited: unreadable, without rows, or short of a column.

    Spark reads all files past corrupt ones and counts rows and values per file. Only files that give no rows, or no value of
    some column, are opened again, in tasks that read their footers. Nothing fails on a bad file.
    """
    files = list_files(spark, root)
    try:
        raw = (spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].parquet").parquet(f"{root}/*"))
    except AnalysisException:  # no file has a readable footer
        raw = None
    doubtful = files
    if raw is not None:
        path, known = F.col("_metadata.file_path"), [c for c in BAR_COLUMNS if c in raw.columns]
        read = (raw.select(symbol_from_path(path).alias("symbol"), year_from_path(path).alias("file_year"), *known)
                .groupBy("symbol", "file_year").agg(F.count(F.lit(1)).alias("_rows"), F.least(F.lit(1 << 62), *[F.count(c) for c in known]).alias("_least")))
        doubtful = files.join(read, ["symbol", "file_year"], "left")
        if len(known) == len(BAR_COLUMNS):
            doubtful = doubtful.filter(F.coalesce("_least", F.lit(0)) == 0)
    doubtful = checkpointed(doubtful.select("path", "symbol", "file_year", "length"))
    paths = [r[0] for r in doubtful.filter(F.col("length") <= INSPECTED_BYTES).select("path").collect()]  # names of bad files

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    footer = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                    missing = [c for c in BAR_COLUMNS if c not in footer.schema_arrow.names]
                    types = ",".join(str(t) for t in footer.schema_arrow.types)
                    out.append(("schema_missing_cols", ",".join(missing)) if missing else ("empty_file", "no rows") if not footer.metadata.num_rows
                               else ("", types))
                except Exception as e:  # whatever a bad file raises is its report
                    out.append(("read_parquet", f"{type(e).__name__}: {e}"[:300]))
            checks, details = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(checks, pa.string()), pa.array(details, pa.string())], ["path", "check", "detail"])

    if paths:
        footers = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(task, "path string, check string, detail string")
    else:
        footers = spark.createDataFrame([], "path string, check string, detail string")
    # a sound footer, yet no rows: the types are not those of the other files; sound rows without a value are the row rules' matter
    unread = read.select("symbol", "file_year", F.lit(True).alias("_some")) if raw is not None else None
    found = doubtful.join(footers, "path", "left")
    found = found.join(unread, ["symbol", "file_year"], "left") if unread is not None else found.withColumn("_some", F.lit(None).cast("boolean"))
    check = F.when(F.coalesce("check", F.lit("")) != "", F.col("check")).when(F.col("_some").isNull(), F.lit("read_parquet"))
    found = (found.select("symbol", "file_year", F.lit("FAIL").alias("severity"), check.alias("check"), F.coalesce("detail", F.lit("no rows could be read")).alias("detail"))
             .filter(F.col("check").isNotNull()))
    void = spark.createDataFrame([(p,) for p in zero_length_files(spark, root)], "path string").select(
        symbol_from_path(F.col("path")).alias("symbol"), year_from_path(F.col("path")).alias("file_year"), F.lit("FAIL").alias("severity"),
        F.lit("read_parquet").alias("check"), F.lit("0 bytes").alias("detail"))
    return found.unionByName(void).to(StructType.fromDDL(_ISSUES))


def file_bounds(df: DataFrame) -> DataFrame:
    """First and last date per file year over all symbols."""
    return df.groupBy("file_year").agg(F.to_date(F.min("ts_event")).alias("first_date"), F.to_date(F.max("ts_event")).alias("last_date"))


def file_hashes(spark: SparkSession, root: str, whole_bytes: int = INSPECTED_BYTES, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, sha256) of the bar files. Files up to `whole_bytes` are hashed as one value, which Spark limits to 2 GB.

    A longer file is read by a task of its own in ranges of `range_bytes`, through the file system that Arrow has for its path,
    so no task holds more than a range and no size is excluded.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                local = re.sub("^file:/+", "/", path)
                system, inside = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with system.open_input_file(inside) as stream:
                    for start in range(0, stream.size(), range_bytes):
                        digest.update(stream.read_at(min(range_bytes, stream.size() - start), start))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].parquet").load(f"{root}/*")
    whole = files.filter(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    long = files.filter(F.col("length") > whole_bytes).select("path").repartition("path")
    return whole.unionByName(long.mapInArrow(task, "path string, sha256 string"))


def build_manifest(spark: SparkSession, root: str, audit: DataFrame | None = None, with_hash: bool = True, whole_bytes: int = INSPECTED_BYTES) -> DataFrame:
    """Audit manifest: path, market, year, size, modification time, SHA-256, row count, time bounds, audit status.

    `whole_bytes` as in `file_hashes`; `with_hash=False` leaves the hash out.
    """
    files = list_files(spark, root)
    if with_hash:
        files = files.join(file_hashes(spark, root, whole_bytes), "path")
    else:
        files = files.withColumn("sha256", F.lit(None).cast("string"))
    rows = (read_bars(spark, root).groupBy("symbol", "file_year")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("ts_event").alias("ts_min"), F.max("ts_event").alias("ts_max")))
    out = files.join(rows, ["symbol", "file_year"], "left")
    if audit is None:
        return out.withColumn("audit_status", F.lit("UNKNOWN"))
    return out.join(audit_status(audit), ["symbol", "file_year"], "left").withColumn(
        "audit_status", F.coalesce("audit_status", F.lit("UNKNOWN")))


def audit_status(*reports: DataFrame) -> DataFrame:
    """Worst severity per file over report tables with symbol, file_year, severity: FAIL or PASS."""
    rows = reports[0].select("symbol", "file_year", "severity")
    for report in reports[1:]:
        rows = rows.unionByName(report.select("symbol", "file_year", "severity"))
    failed = F.max(F.when(F.upper("severity") == "FAIL", 1).otherwise(F.lit(0))) == 1
    return rows.groupBy("symbol", "file_year").agg(F.when(failed, "FAIL").otherwise("PASS").alias("audit_status"))


def dataset_gate(current: DataFrame, manifest: DataFrame, check_hash: bool = True) -> DataFrame:
    """Files that do not match the manifest, with all reasons; an empty result means the gate passes."""
    m = manifest.select("path", *[F.col(c).alias(f"_{c}") for c in ("length", "modificationTime", "sha256", "audit_status")])
    joined = current.join(m.withColumn("_known", F.lit(True)), "path", "left")
    known = F.col("_known").isNotNull()
    tests = [(~known, "missing_manifest_record"), (known & ~F.coalesce(F.upper("_audit_status") == "PASS", F.lit(False)), "audit_not_pass"),
             (known & (F.col("length") != F.col("_length")), "size_changed"),
             (known & (F.col("modificationTime") != F.col("_modificationTime")), "mtime_changed")]
    if check_hash:
        tests.append((known & ~F.coalesce(F.col("sha256") == F.col("_sha256"), F.lit(False)), "hash_changed"))
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda x: x.isNotNull())
    return joined.select("path", "symbol", "file_year", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def write_canonical(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_group: int = 65_536) -> None:
    """Columns in name order, snappy, floats narrowed; the committer makes the write atomic."""
    narrow = [F.col(f"`{c}`").cast("float").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in sorted(df.dtypes)]
    (df.select(*narrow).write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", rows_per_group)
     .partitionBy(*partition_by).parquet(path))


#: Rows per file of a validated table.
FILE_ROWS = 5_000_000


def write_validated(df: DataFrame, path: str, issues: DataFrame | None = None, file_rows: int = FILE_ROWS) -> None:
    """Cleaned bars partitioned by symbol and year, sorted by time inside each file.

    Rows are dealt by ranges of time within symbol and year, so a symbol-year of very many rows is written by several tasks, in
    files of at most `file_rows` that follow each other in time. With `issues` (severity) nothing is written while a row is FAIL.
    """
    if issues is not None:
        failed = issues.filter(F.upper("severity") == "FAIL").limit(10).collect()
        if failed:
            raise ValueError("validated write refused: " + "; ".join(str(r.asDict()) for r in failed))
    (df.repartitionByRange("symbol", "file_year", "ts_event").sortWithinPartitions("symbol", "file_year", "ts_event")
     .write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("symbol", "file_year").parquet(path))


def write_reports(tables: dict[str, DataFrame], out: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")


def write_results(tables: dict[str, DataFrame], out: str, keys: Sequence[str] = ("symbol", "split_id")) -> None:
    """Result frames as parquet partitioned by their keys; report frames (names ending in _report) as JSON."""
    for name, table in tables.items():
        if name.endswith("_report"):
            table.write.mode("overwrite").json(f"{out}/{name}")
        else:
            by = [k for k in keys if k in table.columns]
            table.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/{name}")


def fingerprint(settings: dict, files: DataFrame | None = None) -> str:
    """SHA-256 of the settings and of an order-insensitive digest of the input files."""
    payload = json.dumps(settings, sort_keys=True, default=str)
    digest = ""
    if files is not None:
        row = files.agg(F.bit_xor(F.xxhash64("path", "length", F.col("modificationTime").cast("string"))).alias("x"), F.count(F.lit(1)).alias("n")).first()
        digest = f"{row['x']}:{row['n']}"
    return hashlib.sha256(f"{payload}|{digest}".encode()).hexdigest()


def read_or_build(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame], check: Callable[[DataFrame], None] | None = None,
                  partition_by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Cached artifact `<root>/fp=<key>`: built once, complete only with the committer's _SUCCESS file, checked on load."""
    path = f"{root}/fp={key}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    out = spark.read.parquet(path)
    if check is not None:
        check(out)
    return out


BACKTEST_PATTERN = r"([^/]+)/((\d{4})_split_(\d+)([^/]*))/backtest_results"
BACKTEST_COLUMNS = ("ts_event", "pnl", "position", "benchmark_pnl", "prediction_prob", "ret_exec", "equity_curve", "return_on_equity", "drawdown_pct")


def read_backtests(spark: SparkSession, root: str, profile: str = "") -> DataFrame:
    """Backtests under `<root>/<market>/<year>_split_<n>[_profile]/backtest_results*.parquet` in one read.

    The profile suffix only filters when at least one directory carries it.
    """
    raw = spark.read.option("mergeSchema", True).parquet(f"{root}/*/*_split_*/backtest_results*.parquet")
    path = F.col("_metadata.file_path")
    tagged = raw.select(F.regexp_extract(path, BACKTEST_PATTERN, 1).alias("symbol"), F.regexp_extract(path, BACKTEST_PATTERN, 3).cast("int").alias("year"),
                        F.regexp_extract(path, BACKTEST_PATTERN, 4).cast("int").alias("split_id"), F.regexp_extract(path, BACKTEST_PATTERN, 5).alias("_suffix"),
                        *[F.col(c) for c in BACKTEST_COLUMNS if c in raw.columns])
    if profile:
        chosen = tagged.filter(F.col("_suffix").endswith(f"_{profile}"))
        tagged = tagged if chosen.isEmpty() else chosen
    return tagged.drop("_suffix")


def read_split_summaries(spark: SparkSession, root: str, year: int, rows: DataFrame | None = None) -> DataFrame:
    """Per-split JSON manifests of a year, with result row counts when given."""
    manifests = spark.read.json(f"{root}/*/{year}_split_*/manifest.json")
    return manifests if rows is None else manifests.join(rows, [c for c in ("symbol", "split_id") if c in manifests.columns], "left")
