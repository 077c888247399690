"""Provenance and inventory of data sets."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import _hashlib
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.normalize import latest_per_key
from barloom.schema import SCHEMA_VERSION
from barloom.session import checkpoint_dir, importable

HASH_STEP = 128 << 20      # bytes of a file that one task hashes before it hands the state on
HASH_PIECE = 1 << 20       # bytes of a row of file content
BOM = b"\xef\xbb\xbf"
# Spark's readers of lines decompress files with these endings.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|lzo|snappy|zst|zstd)$"


def bars_by_symbol(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"))


def distinct_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def row_hash(df: DataFrame):
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)])


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of the rows: count, hash sum and hash xor."""
    hashed = df.select(row_hash(df).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"),
                      F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("hash_sum"),
                      F.bit_xor("h").alias("hash_xor"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with size and modification time; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "modificationTime", "length"))


class Sha256:
    """SHA-256 whose inner state can be kept as bytes and taken up in another process.

    hashlib hides the state; this is the same function of the library that hashlib is linked with.
    """

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.own = ctypes.create_string_buffer(state, 112) if state else ctypes.create_string_buffer(112)
        if not state:
            self.lib.SHA256_Init(self.own)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.own, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self.own.raw

    def hexdigest(self) -> str:
        out, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, 112)
        self.lib.SHA256_Final(out, copy)
        return out.raw.hex()


def _pieces(batches):
    """Rows (path, size, at, value) of lines in file order as rows (path, size, at, no, content) of about `HASH_PIECE` bytes."""
    here, held, n, no = None, [], 0, 0

    def row():
        values = [[here[0]], [here[1]], [here[2]], [no], [b"\n".join([*held, b""])]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["path", "size", "at", "no", "content"])

    for batch in batches:
        for *place, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (place != here or n >= HASH_PIECE):
                yield row()
                held, n, no = [], 0, no + 1 if place == here else 0
            here = place
            held.append(value)
            n += len(value) + 1
    if held:
        yield row()


def _advance(rows: pa.Table) -> pa.Table:
    """Pieces (path, size, total, state, seen, at, no, content) of one path, in any order, as one row (path, state, seen, sha256)."""
    path, size, total, state, seen = (rows.column(c)[0].as_py() for c in ("path", "size", "total", "state", "seen"))
    hasher, seen = Sha256(state), seen or 0
    if state is None and size - total >= len(BOM) - 1:      # readers of lines leave the mark out
        hasher.update(BOM)
        seen = len(BOM)
    for _, _, i in sorted(zip(rows.column("at").to_pylist(), rows.column("no").to_pylist(), range(len(rows)), strict=True)):
        content = rows.column("content")[i].as_py()[:size - seen]            # the last line may have no end
        hasher.update(content)
        seen += len(content)
    return pa.Table.from_pylist([{"path": path, "state": hasher.state, "seen": seen, "sha256": hasher.hexdigest()}])


def file_fingerprints(spark: SparkSession, path: str, step: int = HASH_STEP) -> DataFrame:
    """SHA-256 per file, of any size; Spark's readers leave empty files out.

    The hash of a file can only be taken from its start to its end. Files are split at line feeds by Spark's reader
    and laid into the shared folder in pieces; then, `step` bytes of each file at a time, tasks take up the state
    of the hash where others left it. So no task reads a whole file; the steps of one file follow one another.
    Only a stretch without any line feed is one row. Compressed files are read whole (2 GB at most).
    """
    importable(spark)
    own = F.col("_metadata.file_path").alias("path")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    whole = spark.read.format("binaryFile").load(path)
    home = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    lines = spark.read.text(path, lineSep="\n").select(
        own, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("value")).filter(~F.col("_metadata.file_path").rlike(COMPRESSED))
    laid = "path string, size long, at long, no int, content binary"
    lines.mapInArrow(_pieces, laid).withColumn("step", F.floor(F.col("at") / step).cast("int")).write.partitionBy("step").parquet(f"{home}/pieces")
    pieces = spark.read.schema(f"{laid}, step int").parquet(f"{home}/pieces")
    states = "path string, state binary, seen long, sha256 string"
    totals = pieces.groupBy("path").agg(F.sum(F.length("content")).alias("total"))
    reached = spark.createDataFrame([], states)
    for k in range((pieces.agg(F.max("step")).first()[0] or 0) + 1):
        due = pieces.filter(F.col("step") == k).join(totals, "path").join(reached.select("path", "state", "seen"), "path", "left")
        due.groupBy("path").applyInArrow(_advance, states).write.parquet(f"{home}/states/{k}")
        reached = spark.read.schema(states).parquet(*[f"{home}/states/{i}" for i in range(k + 1)]).groupBy("path").agg(
            F.max_by(F.struct("state", "seen", "sha256"), "seen").alias("r")).select("path", "r.*")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/pieces")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    files = whole.select(name, own.alias("_of"), "length").filter(~F.col("_of").rlike(COMPRESSED))
    # Only a file of the mark alone has no line.
    digest = F.when(F.col("length") == F.col("seen"), F.col("sha256")).when(
        F.col("seen").isNull() & (F.col("length") == len(BOM)), hashlib.sha256(BOM).hexdigest())
    hashed = files.join(reached, F.col("_of") == F.col("path"), "left").select("file", "length", digest.otherwise(
        F.raise_error(F.concat(F.lit("file changed while it was read: "), "file"))).alias("sha256"))
    return hashed.unionAll(whole.filter(F.col("_metadata.file_path").rlike(COMPRESSED)).select(name, "length", F.sha2("content", 256).alias("sha256")))


def list_datasets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, columns and size per file of each named data set."""
    out = None
    for tier, path in paths.items():
        df = spark.read.parquet(path)
        rows = df.groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        name = F.element_at(F.split("path", "/"), -1)
        sizes = file_listing(spark, path).select(name.alias("file"), F.col("length").alias("bytes"))
        one = rows.select(name.alias("file"), "rows").join(sizes, "file").select(
            F.lit(tier).alias("tier"), "file", "rows", F.lit(len(df.columns)).alias("columns"), "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def dataset_totals(listing: DataFrame) -> DataFrame:
    return listing.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"),
                                       F.sum("bytes").alias("bytes"))


def newest_files(spark: SparkSession, tiers: dict[str, str], rows: int = 10) -> DataFrame:
    """Most recently written files of each tier."""
    listed = None
    for tier, path in tiers.items():
        one = file_listing(spark, path).withColumn("tier", F.lit(tier))
        listed = one if listed is None else listed.unionByName(one)
    return latest_per_key(listed, ["tier"], [F.desc("modificationTime"), F.asc("path")], rows)


def catalog_records(bars: DataFrame, provider: str, timeframe: str, zone: str = "UTC") -> DataFrame:
    """One catalogue row per symbol with bounds, count, checksum and consistency flag."""
    return bars.withColumn("_h", row_hash(bars)).groupBy("symbol").agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.count(F.lit(1)).alias("record_count"),
        # With the sum and the count, equal rows do not cancel as in the exclusive or alone.
        F.xxhash64(F.bit_xor("_h"), F.sum(F.shiftright("_h", 24)), F.count(F.lit(1))).alias("checksum"),
    ).select(
        F.lit(provider).alias("provider"), "symbol", F.lit(timeframe).alias("timeframe"), "start", "end",
        F.lit(zone).alias("timezone"), F.lit(SCHEMA_VERSION).alias("schema_version"), "record_count",
        "checksum", ((F.col("start") <= F.col("end")) & (F.col("record_count") >= 0)).cast("int")
        .alias("is_valid"))
