"""Shared pieces of the training-data operators: shared storage, ranks, components, text blocks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The six ASCII white-space bytes, and A-Z to a-z; every other byte stays.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_SPACE_TABLE = bytes(32 if b in ASCII_SPACE else LOWER_TABLE[b] for b in range(256))
#: Between the documents of a block; never part of valid UTF-8.
MARK = b"\xff"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary one of this session, if driver and executors are one process; else an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_tidewell_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stable_salt(key: Column, n: int) -> Column:
    """0..n-1 from the first 8 hex digits of md5(key as text): the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(n)


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, salt: Column, weight: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, ordered by (salt, order), though no task sees a whole group.

    Rows are ranked inside (group, salt); the few counts of (group, salt) are summed up and added. With a weight (a whole
    number), a row's number is the sum of the weights before it instead. Null group values form groups like any other.
    """
    s = "_salt_"
    one = F.lit(1) if weight is None else weight
    inside = Window.partitionBy(*group, s).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn(s, salt).withColumn("_rank_", F.sum(one).over(inside) - one)
    counts = df.withColumn(s, salt).groupBy(*group, s).agg(F.sum(one).alias("_n_"))
    before = Window.partitionBy(*group).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before_", F.coalesce(F.sum("_n_").over(before), F.lit(0))).drop("_n_")
    keys = [*group, s]
    offsets = offsets.select(*(F.col(k).alias(f"_o{i}_") for i, k in enumerate(keys)), "_before_")
    on = [F.col(k).eqNullSafe(F.col(f"_o{i}_")) for i, k in enumerate(keys)]
    joined = ranked.join(offsets, on, "left")
    return joined.withColumn(name, (F.col("_rank_") + F.col("_before_")).cast("long")).drop("_rank_", "_before_", s, *(f"_o{i}_" for i in range(len(keys))))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest node reachable from each node of edges(a, b): columns node, component.

    Alternating large-star and small-star rounds over a table in shared storage; no edge or component
    visits the driver, which sees one count and one checksum a round. Nulls and loops are ignored.
    """
    loops = edges.where("a is not null and b is not null").select("a", "b").distinct()
    now = materialize(loops, label)
    nodes_only = now.select(F.col("a").alias("node")).union(now.select(F.col("b"))).distinct()
    first = now
    seen = None
    while True:
        # large star: every larger neighbour of u is tied to the smallest node around u
        both = now.where("a <> b").select("a", "b").union(now.where("a <> b").select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of u, and u, are tied to the smallest of them
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialize(small, label)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now is not first:
            discard(now)
        now = new
        if state == seen:
            break
        seen = state
    roots = now.groupBy("a").agg(F.min("b").alias("m"))
    return nodes_only.join(roots, nodes_only.node == roots.a, "left").select("node", F.coalesce("m", "node").alias("component"))


def give_back() -> None:
    """Hand freed memory, Arrow's too, back to the system, so that idle Python workers beside other stages stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows regrouped so that a block's texts have about `limit` bytes (a longer text stands alone); nulls become empty."""
    give_back()  # what the task before held in this worker, its broadcast values among it
    try:
        yield from _text_blocks(batches, column, limit)
    finally:
        give_back()


def _text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield _block(held, column)
                held, size, start = [], 0, i
            size += n + 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield _block(held, column)


def _bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def _block(held: list[pa.RecordBatch], column: str) -> tuple[pa.Table, list[bytes]]:
    table = pa.Table.from_batches(held)
    return table, [v or b"" for c in table.column(column).chunks for v in _bytes(c)]


def crc_mod(key: Column, n: int) -> Column:
    """crc32(key as text) mod n, which fixes the folds of the labelled operators."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of data, in which every white-space byte is 0x20 already.

    Polynomial over the word's bytes, by positions within the word, so it takes a few vector operations a block.
    """
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = a == 32
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = ends - starts
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64) + n.astype(np.uint64)
    # eight bytes at a time: words are packed into 64-bit pieces, which are mixed in turn
    padded = np.concatenate([a, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.as_strided(padded, shape=(len(a), 8), strides=(1, 1))
    live = np.arange(len(starts))
    offset = 0
    while len(live):
        left = n[live] - offset
        piece = np.ascontiguousarray(wide[starts[live] + offset]).view(np.uint64).ravel()
        short = left < 8
        if short.any():
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8))
            piece = piece & keep
        h[live] = mix64(h[live] ^ piece) + np.uint64(0x9E3779B97F4A7C15)
        offset += 8
        live = live[left > 8]
    return h, starts


def pieces(values: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """Where ascending hashes are cut between equal ranges (a power of two of them): each range that holds any, and its place."""
    if not len(values):
        return []
    which = values >> np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else np.zeros(len(values), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])).tolist()
    return list(zip(which[first].astype(np.int64).tolist(), map(slice, first, [*first[1:], len(values)]), strict=True))


def cuts(total: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of a list with these running totals, so that each piece adds up to about `size` (a larger item stands alone)."""
    at = 0
    while at < len(total):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, stop
        at = stop
