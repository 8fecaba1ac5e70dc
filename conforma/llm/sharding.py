"""Global shuffle of a table too large for memory, in two passes, and its cut into shards.

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash; pass 2 shuffles each bucket with
Fisher-Yates and writes it. The buckets in order are one random order of all rows; shard s is the s-th of n equal
runs of it, so shard sizes differ by one row at most (law ``rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import fresh_path, materialise, small

#: Bytes of rows that a bucket holds about; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
#: Buckets that a task takes one after the other, once there are more buckets than shuffle partitions: half a GB of rows.
PART_BUCKETS = 64
#: Parts (the buckets of a task) whose rows are summed up together.
BLOCK_BUCKETS = 4096
RESERVED = {"_bucket", "_part", "_place", "_key", "_rows", "_before", "_at"}


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of range(n), by numpy's seeded generator, whose permutation() is Fisher-Yates."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def shuffle_rows(df: DataFrame, size: str, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of df in one global random order: (rows with _part and _place, table of _part, _rows, _before).

    A part is a run of buckets that one task takes: it gets them sorted by Spark, which spills, and holds one at a time. _place
    counts within the part. The number of parts has no say in the order.

    size: SQL expression of a row's bytes. The order depends on doc_id, text, the seed and the number of buckets alone,
    so a task that runs again after a lost executor gives the same rows. Rows with equal doc_id and text are
    interchangeable and share a bucket. A row larger than a bucket makes its bucket that much larger. Columns of df with
    names in RESERVED are refused. An empty table gives no rows.
    """
    if RESERVED & set(df.columns):
        raise ValueError(f"columns {', '.join(sorted(RESERVED))} are reserved")
    total = df.agg(F.sum(F.expr(size)).alias("b")).first()["b"] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    # the bits that place a row within its bucket must not be those that chose the bucket
    keyed = df.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("_bucket", F.pmod(F.shiftright("_key", 7), F.lit(n)).cast("int"))
    parts = min(n, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_BUCKETS)))
    keyed = keyed.withColumn("_part", F.floor(F.col("_bucket").cast("long") * parts / n).cast("int"))
    counts = materialise(keyed.groupBy("_part").agg(F.count("*").alias("_rows")), "part-rows")

    def ahead(window, rows: str) -> Column:
        return F.coalesce(F.sum(rows).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # rows before a part: those of the blocks of parts before its own, and of the parts before it in its block
    block = F.floor(F.col("_part") / BLOCK_BUCKETS)
    blocks = counts.groupBy(block.alias("_block")).agg(F.sum("_rows").alias("_n"))
    blocks = blocks.select("_block", ahead(Window.orderBy("_block"), "_n").alias("_first"))
    within = counts.withColumn("_block", block).withColumn("_within", ahead(Window.partitionBy("_block").orderBy("_part"), "_rows"))
    starts = within.join(small(blocks, -(-parts // BLOCK_BUCKETS)), "_block").select("_part", "_rows", (F.col("_first") + F.col("_within")).alias("_before"))
    starts = materialise(starts, "part-starts")
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _part int, _place long"

    # the order of arrival may differ when a task runs again: sort first, then shuffle
    keys = [("_key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]

    def one(bucket: int, got: list[pa.RecordBatch], before: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(got).drop_columns(["_bucket"])
        order = pa.compute.sort_indices(whole, sort_keys=keys).to_numpy()
        order = order[fisher_yates(len(order), (seed << 32) + bucket)]
        whole = whole.drop_columns(["_key"]).combine_chunks()
        for k in range(0, len(order), 4096):
            piece = whole.take(pa.array(order[k : k + 4096]))
            places = np.arange(before + k, before + k + len(piece), dtype=np.int64)
            yield from piece.append_column("_place", pa.array(places)).combine_chunks().to_batches()

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each bucket of a part in its turn, as soon as the next one begins."""
        bucket, got, before = None, [], 0
        for batch in batches:
            buckets = batch.column("_bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if got and buckets[lo] != bucket:
                    yield from one(bucket, got, before)
                    before, got = before + sum(b.num_rows for b in got), []
                bucket = int(buckets[lo])
                got.append(batch.slice(lo, hi - lo))
        if got:
            yield from one(bucket, got, before)

    dealt = keyed.repartitionById(parts, F.col("_part")).sortWithinPartitions("_bucket")
    return dealt.mapInArrow(shuffle, out_schema), starts


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 17, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs, shuffled and cut into n_shards shards, as Parquet under path (shard=0, shard=1, ...), and read them back.

    Adds shard (int), slot (long, gapless from 0 within the shard) and size (UTF-8 bytes of text plus 8; a null text counts
    none). Columns of docs named like these are dropped; names in RESERVED are refused. Empty table: empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "size")
    path = path or fresh_path(spark, "shards")
    size = "coalesce(octet_length(text), 0) + 8"
    rows, starts = shuffle_rows(docs, size, seed, bucket_bytes)
    total = starts.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    base, longer = divmod(total, n_shards)
    edge = longer * (base + 1)
    at = F.col("_before") + F.col("_place")
    short = F.lit(longer) + F.floor((at - edge) / F.lit(max(base, 1)))
    shard = F.when(at < edge, F.floor(at / F.lit(base + 1))).otherwise(short).cast("int")
    first = F.col("shard") * F.lit(base) + F.least(F.col("shard"), F.lit(longer))
    # one row a part, counted
    out = rows.join(small(starts.drop("_rows"), starts.count()), "_part").withColumn("_at", at).withColumn("shard", shard)
    out = out.withColumn("slot", (F.col("_at") - first).cast("long")).withColumn("size", F.expr(size).cast("long"))
    out.drop("_part", "_place", "_before", "_at").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = out.drop("_part", "_place", "_before", "_at", "shard").schema.add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)
