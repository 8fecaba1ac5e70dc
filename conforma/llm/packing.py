"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing runs over counts, not documents: bins that look alike form a class (a run of sequence numbers with
equal room left), and a step puts many pieces of one length into a class at once. Pieces then take the planned slots
by joining on their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, text_slices
from .tokens import encoder

CAPACITY = 2048
#: Ranks are counted in so many pieces a bucket, about.
RANK_ROWS = 20_000
PLAN = "length int, lo long, hi long, first long, per int, at int"
#: Columns that pack adds on the way.
RESERVED = {"_bucket", "_n", "_before", "_rank", "_length", "_lo", "_hi", "_first", "_per", "_at"}


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, lo, hi, first, per, at).

    Piece of rank r in lo..hi-1 goes to sequence first + (r - lo) // per, at offset at + (r - lo) % per * length.
    Every step uses up either the pieces of a length or the bins of a class, and adds at most one class more, so the
    number of steps is bounded by a function of capacity alone, however many pieces there are.
    """
    rows, sequences = [], 0
    rooms: list[int] = []  # rooms left that occur, ascending
    classes: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, bins)

    def add(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in classes:
                insort(rooms, room)
                classes[room] = []
            classes[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        lo, n = 0, histogram[length]
        while lo < n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, bins = classes[room].pop()
                used = min(bins, n - lo)
                if not classes[room]:
                    del classes[room]
                    rooms.pop(k)
                rows.append((length, lo, lo + used, first, 1, capacity - room))
                add(room - length, first, used)
                add(room, first + used, bins - used)
                lo += used
            else:
                per = capacity // length
                bins = (n - lo) // per
                if bins:
                    rows.append((length, lo, lo + bins * per, sequences, per, 0))
                    add(capacity - per * length, sequences, bins)
                    sequences += bins
                    lo += bins * per
                if lo < n:
                    rows.append((length, lo, n, sequences, n - lo, 0))
                    add(capacity - (n - lo) * length, sequences, 1)
                    sequences += 1
                    lo = n
    return rows


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Ids of each text and end_id, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32 and, with_ids, ids.

    A null text is empty (its piece is end_id alone); only documents over capacity are cut, and only their last piece may be
    shorter. Null and repeated doc_ids are kept as they are; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch):
                doc, piece, start, length, crc, raw = [], [], [], [], [], []
                for d, coded in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    coded += end
                    for k, i in enumerate(range(0, len(coded), 4 * capacity)):
                        x = coded[i : i + 4 * capacity]
                        doc.append(d)
                        piece.append(k)
                        start.append(i // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        raw.append(x)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.append(0, np.cumsum(length)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (long) and offset (long) to pieces with an int column length of 1..capacity.

    Within a sequence the offsets run gapless from 0. pieces is read twice, so it should be a stored table. Pieces of equal
    length are interchangeable; ranks within a length come from hash buckets, so no length is gathered into one task.
    An empty table gives an empty result. Columns named sequence_id or offset are replaced; those in RESERVED are refused.
    """
    if RESERVED & set(pieces.columns):
        raise ValueError(f"columns {', '.join(sorted(RESERVED))} are reserved")
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*[c for c, t in pieces.dtypes if t in ("bigint", "int", "string")]), F.lit(1 << 20)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    buckets = max(1, -(-total // RANK_ROWS))
    keyed = keyed.withColumn("_bucket", F.pmod("_bucket", F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(*[c for c in ("doc_id", "piece") if c in pieces.columns] or ["_bucket"])
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    # the plan's size depends on capacity alone (see plan_packing)
    plan = F.broadcast(spark.createDataFrame(plan_packing(histogram, capacity), PLAN))
    plan = plan.toDF(*[f"_{c}" for c in plan.columns])
    out = ranked.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    step = F.col("_rank") - F.col("_lo")
    out = out.withColumn("sequence_id", (F.col("_first") + F.floor(step / F.col("_per"))).cast("long"))
    out = out.withColumn("offset", (F.col("_at") + step % F.col("_per") * F.col("length")).cast("long"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (see token_pieces) with their place in as few sequences as best-fit decreasing needs."""
    return pack(materialise(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
