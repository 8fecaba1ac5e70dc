"""Files of token ids in a word-aligned code: selectors pack varying counts of ids into 64-bit words.

A word holds a selector in its top 4 bits and, from the lowest bit up, as many ids as fit at one width. Selector 0
is an escape: the next word is one id as it is, for ids of 60 bits and more. Ids are coded in blocks that each start a
new word; the offsets of the blocks' first words let all blocks be decoded side by side.

A file: the magic, counts (documents, ids, blocks, words), doc_ids, ids per document, first word of each block, words.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_path, text_slices
from .tokens import encoder

MAGIC = b"WALIGN01"
BLOCK = 2048
#: Fixed values of the code: ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
FIRST = 1
#: Bits of the numbers below 2**16.
_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0. Above 53 bits it may be one too many, which costs room but no id."""
    if len(ids) and ids.max() < len(_SHORT):
        return _SHORT[ids.astype(np.int64)]
    return np.frexp(ids.astype(np.float64))[1].astype(np.int8)


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit ids. Each word takes the longest run that fits."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_blocks = -(-n // block)
    padded = np.full(n_blocks * block, 64, np.int8)
    padded[:n] = _bits(ids)
    # widest id of the run of each selector's length from each place, by doubling
    grid = np.full((n_blocks, block + int(COUNTS.max())), 64, np.int8)
    grid[:, :block] = padded.reshape(n_blocks, block)
    choice = np.full((n_blocks, block), ESCAPE, np.int8)
    widest = {1: grid}
    for s in range(len(COUNTS) - 1, FIRST - 1, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        if p not in widest:
            last, run = widest[p // 2], p // 2
            widest[p] = np.maximum(last, np.concatenate([last[:, run:], np.full((n_blocks, run), 64, np.int8)], axis=1))
        fits = np.maximum(widest[p][:, :block], widest[p][:, c - p : c - p + block]) <= WIDTHS[s]
        # where no run of a length fits, no longer run of a narrower width does
        if not fits.any():
            break
        np.copyto(choice, np.int8(s), where=fits)
    del widest, grid
    # the words of all blocks are found side by side
    step = COUNTS.astype(np.int8)[choice]
    at = np.zeros(n_blocks, np.int64)
    lengths = np.minimum(block, n - np.arange(n_blocks) * block)
    row_base = np.arange(n_blocks) * block
    starts = []
    live = np.arange(n_blocks)
    while len(live):
        starts.append(row_base[live] + at[live])
        at[live] += step[live, at[live]]
        live = live[at[live] < lengths[live]]
    starts = np.sort(np.concatenate(starts))
    chosen = choice.reshape(-1)[starts].astype(np.int64)
    escaped = chosen == ESCAPE
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(int(place[-1] + 1 + escaped[-1]), np.uint64)
    for s in np.unique(chosen).tolist():
        here = chosen == s
        if s == ESCAPE:
            words[place[here]] = 0
            words[place[here] + 1] = ids[starts[here]]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        got = np.full(int(here.sum()), np.uint64(s) << np.uint64(60))
        for k in range(c if w else 0):
            got |= ids[starts[here] + k] << np.uint64(k * w)
        words[place[here]] = got
    firsts = place[np.searchsorted(starts, row_base)]
    return words, firsts


def decode_ids(words: np.ndarray, firsts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of words; firsts are the first words of the blocks. Blocks are decoded side by side."""
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # a raw word after an escape may look like anything, so escapes are found first, block by block and word by word
    raw = np.zeros(len(words), dtype=bool)
    if (selectors == ESCAPE).any():
        ends = np.append(firsts[1:], len(words))
        at, live = firsts.copy(), np.arange(len(firsts))
        while len(live):
            escape = selectors[at[live]] == ESCAPE
            raw[at[live][escape] + 1] = True
            at[live] += 1 + escape
            live = live[at[live] < ends[live]]
    heads = np.flatnonzero(~raw)
    kinds = selectors[heads]
    counts = COUNTS[kinds]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(starts[-1] + counts[-1]), np.uint64)
    for s in np.unique(kinds).tolist():
        here = kinds == s
        if s == ESCAPE:
            out[starts[here]] = words[heads[here] + 1]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        mask = np.uint64((1 << w) - 1)
        for k in range(c if w else 0):
            out[starts[here] + k] = (words[heads[here]] >> np.uint64(k * w)) & mask
    return out[:n]


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, firsts = encode_ids(ids)
    head = np.array([len(doc_ids), len(ids), len(firsts), len(words)], "<i8")
    parts = (head, doc_ids.astype("<i8"), lengths.astype("<i8"), firsts.astype("<i8"), words.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ids) of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    d, n, b, w = np.frombuffer(raw, "<i8", 4, 8).tolist()
    at = 40
    doc_ids, lengths = np.frombuffer(raw, "<i8", d, at), np.frombuffer(raw, "<i8", d, at + 8 * d)
    firsts = np.frombuffer(raw, "<i8", b, at + 16 * d)
    words = np.frombuffer(raw, "<u8", w, at + 16 * d + 8 * b)
    return doc_ids, lengths, decode_ids(words, firsts, n)


def _opener(folder: str) -> Callable[[str, bytes], None]:
    """A function for executors that puts a file into the shared folder under its final name at once, so retries are safe."""
    scheme = folder.split(":", 1)[0] if ":/" in folder else "file"

    def put(name: str, raw: bytes) -> None:
        from pyarrow import fs

        if scheme == "file":
            place = folder.removeprefix("file:")
            place = "/" + place.lstrip("/")
            os.makedirs(place, exist_ok=True)
            own = f"{place}/.{name}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(raw)
            os.replace(own, f"{place}/{name}")
            return
        system, place = fs.FileSystem.from_uri(folder)
        with system.open_output_stream(f"{place}/{name}") as f:
            f.write(raw)

    return put


def file_number(entry: tuple[str, int, int]) -> int:
    return int(entry[0].split("-")[1].split(".")[0])


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, files: int | None = None, file_text_bytes: int = 16 << 20) -> tuple[str, list[tuple[str, int, int]]]:
    """Encode all texts, append end_id to each, and write the ids in ascending doc_id order; (folder, [(file, documents, ids)]).

    Nulls: a null text is empty; null doc_ids come first and are written as the smallest 64-bit integer. Repeated doc_ids
    stand side by side, ordered by text. Other columns are ignored. An empty table gives no files.
    The list has one entry per file of about file_text_bytes of text; files are named in doc_id order.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    if files is None:
        total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        files = max(1, -(-total // file_text_bytes))
    put = _opener(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, lengths = [], [], []
        for batch in batches:
            for piece in text_slices(batch):
                coded = encode(piece.column("text").to_pylist())
                doc_ids.append(piece.column("doc_id").fill_null(-(2**63)).to_numpy())
                parts += [x for c in coded for x in (c, end)]
                lengths += [len(c) // 4 + 1 for c in coded]
        if not lengths:
            return
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
        del parts
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        put(name, file_bytes(np.concatenate(doc_ids), np.array(lengths, np.int64), ids))
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(lengths)], "n_ids": [len(ids)]})

    # ties are broken by text, so a task that runs again writes the same bytes
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(write, "file string, n_docs long, n_ids long").collect()
    # by the number in the name: names of different length don't sort so
    return path, sorted(((r["file"], r["n_docs"], r["n_ids"]) for r in made), key=file_number)


def read_token_files(spark, path: str, manifest: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and, with_ids, ids."""
    base, before = {}, 0
    for name, _, n in manifest:
        base[name] = before
        before += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                doc_ids, lengths, ids = read_file(raw.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                low = ids.astype("<u4")
                view = memoryview(low).cast("B")
                crcs = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]
                first = base[where.rsplit("/", 1)[1]]
                null = doc_ids == -(2**63)
                cols = [pa.array(doc_ids, mask=null), pa.array(starts + first), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").load([f"{path}/{name}" for name, _, _ in manifest]).select("path", "content")
    return files.mapInArrow(read, schema)
