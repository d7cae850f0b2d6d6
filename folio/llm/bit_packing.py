"""Token ids in files of fixed-width bit fields.

Texts are dealt out by ranges of (doc_id, place in the scan), so the rows of one
doc_id, or those without any, are split like others; each task reads its range
in order and writes a file for every FILE_IDS ids, encoding as it goes. An id
takes the fewest bits the vocabulary needs. A file holds documents in ascending
order:

    magic "FWB1", version, width, block size, documents, ids, payload's crc32
    doc_id of each document          (int64)
    first id of each, and the end    (uint64, counted within the file)
    byte offset of each block, and the end (uint64, within the payload)
    payload: blocks of GROUP-aligned ids, `width` 64-bit words for 64 ids

64 ids of w bits fill w words exactly, so every group starts on a word: packing
and unpacking are w-bit shifts over whole columns of groups, and any id is read
from its own block alone.

Defined cases: a null or empty text is a document of its end id alone; an empty
table gives no files and no rows; rows that share a doc_id are each encoded, in
any order among themselves; a null doc_id comes before the others and is read
back as null; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import buckets, id_and_text
from folio.llm.tokens import encoder
from folio.session import new_folder, ship_package, written

MAGIC = b"FWB1"
HEAD = struct.Struct("<4sHHIQQI")
GROUP = 64
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)
BLOCK = 64 * GROUP
#: Characters of text in one task, about, but at most PARTS tasks; and ids from which a file is complete.
FILE_CHARS, PARTS, FILE_IDS = 24_000_000, 20_000, 3_000_000
#: Tasks whose files are summed up before the sums are: what a single task sees is one row for so many.
SUMMED = 4096
MANIFEST = "part long, nth long, name string, docs long, n_ids long"


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below it."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit fields, zero-padded to whole groups of 64 ids."""
    if not 1 <= width <= 32:
        raise ValueError(f"width {width} is not within 1 to 32")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    groups = -(-len(ids) // GROUP)
    fields = np.zeros((groups, GROUP), np.uint64)
    fields.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, width), np.uint64)
    for at in range(GROUP):
        word, shift = divmod(at * width, 64)
        out[:, word] |= fields[:, at] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= fields[:, at] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(payload: bytes | memoryview, width: int, count: int) -> np.ndarray:
    words = np.frombuffer(payload, "<u8").reshape(-1, width)
    out = np.empty((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for at in range(GROUP):
        word, shift = divmod(at * width, 64)
        field = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            field = field | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, at] = field & mask
    return out.reshape(-1)[:count]


def build_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    starts = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    payload = pack(ids, width)
    whole = BLOCK // GROUP * width * 8
    offsets = np.append(np.arange(0, len(payload), whole), len(payload)).astype("<u8")
    head = HEAD.pack(MAGIC, 1, width, BLOCK, len(doc_ids), len(ids), zlib.crc32(payload))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), starts.tobytes(), offsets.tobytes(), payload))


class PackedFile:
    """One file's bytes; ids are unpacked block by block as they are asked for."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.block, docs, self.count, self.crc = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of packed ids")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs)
        blocks = -(-self.count // self.block) + 1
        self.offsets = np.frombuffer(data, "<u8", blocks, at := at + 8 * (docs + 1))
        self.payload = memoryview(data)[at + 8 * blocks :]

    def check(self) -> None:
        if zlib.crc32(self.payload) != self.crc:
            raise ValueError("the payload's crc32 differs")

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids from start on; reads only the blocks that hold them."""
        if not length:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + length - 1) // self.block
        part = self.payload[int(self.offsets[first]) : int(self.offsets[last + 1])]
        got = unpack(part, self.width, (last + 1 - first) * self.block)
        return got[start - first * self.block :][:length]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id within the file, ids) of each, a run of blocks at a time."""
        for at in range(0, len(self.doc_ids), 512):
            end = min(at + 512, len(self.doc_ids))
            low, high = int(self.starts[at]), int(self.starts[end])
            ids = self.ids(low, high - low)
            for k in range(at, end):
                yield int(self.doc_ids[k]), int(self.starts[k]), ids[int(self.starts[k]) - low : int(self.starts[k + 1]) - low]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder else "file://" + folder.removeprefix("file:"))


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, file_chars: int = FILE_CHARS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their manifest: task, its n-th file, name, documents, ids.

    A file appears under its name only when complete, so a repeated or
    speculative task leaves one good copy.
    """
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = min(PARTS, buckets(size, file_chars))
    rows = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, nth = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = width_of(own.vocabulary)
        files, root = _filesystem(folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def put() -> pa.RecordBatch:
            keys, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            name = f"ids-{part:06d}-{nth:06d}.fwb"
            files.create_dir(root, recursive=True)
            new = f"{root}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(new) as out:
                out.write(build_file(keys, sizes, ids, width))
            files.move(new, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "name": name, "docs": len(keys), "n_ids": len(ids)}])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, ids, sizes in own.runs(batch.column(1), end_id):
                held.append((keys[at : at + len(sizes)], sizes, ids.astype("<u2" if width <= 16 else "<u4")))
                if sum(len(x) for _, _, x in held) >= file_ids:
                    yield put()
                    nth += 1
        if held:
            yield put()

    return rows.mapInArrow(run, MANIFEST)


def ids_before(manifest: DataFrame) -> DataFrame:
    """(name, before): the ids of all files that come before each; sums by SUMMED tasks first."""
    from pyspark.sql import Window

    rows = manifest.withColumn("block", F.floor(F.col("part") / SUMMED))
    blocks = rows.groupBy("block").agg(F.sum("n_ids").alias("ids"))
    blocks = blocks.select("block", (F.sum("ids").over(Window.orderBy("block")) - F.col("ids")).alias("earlier"))
    within = F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "nth")) - F.col("n_ids")
    return rows.withColumn("within", within).join(blocks, "block").select("name", (F.col("earlier") + F.col("within")).alias("before"))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. manifest: a written table."""
    tasks = min(PARTS, max(1, manifest.count()))
    rows = ids_before(manifest).repartition(tasks, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for name, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                with files.open_input_stream(f"{root}/{name}") as source:
                    file = PackedFile(source.read())
                file.check()
                found = [(None if doc == NO_ID else doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in file.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bit_packed_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    folder = new_folder(docs.sparkSession, "ids")
    manifest = written(write_files(docs, folder, tokenizer_path, end_id), "ids-manifest")
    return read_files(manifest, folder)
