"""Packing into windows of near-equal fill by multiway differencing.

A document of n ids fills n // capacity windows alone; the rest, cut into
pieces of at most PIECE ids, is shared out by the Karmarkar-Karp method: each
piece starts as a partial partition with one window filled, and the two
partial partitions of largest spread are merged, the fullest windows of one
with the emptiest of the other, until one partition is left. If a window of
it is over capacity the number of windows rises and the group starts again.

Pieces are grouped by a hash of document and place: a group is GROUP_WINDOWS
windows' worth of text on average, so its last window is a small part of it
however short the documents are, but at most GROUP_DOCS documents; its work
doesn't grow with the input, and a row
repeated any number of times is dealt out by its place in the scan.

Defined cases: a null or empty text is a document of its end id alone; an empty
table gives no rows; rows that share a doc_id are packed each on its own; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import buckets, id_and_text
from folio.llm.tokens import encoder
from folio.session import ship_package

CAPACITY = 1024
#: Ids in a piece of a document's rest, at most.
PIECE = 256
#: Windows' worth of ids in a group, about, at some CHARS a token; and its documents at most, about.
GROUP_WINDOWS, CHARS, GROUP_DOCS = 160, 4, 20_000

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "full"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, full boolean"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Members of each window, as near to equal sums as differencing gets."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # A partial partition: sums ascending, and beside each the node that holds its members.
    heap, nodes = [], []
    empty = np.full(windows, -1, np.int64)
    for at, size in enumerate(sizes):
        sums, held = np.zeros(windows, np.int64), empty.copy()
        sums[-1], held[-1] = size, at
        nodes.append((at,))
        heap.append((-int(size), at, sums, held))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums, left, right = a + b[::-1], in_a, in_b[::-1]
        held = np.where(left < 0, right, left)
        for k in np.flatnonzero((left >= 0) & (right >= 0)):
            held[k] = len(nodes)
            nodes.append((int(left[k]), int(right[k])))
        order = np.argsort(sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), made, sums, held))
        made += 1
    out = []
    for top in heap[0][3]:
        members, todo = [], [int(top)] if top >= 0 else []
        while todo:
            node = nodes[todo.pop()]
            if len(node) == 1:
                members.append(node[0])
            else:
                todo += node
        out.append(sorted(members))
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their number rises until all fit."""
    if not len(sizes):
        return []
    if int(sizes.max()) > capacity:
        raise ValueError("a piece is larger than a window")
    windows = -(-int(sizes.sum()) // capacity)
    while True:
        found = differencing(sizes, windows)
        if max(int(sizes[x].sum()) for x in found) <= capacity:
            return [x for x in found if x]
        windows += max(1, windows // 256)


def cuts(sizes: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these sizes, each piece's document, start and length: whole windows, then pieces of the rest."""
    whole = sizes // capacity
    many = whole + -(-(sizes % capacity) // piece)
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    full = nth < whole[doc]
    start = np.where(full, nth * capacity, whole[doc] * capacity + (nth - whole[doc]) * piece)
    return doc, start, np.where(full, capacity, np.minimum(piece, sizes[doc] - start))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """Every document cut: whole windows, then its rest. Ids are encoded where the text is read and go no further."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            keys, places = batch.column(0), batch.column(2).to_numpy()
            for at, ids, sizes in own.runs(batch.column(1), end_id):
                doc, start, length = cuts(sizes, capacity, piece)
                raw = memoryview(ids.astype("<u4").tobytes())
                low = 4 * ((np.cumsum(sizes) - sizes)[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                columns = [keys.take(pa.array(at + doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(places[at + doc]), pa.array(length == capacity)]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return id_and_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


def pack_pieces(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        length = table["length"].to_numpy()
        full = table["full"].to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        alone, rest = np.flatnonzero(full), np.flatnonzero(~full)
        sequence[alone] = np.arange(len(alone))
        for at, members in enumerate(pack_group(length[rest], capacity)):
            own = rest[members]
            sequence[own] = len(alone) + at
            offset[own] = np.cumsum(length[own]) - length[own]
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence)).append_column("offset", pa.array(offset))

    return cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).groupBy("bucket").applyInArrow(run, PACKED)


def op8_differencing_windows(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    rows, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
    # Each document has its end id beside its text's.
    groups = max(buckets((chars or 0) // CHARS + rows, GROUP_WINDOWS * capacity), buckets(rows, GROUP_DOCS))
    return pack_pieces(pieces(docs, tokenizer_path, end_id, capacity), groups, capacity)
