"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit where more than half of its shingles' hashes have
it. Distinct fingerprints get a table of Hamming distances to PIVOTS reference
fingerprints, once. By the triangle inequality two fingerprints within `radius`
bits differ by at most `radius` in every coordinate, so a pair is discarded when
its greatest coordinate difference is larger, and only survivors are compared
bit by bit.

Pairs come from block keys: the 64 bits fall into b blocks and a key is a choice
of b - radius of them; at most `radius` blocks hold a difference, so two
fingerprints within the radius share a key. b rises with the number of distinct
fingerprints so that a key holds a bounded number of unrelated ones. Within a
key, members that were reached leave the set still to be compared, so near
copies cost their number, and only links that span are emitted. A key of more
than HOT members is dealt out as pairs of chunks.

Links join distinct fingerprints; equal ones are one node from the start, so
copies are never expanded.

near_copies() is for a similarity of shingle sets of 0.8 or more rather than a
radius of bits: fingerprints lie some 5 to 17 bits apart there, too far for block
keys. A node is a distinct shingle set. A key is a run of ROWS places of a sketch
(the least shingle hash in each of BINS ranges), and the pivot tables, the bits
(radius WIDE) and LOOSE of the places' agreement only screen: what they join are
groups of candidates. Within a group the sets themselves, read from the written
table, decide each link by their exact similarity. A pair is missed only if it
shares no key or the screens drop it, which at 0.8 is rare even for short texts.

Defined cases: a null or empty text, or one of white space alone, has
fingerprint zero and links like any other; a text of fewer words than a shingle
is one shingle; a null doc_id keeps its row, and is the smallest of its
component only if all are null; an empty table gives no rows; rows that share
a doc_id each get their own fingerprint; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.rows import LOWER_BYTES, id_and_text
from folio.session import discard, ship_package, written

SEED = 42
PIVOTS = 24
#: Members of a key beyond which it is dealt out in chunks.
HOT = 2048
#: Sketch places, those in a key, the number of keys, and the radius and the agreement that screen candidates of near_copies().
BINS, ROWS, KEYS, WIDE, LOOSE = 128, 5, 26, 28, 0.25
#: Bytes of shingle sets beyond which a group of candidates is dealt out in chunks.
HOT_BYTES = 32 << 20
#: Unrelated fingerprints that a key may hold, about.
STRANGERS = 8


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[: len(words) - shingle] + 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        totals += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(totals * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS equal ranges, 16 bits of it; an empty range takes the next one's, turned by the distance."""
    if not len(hashes):
        return np.zeros(BINS, "<u2")
    found = np.sort(hashes)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (found >> shift).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    at = np.searchsorted(bins[first], np.arange(BINS))
    away = np.where(at < len(first), bins[first][at % len(first)], bins[first][0] + BINS) - np.arange(BINS)
    low = (found[first][at % len(first)] >> np.uint64(20)).astype(np.int64)
    return ((low + away * 40503) & 0xFFFF).astype("<u2")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def block_count(distinct: int, radius: int) -> int:
    """The fewest blocks whose keys hold about STRANGERS unrelated fingerprints or fewer."""
    for blocks in range(radius + 1, radius + 5):
        if distinct / 2 ** (64 * (blocks - radius) // blocks) <= STRANGERS:
            return blocks
    return radius + 4


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(masks, blocks - radius)]


def references(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed hashes, so every run measures against the same."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(count)], np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have a Jaccard similarity of 0.8 or more."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a) or 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


class Members:
    """Rows of one run: what the tests need, and the id that links carry."""

    def __init__(self, ids: np.ndarray, fps: np.ndarray, tables: np.ndarray, sketches: np.ndarray | None, sets: np.ndarray | None = None):
        self.ids, self.fps, self.tables, self.sketches, self.sets = ids, fps, tables, sketches, sets

    def take(self, at) -> Members:
        return Members(self.ids[at], self.fps[at], self.tables[at], None if self.sketches is None else self.sketches[at], None if self.sets is None else self.sets[at])

    def join(self, other: Members) -> Members:
        both = lambda a, b: None if a is None else np.concatenate([a, b])
        return Members(both(self.ids, other.ids), both(self.fps, other.fps), both(self.tables, other.tables), both(self.sketches, other.sketches), both(self.sets, other.sets))

    def near(self, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        """Which of the pairs a[k], b[k] are links: the tables discard, the bits decide, or where there are sets the sets."""
        keep = np.flatnonzero(np.abs(self.tables[a] - self.tables[b]).max(axis=1) <= radius)
        keep = keep[np.bitwise_count(self.fps[a[keep]] ^ self.fps[b[keep]]) <= radius]
        if self.sketches is not None:
            keep = keep[(self.sketches[a[keep]] == self.sketches[b[keep]]).mean(axis=1) >= LOOSE]
        if self.sets is not None:
            keep = keep[np.array([alike(self.sets[x], self.sets[y]) for x, y in zip(a[keep], b[keep], strict=True)], bool)]
        return keep


def span(rows: Members, radius: int) -> list[tuple[int, int]]:
    """Links that join every component of one key's members; those reached are compared no more among themselves."""
    left, out = np.arange(len(rows.ids)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            own = todo.pop()
            hit = rows.near(np.full(len(left), own), left, radius)
            if len(hit):
                reached = left[hit]
                out += [(int(own), int(x)) for x in reached]
                todo += list(reached)
                left = np.delete(left, hit)
    return out


def _links_of(keys: np.ndarray, rows: Members, radius: int) -> pa.RecordBatch:
    """Links within runs of equal keys. Short runs are compared offset by offset, all runs at once."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    pairs = [np.empty((0, 2), np.int64)]
    size = np.repeat(sizes, sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    for step in range(1, 32):
        a = np.flatnonzero((size <= 32) & (place + step < size))
        if not len(a):
            break
        a = a[rows.near(a, a + step, radius)]
        pairs.append(np.stack([a, a + step], axis=1))
    for start, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        own = span(rows.take(slice(start, start + n)), radius)
        pairs.append(np.array(own, np.int64).reshape(-1, 2) + start)
    found = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(rows.ids[found[:, 0]]), pa.array(rows.ids[found[:, 1]])], ["a", "b"])


def _links(keyed: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Links of rows that are sorted by `columns` within their partitions. keyed: columns, node, fp, pivots and perhaps sketch, and perhaps shingles."""
    width, more = len(columns), [x for x in ("sketch", "shingles") if x in keyed.columns]
    matrix = lambda column, kind, n: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, n)

    def arrays(column) -> np.ndarray:
        out = np.empty(len(column), object)
        out[:] = [np.frombuffer(x, "<u8") for x in column.to_pylist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(width)], axis=1)
            rows = Members(batch.column(width).to_numpy(), batch.column(width + 1).to_numpy().view(np.uint64), matrix(batch.column(width + 2), np.int8, PIVOTS), matrix(batch.column(width + 3), "<u2", BINS) if more else None, arrays(batch.column(width + 4)) if len(more) == 2 else None)
            if held:
                keys, rows = np.concatenate([held[0], keys]), held[1].join(rows)
            # The last run may go on in the next batch.
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = keys[cut:], rows.take(slice(cut, None))
            if cut:
                yield _links_of(keys[:cut], rows.take(slice(0, cut)), radius)
        if held:
            yield _links_of(*held, radius)

    return keyed.select(*columns, "node", "fp", "pivots", *more).mapInArrow(run, "a long, b long")


def pivot_rows(fps: np.ndarray) -> pa.Array:
    table = pivot_table(fps.view(np.uint64)).tobytes()
    return pa.array([table[k : k + PIVOTS] for k in range(0, len(table), PIVOTS)], pa.binary())


def with_pivots(rows: DataFrame) -> DataFrame:
    """rows, whose first column is fp, with their pivot tables."""
    names = [*rows.columns, "pivots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pivot_rows(batch.column(0).to_numpy())], names)

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("binary").alias("pivots")).schema)


def links_within(keyed: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """(a, b): links among rows of one (choice, key), enough to join its components. A key of more than `hot` rows, or HOT_BYTES of sets, is dealt out as pairs of chunks."""
    parts = F.ceil(F.count(F.lit(1)) / hot)
    if "shingles" in keyed.columns:
        parts = F.greatest(parts, F.ceil(F.sum(F.length("shingles")) / HOT_BYTES))
    many = written(keyed.groupBy("choice", "key").agg(parts.cast("long").alias("parts")).where("parts > 1"), "hot-keys")
    cold = keyed
    found = None
    if not many.isEmpty():
        cold = keyed.join(many.select("choice", "key"), ["choice", "key"], "left_anti")
        chunks = F.col("parts")
        dealt = keyed.join(many, ["choice", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("own", "other", "parts")
        cell = ["choice", "key", "x", "y"]
        found = _links(dealt.repartition(*cell).sortWithinPartitions(*cell), cell, radius)
    links = _links(cold.repartition("choice", "key").sortWithinPartitions("choice", "key"), ["choice", "key"], radius)
    return links if found is None else links.union(found)


def near_links(distinct: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """(a, b) of distinct fingerprints within the radius: enough of them to join every component, and no other."""
    masks = block_masks(block_count(distinct.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(at).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for at, m in enumerate(signed)])
    keyed = with_pivots(distinct.select("fp")).select(F.col("fp").alias("node"), "fp", "pivots", F.explode(keys).alias("k")).select("k.choice", "k.key", "node", "fp", "pivots")
    return links_within(written(keyed, "keyed"), radius, hot)


def near_components(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes, radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def op5_pivot_simhash(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    return near_components(docs, shingle, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, fp, sketch); node is the hash of the set of shingle hashes, ascending, from which the others follow too."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few rows at a time: sets are larger than texts.
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            found = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
            fps = np.array([majority(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(x) for x in found], pa.int64()), pa.array(fps), pa.array([sketch(x).tobytes() for x in found], pa.binary())], ["doc_id", "node", "fp", "sketch"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, node long, fp long, sketch binary")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle)).astype("<u8")


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(choice, key, node, fp, pivots, sketch, shingles) of rows (key, node, fp, sketch, text), but for those whose text isn't the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            found = [shingle_set(x, shingle) for x in batch.column(4).to_pylist()]
            own = np.flatnonzero(np.array([node_of(x) for x in found], np.int64) == batch.column(1).to_numpy())
            kept = batch.take(pa.array(own))
            pivots = pivot_rows(kept.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), kept.column(0), kept.column(1), kept.column(2), pivots, kept.column(3), pa.array([found[k].tobytes() for k in own], pa.binary())], ["choice", "key", "node", "fp", "pivots", "sketch", "shingles"])

    return rows.select("key", "node", "fp", "sketch", "text").mapInArrow(run, "choice long, key long, node long, fp long, pivots binary, sketch binary, shingles binary")


def near_copies(docs: DataFrame, shingle: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id and component_id by links of a shingle similarity of 0.8 or more; see the module's text."""
    prints = written(sketched(docs, shingle), "sketches")
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")), "nodes")
    # A key is a hash of the places' bytes, two a place, and of which run it is; the last run goes on at the first place.
    places = F.concat("sketch", F.substring("sketch", 1, 2 * ROWS))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring(places, 2 * ROWS * k + 1, 2 * ROWS)) for k in range(KEYS)])
    narrow = nodes.select("node", F.explode(keys).alias("key"))
    # Only keys that two nodes share can link: the others go while rows are two numbers, before sketches are beside them.
    shared = written(narrow.join(narrow.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"), "shared-keys")
    keyed = shared.join(with_pivots(nodes.select("fp", "node", "sketch")), "node").select(F.lit(0).cast("long").alias("choice"), "key", "node", "fp", "pivots", "sketch")
    keyed = written(keyed, "keyed")
    discard(shared)
    groups = components(links_within(keyed, WIDE, hot))
    # components() has a row for each node but the roots. Then the sets decide within each group; only members of groups are hashed again.
    groups = written(groups.union(groups.select(F.col("root").alias("node"), "root").distinct()).distinct(), "groups")
    discard(keyed)
    wanted = groups.withColumnRenamed("root", "key").join(nodes, "node").withColumn("least", F.coalesce("least", F.lit(NO_ID)))
    texts = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("least"), "text")
    sets = written(shingle_sets(texts.join(wanted, "least"), shingle).dropDuplicates(["node"]), "sets")
    roots = components(links_within(sets, WIDE, hot))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(prints.select("doc_id", "node").join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), "near-copies")
    for table in (prints, nodes, groups, sets, roots):
        discard(table)
    return found


#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies, the one of the smallest doc_id; the columns stay.

    Of rows that share the doc_id that stays, one stays. A null doc_id counts as smaller than any.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = near_copies(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), shingle)
    staying = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = rows.join(staying, "id", "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id"])
    return kept.select("row.*")
