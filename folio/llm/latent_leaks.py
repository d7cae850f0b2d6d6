"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of two blocks of BLOCK words, so any
run of BLOCK words lies whole in one. A passage is a TF-IDF vector over 2^BITS
hashed words, with document frequencies from every document, and no weight is
zero however common a word is; its latent vector
is the projection on the leading right singular vectors, found by randomised
SVD: a random test matrix goes once through the passages of every document, each
task adding up its own part of A'(A R), and an orthonormal basis of the sum,
scaled by the inverse singular values, is the index. Every
passage of every document is projected and compared; benchmark passages are the
queries, in slabs of SLAB, so what is broadcast is bounded.

A passage and an item are candidates if the cosine is COSINE or more, or if a
run of RUN words of the item stands in the passage: a copy with a fifth of its
words replaced keeps such a run, so one made of words that weigh little beside
those around it is found too, and so is any verbatim copy. Pairs that can't be
leaks go before: some stretch of blocks about the passage, as long as any copy
that counts, must have as many words of the item's features as a leak needs,
which every leak has. All candidates are compared. A candidate is a
leak if the longest common subsequence of the item's words and the words around
the passage is at least SIMILARITY of the item's, and the item's last quarter,
its answer, is there by at least ANSWER. Counts of shared words, which no
common subsequence exceeds, go first.

Defined cases: words are runs of letters, digits and characters beyond ASCII,
A-Z lower-cased; a null or empty text has no passage and no leak; a text shorter
than a block is one passage; an empty benchmark, or one whose items have no
words, finds nothing; equal items are each reported; a null doc_id keeps its
rows in `leaks` (decontaminate() judges rows, not ids); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import LOWER_BYTES, hash_stretches, id_and_text
from folio.session import ship_package

BITS = 13
RANK = 192
BLOCK = 20
#: Words to a task of the fit, about: each sends one matrix.
FIT_WORDS = 10_000_000
#: Rows of one feature that the fit adds up at once.
STRIP = 16
#: Benchmark passages in one slab; a slab's latent vectors are what is broadcast.
SLAB = 2_000
#: Candidates by the latent vectors, and by words that stand next to each other.
COSINE, RUN = 0.2, 3
SIMILARITY = 0.8
ANSWER = 0.6
#: Bytes of texts that are handled together in the search, and in the fit.
RUN_BYTES, FIT_BYTES = 400_000, 1_200_000
SIZE = 1 << BITS
FOUND = "item_id long, cosine double, similarity double, first_word long, last_word long"

_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_BYTES)


def words_of(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def cleaned(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_WORD)


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of cleaned bytes starts, and its place among the features."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], codes != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    return starts, (hash_stretches(codes, starts, edges[1::2]) >> np.uint64(64 - BITS)).astype(np.int64)


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's place among the hashed features."""
    return hashed(b" ".join(words))[1]


class Run:
    """Some texts: each one's number of words, the features of all their words, and the words of a text asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        starts, self.flat = hashed(b" ".join(texts))
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.offsets = np.searchsorted(starts, begins)
        self.lengths = np.diff(self.offsets)

    def words(self, at: int) -> list[bytes]:
        return self.texts[at].split()


def runs(texts: list, most: int = RUN_BYTES) -> Iterator[tuple[int, Run]]:
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append(cleaned(text))
        size += len(held[-1])
        if size >= most:
            yield first, Run(held)
            first, held, size = at + 1, [], 0
    if held:
        yield first, Run(held)


def block_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of the joined texts begins, and the text it is of. Texts without words have none."""
    many = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(lengths) - lengths, many) + nth * BLOCK, text


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Of each feature, over every document, and how many documents and words those are; the sums are SIZE + 2 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(SIZE + 2, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            total[SIZE] += batch.num_rows
            for _, part in runs(batch.column(0).to_pylist()):
                total[SIZE + 1] += len(part.flat)
                places = np.arange(int(part.lengths.max()))
                for low, high in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
                    # A feature counts where its last place in the text is.
                    own, place = part.flat[low:high], places[: high - low]
                    mark[own] = place
                    total[own[mark[own] == place]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE + 2, np.int64)
    out[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out[:SIZE], int(out[SIZE]), int(out[SIZE + 1])


def idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Smoothed: a word of every document weighs log 2."""
    return np.log1p(documents / np.maximum(frequencies, 1)).astype(np.float32)


def blocks_of(part: Run, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the table's rows over each block's words, where the block starts among the run's words, its text, and its features.

    The table's rows are weighted already and its last row is zero: it stands
    for words without weight and for places beyond a text's end.
    """
    lengths, flat = part.lengths, part.flat
    starts, text = block_starts(lengths)
    if not len(starts):
        return np.empty((0, table.shape[1]), np.float32), starts, text, np.empty((0, BLOCK), np.int64)
    n = np.minimum(BLOCK, np.cumsum(lengths)[text] - starts)
    grid = np.full((len(starts), BLOCK), len(table) - 1)
    inside = np.arange(BLOCK) < n[:, None]
    grid[inside] = flat
    out = np.zeros((len(starts), table.shape[1]), np.float32)
    for at in range(0, len(starts), 256):
        own = out[at : at + 256]
        for column in grid[at : at + 256].T:
            own += table[column]
    return out, starts, text, grid


def weighted(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([table * weights[:, None], np.zeros((1, table.shape[1]))]).astype(np.float32)


def passages(blocks: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each block with the next one of its text; a last block of several is a passage of its own too."""
    out = blocks.copy()
    follows = np.append(text[1:] == text[:-1], False) if len(text) else np.empty(0, bool)
    at = np.flatnonzero(follows)
    out[at] += blocks[at + 1]
    return out


def random_matrix(weights: np.ndarray, rank: int) -> np.ndarray:
    return weighted(np.random.default_rng(7).standard_normal((SIZE, rank)), weights)


def add_image(total: np.ndarray, texts: list, test: np.ndarray) -> None:
    """Adds these texts' part of A'(A R), not yet weighted, to the total."""
    for _, part in runs(texts, FIT_BYTES):
        blocks, starts, text, _ = blocks_of(part, test)
        if not len(starts):
            continue
        sums = passages(blocks, text)
        # A block is in its own passage and in the one before it.
        back = sums.copy()
        same = np.flatnonzero(np.append(False, text[1:] == text[:-1]))
        back[same] += sums[same - 1]
        # Numbers of 16 bits are sorted by their digits.
        order = np.argsort(part.flat.astype(np.uint16), kind="stable")
        flat, rows = part.flat[order], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(part.flat))))[order]
        while True:
            heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            # Strips of a feature's rows give a sum each, and those sums are rows again, until each feature has one.
            strips = np.flatnonzero((np.arange(len(flat)) - np.repeat(heads, np.diff(np.append(heads, len(flat))))) % STRIP == 0)
            back = sums_of_strips(back, rows, strips)
            flat, rows = flat[strips], np.arange(len(strips))
            if len(strips) == len(heads):
                break
        total[flat] += back


def sums_of_strips(table: np.ndarray, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sums of the table's rows numbered from each head to the next one."""
    many = np.diff(np.append(heads, len(rows)))
    order = np.argsort(-many, kind="stable")
    out = np.empty((len(heads), table.shape[1]), table.dtype)
    for at in range(0, len(order), 256):
        strips = order[at : at + 256]
        first, n = heads[strips], many[strips]
        own = table[rows[first]]
        for k in range(1, int(n[0])):
            longer = int(np.searchsorted(-n, -k))
            own[:longer] += table[rows[first[:longer] + k]]
        out[strips] = own
    return out


def image_of(texts: list, weights: np.ndarray, rank: int) -> np.ndarray:
    """These texts' part of A'(A R)."""
    total = np.zeros((SIZE, rank))
    add_image(total, texts, random_matrix(weights, rank))
    return (total * weights[:, None]).astype(np.float32)


def basis_of(image: np.ndarray) -> np.ndarray:
    """image = A'A R: its QR spans the leading right singular space, and its singular values give the scale there."""
    if not image.any():
        return np.random.default_rng(7).standard_normal(image.shape).astype(np.float32)
    vectors, upper = np.linalg.qr(image.astype(float))
    left, values, _ = np.linalg.svd(upper)
    scale = np.sqrt(np.maximum(values, values.max() * 1e-6))
    return ((vectors @ left) / scale).astype(np.float32)


def basis(docs: DataFrame, weights: np.ndarray, words: int, rank: int = RANK) -> np.ndarray:
    """SIZE x rank: right singular vectors of all passages over their singular values."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, test = np.zeros((SIZE, rank)), random_matrix(sent.value, rank)
        for batch in batches:
            add_image(total, batch.column(0).to_pylist(), test)
        if total.any():
            at = np.arange(0, SIZE, 256)
            image = (total * sent.value[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([image[k : k + 256].tobytes() for k in at], pa.binary())], ["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0.0) + np.frombuffer(part, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["slice", "part"])

    # Every text is read; only the tasks are bounded, as each of them sends one matrix.
    tasks = max(2 * spark.sparkContext.defaultParallelism, words // FIT_WORDS)
    kinds = "slice long, part binary"
    parts = docs.select("text").coalesce(tasks).mapInArrow(run, kinds).repartition("slice").mapInArrow(add, kinds).toPandas()
    image = np.zeros((SIZE, rank), np.float32)
    for at, part in zip(parts["slice"], parts["part"], strict=True):
        image[at : at + 256] += np.frombuffer(part, np.float32).reshape(-1, rank)
    return basis_of(image)


def longest_common(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place of a match in b; bit-parallel over a."""
    places: dict[bytes, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    first = last = -1
    for k, x in enumerate(b):
        hit = places.get(x, 0)
        if hit:
            u = row & hit
            new = ((row + u) | (row - u)) & full
            if new != row:
                first = k if first < 0 else first
                last = k
            row = new
    return len(a) - row.bit_count(), first, last


class Items:
    """One slab of the benchmark, ready to be compared."""

    def __init__(self, rows: list[tuple[int, str]], index: np.ndarray):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.counts = [Counter(w) for w in self.words]
        self.distinct = [frozenset(w) for w in self.words]
        self.answers = [Counter(w[-max(1, len(w) // 4) :]) for w in self.words]
        table = np.stack([index[numbered(w)].sum(0) for w in self.words])
        # Features of each item; the blocks that a stretch searched by verify() can touch, and those that verify() looks beyond a passage.
        self.has = np.zeros((len(index), len(rows)), np.uint8)
        for at, w in enumerate(self.words):
            self.has[numbered(w), at] = 1
        n = np.array([len(w) for w in self.words])
        self.need = np.ceil(np.maximum(SIMILARITY * n - 1e-9, 0.5)).astype(np.int32)
        self.span = (n + np.maximum(4, n // 3) + BLOCK - 2) // BLOCK + 1
        self.reach = -(-n // BLOCK)
        # An item longer than a passage is compared by its pieces of that length too.
        pieces, owner = [], []
        for at, w in enumerate(self.words):
            for start in range(0, len(w), BLOCK):
                if len(w) > 2 * BLOCK and len(piece := w[start : start + 2 * BLOCK]) > BLOCK:
                    pieces.append(index[numbered(piece)].sum(0))
                    owner.append(at)
        self.owner = np.array([*range(len(rows)), *owner])
        self.latent = unit(np.concatenate([table, np.stack(pieces)]) if pieces else table)
        # Vectors of each item, one item's after the other's; and by length the keys of its runs of words with the items that hold them.
        self.order = np.argsort(self.owner, kind="stable")
        self.vectors = np.bincount(self.owner, minlength=len(rows))
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, RUN + 1):
            own = [(k, run_keys(numbered(w), size)) for k, w in enumerate(self.words) if min(len(w), RUN) == size]
            if own:
                keys, held = np.concatenate([x for _, x in own]), np.concatenate([np.full(len(x), k) for k, x in own])
                pairs = np.unique(np.stack([keys, held], axis=1), axis=0)
                self.runs[size] = pairs[:, 0], pairs[:, 1]

    def cosines(self, latent: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The cosine of each pair of a latent row and an item: of its closest piece."""
        out = np.empty(len(row))
        first = np.cumsum(self.vectors) - self.vectors
        for at in range(0, len(row), 4096):
            a, b = row[at : at + 4096], item[at : at + 4096]
            n = self.vectors[b]
            ends = np.cumsum(n)
            own = self.order[np.arange(int(ends[-1])) + np.repeat(first[b] - ends + n, n)]
            out[at : at + 4096] = np.maximum.reduceat(np.einsum("ij,ij->i", latent[np.repeat(a, n)], self.latent[own]), ends - n)
        return out

    def shared_runs(self, part: Run, starts: np.ndarray) -> np.ndarray:
        """Pairs (block, item), as block * items + item, such that a run of the item's words begins in the block."""
        out = [np.empty(0, np.int64)]
        for size, (keys, held) in self.runs.items():
            if len(part.flat) < size:
                continue
            found = run_keys(part.flat, size)
            seen = np.zeros(1 << 20, bool)
            seen[keys * 0x9E3779B1 >> 7 & 0xFFFFF] = True
            place = np.flatnonzero(seen[found * 0x9E3779B1 >> 7 & 0xFFFFF])
            low, high = np.searchsorted(keys, found[place]), np.searchsorted(keys, found[place], side="right")
            n = high - low
            # A run that goes on in the next text is none.
            ends = part.offsets[np.searchsorted(part.offsets, place, side="right")]
            n[place + size > ends] = 0
            sums = np.cumsum(n)
            item = held[np.arange(int(sums[-1]) if len(sums) else 0) + np.repeat(low - sums + n, n)]
            block = np.searchsorted(starts, np.repeat(place, n), side="right") - 1
            out.append(block * len(self.ids) + item)
        return np.unique(np.concatenate(out))

    def possible(self, grid: np.ndarray, low: int, high: int) -> np.ndarray:
        """Of blocks low to high and all items: whether a stretch that verify() would search there has enough of the item's words; never drops a leak."""
        margin = int((self.reach + self.span).max()) + 2
        first, end = max(0, low - margin), min(len(grid), high + margin)
        hits = np.zeros((end - first, len(self.ids)), np.uint8)
        for column in grid[first:end].T:
            hits += self.has[column]
        # Only differences over a few blocks count, if an item isn't long: sums may then wrap.
        kind = np.uint16 if BLOCK * (2 * margin + 1) < 1 << 16 else np.int32
        sums = np.zeros((end - first + 1, len(self.ids)), kind)
        np.cumsum(hits, axis=0, out=sums[1:])
        out = np.zeros((high - low, len(self.ids)), bool)
        here = np.arange(low, high) - first
        for span, reach in set(zip(self.span.tolist(), self.reach.tolist(), strict=True)):
            own = np.flatnonzero((self.span == span) & (self.reach == reach))
            part = sums[:, own]
            ends = np.minimum(np.arange(end - first) + span, end - first)
            full = np.zeros(part.shape, kind)
            np.cumsum(part[ends] - part[:-1] >= self.need[own].astype(kind), axis=0, out=full[1:])
            out[:, own] = full[np.minimum(here + 2 + reach, end - first)] != full[np.maximum(here - reach, 0)]
        return out

    def verify(self, at: int, words: list[bytes], low: int, high: int) -> tuple[float, int, int] | None:
        """(similarity, first word, last word) in the text, if the item is between the two places, give or take its length."""
        item = self.words[at]
        if not item:
            return None
        low, high = max(0, low - len(item)), min(len(words), high + len(item))
        near = words[low:high]
        need = SIMILARITY * len(item)
        # Each word that isn't there at all costs one match or more.
        distinct = self.distinct[at]
        if len(item) - len(distinct) + len(distinct.intersection(near)) < need:
            return None
        there = Counter(near)
        if sum(min(n, there[w]) for w, n in self.counts[at].items()) < need:
            return None
        answer = self.answers[at]
        if sum(min(n, there[w]) for w, n in answer.items()) < ANSWER * answer.total():
            return None
        # The closest copy: the subsequence must lie within a stretch little longer than the item.
        best = (0, -1, -1)
        reach = len(item) + max(4, len(item) // 3)
        # No subsequence is longer than the number of the item's words there.
        sums = [0, *accumulate(w in distinct for w in near)]
        for start in range(0, max(1, len(near) - len(item) + 1), max(1, len(item) // 8)):
            there_now = sums[min(start + reach, len(near))] - sums[start]
            if there_now < need or there_now <= best[0] or best[0] == len(item):
                continue
            n, first, last = longest_common(item, near[start : start + reach])
            if n > best[0]:
                best = (n, start + first, start + last)
        if best[0] < need:
            return None
        return best[0] / len(item), low + best[1], low + best[2]


def run_keys(flat: np.ndarray, size: int) -> np.ndarray:
    """The features of each `size` words that stand next to each other, as one number."""
    out = np.zeros(max(0, len(flat) - size + 1), np.int64)
    for k in range(size):
        out = out << BITS | flat[k : len(flat) - size + 1 + k]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def search(texts: list, items: Items, table: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(text's place, (item_id, cosine, similarity, first word, last word)) of every leak, the best place of each item."""
    for first, part in runs(texts):
        blocks, starts, text, grid = blocks_of(part, table)
        if not len(starts):
            continue
        latent = unit(passages(blocks, text))
        found: dict[tuple[int, int], tuple] = {}
        held: dict[int, list[bytes]] = {}
        runs_at = items.shared_runs(part, starts)
        step = max(256, 1_000_000 // len(items.ids))
        for at in range(0, len(latent), step):
            row, item_of = np.nonzero(items.possible(grid, at, min(at + step, len(latent))))
            row = row + at
            cosine = items.cosines(latent, row, item_of)
            candidate = (cosine >= COSINE) | np.isin(row * len(items.ids) + item_of, runs_at)
            for block, item, near in zip(row[candidate].tolist(), item_of[candidate].tolist(), cosine[candidate].tolist(), strict=True):
                whole = int(text[block])
                low = int(starts[block] - part.offsets[whole])
                if whole not in held:
                    held = {whole: part.words(whole)}
                got = items.verify(item, held[whole], low, low + 2 * BLOCK)
                if got and (got[0], near) > found.get((whole, item), (0, 0))[1::-1]:
                    found[whole, item] = (near, *got)
        for (own, item), got in sorted(found.items()):
            yield first + own, (items.ids[item], *got)


def _prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple]:
    """The broadcast index, with each slab of items."""
    spark = docs.sparkSession
    ship_package(spark)
    frequencies, documents, words = document_frequencies(docs)
    weights = idf(frequencies, documents)
    index = basis(docs, weights, words)
    table = weighted(index, weights)
    sent = spark.sparkContext.broadcast(table)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text")
    slab: list = []
    for row in items.toLocalIterator():
        slab.append((row["item_id"], row["text"]))
        if len(slab) == SLAB:
            yield sent, spark.sparkContext.broadcast(Items(slab, table))
            slab = []
    if slab:
        yield sent, spark.sparkContext.broadcast(Items(slab, table))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, similarity, first_word, last_word."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, " + FOUND)
    rows = id_and_text(docs)
    for sent, slab in _prepared(rows, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, slab=slab) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [(ids[at], *x) for at, x in search(batch.column(1).to_pylist(), slab.value, sent.value)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "cosine", "similarity", "first_word", "last_word"])

        out = out.unionByName(rows.mapInArrow(run, "doc_id long, " + FOUND))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; the columns stay, and only texts go to Python."""

    def without(sent, slab):
        def clean(text: pa.Array) -> pa.Array:
            found = np.ones(len(text), bool)
            found[[at for at, _ in search(text.to_pylist(), slab.value, sent.value)]] = False
            return pa.array(found)

        return F.arrow_udf(clean, "boolean")

    out = docs
    for sent, slab in _prepared(id_and_text(docs), benchmark):
        out = out.where(without(sent, slab)(F.col("text")))
    return out


def op9_latent_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
