"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, and each decision (the byte's bits so far) has
a context tree of its own over the DEPTH bytes before it, the nearest first.
Every tree node holds a Krichevsky-Trofimov estimate of its counts, and its
weighted probability is half that estimate and half the product of its
children's; the code length of a text is what the weighted mixture over all
depths gives, in bits a byte. A text begins in a context of END bytes and ends
with one (0xFF, which UTF-8 never has), so scores are of whole texts.

The counts of DEPTH+1 bytes in a row are all that the trees need. They are
counted where the text is read, a run of documents at a time, and travel as
sorted arrays of distinct grams in shards, by the last two bytes of context:
what lies below one such context is in one shard, and a shard's nodes are runs
of its sorted grams. Only the nodes above (no context, or one byte) span shards:
at most 256 * 255 + 255 of them, the one table that is broadcast. The model's
other parts grow with the corpus and stay in shards, in a written table.

Scoring asks for what it needs: documents are dealt to chunks, a chunk's
distinct grams go to their shards, come back with a code length each, and the
chunk's documents are summed up from them. No task holds more than a chunk and
a shard. The base, a smoothed unigram over words, is looked up the same way.

Defined cases: a null or empty text is its end alone, scored as such; a corpus
without training documents gives every node probability one half, N = 0 and a
base of 0 for known and unknown words alike where it is undefined (V = N = 0:
log10(0.1 / 0.1) = 0); a null doc_id counts as the text "" for crc32, so it is
held out; rows that share a doc_id are each counted and scored; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import LOWER_BYTES, buckets, id_and_text
from folio.session import ship_package, written

DEPTH = 5
END = 0xFF
#: Bytes of text that are counted or scored in one go, and those in a chunk and behind a shard.
RUN_BYTES = 4_000_000
CHUNK_BYTES = 16_000_000
GRAMS, WORDS = 0, 1
SEED = 42
ALPHA = 0.1
LN2, LN10 = math.log(2), math.log(10)
U8 = np.uint64(8)


# ---- estimates ----


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive arrays: Stirling's series beyond a shift by eight."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(y), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    a, b = zeros.astype(float), ones.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys ascending, and the sum of each value over equal ones."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[starts], *(np.add.reduceat(v[order], starts) for v in values))


# ---- trees ----
# A gram is a long: context bytes, nearest first, then the byte itself in the
# lowest eight bits. A node's key is its context (as many bytes as its depth)
# and then the decision, 1..255: the byte's bits so far behind a leading 1.


def decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of one depth from distinct (context, byte) keys of that depth."""
    context, byte = keys >> U8, keys & np.uint64(255)
    nodes, zeros, ones = [], [], []
    for bit in range(8):
        before = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        next_bit = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        found = sums((context << U8) | before, np.where(next_bit, 0, counts), np.where(next_bit, counts, 0))
        for out, x in zip((nodes, zeros, ones), found, strict=True):
            out.append(x)
    node, zero, one = map(np.concatenate, (nodes, zeros, ones))
    order = np.argsort(node)
    return node[order], zero[order], one[order]


def shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys (context, byte) or nodes (context, decision) of a depth as those one byte shorter: the farthest byte goes."""
    return ((keys >> np.uint64(16)) << U8) | (keys & np.uint64(255)) if depth else keys


class Level:
    """The nodes of one depth: ln of the KT and the weighted probability, and the next zero's probability."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones = node, zeros, ones
        own = kt_log(zeros, ones)
        if below is None:
            self.weighted, share = own, np.ones(len(node))
        else:
            self.weighted = np.logaddexp(own, below) - LN2
            share = np.exp(own - LN2 - self.weighted)
        self.share, self.zero = share, (zeros + 0.5) / (zeros + ones + 1)

    def mix(self, asked: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of a zero at each asked node, given that of the deeper context."""
        if not len(self.node):
            return deeper / 2 + 0.25
        at = np.minimum(np.searchsorted(self.node, asked), len(self.node) - 1)
        seen = self.node[at] == asked
        share = np.where(seen, self.share[at], 0.5)
        return share * np.where(seen, self.zero[at], 0.5) + (1 - share) * deeper


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels from `depth` up to `least`, and the (context, byte) keys and counts at `least`."""
    out, below = [], None
    keys, held = grams, counts
    for at in range(depth, least - 1, -1):
        node, zeros, ones = decisions(keys, held)
        if below is not None:
            known, total = sums(shorter(below.node, at + 1), below.weighted)
            product = np.zeros(len(node))
            product[np.searchsorted(node, known)] = total
            out.append(Level(node, zeros, ones, product))
        else:
            out.append(Level(node, zeros, ones, None))
        below = out[-1]
        if at > least:
            keys, held = sums(shorter(keys, at), held)
    return out, keys, held


def code_lengths(asked: np.ndarray, depth: int, trees: list[Level]) -> np.ndarray:
    """ln of the byte's probability in its context, for each asked gram. trees: deepest first, the last of depth 0."""
    out = np.zeros(len(asked))
    byte = asked & np.uint64(255)
    for bit in range(8):
        before = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        context = asked >> U8
        zero = np.full(len(asked), 0.5)
        for at, level in zip(range(depth, -1, -1), trees, strict=True):
            zero = level.mix((context << U8) | before, zero) if at < depth else _leaf(level, (context << U8) | before)
            context = context >> U8
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        out += np.log(np.where(one, 1 - zero, zero))
    return out


def _leaf(level: Level, asked: np.ndarray) -> np.ndarray:
    if not len(level.node):
        return np.full(len(asked), 0.5)
    at = np.minimum(np.searchsorted(level.node, asked), len(level.node) - 1)
    return np.where(level.node[at] == asked, level.zero[at], 0.5)


# ---- counting ----


def runs_of(texts: list, fold: bool = False, most: int = RUN_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first place, UTF-8 texts) of about so many bytes; with `fold`, A-Z lower-cased."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        own = (text or "").encode("utf-8", "replace")
        held.append(own.translate(LOWER_BYTES) if fold else own)
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = at + 1, [], 0
    if held:
        yield first, held


def gram_array(texts: list[bytes], depth: int) -> np.ndarray:
    """The gram at each byte and end of the texts, one after the other."""
    pad = bytes([END]) * depth
    end = bytes([END])
    flat = np.frombuffer(pad + b"".join(x + end + pad for x in texts), np.uint8)
    n = len(flat) - depth
    out = np.zeros(n, np.uint64)
    for back in range(1, depth + 1):
        out = (out << U8) | flat[depth - back : depth - back + n]
    out = (out << U8) | flat[depth : depth + n]
    # The pad behind each text is context only.
    keep = np.ones(n, bool)
    at = np.cumsum([len(x) + 1 + depth for x in texts]) - depth
    for k in range(depth):
        keep[at + k] = False
    return out[keep]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    if not len(values):
        return values, np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.diff(np.append(starts, len(values)))


def word_keys(counted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counted), np.uint64, len(counted))
    counts = np.fromiter(counted.values(), np.int64, len(counted))
    return sums(keys, counts)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_BYTES).split()


def gram_shard(grams: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """Shard by the two nearest context bytes."""
    near = (grams >> np.uint64(8 * (depth + 1 - 2))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def squeeze(values: np.ndarray) -> bytes:
    """Ascending longs as their steps, bytes of equal weight together: what a shuffle's compression packs well."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").reshape(-1), dtype=np.uint64)


def squeeze_counts(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


class Tally:
    """Distinct grams and words of what it has seen, with counts; merged as it grows."""

    def __init__(self, depth: int):
        self.depth, self.grams, self.words, self.loose = depth, [], Counter(), 0

    def add(self, texts: list[bytes]) -> None:
        own = distinct(gram_array(texts, self.depth))
        self.grams.append(own)
        self.loose += len(own[0])
        if self.loose > 8_000_000:
            self.merge()
        for text in texts:
            self.words.update(words_of(text))

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.grams:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        merged = self.grams[0] if len(self.grams) == 1 else sums(np.concatenate([g for g, _ in self.grams]), np.concatenate([c for _, c in self.grams]))
        self.grams, self.loose = [merged], 0
        return merged

    def rows(self, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, shard, keys, counts), each shard's keys ascending."""
        grams, counts = self.merge()
        words, n = word_keys(self.words)
        for kind, keys, values, shard in ((GRAMS, grams, counts, gram_shard(grams, self.depth, shards)), (WORDS, words, n, words % np.uint64(shards))):
            if not len(keys):
                continue
            order = np.argsort(shard, kind="stable")
            keys, values, shard = keys[order], values[order], shard[order]
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
                yield kind, int(shard[a]), squeeze(keys[a:b]), squeeze_counts(values[a:b])


# ---- Spark ----

PART = "kind int, shard long, keys binary, counts binary"


def tallies(docs: DataFrame, depth: int, shards: int, fold: bool = False) -> DataFrame:
    """What each scan task counts, sharded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(depth)
        for batch in batches:
            for _, texts in runs_of(batch.column(0).to_pylist(), fold):
                tally.add(texts)
        for kind, shard, keys, counts in tally.rows(shards):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard]), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], ["kind", "shard", "keys", "counts"])

    return docs.select("text").mapInArrow(run, PART)


def merged(parts: DataFrame, depth: int) -> DataFrame:
    """One row a shard: keys and counts; and for grams what its nodes of depth two add to those of depth one, as (byte or node, value) pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = sums(np.concatenate([unsqueeze(x.as_py()) for x in table["keys"]]), np.concatenate([unsqueeze_counts(x.as_py()) for x in table["counts"]]))
        top_keys, top_counts, top_nodes, top_logs = [], [], [], []
        if key[0].as_py() == GRAMS and len(keys):
            trees, near, held = levels(keys, counts, depth, 2)
            top_keys, top_counts = sums(shorter(near, 2), held)
            top_nodes, top_logs = sums(shorter(trees[-1].node, 2), trees[-1].weighted)
        as_long = lambda x: pa.array([np.asarray(x, np.int64)], pa.list_(pa.int64()))
        return pa.table({
            "kind": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([squeeze(keys)], pa.binary()), "counts": pa.array([squeeze_counts(counts)], pa.binary()),
            "n_keys": pa.array([len(keys)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()),
            "top_keys": as_long(top_keys), "top_counts": as_long(top_counts), "top_nodes": as_long(top_nodes), "top_logs": pa.array([np.asarray(top_logs, float)], pa.list_(pa.float64())),
        })

    return parts.groupBy("kind", "shard").applyInArrow(run, PART + ", n_keys long, n long, top_keys array<long>, top_counts array<long>, top_nodes array<long>, top_logs array<double>")


class Model:
    """The written shards, the two upper levels, and the base's totals."""

    def __init__(self, docs: DataFrame, depth: int, shards: int, fold: bool = False):
        self.depth, self.shards, self.fold = depth, shards, fold
        self.table = written(merged(tallies(docs, depth, shards, fold), depth), "context-tree")
        words = self.table.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
        self.words, self.vocabulary = int(words[0]), int(words[1])
        self.top = self._top()

    def _summed(self, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        pairs = self.table.where(F.col("kind") == GRAMS).select(F.explode(F.arrays_zip(key, value)).alias("p")).select(f"p.{key}", f"p.{value}")
        # At most 256 * 256 sums come to the driver, whatever the corpus.
        found = pairs.groupBy(key).agg(F.sum(value).alias(value)).toPandas().sort_values(key)
        return found[key].to_numpy(np.int64).view(np.uint64), found[value].to_numpy()

    def _top(self) -> list[Level]:
        keys, counts = self._summed("top_keys", "top_counts")
        nodes, logs = self._summed("top_nodes", "top_logs")
        counts, logs = counts.astype(np.int64), logs.astype(float)
        node, zeros, ones = decisions(keys, counts)
        below = np.zeros(len(node))
        below[np.searchsorted(node, nodes)] = logs
        one = Level(node, zeros, ones, below)
        node, zeros, ones = decisions(*sums(keys & np.uint64(255), counts))
        known, total = sums(one.node & np.uint64(255), one.weighted)
        below = np.zeros(len(node))
        below[np.searchsorted(node, known)] = total
        return [one, Level(node, zeros, ones, below)]


def answers(asked: DataFrame, model: Model) -> DataFrame:
    """(chunk, kind, keys, values): ln probability of each gram, count of each word."""
    depth, top = model.depth, model.top
    sent = model.table.sparkSession.sparkContext.broadcast(top)

    def run(key: tuple, rows: pa.Table, shard: pa.Table) -> pa.Table:
        keys = unsqueeze(shard["keys"][0].as_py()) if shard.num_rows else np.empty(0, np.uint64)
        counts = unsqueeze_counts(shard["counts"][0].as_py()) if shard.num_rows else np.empty(0, np.int64)
        wanted = [unsqueeze(x.as_py()) for x in rows["keys"]]
        every = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.uint64)
        if not len(every):
            found = np.empty(0)
        elif key[0].as_py() == GRAMS:
            trees = levels(keys, counts, depth, 2)[0]
            found = code_lengths(every, depth, [*trees, *sent.value])
        elif len(keys):
            at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
            found = np.where(keys[at] == every, counts[at], 0).astype(float)
        else:
            found = np.zeros(len(every))
        values = [found[np.searchsorted(every, x)].astype("<f4" if key[0].as_py() == GRAMS else "<f8").tobytes() for x in wanted]
        return pa.table({"chunk": rows["chunk"].cast(pa.int64()), "kind": rows["kind"].cast(pa.int32()), "keys": rows["keys"].cast(pa.binary()), "values": pa.array(values, pa.binary())})

    return asked.groupBy("kind", "shard").cogroup(model.table.select("kind", "shard", "keys", "counts").groupBy("kind", "shard")).applyInArrow(run, "chunk long, kind int, keys binary, values binary")


def questions(chunked: DataFrame, depth: int, shards: int, fold: bool = False) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tally = Tally(depth)
        for _, texts in runs_of(table["text"].to_pylist(), fold):
            tally.add(texts)
        # A chunk has a text at least, and each text an end: there is always a gram.
        rows = [(key[0].as_py(), kind, shard, keys) for kind, shard, keys, _ in tally.rows(shards)]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["chunk", "kind", "shard", "keys"])

    return chunked.groupBy("chunk").applyInArrow(run, "chunk long, kind int, shard long, keys binary")


class Lookup:
    """Values by key, in an open-addressing table: one or two memory reads a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = keys, values
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        at = self._hash(keys)
        place = self.slots[at]
        todo = np.flatnonzero(self.keys[place] != keys)
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            place[todo] = self.slots[at[todo]]
            todo = todo[self.keys[place[todo]] != keys[todo]]
        return self.values[place]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def scored(chunked: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    depth, total, vocabulary, ends, fold = model.depth, model.words, model.vocabulary, model.ends, model.fold

    def run(key: tuple, docs: pa.Table, rows: pa.Table) -> pa.Table:
        import xxhash

        kinds = rows["kind"].to_numpy()
        part = lambda kind, dtype: (np.concatenate([unsqueeze(rows["keys"][int(i)].as_py()) for i in np.flatnonzero(kinds == kind)] or [np.empty(0, np.uint64)]), np.concatenate([np.frombuffer(rows["values"][int(i)].as_py(), dtype) for i in np.flatnonzero(kinds == kind)] or [np.empty(0)]))
        grams = Lookup(*part(GRAMS, "<f4"))
        words, counts = part(WORDS, "<f8")
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        logs: dict[bytes, float] = {}
        known: set[bytes] = set()
        floor = math.log10(total + ALPHA * (vocabulary + 1))
        end = math.log10(ends + ALPHA) - floor
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        for _, texts in runs_of(docs["text"].to_pylist(), fold):
            values = grams.get(gram_array(texts, depth)).astype(float)
            lengths = np.array([len(x) + 1 for x in texts])
            natural = np.add.reduceat(values, np.cumsum(lengths) - lengths)
            out["score"] += (natural / LN10).tolist()
            out["bits_per_byte"] += (-natural / LN2 / lengths).tolist()
            split = [words_of(x) for x in texts]
            new = list(set().union(*split).difference(logs))
            if new:
                keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new))
                c = counts[np.searchsorted(words, keys)]
                logs.update(zip(new, (np.log10(c + ALPHA) - floor).tolist(), strict=True))
                known.update(w for w, x in zip(new, c, strict=True) if x > 0)
            for own in split:
                out["n_tokens"].append(len(own) + 1)
                out["n_known"].append(sum([w in known for w in own]) + (ends > 0))
                out["base_score"].append(math.fsum([logs[w] for w in own]) + end)
        kept = docs.select(["doc_id", "held_out"])
        return kept.append_column("n_tokens", pa.array(out["n_tokens"], pa.int64())).append_column("n_known", pa.array(out["n_known"], pa.int64())).append_column("base_score", pa.array(out["base_score"], pa.float64())).append_column("score", pa.array(out["score"], pa.float64())).append_column("bits_per_byte", pa.array(out["bits_per_byte"], pa.float64()))

    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, SCORES)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_documents(docs: DataFrame, depth: int = DEPTH, fold: bool = False) -> DataFrame:
    """Trains on the rows that are not held out and scores every row; with `fold`, on texts whose A-Z are lower-cased, which the base's words always are."""
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7: a gram of depth + 1 bytes fits a long")
    ship_package(docs.sparkSession)
    rows = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    parts = buckets(size[0], CHUNK_BYTES)
    model = Model(rows.where(~F.col("held_out")), depth, parts, fold)
    # Each training text's end is a token like a word, counted apart.
    model.ends = int(size[1])
    model.vocabulary += int(size[1] > 0)
    model.words += int(size[1])
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    found = answers(questions(chunked, depth, parts, fold), model)
    return scored(chunked, found, model).withColumn("train_tokens", F.lit(model.words).cast("long"))


def op2_context_tree(docs: DataFrame) -> DataFrame:
    """Model and base score the same text: the one whose A-Z are lower-cased."""
    return score_documents(docs, fold=True).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
