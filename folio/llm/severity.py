"""Toxicity as an ordinal severity grade.

A cumulative-link (proportional odds) model: P(grade > k) = sigmoid(w.x - t_k)
with one weight vector w for all thresholds t_1 < t_2 < ..., so expected
severity is the sum of P(grade > k). The labels give three grades: 0 not toxic,
1 toxic, 2 toxic and of low quality.

Features are sparse: each word (letters alone, A-Z lower-cased) and its first 4,
5 and 6 characters, hashed to 2^BITS places; the value is the square root of a
feature's share of the text's words. The model is fitted on every labelled row:
their features are written once, and each step of the fit is a pass over them, of
which every task sends one vector of sums. Texts don't move for that: features are
made where a document is read, if a filter of the labelled doc_ids lets it through
(it drops no labelled one; the join decides), and only they meet the labels.
Features are kept as 16-bit gaps and 8-bit counts. The P(grade > 0) from which a document
is rejected is the one that has the best F1 on the labelled rows which a second
fit, made in the same passes, doesn't see: those of a part of the doc_ids, by
hash. Weights have a fixed size, which is what is broadcast.

Defined cases: a null or empty text, or one without letters, has no feature and
gets the model's grade for that; a label that is null counts as 0; labels of
the same doc_id that differ are each a row of the fit; labels without a
document have no part; with no labelled row at all every text has expected
severity 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.rows import LOWER_BYTES, hash_stretches, id_and_text
from folio.session import discard, ship_package, written

BITS = 18
GRADES = 3
PREFIXES = (4, 5, 6)
RUN_CHARS = 1_000_000
SIZE = 1 << BITS
#: Features of a row go as gaps up to WIDE and counts below MANY; a wider gap is bridged, a larger count is told beside.
WIDE, MANY = 0xFFFF, 0xFF
#: Features that one written row holds, about.
PACKED = 1 << 20
#: Bits of the filter of labelled doc_ids: for each label, and at most and least; beyond the most more documents pass it in vain.
FILTER_BITS, MOST_BITS, LEAST_BITS = 16, 1 << 27, 1 << 12
#: A feature must stand in so many labelled documents to have a weight.
LEAST_DOCS = 5
#: Most steps of the fit, the length of the mean loss's slope at which it ends, the steps it remembers, and the weight decay.
STEPS, SLOPE, MEMORY, DECAY = 160, 3e-4, 6, 2e-4
#: One doc_id in so many is kept from the second fit, to set the cut-off, if so many of their rows at least are toxic; else it is one half.
KEPT, LEAST_TOXIC = 4, 20
#: The cut-off is set on counts by so many equal parts of the probabilities from 0 to 1.
PARTS = 1 << 17

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_BYTES)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, and (text's place, feature, count) triples, sorted."""
    raw = [(x or "").encode("utf-8", "replace") for x in texts]
    codes = np.frombuffer(b" ".join(raw).translate(_LETTERS), np.uint8)
    inside = np.concatenate([[False], codes != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)])))
    # Where each word ends and each of its prefixes, by characters; after the last one there is an end, and then none.
    begins = (codes & 0xC0) != 0x80
    first = np.cumsum(begins, dtype=np.int64)[starts] - 1
    characters = np.append(np.flatnonzero(begins), [len(codes), *[len(codes) + 1] * max(PREFIXES)])
    ends = np.column_stack([stops, *(characters[first + k] for k in PREFIXES)])
    there = ends <= stops[:, None]
    n = there.sum(1)
    hashes = hash_stretches(codes, np.repeat(starts, n), ends[there])
    # Words and prefixes take other bits.
    hashes = np.where(np.nonzero(there)[1] == 0, hashes >> np.uint64(64 - BITS), hashes >> np.uint64(64 - 2 * BITS) & np.uint64(SIZE - 1))
    keys = np.sort(np.repeat(np.repeat(np.arange(len(texts)), sizes), n) << BITS | hashes.astype(np.int64))
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return sizes, keys[heads] >> BITS, keys[heads] & (SIZE - 1), np.diff(np.append(heads, len(keys)))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, feature, value) triples, sorted."""
    sizes, place, feature, count = counted(texts)
    return place, feature, np.sqrt(count / sizes[place])


def probabilities(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k, a column each."""
    z = np.clip(margin[:, None] - thresholds[None, :], -40, 40)
    return 1 / (1 + np.exp(-z))


class Rows(NamedTuple):
    """Some labelled rows: their grades, which are kept from the second fit, and how many features each text has, and which, with what value; a bridge has value 0."""

    grades: np.ndarray
    kept: np.ndarray
    many: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def margin(self, weights: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(self.grades)), np.flatnonzero(self.many)
        if len(own):
            out[own] = np.add.reduceat(weights[self.feature] * self.value, (np.cumsum(self.many) - self.many)[own])
        return out


def thresholds_of(theta: np.ndarray) -> np.ndarray:
    """Thresholds stay in order as a first one and the logarithms of positive steps."""
    return theta[0] + np.append(0, np.cumsum(np.exp(theta[1:])))


def spread(used: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights by feature from those of the used features."""
    out = np.zeros(SIZE, weights.dtype)
    out[used] = weights
    return out


def loss_sums(rows: Rows, used: np.ndarray, params: np.ndarray, all_rows: bool) -> np.ndarray:
    """The log loss's slopes by the used features' weights and by theta, and the loss itself, each added up over the rows, or over those that aren't kept."""
    weights, theta = spread(used, params[: len(used)]), params[len(used) :]
    grades, at, edges = rows.grades, np.arange(len(rows.grades)), len(theta)
    counts = np.ones(len(grades)) if all_rows else 1.0 - rows.kept
    above = np.column_stack([np.ones(len(grades)), probabilities(rows.margin(weights), thresholds_of(theta)), np.zeros(len(grades))])
    slope = above * (1 - above)
    likely = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
    by_margin = -counts * (slope[at, grades] - slope[at, grades + 1]) / likely
    by_threshold = np.array([(counts * slope[at, k + 1] / likely * ((grades == k + 1) * 1.0 - (grades == k) * 1.0)).sum() for k in range(edges)])
    by_theta = [by_threshold.sum(), *(by_threshold[k:].sum() * np.exp(theta[k]) for k in range(1, edges))]
    return np.concatenate([np.bincount(rows.feature, np.repeat(by_margin, rows.many) * rows.value, minlength=SIZE)[used], by_theta, [-(counts * np.log(likely)).sum()]])


def minimised(x: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS from x: yields points, is sent the loss and its slopes there, returns the last point that was accepted."""
    loss, slope = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if (length := np.linalg.norm(slope)) <= SLOPE:
            break
        way, shares = slope.copy(), []
        for moved, turned in reversed(steps):
            shares.append(moved @ way / (moved @ turned))
            way -= shares[-1] * turned
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / length
        for (moved, turned), share in zip(steps, reversed(shares), strict=True):
            way += moved * (share - turned @ way / (moved @ turned))
        size = 1.0
        while True:
            there = x - size * way
            new_loss, new_slope = yield there
            if new_loss <= loss - 1e-4 * size * (slope @ way):
                break
            size *= 0.4
            if size < 1e-6:
                return x
        moved, turned = there - x, new_slope - slope
        if moved @ turned > 1e-12:
            steps = [*steps, (moved, turned)][-MEMORY:]
        x, loss, slope = there, new_loss, new_slope
    return x


def start_of(features: int, shares: list[float], rows: int) -> np.ndarray:
    """No weights, and the thresholds that fit the grades' shares above each."""
    shares = [min(1 - 0.5 / rows, max(0.5 / rows, s)) for s in shares]
    start = np.maximum.accumulate([np.log((1 - s) / s) for s in shares])
    return np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade, kept) of every labelled row."""
    grade = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL").withColumn("kept", F.pmod(F.xxhash64("doc_id"), F.lit(KEPT)) == 0)


def filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the doc_ids, two bits each, as 64-bit words."""
    bits = LEAST_BITS
    rows = ids.count()
    while bits < min(MOST_BITS, rows * FILTER_BITS):
        bits *= 2
    h = F.xxhash64("doc_id")
    places = ids.select(F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))).alias("p"))
    found = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("own")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["own"].to_numpy()
    return out.view(np.uint64)


def passed(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each doc_id, by its hash."""
    last, out = np.uint64(len(words) * 64 - 1), np.ones(len(hashes), bool)
    for p in (hashes & last, hashes >> np.uint64(32) & last):
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def encoded(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]:
    """Of each text: its words, and its features as gaps, counts, and the counts that are MANY or more."""
    sizes, place, feature, count = counted(texts)
    gap = np.diff(feature, prepend=0)
    heads = np.flatnonzero(np.diff(place, prepend=-1))
    gap[heads] = feature[heads]
    bridges = gap // WIDE
    at = np.arange(len(gap)) + np.cumsum(bridges)
    gaps, counts = np.full(len(gap) + int(bridges.sum()), WIDE, "<u2"), np.zeros(len(gap) + int(bridges.sum()), np.uint8)
    gaps[at], counts[at] = gap - bridges * WIDE, np.minimum(count, MANY)
    ends = np.searchsorted(np.repeat(place, bridges + 1), np.arange(len(texts) + 1)).tolist()
    large = np.flatnonzero(count >= MANY)
    large_ends = np.searchsorted(place[large], np.arange(len(texts) + 1)).tolist()
    cut = lambda x, by: [x[a:b].tobytes() for a, b in zip(by[:-1], by[1:], strict=True)]
    return sizes, cut(gaps, ends), cut(counts, ends), cut(count[large].astype("<i8"), large_ends)


def featured(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, words and features of every document whose doc_id is among the ids, and of few others."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(passed(sent.value, batch.column(2).to_numpy().view(np.uint64))))
            at = 0
            for part in _runs(own.column(1).to_pylist()):
                sizes, *lists = encoded(part)
                yield pa.RecordBatch.from_arrays([own.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in lists)], ["doc_id", "words", "gaps", "counts", "large"])
                at += len(part)

    rows = id_and_text(docs).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    return rows.mapInArrow(run, "doc_id long, words long, gaps binary, counts binary, large binary")


def packed(rows: DataFrame) -> DataFrame:
    """Many rows of (grade, kept, words, gaps, counts, large) as one, their values one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def all_held() -> pa.RecordBatch:
            grade, kept, words, gaps, counts, large = zip(*held, strict=True)
            own = [np.array(grade, "<i4").tobytes(), np.array(kept, bool).tobytes(), np.array(words, "<i8").tobytes(), np.array([len(x) for x in counts], "<i8").tobytes(), *map(b"".join, (gaps, counts, large))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], ["grade", "kept", "words", "many", "gaps", "counts", "large"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held.append(row)
                size += len(row[4])
                if size >= PACKED:
                    yield all_held()
                    held, size = [], 0
        if held:
            yield all_held()

    return rows.select("grade", "kept", "words", "gaps", "counts", "large").mapInArrow(run, "grade binary, kept binary, words binary, many binary, gaps binary, counts binary, large binary")


def rows_of(batch: pa.RecordBatch) -> Iterator[Rows]:
    """What each packed row holds."""
    kinds = ("<i4", bool, "<i8", "<i8", "<u2", np.uint8, "<i8")
    for at in range(batch.num_rows):
        grades, kept, words, many, gaps, counts, large = (np.frombuffer(x[at].as_buffer(), kind) for x, kind in zip(batch.columns, kinds, strict=True))
        sums = np.cumsum(gaps, dtype=np.int64)
        ends = np.cumsum(many)
        feature = sums - np.repeat(np.append(0, sums)[ends - many], many)
        value = counts.astype(float)
        value[counts == MANY] = large
        yield Rows(grades.astype(np.int64), kept, many, feature, np.sqrt(value / np.repeat(words, many)))


def added_up(table: DataFrame, sums: Callable[[Rows], list[np.ndarray]], many: int) -> list[np.ndarray | float]:
    """The vectors that `sums` has of some rows, each added up over the whole table; every task, one a core, sends as many as one call returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [0.0] * many
        for batch in batches:
            for rows in rows_of(batch):
                total = [a + b for a, b in zip(total, sums(rows), strict=True)]
        own = [k for k in range(many) if np.ndim(total[k])]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([total[k].tobytes() for k in own], pa.binary())], ["vector", "part"])

    found = table.coalesce(table.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "vector int, part binary").toArrow()
    out: list = [0.0] * many
    for at, part in zip(found["vector"].to_pylist(), found["part"], strict=True):
        out[at] = out[at] + np.frombuffer(part.as_buffer(), float)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    ship_package(docs.sparkSession)
    own = graded(labels)
    # As many labels as there may be: the features move, not the labels to every task.
    table = written(packed(featured(docs, own.select("doc_id")).join(own.hint("merge"), "doc_id")), "severity")
    try:
        return fit_table(table)
    finally:
        discard(table)


def fit_table(table: DataFrame, levels: int = GRADES) -> Model | None:
    """The minimum of the mean log loss with weight decay over all rows, and the cut-off from those kept."""
    context = table.sparkSession.sparkContext

    def of_all(rows: Rows) -> list[np.ndarray]:
        by_grade = [np.bincount(rows.grades[own], minlength=levels) for own in (slice(None), rows.kept)]
        return [np.bincount(rows.feature[rows.value > 0], minlength=SIZE).astype(float), np.concatenate(by_grade).astype(float)]

    seen, by_grade = added_up(table, of_all, 2)
    if not np.ndim(by_grade):
        return None
    every, kept = by_grade[:levels], by_grade[levels:]
    used = np.flatnonzero(seen >= LEAST_DOCS)
    used_sent = context.broadcast(used)
    # The fit to all rows, and the one that sets the cut-off.
    rows_in = [every, every - kept] if kept[1:].sum() >= LEAST_TOXIC and (every - kept).sum() else [every]
    fits = [minimised(start_of(len(used), [n[k + 1 :].sum() / n.sum() for k in range(levels - 1)], int(n.sum()))) for n in rows_in]
    points, done = {k: next(x) for k, x in enumerate(fits)}, {}
    while points:
        sent = context.broadcast(points)

        def at_points(rows: Rows, sent=sent) -> list[np.ndarray]:
            return [loss_sums(rows, used_sent.value, params, k == 0) for k, params in sent.value.items()]

        got = added_up(table, at_points, len(points))
        sent.destroy()
        for (k, params), sums in zip(list(points.items()), got, strict=True):
            mean = sums / rows_in[k].sum()
            weights = params[: len(used)]
            mean[: len(used)] += DECAY * weights
            try:
                points[k] = fits[k].send((mean[-1] + DECAY / 2 * (weights @ weights), mean[:-1]))
            except StopIteration as end:
                done[k] = Model(spread(used, end.value[: len(used)].astype(np.float32)), thresholds_of(end.value[len(used) :]))
                del points[k]
    if len(fits) == 1:
        return done[0]
    sent = context.broadcast(done[1])

    def judged(rows: Rows) -> list[np.ndarray]:
        p = probabilities(rows.margin(sent.value.weights), sent.value.thresholds)[:, 0]
        part = np.minimum((p * PARTS).astype(np.int64), PARTS - 1)
        return [np.bincount(part[rows.kept & own], minlength=PARTS).astype(float) for own in (rows.grades > 0, rows.grades == 0)]

    toxic, clean = added_up(table, judged, 2)
    return done[0]._replace(cut=best_cut(toxic, clean))


def best_cut(toxic: np.ndarray, clean: np.ndarray) -> float:
    """Rows by equal parts of the probabilities: the middle of the gap below the part from which F1 is best; one half if nothing is toxic."""
    if not toxic.any():
        return 0.5
    own = np.flatnonzero(toxic + clean)[::-1]
    score = 2 * np.cumsum(toxic[own]) / (np.cumsum(toxic[own] + clean[own]) + toxic.sum())
    at = int(np.argmax(score))
    below = own[at + 1] + 1 if at + 1 < len(own) else own[at]
    return float(own[at] + below) / 2 / len(toxic)


def _runs(texts: list, most: int = RUN_CHARS) -> Iterator[list]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


GRADED = "doc_id long, p_toxic double, p_severe double, expected_severity double, grade int"


def grade_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, P(grade > 0), P(grade > 1), expected severity, most likely grade."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            margins = []
            for part in _runs(batch.column(1).to_pylist()):
                if own is None:
                    margins.append(np.zeros(len(part)))
                    continue
                place, feature, value = features(part)
                margins.append(np.bincount(place, own.weights[feature] * value, minlength=len(part)))
            margin = np.concatenate(margins) if margins else np.empty(0)
            above = np.zeros((len(margin), GRADES - 1)) if own is None else probabilities(margin, own.thresholds)
            each = np.column_stack([np.ones(len(margin)), above]) - np.column_stack([above, np.zeros(len(margin))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (above[:, 0], above[:, 1], above.sum(1), each.argmax(1).astype(np.int32)))], ["doc_id", "p_toxic", "p_severe", "expected_severity", "grade"])

    return id_and_text(docs).mapInArrow(run, GRADED)


def op1_ordinal_severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return grade_documents(docs, model).withColumn("toxic", F.col("p_toxic") >= F.lit(model.cut if model else 1.0))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose P(grade > 0) is the cut-off or more; the columns stay, and only texts go to Python. A null doc_id is judged like any other."""
    model = fit(docs, labels)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: pa.Array) -> pa.Array:
        own, out = sent.value, []
        for part in _runs(text.to_pylist()):
            place, feature, value = features(part)
            margin = np.bincount(place, own.weights[feature] * value, minlength=len(part))
            out.append(probabilities(margin, own.thresholds)[:, 0] < own.cut)
        return pa.array(np.concatenate(out) if out else np.empty(0, bool))

    return docs.where(F.arrow_udf(clean, "boolean")(F.col("text")))
