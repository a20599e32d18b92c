"""Toxicity: a convolutional classifier on hashed word embeddings, trained in numpy on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsight.plans.lineage import collect_small, durable, small_table

from .tokens import text_slices
from .words import LOWER, PUNCTUATED, Words, mix

WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
#: words that go through the filters at once
BLOCK = 32_768


def hashed(texts: list[str | None], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (word, and its first 4 and 6 bytes), and each text's first place.

    Every text is followed by empty places (row number `rows`), one more than the widest filter has neighbours.
    """
    w = Words(texts, PUNCTUATED, LOWER, places=True)
    hashes = [w.hash] + [w.between(w.start, np.minimum(w.start + n, w.end)) + np.uint64(n) for n in PREFIXES]
    own = np.stack([(mix(h) % np.uint64(rows)).astype(np.int32) for h in hashes], 1)
    pad = max(WIDTHS)
    counts = np.diff(w.first)
    begin = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.full((int(begin[-1]), own.shape[1]), rows, np.int32)
    place = np.arange(len(own)) + pad * np.repeat(np.arange(len(counts)), counts)
    out[place] = own
    return out, begin


@dataclass
class Model:
    """Weights of the network and the thresholds by language."""

    table: np.ndarray
    filters: np.ndarray  # dim x (all offsets of all widths x filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    n: int
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        y = x @ self.filters
        maps, at = [], 0
        for w in WIDTHS:
            m = y[:, at : at + self.n].copy()
            for j in range(1, w):
                m[:-j] += y[j:, at + j * self.n : at + (j + 1) * self.n]
            maps.append(m)
            at += w * self.n
        return x, maps

    def logits(self, texts: list[str | None]) -> np.ndarray:
        ids, begin = hashed(texts, len(self.table) - 1)
        pad = max(WIDTHS)
        # windows start at the words of a text and at its first empty place, never in the next text; long texts go in
        # pieces, and a block of pieces is all that is held at once
        cuts = [(i, s, min(s + BLOCK, e)) for i, (s, e) in enumerate(zip(begin[:-1], begin[1:] - pad + 1, strict=True)) for s in range(s, e, BLOCK)]
        pooled = np.full((len(texts), len(WIDTHS) * self.n), -np.inf, np.float32)
        block: list[tuple[int, int, int]] = []
        for k, cut in enumerate(cuts):
            block.append(cut)
            if k + 1 == len(cuts) or cuts[k + 1][2] - block[0][1] > BLOCK:
                low = block[0][1]
                _, maps = self.features(ids[low : cut[2] + pad - 1])
                bounds = np.array([c[1:] for c in block]).reshape(-1) - low
                best = np.concatenate([np.maximum.reduceat(m, bounds, 0)[::2] for m in maps], 1)
                np.maximum.at(pooled, [c[0] for c in block], best)
                block = []
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


class Learner:
    """A model in training, with Adagrad's sums of squared slopes."""

    def __init__(self, rows: int = 1 << 16, dim: int = 16, filters: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 7):
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (rows + 1, dim)).astype(np.float32)
        table[rows] = 0
        columns = sum(WIDTHS) * filters
        self.model = Model(
            table, rng.normal(0, 1 / np.sqrt(dim), (dim, columns)).astype(np.float32), np.zeros(len(WIDTHS) * filters, np.float32),
            rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32), 0.0, filters,
        )
        self.dense = {k: np.zeros_like(getattr(self.model, k)) for k in ("filters", "bias", "out")}
        self.sparse, self.shift_sum = np.full(rows + 1, 1e-6, np.float32), 1e-6
        self.rows, self.batch, self.rate, self.seed, self.rng = rows, batch, rate, seed, rng

    def _chosen(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest value of every filter in each text, and the first place that has it; a block of places at a time."""
        pad, n = max(WIDTHS), len(begin) - 1
        high = np.full((n, len(self.model.bias)), -np.inf, np.float32)
        place = np.zeros(high.shape, np.int64)
        cuts = [(i, s, min(s + BLOCK, e)) for i, (s, e) in enumerate(zip(begin[:-1], begin[1:] - pad + 1, strict=True)) for s in range(s, e, BLOCK)]
        first = 0
        for k, (_, _, end) in enumerate(cuts):
            if k + 1 < len(cuts) and cuts[k + 1][2] - cuts[first][1] <= BLOCK:
                continue
            low = cuts[first][1]
            maps = np.concatenate(self.model.features(ids[low : end + pad - 1])[1], 1)
            for i, s, e in cuts[first : k + 1]:
                at = maps[s - low : e - low].argmax(0)
                value = np.take_along_axis(maps[s - low : e - low], at[None], 0)[0]
                better = value > high[i]
                high[i][better], place[i][better] = value[better], at[better] + s
            first = k + 1
        return high, place

    def step(self, coded: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        """One batch, forward in full, and back through the places that pooling chose."""
        model, n, dim = self.model, self.model.n, self.model.table.shape[1]
        ids = np.concatenate(coded)
        high, place = self._chosen(ids, np.concatenate([[0], np.cumsum([len(c) for c in coded])]))
        pooled = high + model.bias
        active = np.maximum(pooled, 0)
        prob = 1 / (1 + np.exp(-np.clip(active @ model.out + model.shift, -30, 30)))
        delta = ((prob - labels) * weight / len(coded)).astype(np.float32)
        grad = {"out": active.T @ delta, "filters": np.zeros_like(model.filters)}
        back = delta[:, None] * model.out[None, :] * (pooled > 0)
        grad["bias"] = back.sum(0)
        touched, pushed, at = [], [], 0
        for k, w in enumerate(WIDTHS):
            g = back[:, k * n : (k + 1) * n]
            for j in range(w):
                own = ids[place[:, k * n : (k + 1) * n] + j]
                cols = slice(at, at + n)
                grad["filters"][:, cols] = np.einsum("bfd,bf->df", model.table[own].sum(2), g)
                touched.append(own.reshape(-1, ids.shape[1]))
                pushed.append((g[:, :, None] * model.filters[:, cols].T[None]).reshape(-1, dim))
                at += n
        for name, g in grad.items():
            self.dense[name] += g * g
            getattr(model, name).__isub__(self.rate * g / np.sqrt(self.dense[name] + 1e-8))
        self.shift_sum += float(delta.sum()) ** 2
        model.shift -= self.rate * float(delta.sum()) / np.sqrt(self.shift_sum)
        rows_hit, pushed_all = np.concatenate(touched), np.concatenate(pushed)
        live = np.abs(pushed_all).sum(1) > 0
        hit, inverse = np.unique(rows_hit[live].reshape(-1), return_inverse=True)
        sums = np.zeros((len(hit), dim), np.float32)
        np.add.at(sums, inverse, np.repeat(pushed_all[live], rows_hit.shape[1], 0))
        self.sparse[hit] += (sums * sums).mean(1)
        model.table[hit] -= 5 * self.rate * sums / np.sqrt(self.sparse[hit])[:, None]
        model.table[self.rows] = 0

    def pass_over(self, coded: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        order = rng.permutation(len(coded))
        for b in range(0, len(order), self.batch):
            own = order[b : b + self.batch]
            self.step([coded[i] for i in own], labels[own], weight[own])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """All numbers that training changes: those of the network, and a row for each row of the table."""
        m, d = self.model, self.dense
        ends = [[m.shift, self.shift_sum]]
        small = np.concatenate([np.ravel(x) for x in (m.filters, m.bias, m.out, d["filters"], d["bias"], d["out"], *ends)])
        return small.astype(np.float64), np.concatenate([m.table, self.sparse[:, None]], 1)

    def set_state(self, small: np.ndarray, wide: np.ndarray) -> None:
        m, d, at = self.model, self.dense, 0
        for x in (m.filters, m.bias, m.out, d["filters"], d["bias"], d["out"]):
            x[...] = small[at : at + x.size].reshape(x.shape)
            at += x.size
        m.shift, self.shift_sum = float(small[at]), float(small[at + 1])
        m.table[...], self.sparse[...] = wide[:, :-1], wide[:, -1]


def no_model(learner: Learner) -> Learner:
    """Without labels of both kinds there is nothing to tell apart: every score is then the same, far below 0.5."""
    learner.model.out[:] = 0
    learner.model.shift = -8.0
    return learner


def _weight_of_toxic(clean: int, toxic: int) -> float:
    return min(20.0, clean / toxic)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 6, **options) -> Model:
    """Train on a list of labelled texts, in this process."""
    return _fitted(texts, labels, epochs, **options).model


def _fitted(texts: list[str | None], labels: np.ndarray, epochs: int, **options) -> Learner:
    learner = Learner(**options)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return no_model(learner)
    weight = np.where(labels > 0, _weight_of_toxic((labels == 0).sum(), (labels > 0).sum()), 1.0).astype(np.float32)
    coded = [hashed([t], learner.rows)[0] for t in texts]
    for _ in range(epochs):
        learner.pass_over(coded, labels, weight, learner.rng)
    return learner


#: characters of the texts of one trainer
SHARE = 1 << 24
#: rows of the table in a block of changes, and steps of the fixed-point numbers in which changes are added up
CHANGED = 4096
UNIT = float(1 << 32)
CHANGES = "block int, rows binary, body binary"
_CHANGES = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("body", pa.binary())])


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHANGES, strict=True)], schema=_CHANGES)


def _train_whole(options: dict, epochs: int):
    """All epochs over rows that one trainer holds; out: its state, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("body").to_pylist(), batch.column("label").to_pylist()) for batch in batches]
        small, wide = _fitted([t for texts, _ in held for t in texts], np.array([y for _, labels in held for y in labels]), epochs, **options).state()
        yield _changes([(-1, b"", small.tobytes())])
        for a in range(0, len(wide), CHANGED):
            yield _changes([(a // CHANGED, b"", wide[a : a + CHANGED].tobytes())])

    return run


def _train_parts(options: dict, small: np.ndarray, wide: np.ndarray, weight: float, epoch: int):
    """Every part goes once through a trainer of its own, which starts from the given state; out: what it changed, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, part, rng = Learner(**options), None, None
        ahead = 8 * learner.batch
        coded: list[np.ndarray] = []
        labels: list[float] = []

        def learn() -> None:
            y = np.array(labels, np.float32)
            learner.pass_over(coded, y, np.where(y > 0, np.float32(weight), np.float32(1)), rng)
            coded.clear()
            labels.clear()

        def changed() -> Iterator[pa.RecordBatch]:
            if coded:
                learn()
            small_now, wide_now = learner.state()
            yield _changes([(-1, b"", (small_now - small).tobytes())])
            for a in range(0, len(wide), CHANGED):
                change = wide_now[a : a + CHANGED] - wide[a : a + CHANGED]
                rows = np.flatnonzero(change.any(1))
                if len(rows):
                    yield _changes([(a // CHANGED, rows.astype(np.int32).tobytes(), change[rows].tobytes())])

        for batch in text_slices(batches, "body"):
            ids, begin = hashed(batch.column("body").to_pylist(), learner.rows)
            for i, (own, label) in enumerate(zip(batch.column("part").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if own != part:
                    if part is not None:
                        yield from changed()
                    learner.set_state(small, wide)
                    part, rng = own, np.random.default_rng([learner.seed, epoch, own])
                coded.append(ids[begin[i] : begin[i + 1]])
                labels.append(label)
                if len(coded) == ahead:
                    learn()
        if part is not None:
            yield from changed()

    return run


def _mean_changes(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Of each block the mean change over the trainers that changed a row; sums in whole numbers, so their order is nothing."""
    sums: dict[int, np.ndarray] = {}
    times: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, rows, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            change = np.frombuffer(body, np.float64)[None] if block < 0 else np.frombuffer(body, np.float32).reshape(-1, dim + 1)
            at = np.zeros(1, np.int32) if block < 0 else np.frombuffer(rows, np.int32)
            if block not in sums:
                sums[block] = np.zeros((1 if block < 0 else CHANGED, change.shape[1]), np.int64)
                times[block] = np.zeros(len(sums[block]), np.int64)
            sums[block][at] += np.rint(change.astype(np.float64) * UNIT).astype(np.int64)
            times[block][at] += 1
    for block, total in sums.items():
        rows = np.flatnonzero(times[block])
        mean = total[rows] / UNIT / times[block][rows, None]
        yield _changes([(block, rows.astype(np.int32).tobytes(), (mean if block < 0 else mean.astype(np.float32)).tobytes())])


def fit_table(rows: DataFrame, epochs: int = 6, **options) -> Model:
    """Train on all rows (id, body string, lang, label int) of a table, on the executors.

    Up to 16 million characters go through all epochs in one task, in order of ids. More rows are dealt by their hash to trainers of about 16 million characters. In an epoch every trainer starts from the
    common model and goes once through its rows; what the trainers changed is added up in a shuffle, by blocks of the
    table, and the mean (of a row of the table: over those that changed it) makes the next common model. The driver
    holds a model, whatever the rows. The parts and the sums are the same on any cluster.
    """
    learner = Learner(**options)
    size, clean, toxic = rows.agg(
        F.coalesce(F.sum(F.length("body") + 1), F.lit(0)), F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") != 0, 1))
    ).first()
    if not clean or not toxic:
        return no_model(learner).model
    if size <= SHARE:
        one = rows.select("id", "body", "lang", "label").repartition(1).sortWithinPartitions("id", "body", "lang")
        found = {block: body for block, _, body in one.mapInArrow(_train_whole(options, epochs), CHANGES).collect()}
        wide = np.concatenate([np.frombuffer(found[b], np.float32) for b in range(len(found) - 1)])
        learner.set_state(np.frombuffer(found[-1], np.float64), wide.reshape(learner.rows + 1, -1))
        return learner.model
    # the parts are the files of the table that is stored here; a task may read several, one after another
    order = F.xxhash64("id", "body", F.lit(learner.seed))
    dealt = rows.select("id", "body", "label").repartition(-(-size // SHARE), order).sortWithinPartitions(order, "id", "body", "label")
    stored = durable(dealt.select(F.spark_partition_id().alias("part"), "body", "label"))
    weight, dim = _weight_of_toxic(clean, toxic), learner.model.table.shape[1]
    for epoch in range(epochs):
        small, wide = learner.state()
        changes = stored.mapInArrow(_train_parts(options, small, wide, weight, epoch), CHANGES).repartition(8, "block")
        for block, at, body in changes.mapInArrow(lambda b: _mean_changes(b, dim), CHANGES).collect():
            if block < 0:
                small = small + np.frombuffer(body, np.float64)
            else:
                wide[block * CHANGED + np.frombuffer(at, np.int32)] += np.frombuffer(body, np.float32).reshape(-1, dim + 1)
        learner.set_state(small, wide)
    return learner.model


def best_cuts(rows: DataFrame) -> dict[str, tuple[float, int, int]]:
    """Of rows (kind string, logit float, label int), for each kind: the logit that separates the labels best (F1),
    midway in its gap, and the numbers of rows and of labels 1. 0 where a label is missing.

    Equal logits are folded; they are sorted in ranges, every range gets the sums of those above it, and the driver sees one
    candidate for each range and kind.
    """
    counts = rows.groupBy("kind", "logit").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("hits"))
    ranges = durable(counts.repartitionByRange("kind", F.desc("logit")).withColumn("part", F.spark_partition_id()))
    sums = collect_small(ranges.groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("logit").alias("top")))
    whole: dict[str, list] = {}
    for r in sorted(sums, key=lambda r: (r["kind"], r["part"])):
        whole.setdefault(r["kind"], []).append(r)
    before = []
    for kind, parts in whole.items():
        n = hits = 0
        total = sum(r["hits"] for r in parts)
        for r, after in zip(parts, [*parts[1:], None], strict=True):
            before.append((kind, r["part"], n, hits, total, after and after["top"]))
            n, hits = n + r["n"], hits + r["hits"]
    if not before:
        return {}
    bases = small_table(rows.sparkSession, before, "kind string, part int, n_before long, hits_before long, total long, next_top float")
    down = Window.partitionBy("kind", "part").orderBy(F.desc("logit"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = ranges.select("kind", "part", "logit", F.sum("n").over(so_far).alias("n"), F.sum("hits").over(so_far).alias("hits"), F.lead("logit").over(down).alias("after"))
    f1 = 2 * (F.col("hits") + F.col("hits_before")) / (F.col("n") + F.col("n_before") + F.col("total"))
    best = judged.join(bases, ["kind", "part"]).groupBy("kind", "part").agg(
        F.max(F.struct(f1.alias("f1"), "logit", F.coalesce("after", "next_top", F.col("logit") - 1).alias("after"))).alias("best")
    )
    out: dict[str, tuple] = {}
    for r in collect_small(best):
        out[r["kind"]] = max(out.get(r["kind"], (-1.0, 0.0, 0.0)), tuple(r["best"]))
    sizes = {k: (sum(r["n"] for r in v), sum(r["hits"] for r in v)) for k, v in whole.items()}
    return {k: ((top + after) / 2 if 0 < sizes[k][1] < sizes[k][0] else 0.0, *sizes[k]) for k, (_, top, after) in out.items()}


def _logits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "body"):
            logits = np.asarray(model.logits(batch.column("body").to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(logits), batch.column("label")], names=["lang", "logit", "label"])

    return run


#: places of a filter of ids: 16 an id, up to 8 MB in all; beyond that it lets more rows through
PLACES, MOST_PLACES = 1 << 15, 1 << 26


def _bits(table: pa.Table) -> pa.Table:
    marks = np.zeros(PLACES, bool)
    marks[table.column("place").to_numpy()] = True
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def perhaps_in(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose id may be one of `n` ids: all that are, and one in 16 or so of the others.

    Each id marks one place by its hash; blocks of places are put together on the executors, the driver holds 8 MB at most.
    """
    size = min(MOST_PLACES, max(PLACES, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("id").cast(rows.schema["id"].dataType)), F.lit(size)).cast("int")
    blocks = ids.select(F.floor(place / PLACES).cast("int").alias("block"), (place % PLACES).alias("place"))
    bits = np.zeros((size // PLACES, PLACES // 8), np.uint8)
    for block, own in blocks.groupBy("block").applyInArrow(_bits, "block int, bits binary").collect():
        bits[block] = np.frombuffer(own, np.uint8)
    flat = bits.reshape(-1)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((flat[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return rows.where(F.col("id").isNotNull()).where(marked(place))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str, every: int) -> DataFrame:
    """Distinct labelled rows: id, body, lang, label, kept (from the fit: those of every so many'th labelled id, in order).

    An id with several labels has the largest. Ids are ranked over ranges of ids, each with the number of ids before it.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = marks.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    ranges = durable(known.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for r in collect_small(ranges.groupBy("part").count().orderBy("part")):
        before.append((r["part"], at))
        at += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    chosen = ranges.select("id", "label", "part", place.alias("place")).join(small_table(docs.sparkSession, before, "part int, before long"), "part").select(
        "id", "label", ((F.col("before") + F.col("place")) % every == 0).alias("kept")
    )
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.coalesce(lang, F.lit("")).alias("lang"))
    # most rows without a label leave here, before their texts are shuffled
    return perhaps_in(rows, ranges, at).join(chosen, "id").distinct()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    lang_col: str = "lang", held_back: float = 0.25, min_calibration: int = 40, **options,
) -> Model:
    """Fit on the labelled rows, all of them, and calibrate on a part of them.

    A quarter of the rows is kept from the fit: the cut that separates it best becomes score 0.5, and every language
    with enough rows of both labels gets its own threshold. Languages decide thresholds only, they never enter a score.
    Rows without a label are not used. Fit and cuts are made on the executors; the driver holds one model.

    Where the rows of the fit do not have labels of both kinds (no labels, labels of other documents, held-out ones
    only), the model rejects nothing and is not calibrated.
    """
    rows = durable(labelled(docs, labels, id_col, text_col, label_col, lang_col, max(2, round(1 / held_back))))
    model = fit_table(rows.where("NOT kept"), **options)
    if not model.out.any():
        return model
    logits = rows.where("kept").select("lang", "body", "label").mapInArrow(_logits(model), "lang string, logit float, label int")
    # kind '*' is all rows together, '=de' a language
    cuts = best_cuts(logits.select(F.explode(F.array(F.lit("*"), F.concat(F.lit("="), F.col("lang")))).alias("kind"), "logit", "label"))
    cut = cuts["*"][0] if cuts else 0.0
    model.shift -= cut
    for kind, (own, n, hits) in sorted(cuts.items()):
        if kind != "*" and n >= min_calibration and 0 < hits < n:
            model.thresholds[kind[1:]] = float(1 / (1 + np.exp(-(own - cut))))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, score (0 to 1) and rejected (the score reaches its language's threshold, 0.5 where it has none).

    Whole texts are scored, slice by slice. NULL and empty texts have the score of a text without words; a NULL or
    unknown language takes 0.5; repeated rows are all returned. The network is of fixed size whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            s = model.scores(batch.column("text").to_pylist())
            cuts = np.array([model.thresholds.get(x, 0.5) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array(s >= cuts)], names=["id", "score", "rejected"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(run, "id long, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is not rejected, with all their columns, in one pass and without a shuffle.

    NULL and empty texts have the score of a text without words, NULL and unknown languages the threshold 0.5. Each row
    is judged by itself: NULL and repeated ids, repeated rows and ties change nothing. Whole texts are scored, slice by
    slice; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            s = model.scores(batch.column(text_col).to_pylist())
            langs = batch.column(lang_col).to_pylist() if lang_col in batch.schema.names else [None] * len(s)
            yield batch.filter(pa.array(s < np.array([model.thresholds.get(x, 0.5) for x in langs])))

    return docs.mapInArrow(run, docs.schema)
