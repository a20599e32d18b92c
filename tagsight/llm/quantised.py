"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .components import components

#: rows that the index is fitted on, at most
FIT_ROWS = 20_000
#: values of a fitted sample, at most
FIT_VALUES = 8_000_000
#: hosts of a list that one task compares with the list's guests
BLOCK = 2000
SUBSPACES, CODEWORDS = 8, 64


def clean(values: list | None) -> bool:
    """False for vectors that link with nothing: NULL, empty, zero, or with NULL or non-finite components."""
    if not values or None in values:
        return False
    v = np.asarray(values, np.float64)
    return bool(np.isfinite(v).all() and v.any())


def directions(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors of little-endian doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(raw), width))
    for row, r in zip(out, raw, strict=True):
        v = np.frombuffer(r, "<f8")
        row[: len(v)] = v / np.abs(v).max()
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of at most k clusters by Lloyd's rounds; empty clusters move to the rows that lie farthest off."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = squares(x, centres)
        own = far.argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            worst = np.argsort(-far[np.arange(len(x)), own], kind="stable")[: int((~full).sum())]
            centres[~full] = x[worst]
    return centres


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


class Index:
    """Coarse centres and one codebook per subspace of the residuals; fitted on a sample, applied to every row."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.width = sample.shape[1]
        self.centres = k_means(sample, cells)
        residual = sample - self.centres[squares(sample, self.centres).argmin(1)]
        self.parts = np.array_split(np.arange(self.width), min(SUBSPACES, self.width))
        self.books = [k_means(residual[:, p], CODEWORDS) for p in self.parts]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and length of what the codes leave out of each row, and its distances to all centres."""
        far = np.sqrt(squares(x, self.centres))
        cell = far.argmin(1)
        rest = x - self.centres[cell]
        codes = np.stack([squares(rest[:, p], b).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        left = rest.copy()
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            left[:, p] -= b[codes[:, k]]
        return cell, codes, np.sqrt((left * left).sum(1)), far

    def lookups(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows x to coded rows of a cell: one table per row and subspace, summed by code."""
        rest = x - self.centres[cell]
        total = np.zeros((len(x), len(codes)))
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            total += squares(rest[:, p], b)[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def reach_of(least: float) -> float:
    """Distance of unit vectors whose cosine is `least`."""
    return math.sqrt(2 - 2 * least)


def _place(batches: Iterator[pa.RecordBatch], index: Index, least: float, sigmas: float) -> Iterator[pa.RecordBatch]:
    """One host row per vector, in the list of its cell, and one guest row per other list that it probes.

    A list is a cell's core (rows within half the reach of the centre, which are all linked) or the rest. A vector that
    lies within reach of x in another cell is at least as far off as the plane between both centres; in a random
    direction, the step towards that plane is reach / sqrt(width) on average, so `sigmas` of these are probed (all of the
    reach where that is less). Of two cells, the one with the smaller number is the guest.
    """
    reach = reach_of(least) + 1e-9
    between = np.sqrt(squares(index.centres, index.centres))
    likely = reach * min(1.0, sigmas / math.sqrt(index.width))
    kinds = {"label": pa.string(), "cell": pa.int32(), "core": pa.bool_(), "host": pa.bool_(), "key": pa.int64(), "n": pa.int64(),
             "own": pa.bool_(), "vector": pa.binary(), "codes": pa.binary(), "off": pa.float64()}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            raw = part.column("vector").to_pylist()
            x = directions(raw, index.width)
            cell, codes, off, far = index.assign(x)
            row = np.arange(len(x))
            core = far[row, cell] <= reach / 2 - 1e-6
            with np.errstate(divide="ignore", invalid="ignore"):
                margin = (far**2 - far[row, cell][:, None] ** 2) / (2 * between[cell])
            probed = (margin <= likely) & (np.arange(len(index.centres))[None] > cell[:, None])
            out: dict[str, list] = {c: [] for c in kinds}
            labels, keys, n = (part.column(c).to_pylist() for c in ("label", "key", "n"))

            def add(i: int, to: int, to_core: bool, host: bool, own: bool, out=out, labels=labels, keys=keys, n=n, raw=raw, codes=codes, off=off) -> None:
                values = (labels[i], to, to_core, host, keys[i], n[i], own, raw[i], codes[i].tobytes() if host else b"", float(off[i]))
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)

            for i in range(len(x)):
                add(i, int(cell[i]), bool(core[i]), True, True)
                if not core[i]:
                    add(i, int(cell[i]), False, False, True)  # the rest of the own cell is compared with itself
                    if far[i, cell[i]] <= 1.5 * reach:
                        add(i, int(cell[i]), True, False, False)
                for j in np.flatnonzero(probed[i]).tolist():
                    add(i, j, False, False, False)
                    if far[i, j] <= 1.5 * reach:
                        add(i, j, True, False, False)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], names=list(kinds))


def _compare(batches: Iterator[pa.RecordBatch], index: Index, least: float) -> Iterator[pa.RecordBatch]:
    """Per block of a list: how many rows each vector is linked with, and links that join the same rows as all of them.

    Rows arrive sorted by list and block, hosts first. Guests pass through in slices, so a task holds one block.
    """
    reach = reach_of(least)
    at, hosts, guests = None, [], []
    state: dict = {}

    def begin() -> None:
        raw = [h["vector"] for h in hosts]
        state.update(
            x=directions(raw, index.width), keys=np.array([h["key"] for h in hosts], np.int64), n=np.array([h["n"] for h in hosts], np.int64),
            codes=np.frombuffer(b"".join(h["codes"] for h in hosts), np.uint8).reshape(len(hosts), -1), off=np.array([h["off"] for h in hosts]),
        )

    def flush() -> Iterator[pa.RecordBatch]:
        if not hosts or not guests:
            guests.clear()
            return
        if not state:
            begin()
        x, keys, n, codes, off = (state[c] for c in ("x", "keys", "n", "codes", "off"))
        y = directions([g["vector"] for g in guests], index.width)
        own, gk, gn = (np.array([g[c] for g in guests]) for c in ("own", "key", "n"))
        near = index.lookups(y, at[1], codes) - off[None] <= reach + 1e-9
        near &= ~own[:, None] | (gk[:, None] < keys[None])
        i, j = np.nonzero(near)
        same = np.einsum("ij,ij->i", y[i], x[j]) >= least if len(i) else np.zeros(0, bool)
        i, j = i[same], j[same]
        guests.clear()
        if not len(i):
            return
        linked = np.concatenate([gk[i], keys[j]])
        several = np.concatenate([n[j], gn[i]])
        who, where = np.unique(linked, return_inverse=True)
        sums = np.zeros(len(who), np.int64)
        np.add.at(sums, where, several)
        top = dict(zip(who.tolist(), who.tolist(), strict=True))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for a, b in set(zip(gk[i].tolist(), keys[j].tolist(), strict=True)):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
        ends = [root(k) for k in who.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(sums), pa.array(ends, pa.int64())], names=["key", "links", "to"])

    for batch in batches:
        for r in batch.to_pylist():
            here = (r["label"], r["cell"], r["core"], r["block"])
            if here != at:
                yield from flush()
                at, hosts = here, []
                state.clear()
            if r["host"]:
                hosts.append(r)
            else:
                guests.append(r)
                if len(guests) >= 500:
                    yield from flush()
    yield from flush()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, widths = [], []
        for values in batch.column("values").to_pylist():
            ok = clean(values)
            raw.append((np.asarray(values, "<f8") + 0.0).tobytes() if ok else None)  # -0.0 and 0.0 are one value
            widths.append(len(values) if ok else 0)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "label")], pa.array(raw, pa.binary()), pa.array(widths, pa.int32())],
                                         names=["row", "id", "label", "vector", "width"])


def fit_index(kinds: DataFrame, cells: int | None = None, fit_rows: int = FIT_ROWS) -> Index | None:
    """The index, fitted on at most `fit_rows` vectors (FIT_VALUES values): those whose hashed key is smallest."""
    facts = kinds.agg(F.count("*").alias("rows"), F.max("width").alias("width")).first()
    if not facts["rows"]:
        return None
    most = max(1, min(fit_rows, FIT_VALUES // facts["width"]))
    sample = [r["vector"] for r in kinds.orderBy(F.xxhash64("key"), "key").limit(most).select("vector").collect()]
    return Index(directions(sample, facts["width"]), cells or max(1, min(256, round(math.sqrt(facts["rows"]) / 4))))


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    sigmas: float = 3.0, cells: int | None = None, fit_rows: int = FIT_ROWS, block: int = BLOCK,
) -> DataFrame:
    """Every row with its links and its component: id, n_links (other rows linked directly), component_id, kept.

    Rows with equal, non-NULL labels and vectors of equal length are linked when their cosine (in doubles) is `least`
    or more. Equal vectors are folded to one that counts for all. The index is fitted on a bounded sample and holds
    every vector. Each vector probes the lists of its cell and of the cells whose border is near (`_place`); the codes rule
    a host out where their distance, less what the code leaves out, is beyond reach, which loses no link; what is left
    is decided by exact cosines. `sigmas` of sqrt(width) and more probe all that the reach can hold: then no link is lost.
    Rows within half the reach of a centre are all linked, so a dense group is counted, not compared.

    Vectors that are NULL, empty, zero or hold NULL, NaN or infinite components, and rows with a NULL label, have
    no links. component_id is the smallest id that links reach, the own one included; NULL ids are behind all others. Rows that
    repeat an id are all returned, each with its own links. Ties of cosines at the threshold count as links.
    Other columns are not read, an empty table gives an empty result.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("values"))
    rows = durable(rows.mapInArrow(_packed, "row long, id long, label string, vector binary, width int"))
    usable = rows.where("vector IS NOT NULL AND label IS NOT NULL")
    folded = usable.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("row").alias("key"), F.min("id").alias("least"))
    kinds = durable(folded.withColumn("width", F.expr("CAST(length(vector) / 8 AS INT)")))
    index = fit_index(kinds, cells, fit_rows)
    if index is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    listed = kinds.select(F.concat_ws("/", "width", "label").alias("label"), "key", "n", "vector")
    placed = durable(listed.mapInArrow(
        lambda b: _place(b, index, least, sigmas),
        "label string, cell int, core boolean, host boolean, key long, n long, own boolean, vector binary, codes binary, off double",
    ))
    lists = ["label", "cell", "core"]
    sizes = placed.where("host").groupBy(*lists).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, lists)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("host"), F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    parts = dealt.drop("blocks").repartition(*lists, "block").sortWithinPartitions(*lists, "block", F.col("host").desc())
    compared = durable(parts.mapInArrow(lambda b: _compare(b, index, least), "key long, links long, to long"))

    cores = durable(placed.where("host AND core").groupBy("label", "cell").agg(F.sum("n").alias("rows"), F.min("key").alias("first")))
    cored = placed.where("host AND core").select("key", "n", "label", "cell").join(cores, ["label", "cell"])
    within = cored.select("key", (F.col("rows") - F.col("n")).alias("links"), F.col("first").alias("to"))
    found = durable(compared.unionByName(within).groupBy("key").agg(F.sum("links").alias("links"), F.collect_set("to").alias("to")))
    joins = found.select(F.col("key").alias("a"), F.explode("to").alias("b")).where("a != b")
    labels = components(joins)

    named = kinds.select("label", "vector", "key", "n", "least").join(found.select("key", "links"), "key", "left")
    named = named.join(labels.withColumnRenamed("id", "key").withColumnRenamed("label", "group"), "key", "left")
    named = durable(named.select("label", "vector", F.coalesce("group", "key").alias("group"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least"))
    first = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = durable(named.join(first, "group").select("label", "vector", "n_links", "component_id"))
    out = rows.join(named, ["label", "vector"], "left")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))})
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
