"""Packing of token sequences: a configuration linear program over the length histogram, rounded, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .tokens import BULK, encoder, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: (lengths of one sequence, largest first; number of such sequences)
Pattern = tuple[tuple[int, ...], int]


def _cut_pieces(path: str, spaced: bool, end: bytes, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = encoder(path, spaced), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in text_slices(batches, "text", BULK):
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column("id").to_pylist(), codes.encode(batch.column("text")), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    n = len(own) // 4
                    for col, v in zip(cols, (doc_id, piece, at // 4, n, zlib.crc32(own), part, int(seen[n])), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _knapsack(values: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity with any number of each length, and the length that was added last (0: none)."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    for c in range(int(lengths[0]) if len(lengths) else room + 1, room + 1):
        m = bisect_left(lengths, c + 1)
        gains = best[c - lengths[:m]] + worth[:m]
        k = int(gains.argmax())
        if gains[k] > best[c - 1]:
            best[c], last[c] = gains[k], lengths[k]
        else:
            best[c] = best[c - 1]
    return best, last


def _fill(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, room: int, eps: float = 0.1, pricings: int = 120) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, about the least total that covers every length as often as asked.

    Multiplicative weights: a length is worth its weight, which falls as it gets covered. One knapsack table prices the
    best configuration around every length; those within 1 - eps of the best are used, each as far as its scarcest
    length allows a step of eps. A length that is covered leaves the program.
    """
    need = counts.astype(float)
    covered = np.zeros(room + 1)
    weight = np.where(counts > 0, np.arange(room + 1) / room, 0.0)
    used: dict[tuple[int, ...], float] = {}
    for _ in range(pricings):
        open_ = (counts > 0) & (covered < need)
        if not open_.any():
            break
        values = np.where(open_, weight * np.exp(-eps * covered / np.maximum(need, 1)), 0.0)
        best, last = _knapsack(values, room)
        lengths = np.flatnonzero(open_)
        worth = values[lengths] + best[room - lengths]
        order = np.argsort(-worth, kind="stable")
        for i in order[worth[order] >= (1 - eps) * worth.max()]:
            first = int(lengths[i])
            if covered[first] >= need[first]:
                continue
            config = tuple(sorted([first, *_fill(last, room - first)], reverse=True))
            times = Counter(config)
            # as far as the scarcest length allows, and no further than a step of its need
            step = min(min((need[k] - covered[k]) / n for k, n in times.items()), max(1.0, 10 * eps * min(need[k] / n for k, n in times.items())))
            if step > 0:
                used[config] = used.get(config, 0.0) + step
                for k, n in times.items():
                    covered[k] += step * n
    return used


def best_fit(counts: np.ndarray, room: int) -> list[Pattern]:
    """Best fit, largest first, on groups of equal sequences: the work follows the kinds of lengths, not the pieces."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # free room -> contents -> sequences
    free: list[int] = []
    for length in range(room, 0, -1):
        todo = int(counts[length])
        while todo:
            at = bisect_left(free, length)
            if at < len(free):
                gap = free[at]
                content, n = groups[gap].popitem()
                take = min(n, todo)
                if n > take:
                    groups[gap][content] = n - take
                elif not groups[gap]:
                    del groups[gap]
                    free.pop(at)
                fits = 1
            else:
                fits = min(room // length, todo)
                gap, content, take = room, (), max(1, todo // fits)
            new = (*content, *[length] * fits)
            rest = gap - length * fits
            if rest not in groups:
                groups[rest] = {}
                free.insert(bisect_left(free, rest), rest)
            groups[rest][new] = groups[rest].get(new, 0) + take
            todo -= take * fits
    return [(content, n) for by in groups.values() for content, n in by.items()]


def plan_sequences(counts: np.ndarray, room: int) -> list[Pattern]:
    """Sequences that hold counts[length] pieces of each length, as patterns with multiplicities.

    The fractional solution is rounded down to what is still there; what rounding leaves is packed by best fit. Where
    best fit alone needs fewer sequences, its plan is taken.
    """
    left, out = counts.astype(np.int64).copy(), []
    for config, x in sorted(fractional(counts, room).items(), key=lambda kv: (-sum(kv[0]), kv[0])):
        kinds, times = np.unique(config, return_counts=True)
        n = int(min(np.floor(x + 1e-9), (left[kinds] // times).min()))
        if n > 0:
            out.append((config, n))
            left[kinds] -= n * times
    out += best_fit(left, room)
    plain = best_fit(counts, room)
    return min(out, plain, key=lambda p: sum(n for _, n in p))


def slot_table(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes: runs of ranks, ordered by length and first rank."""
    rows, used, first = [], {}, 0
    for content, n in patterns:
        at = 0
        for length in content:
            rank = used.get(length, 0)
            rows.append((length, rank, first, at))
            used[length] = rank + n
            at += length
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run_no = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
            sequence = slots["sequence"][run_no] + rank - slots["rank"][run_no]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(slots["offset"][run_no])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 0, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document with the sequence and the offset where each lies.

    Documents are encoded whole, get the end id and are cut only where they are longer than `limit`. The driver gets
    the histogram of lengths, `limit` numbers at most, and plans patterns; the executors rank the pieces of each length
    (place in its part, plus the pieces in earlier parts) and look up their slot. The slot table has a row for each item
    of a pattern, a number bound by `limit` and the pricings, not by the pieces.

    NULL and empty texts give a piece with the end id alone; NULL ids are kept; repeated rows are packed each. Other
    columns are not read. An empty table gives an empty result.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = durable(rows.mapInArrow(_cut_pieces(tokenizer, spaced, end, limit), PIECES))
    per_part = durable(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(limit + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots = slot_table(plan_sequences(counts, limit))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
