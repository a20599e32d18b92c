"""Benchmark passages in documents: greedy string tiling over shared-word seeds."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drops import mark, without
from .tokens import text_slices
from .words import LOWER, PUNCTUATED, Words, shingles

#: words of the shortest match; shorter items match as a whole
LEAST = 5
#: benchmarks up to so many bytes of text are sent to every task; larger ones meet the documents in a join
SENT_BYTES = 64 << 20


def tiles(doc: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in doc, place in item, words), longest matches first, none overlapping another.

    pairs: places of equal runs of `width` words. Neighbours on a diagonal join into maximal matches; a match that a
    longer one has covered in part goes back with what is left of it. Equal lengths go by place in the document.
    """
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for p, q in set(pairs):
        by_diagonal[p - q].append(p)
    heap: list[tuple[int, int, int]] = []
    for diagonal, places in by_diagonal.items():
        places.sort()
        begin = places[0]
        for a, b in zip(places, [*places[1:], places[-1] + 2], strict=True):
            if b != a + 1:
                heapq.heappush(heap, (-(a - begin + width), begin, begin - diagonal))
                begin = b
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        size, p, q = heapq.heappop(heap)
        size = -size
        free = ~(in_doc[p : p + size] | in_item[q : q + size])
        if free.all():
            if (doc[p : p + size] == item[q : q + size]).all():
                in_doc[p : p + size] = in_item[q : q + size] = True
                out.append((p, q, size))
            continue
        edge = np.diff(free.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s >= width:
                heapq.heappush(heap, (-int(e - s), p + int(s), q + int(s)))
    return out


@dataclass
class Seeds:
    """Seeds of a set of items: for each width, sorted hashes with (item number, place)."""

    ids: list
    words: list[np.ndarray]
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], least: int) -> Seeds:
        w = Words(texts, PUNCTUATED, LOWER)
        own = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        rows: dict[int, list] = defaultdict(list)
        for n, h in enumerate(own):
            if len(h):
                width = min(least, len(h))
                rows[width] += [(s, n, k) for k, s in enumerate(shingles(h, width))]
        table = {}
        for width, found in rows.items():
            hashes = np.array([r[0] for r in found], np.uint64)
            order = np.argsort(hashes, kind="stable")
            marks = np.zeros(1 << 20, bool)  # rules out most words without a search
            marks[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            table[width] = (hashes[order], np.array([r[1] for r in found])[order], np.array([r[2] for r in found])[order], marks)
        return cls(ids, own, table)

    def coverage(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(text number, item id, words of the item, words covered, tiles) for every text and item that share a seed."""
        w, out = Words(texts, PUNCTUATED, LOWER), []
        owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        widths: dict[tuple[int, int], int] = {}
        for width, (hashes, items, places, marks) in self.by_width.items():
            runs = shingles(w.hash, width)
            same = owner[: len(runs)] == owner[width - 1 :] if len(runs) else np.zeros(0, bool)
            maybe = np.flatnonzero(marks[(runs & np.uint64(len(marks) - 1)).astype(np.int64)] & same)
            low, high = np.searchsorted(hashes, runs[maybe], "left"), np.searchsorted(hashes, runs[maybe], "right")
            for at, lo, hi in zip(maybe[high > low], low[high > low], high[high > low], strict=True):
                text = int(owner[at])
                for k in range(lo, hi):
                    found[text, int(items[k])].append((int(at - w.first[text]), int(places[k])))
                    widths[text, int(items[k])] = width
        for (text, item), pairs in sorted(found.items()):
            got = tiles(w.hash[w.first[text] : w.first[text + 1]], self.words[item], pairs, widths[text, item])
            out.append((text, self.ids[item], len(self.words[item]), sum(t[2] for t in got), len(got)))
        return out


_FOUND = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long"


def _cover(batches: Iterator[pa.RecordBatch], seeds: Seeds) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5
    for batch in text_slices(batches, "text"):
        ids = batch.column("id").to_pylist()
        rows = [(ids[t], *rest) for t, *rest in seeds.coverage(batch.column("text").to_pylist())]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_words", "n_covered", "n_tiles"])


def _seed_rows(batches: Iterator[pa.RecordBatch], widths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        ids, w = batch.column("id").to_pylist(), Words(batch.column("text").to_pylist(), PUNCTUATED, LOWER)
        for n, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            for width in widths:
                seeds = np.unique(shingles(w.hash[a:b], width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids[n]] * len(seeds), pa.int64()), pa.array([width] * len(seeds), pa.int32()), pa.array(seeds)], names=["id", "width", "seed"])


def _item_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, w = batch.column("id").to_pylist(), Words(batch.column("text").to_pylist(), PUNCTUATED, LOWER)
        for n, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            if b > a:
                width = min(least, int(b - a))
                seeds = np.unique(shingles(w.hash[a:b], width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids[n]] * len(seeds), pa.int64()), pa.array([width] * len(seeds), pa.int32()), pa.array(seeds)], names=["item", "width", "seed"])


def _cover_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            one = pa.RecordBatch.from_pylist([{"id": row["id"], "text": row["text"]}], schema=pa.schema([("id", pa.int64()), ("text", pa.string())]))
            yield from _cover(iter([one]), Seeds.of([row["item"]], [row["item_text"]], least))


def contamination(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, n_words, n_covered, n_tiles, coverage (at least `threshold`).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every run of `least` words of an item
    is a seed; documents that share one are tiled against the item, so passages that were moved or interrupted still
    count. Coverage is the share of the item's words under tiles. Items shorter than `least` words match as a whole.

    A benchmark of up to `sent_bytes` of text goes to every task and documents are read once, without a shuffle; beyond
    that, seeds meet in a join, and only pairs that share one are tiled. Both give the same rows.

    NULL and empty texts and items hold nothing; documents and items without an id are left out of the answer; repeated
    rows give one row. Other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bench = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= sent_bytes:
        got = bench.distinct().orderBy("id", "text").collect()
        seeds = Seeds.of([r["id"] for r in got], [r["text"] for r in got], least)
        found = rows.mapInArrow(lambda b: _cover(b, seeds), _FOUND)
    else:
        of_items = bench.mapInArrow(lambda b: _item_rows(b, least), "item long, width int, seed long").distinct()
        widths = sorted(r[0] for r in of_items.select("width").distinct().collect())  # least values at most
        of_docs = rows.mapInArrow(lambda b: _seed_rows(b, widths), "id long, width int, seed long")
        pairs = of_docs.join(of_items, ["width", "seed"]).select("id", "item").distinct()
        texts = pairs.join(rows, "id").join(bench.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
        found = texts.mapInArrow(lambda b: _cover_pairs(b, least), _FOUND)
    found = found.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= threshold)
    return found.distinct().withColumnRenamed("doc_id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns.

    Rows are judged by their text, so those without an id or with a repeated one are treated as others. NULL and empty
    texts hold nothing and stay; texts are searched whole. An empty table stays empty, an empty benchmark drops nothing.
    """
    texts = docs.select(mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    found = contamination(texts, items, threshold, least, "mark", "text", **options)
    return without(docs, found.select("mark"), [mark(text_col)])
