"""Repeated word spans: word k-mers as edges of a de Bruijn graph, repeated ones compacted into paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .drops import renamed, row_numbers
from .repeats import (
    BLOCKS, block_rows, body_slices, by_bucket, chosen_places, fragments, gathered, repeated_seeds, runs_of, spread_ranges,
    squeezed, to_ids, unpack, unsqueezed,
)
from .words import BLANK, Words, mix, shingles

#: stands for a missing id, behind all others
NO_ID = (1 << 63) - 1
#: edges that a task holds before it sends them on
HELD = 2_000_000


def _cut(width: int):
    least = min(5, width)

    def cut(texts: list):
        w = Words(texts, BLANK)
        return fragments(shingles(w.hash, least), width - least + 1, w.first[:-1], w.first[1:], width), w.first[:-1]

    return cut


def _later(edges: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by edge and id, and True (in that order) where the edge also occurs under a smaller id."""
    order = np.lexsort((ids, edges))
    e, own = edges[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    least = np.repeat(own[first], np.diff(np.append(first, len(e))))
    return order, own > least


def _paths(ids: np.ndarray, places: np.ndarray, parts: int) -> list[tuple]:
    """Blocks of (id, first edge, edges): edges that follow one another in a document are one path."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (places[1:] > places[:-1] + 1)])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(ids)) - 1
    return to_ids(ids[begin], places[begin], places[last] - places[begin] + 1, parts)


def _edges(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    cut = _cut(width)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        edges, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
        order, later = _later(edges, ids)
        edges, ids, places = edges[order], ids[order], places[order]
        if later.any():  # decided here: the same words start under a smaller id in this very task
            yield from block_rows(_paths(ids[later], places[later], parts))
        # one edge of a document is enough for the others
        keep = ~later
        edges, ids, places = edges[keep], ids[keep], places[keep]
        bucket = (edges % np.uint64(parts)).astype(np.int64)
        yield from block_rows(by_bucket(bucket, 0, ids, [places.astype(np.int32), edges]))

    held, n = [], 0
    for batch in body_slices(batches):
        texts = unsqueezed(batch.column("body").to_pylist())
        ids = np.asarray(batch.column("id").to_pylist(), np.int64)
        f, begin = cut(texts)
        wanted = np.isin(f.seed, chosen_places(batch.column("pairs").to_pylist(), begin))
        if wanted.any():
            hashes = shingles(Words(texts, BLANK).hash, width)
            place = spread_ranges(f.start[wanted], f.windows[wanted])
            text = np.repeat(f.text[wanted], f.windows[wanted])
            held.append((mix(hashes[place]), ids[text], place - begin[text]))
            n += len(place)
        if n >= HELD:
            yield from send(held)
            held, n = [], 0
    if held:
        yield from send(held)


def _first_edges(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        kinds = np.asarray(batch.column("kind").to_pylist())
        if (kinds != 0).any():
            yield batch.filter(pa.array(kinds != 0))
        for row in batch.filter(pa.array(kinds == 0)).to_pylist():
            ids, places, edges = unpack(row["body"], row["n"], [8, 4, 8])
            held.append((edges.view(np.uint64), np.cumsum(ids), places.astype(np.int64)))
    if held:
        edges, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
        order, later = _later(edges, ids)
        if later.any():
            yield from block_rows(_paths(ids[order][later], places[order][later], parts))


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows that start in a document with a smaller id too: (id, pairs), pairs of (first window, windows).

    A window of `width` words is an edge between its first and last width - 1 words. Seeds rule out windows that cannot
    occur twice; the others meet by edge. A task decides at once what repeats among its own documents and sends only
    the first occurrence of each edge, so an edge that every document has arrives as a row or two per task. Edges that
    follow one another in a document and lead back to earlier documents are compacted into paths, and only these
    coordinates come back to the document.

    NULL ids count as one id behind all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds, _ = repeated_seeds(rows, _cut(width), across=True)
    moved = squeezed(rows).join(seeds, "id").mapInArrow(lambda b: _edges(b, width, parts), BLOCKS)
    met = moved.repartitionById(parts, F.col("bucket")).mapInArrow(lambda b: _first_edges(b, parts), BLOCKS)
    return gathered(durable(met), parts)


def _removed(spans: bytes, n: int, width: int) -> np.ndarray:
    """True for every word under a span's windows."""
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    change = np.zeros(n + width + 1, np.int64)
    fits = pairs[:, 0] + pairs[:, 1] + width - 1 <= n
    pairs = pairs[fits]
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + width - 1, -1)
    return np.cumsum(change)[:n] > 0


def _apply(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in body_slices(batches):
        ids, rows = batch.column("id").to_pylist(), []
        texts = unsqueezed(batch.column("body").to_pylist())
        w = Words(texts, BLANK)
        raw = w.data.tobytes()
        for n, spans in enumerate(batch.column("pairs").to_pylist()):
            a, b = int(w.first[n]), int(w.first[n + 1])
            gone = _removed(spans or b"", b - a, width)
            words = [raw[s:e] for s, e in zip(w.start[a:b][~gone].tolist(), w.end[a:b][~gone].tolist(), strict=True)]
            begin, end = runs_of(gone)
            kept = b" ".join(words)
            rows.append((None if ids[n] == NO_ID else ids[n], b - a, int(gone.sum()), kept.decode(), np.stack([begin, end], 1).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        cols = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_words", "n_removed", "kept", "removed"])


def drop_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words of repeated windows: id, n_words, n_removed, kept (joined by one blank), removed.

    Words end at [\\x20\\x09-\\x0D] and are compared as they are; windows are judged on the input. removed lists
    (first, behind) words. NULL, empty and short texts lose nothing. Where ids are missing or repeated, rows are numbered by id (NULL
    last) and the hash of their text first, and lose what starts under a smaller number; rows that repeat an id and a
    text lose the same. Very long texts are taken whole. Other columns are not read.
    """
    docs, kinds = row_numbers(docs, id_col, text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, width, id_col, text_col)
    found = squeezed(rows).join(spans, "id", "left").mapInArrow(
        lambda b: _apply(b, width), "id long, n_words long, n_removed long, kept string, removed array<array<long>>"
    ).withColumnRenamed("id", id_col)
    return renamed(found, kinds, id_col)
