"""Repeated byte strings: a sparse enhanced suffix array, scanned for common-prefix intervals with diverse left sides."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .debruijn import NO_ID
from .drops import renamed, row_numbers
from .repeats import (
    BLOCKS, FOUND, block_rows, body_slices, by_bucket, chosen_places, edges_of, fragments, gathered, pack, repeated_seeds, runs_of,
    spread_ranges, squeezed, to_ids, unpack, unsqueezed,
)
from .words import Words, short_hashes

#: bytes of a seed
SEED = 16
#: fragments and single windows that a task holds before it sends them on
HELD = 400_000


def _seed_size(span: int) -> int:
    return min(SEED, span)


def _cut_words(texts: list, span: int):
    w, k = Words(texts), _seed_size(span)
    return w, fragments(short_hashes(w.data, k), span - k + 1, w.text_start[:-1], w.text_start[1:] - 1, span)


def _cut(span: int):
    def cut(texts: list):
        w, f = _cut_words(texts, span)
        return f, w.text_start[:-1]

    return cut


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first row, behind last row) of a sorted list, deepest first, by one stack scan.

    lcp[i] is the common prefix of rows i - 1 and i. Only depths of at least `least` are reported.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        begin = i - 1
        while stack and stack[-1][0] > depth:
            top, begin = stack.pop()
            if top >= least:
                yield top, begin, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def maximal_groups(rights: list[bytes], lefts: list[bytes], span: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats around one place: (bytes to the left, bytes to the right, rows), left + right >= span.

    rights are the texts from the place on, lefts those before it read backwards. The rows of every common-prefix
    interval of the sorted rights are sorted by their left sides in turn; intervals of that order end where the left
    sides differ, so each group reported extends neither way.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common(rights[a], rights[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    for right, a, b in intervals(lcp, 1):
        need = max(0, span - right)
        rows = sorted(order[a:b], key=lefts.__getitem__)
        back = [0] + [common(lefts[x], lefts[y]) for x, y in zip(rows[:-1], rows[1:], strict=True)]
        for left, c, d in intervals(back, need):
            yield left, right, rows[c:d]


def _fragment_blocks(bucket: np.ndarray, ids: np.ndarray, place: np.ndarray, offset: np.ndarray, texts: list[bytes]) -> list[tuple]:
    """Blocks of fragments: numbers first, then the joined texts."""
    import zstandard

    order = np.argsort(bucket, kind="stable")
    edges, out = edges_of(bucket[order]), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        sizes = np.array([len(texts[i]) for i in rows], np.int32)
        numbers = pack([np.diff(ids[rows], prepend=0), place[rows], sizes, offset[rows].astype(np.int32)])
        joined = zstandard.ZstdCompressor(level=3).compress(b"".join([texts[i] for i in rows]))
        out.append((int(bucket[rows[0]]), 0, int(b - a), len(numbers).to_bytes(8, "little") + numbers + joined))
    return out


def _first_of(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """True for the first occurrence (id, place) of every key."""
    order = np.lexsort((places, ids, keys))
    out = np.zeros(len(keys), bool)
    k = keys[order]
    out[order] = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else False
    return out


def _send(batches: Iterator[pa.RecordBatch], span: int, parts: int, hot: np.ndarray, fold: bool) -> Iterator[pa.RecordBatch]:
    """kind 0: fragments by seed; kind 1: single windows of hot seeds; kind FOUND: ranges decided here."""

    def send(frags: list, windows: list) -> Iterator[pa.RecordBatch]:
        if frags:
            seed, ids, place, offset = (np.concatenate(x) for x in list(zip(*frags, strict=True))[:4])
            texts = [t for f in frags for t in f[4]]
            kinds: dict[tuple[int, bytes], int] = {}
            key = np.fromiter((kinds.setdefault(x, len(kinds)) for x in zip(offset.tolist(), texts, strict=True)), np.int64, len(texts))
            first = _first_of(key, ids, place) if fold else np.ones(len(key), bool)
            size = np.array([len(t) for t in texts], np.int64)
            rest = ~first
            if rest.any():
                yield from block_rows(to_ids(ids[rest], place[rest], place[rest] + size[rest], parts))
            at = np.flatnonzero(first)
            bucket = (seed[at] % np.uint64(parts)).astype(np.int64)
            yield from block_rows(_fragment_blocks(bucket, ids[at], place[at], offset[at], [texts[i] for i in at]))
        if windows:
            key, ids, place = (np.concatenate(x) for x in zip(*windows, strict=True))
            first = _first_of(key, ids, place)
            rest = ~first
            if rest.any():
                yield from block_rows(to_ids(ids[rest], place[rest], place[rest] + span, parts))
            bucket = (key[first] % np.uint64(parts)).astype(np.int64)
            yield from block_rows(by_bucket(bucket, 1, ids[first], [key[first], place[first]]))

    frags, windows, n = [], [], 0
    for batch in body_slices(batches):
        ids = np.asarray(batch.column("id").to_pylist(), np.int64)
        w, f = _cut_words(unsqueezed(batch.column("body").to_pylist()), span)
        begin = w.text_start[:-1]
        wanted = np.isin(f.seed, chosen_places(batch.column("pairs").to_pylist(), begin))
        many = wanted & np.isin(f.hash, hot)
        few = np.flatnonzero(wanted & ~many)
        if len(few):
            raw = w.data.tobytes()
            start, end = f.start[few], f.start[few] + f.windows[few] + span - 1
            texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            offset = f.seed[few] - start
            frags.append((f.hash[few], ids[f.text[few]], start - begin[f.text[few]], offset, texts))
            n += len(few)
        if many.any():
            place = spread_ranges(f.start[many], f.windows[many])
            text = np.repeat(f.text[many], f.windows[many])
            windows.append((w.between(place, place + span), ids[text], place - begin[text]))
            n += len(place) // 8
        if n >= HELD:
            yield from send(frags, windows)
            frags, windows, n = [], [], 0
    yield from send(frags, windows)


def _read_fragments(row: dict) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, place, offset of the seed, text) of a block."""
    import zstandard

    size = 8 + int.from_bytes(row["body"][:8], "little")
    ids, place, sizes, offset = unpack(row["body"][8:size], row["n"], [8, 8, 4, 4])
    joined = zstandard.ZstdDecompressor().decompress(row["body"][size:])
    ends = np.cumsum(sizes.astype(np.int64)).tolist()
    begin = 0
    for i, p, o, e in zip(np.cumsum(ids).tolist(), place.tolist(), offset.tolist(), ends, strict=True):
        yield i, p, o, joined[begin:e]
        begin = e


def _groups(rows: list[dict], span: int) -> Iterator[tuple[int, int, list[list[tuple[int, int]]]]]:
    """Maximal repeats of the fragments of a task: (left, right, occurrences (id, place of the seed) by distinct fragment)."""
    k = _seed_size(span)
    by_seed: dict[bytes, dict[tuple[int, bytes], list[tuple[int, int]]]] = defaultdict(dict)
    for row in rows:
        for i, place, offset, text in _read_fragments(row):
            by_seed[text[offset : offset + k]].setdefault((offset, text), []).append((i, place + offset))
    for own in by_seed.values():
        if len(own) > 1 or any(len(v) > 1 for v in own.values()):
            kinds = list(own)
            found = [own[x] for x in kinds]
            for (offset, text), places in own.items():
                if len(places) > 1:
                    yield offset, len(text) - offset, [places]
            if len(kinds) > 1:
                for left, right, rows_ in maximal_groups([t[o:] for o, t in kinds], [t[:o][::-1] for o, t in kinds], span):
                    yield left, right, [found[r] for r in rows_]


def _resolve(batches: Iterator[pa.RecordBatch], span: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, begin, end): bytes under strings that start earlier as well."""
    blocks, windows = [], []
    for batch in batches:
        kinds = np.asarray(batch.column("kind").to_pylist())
        if (kinds == FOUND).any():
            yield batch.filter(pa.array(kinds == FOUND))
        for row in batch.filter(pa.array(kinds != FOUND)).to_pylist():
            if row["kind"] == 0:
                blocks.append(row)
            else:
                ids, key, place = unpack(row["body"], row["n"], [8, 8, 8])
                windows.append((key.view(np.uint64), np.cumsum(ids), place))
    if windows:
        key, ids, place = (np.concatenate(x) for x in zip(*windows, strict=True))
        rest = ~_first_of(key, ids, place)
        yield from block_rows(to_ids(ids[rest], place[rest], place[rest] + span, parts))
    ids, begin, end = [], [], []
    for left, right, members in _groups(blocks, span):
        first = min(min(m) for m in members)
        for m in members:
            for occurrence in m:
                if occurrence != first:
                    ids.append(occurrence[0])
                    begin.append(occurrence[1] - left)
                    end.append(occurrence[1] + right)
    yield from block_rows(to_ids(*(np.array(x, np.int64) for x in (ids, begin, end)), parts))


def _moved(docs: DataFrame, span: int, id_col: str, text_col: str, hot: int | None, fold: bool) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # seeds above the limit are few: each takes a thousandth of the documents at least
    limit = (max(2000, docs.count() // 1000) if hot is None else hot) if fold else 0
    seeds, many = repeated_seeds(rows, _cut(span), across=False, hot=limit)
    moved = squeezed(rows).join(seeds, "id").mapInArrow(lambda b: _send(b, span, parts, many, fold), BLOCKS)
    return moved.repartitionById(parts, F.col("bucket")), parts


def covered(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """(id, pairs): byte ranges (begin, end) of every document under strings of `span` bytes that start earlier too.

    Suffixes are sampled: each string of `span` bytes has one seed, and strings that are equal have it at the same
    offset. Fragments around seeds that occur again meet by seed, are sorted by the text from the seed on, and a stack
    scan of their common prefixes gives every interval; sorting its rows by the text before the seed gives the groups
    that cannot be extended to the left either.

    A task sends the first of equal fragments only and decides the others. Seeds that occur more than `hot` times (a
    thousandth of the documents, 2000 at least) do not meet in one task: their fragments are taken apart into single
    strings of `span` bytes, which meet by content and are folded on both sides of the shuffle.
    """
    moved, parts = _moved(docs, span, id_col, text_col, hot, fold=True)
    return gathered(durable(moved.mapInArrow(lambda b: _resolve(b, span, parts), BLOCKS)), parts)


def maximal_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats with all their occurrences, one row per occurrence: group_id, length, id, start (bytes).

    A repeat is maximal within its fragment (up to 2 * span bytes around its seed): longer ones are chains of groups
    that overlap. Groups are whole, so a string that very many documents share is listed by one task; to remove
    repeats use drop_repeats, which has no such task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row for batch in batches for row in batch.to_pylist() if row["kind"] == 0]
        for left, right, members in _groups(blocks, span):
            places = sorted({o for m in members for o in m})
            name = f"{places[0][0]}:{places[0][1] - left}:{left + right}:{places[0][1]}"
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([left + right] * n, pa.int64()), pa.array([p[0] if p[0] != NO_ID else None for p in places], pa.int64()), pa.array([p[1] - left for p in places], pa.int64())],
                names=["group_id", "length", "id", "start"],
            )

    moved, _ = _moved(docs, span, id_col, text_col, None, fold=False)
    return moved.mapInArrow(run, "group_id string, length long, id long, start long")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in body_slices(batches):
        ids, rows = batch.column("id").to_pylist(), []
        for n, (text, ranges) in enumerate(zip(unsqueezed(batch.column("body").to_pylist()), batch.column("pairs").to_pylist(), strict=True)):
            raw = np.frombuffer(text.encode(), np.uint8)
            pairs = np.frombuffer(ranges or b"", np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 1] <= len(raw)]
            change = np.bincount(pairs[:, 0], minlength=len(raw) + 1) - np.bincount(pairs[:, 1], minlength=len(raw) + 1)
            gone = np.cumsum(change)[: len(raw)] > 0
            begin, end = runs_of(gone)
            rows.append((None if ids[n] == NO_ID else ids[n], len(raw), int(gone.sum()), len(begin), raw[~gone].tobytes(), np.stack([begin, end], 1).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "removed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def drop_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """Every document without bytes under repeated strings: id, n_bytes, n_removed, n_spans, kept (bytes), removed.

    Texts are UTF-8; strings never cross documents and are judged on the input. Earlier is a smaller id, or the same
    document and an earlier start. removed lists (first, behind) bytes of the maximal removed runs. NULL, empty and
    short texts lose nothing. Where ids are missing or repeated, rows are numbered by id (NULL
    last) and the hash of their text first, and lose what starts under a smaller number; rows that repeat an id and a
    text lose the same. Very long texts are taken whole. Other columns are not read.
    """
    docs, kinds = row_numbers(docs, id_col, text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    ranges = covered(docs, span, id_col, text_col, hot)
    found = squeezed(rows).join(ranges, "id", "left").mapInArrow(
        _apply, "id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>"
    ).withColumnRenamed("id", id_col)
    return renamed(found, kinds, id_col)
