"""Fragments of texts around chosen seeds, and the seeds that occur more than once.

Every window (so many bytes or words in a row) has a seed: the place in it with the smallest hash of a few bytes or
words. Equal windows choose equal seeds at equal offsets, so only fragments - runs of windows with one seed - whose seed
occurs again can hold a repeated window. All others need never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .tokens import text_slices, trim

#: fragments that a task holds before it sends them on
HELD = 1_000_000
_PLACE = np.uint64((1 << 26) - 1)


@dataclass
class Fragments:
    """Runs of windows that share a seed; places count in the whole slice."""

    text: np.ndarray  # number of the text
    start: np.ndarray  # first window
    windows: np.ndarray  # number of windows
    seed: np.ndarray  # place of the seed
    hash: np.ndarray  # its hash


def fragments(hashes: np.ndarray, reach: int, begin: np.ndarray, end: np.ndarray, span: int) -> Fragments:
    """Fragments of texts that lie at begin[i] to end[i]; hashes[p] is that of the seed at p.

    A window at p takes the leftmost smallest of the `reach` seeds from p on. Slices longer than 2^26 places are cut
    into pieces that overlap by a window; the choice does not depend on the cut.
    """
    n_windows = np.maximum(end - begin - span + 1, 0)
    total = int(n_windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Fragments(none, none, none, none, np.zeros(0, np.uint64))
    chosen = np.empty(len(hashes), np.int64)
    step = 1 << 22
    for a in range(0, len(hashes), step):
        part = hashes[a : a + step + reach - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % reach + reach
        rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, reach)
        head = np.minimum.accumulate(rows, 1).reshape(-1)
        tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
        m = min(step, len(hashes) - a)
        chosen[a : a + m] = a + (np.minimum(tail[:m], head[reach - 1 : reach - 1 + m]) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(begin)), n_windows)
    first = np.concatenate([[0], np.cumsum(n_windows)[:-1]])
    window = np.arange(total) - first[text] + begin[text]
    seed = chosen[window]
    new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]))
    return Fragments(text[new], window[new], np.diff(np.append(new, total)), seed[new], hashes[seed[new]])


#: texts of a slice -> (fragments, place of each text)
Cut = Callable[[list], tuple[Fragments, np.ndarray]]


def _repeated(seeds: np.ndarray, ids: np.ndarray, across: bool) -> np.ndarray:
    """True where the seed occurs again (across: under another id)."""
    order = np.argsort(seeds, kind="stable")
    s, own = seeds[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    if across:
        many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(s) else np.zeros(0, bool)
    else:
        many = np.diff(np.append(first, len(s))) > 1
    out = np.zeros(len(seeds), bool)
    out[order] = many[group]
    return out


def edges_of(keys: np.ndarray) -> np.ndarray:
    """Begin of every run of equal keys, and the end of the last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as compressed byte planes."""
    import zstandard

    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(body: bytes, n: int, widths: list[int]) -> list[np.ndarray]:
    """Columns of n numbers, each so many bytes wide."""
    import zstandard

    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), [], 0
    for w in widths:
        out.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(f"<i{w}").reshape(-1))
        at += w * n
    return out


#: rows that carry blocks of numbers: which bucket they belong to, what they are, how many numbers a column has
BLOCKS = "bucket int, kind int, n int, body binary"
_BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])


def block_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 512):
        cols = zip(*rows[a : a + 512], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)


def by_bucket(bucket: np.ndarray, kind: int, ids: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """One block per bucket: ids as differences, then the columns."""
    order = np.lexsort((columns[0], ids, bucket))
    own, ids, columns = bucket[order], ids[order], [c[order] for c in columns]
    edges = edges_of(own)
    return [
        (int(own[a]), kind, int(b - a), pack([np.diff(ids[a:b], prepend=0), *[c[a:b] for c in columns]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


#: what is found about a document, as pairs of numbers
FOUND = 9


def to_ids(ids: np.ndarray, first: np.ndarray, second: np.ndarray, parts: int) -> list[tuple]:
    """Blocks of (id, pair of numbers), one for each of the parts that ids are dealt to."""
    return by_bucket(np.mod(ids, parts), FOUND, ids, [first, second])


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            ids, first, second = unpack(row["body"], row["n"], [8, 8, 8])
            held.append((np.cumsum(ids), first, second))
    if held:
        ids, first, second = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((first, ids))
        ids, pairs = ids[order], np.stack([first[order], second[order]], 1)
        edges = edges_of(ids)
        for a in range(0, len(edges) - 1, 1000):
            part = edges[a : a + 1001]
            lists = [pairs[x:y].tobytes() for x, y in zip(part[:-1], part[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part[:-1]]), pa.array(lists, pa.binary())], names=["id", "pairs"])


def gathered(blocks: DataFrame, parts: int) -> DataFrame:
    """(id, pairs): what blocks of the kind FOUND say about each id, as 64-bit pairs in order."""
    return blocks.where(F.col("kind") == FOUND).repartitionById(parts, F.col("bucket")).mapInArrow(_at_home, "id long, pairs binary")


def _spread(batches: Iterator[pa.RecordBatch], cut: Cut, parts: int, across: bool) -> Iterator[pa.RecordBatch]:
    def send(held: list) -> Iterator[pa.RecordBatch]:
        seeds, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
        known = _repeated(seeds, ids, across)
        # what is known to repeat goes on as it is; of each such seed two stand for all, under two ids where it has them
        order = np.lexsort((ids, seeds))
        s, k = seeds[order], known[order]
        edge = np.concatenate([[True], s[1:] != s[:-1]])
        last = np.concatenate([s[1:] != s[:-1], [True]])
        sent, weight = np.zeros(len(seeds), bool), np.ones(len(seeds), np.int64)
        sent[order] = ~k | edge | last
        # the first stands for all that are not sent
        size = np.diff(np.append(np.flatnonzero(edge), len(s)))
        weight[order[edge]] = np.where(k[edge], np.maximum(size - 1, 1), 1)
        bucket = ((seeds >> np.uint64(26)) % np.uint64(parts)).astype(np.int64)
        yield from block_rows(by_bucket(bucket[sent], 0, ids[sent], [seeds[sent], places[sent], weight[sent]]))
        yield from block_rows(to_ids(ids[known], places[known], np.ones(int(known.sum()), np.int64), parts))

    held, n = [], 0
    for batch in text_slices(batches, "text"):
        ids = np.asarray(batch.column("id").to_pylist(), np.int64)
        found, begin = cut(batch.column("text").to_pylist())
        if len(found.text):
            held.append((found.hash, ids[found.text], found.seed - begin[found.text]))
            n += len(found.text)
        if n >= HELD:
            yield from send(held)
            held, n = [], 0
    if held:
        yield from send(held)


#: a list of seeds that occur very often
HOT = 8


def _meet(batches: Iterator[pa.RecordBatch], parts: int, across: bool, hot: int) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        if 0 not in batch.column("kind").to_pylist():
            yield batch
            continue
        for row in batch.to_pylist():
            if row["kind"]:
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)
            else:
                ids, seeds, places, weight = unpack(row["body"], row["n"], [8, 8, 8, 8])
                held.append((seeds.view(np.uint64), np.cumsum(ids), places, weight))
    if held:
        seeds, ids, places, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, which = np.unique(seeds, return_inverse=True)
        total = np.bincount(which, weight)
        if hot and (total > hot).any():
            yield from block_rows([(0, HOT, int((total > hot).sum()), kinds[total > hot].tobytes())])
        again = _repeated(seeds, ids, across)
        yield from block_rows(to_ids(ids[again], places[again], np.ones(int(again.sum()), np.int64), parts))


def repeated_seeds(rows: DataFrame, cut: Cut, across: bool, hot: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, pairs): the seeds of each id that occur again, as pairs (place within the text, 1); and the hot seeds.

    rows: (id, text), ids not NULL. Tasks keep what repeats among their own fragments and send one or two of each such
    seed, so a passage that every document shares is met as a few rows per task; the rest is met by seed, as
    compressed blocks, one for each part. What is found goes back as one block for each part of the ids. Parts are
    the session's shuffle partitions.

    Hot seeds (64-bit hashes) are those that occur more than `hot` times; 0 asks for none.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(lambda b: _spread(b, cut, parts, across), BLOCKS)
    met = durable(blocks.repartitionById(parts, F.col("bucket")).mapInArrow(lambda b: _meet(b, parts, across, hot), BLOCKS))
    lists = met.where(F.col("kind") == HOT).select("body").collect() if hot else []
    return gathered(met, parts), np.unique(np.frombuffer(b"".join(bytes(r[0]) for r in lists), np.uint64))


def squeezed(rows: DataFrame) -> DataFrame:
    """(id, body): texts as zstandard frames, so that moving them costs less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in text_slices(batches, "text"):
            body = [squeeze((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(body, pa.binary())], names=["id", "body"])

    return rows.mapInArrow(run, "id long, body binary")


def unsqueezed(bodies: list[bytes]) -> list[str]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(b).decode() for b in bodies]


def body_slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where the squeezed bodies of a slice pass `size` bytes."""
    for batch in batches:
        lengths = [len(b) for b in batch.column("body").to_pylist()]
        begin = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(begin, i - begin)
                begin = i
                total = 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    trim()


def chosen_places(pairs: list[bytes], begin: np.ndarray) -> np.ndarray:
    """Places of a slice from the stored pairs of each of its texts, in order."""
    own = [np.frombuffer(p, np.int64)[::2] + b for p, b in zip(pairs, begin, strict=True)]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of True."""
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spread_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] numbers each, one after another."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first - start, count)
