"""Two tokenizations of a text aligned: groups between the byte offsets where tokens of both end, and counts of linked ids."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .tokens import _ENCODERS, _give_up_idle, give_up, places, text_slices, trim

#: a single blank between two other characters: no token of either kind crosses into it from the left
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: a blank beside another one
_LOOSE = re.compile(r" (?:\s|(?<=\s ))")
#: units that a worker remembers, and the longest of them in characters
ROOM = 300_000
SHORT = 40
#: units that are encoded and aligned as one text
JOINED = 512


def common_cuts(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """The result of `cut_counts` as a list of pairs."""
    at, place = cut_counts(np.array(ends_a), np.array(ends_b))
    return list(zip(at.tolist(), place.tolist(), strict=True))


def cut_counts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens (of a, of b) before each common end, in order; both arrays rise and share their last value.

    Divide and conquer: from the middle of the ends of `a` that are still untried, the nearest one that bisection finds
    among those of `b` divides the interval, and both sides go on. Ends found missing on the way border the side
    they fall to and are not tried again. An interval without such an end is a leaf: one group. All open intervals take
    their next step together, so one bisection call serves them all.
    """
    cuts_a, cuts_b = [np.array([len(ends_a)])], [np.array([len(ends_b)])]
    low, high = np.array([0]), np.array([len(ends_a) - 1])  # untried ends of a
    low, high = low[low < high], high[low < high]
    left = right = (low + high) // 2  # those from left to right - 1 have been tried in vain
    turn = np.zeros(len(low), bool)  # whether the next one lies on the left
    while len(low):
        on_left = (left > low) & (turn | (right >= high))
        at = np.where(on_left, left - 1, right)
        place = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[place] == ends_a[at]
        cuts_a.append(at[hit] + 1)
        cuts_b.append(place[hit] + 1)
        left, right = np.where(on_left, at, left), np.where(on_left, right, at + 1)
        miss = ~hit & ((left > low) | (right < high))
        lows, highs = np.concatenate([low[hit], right[hit]]), np.concatenate([left[hit], high[hit]])
        new = lows < highs
        lows, highs = lows[new], highs[new]
        middle = (lows + highs) // 2
        turn = np.concatenate([~on_left[miss], np.zeros(len(lows), bool)])
        left, right = np.concatenate([left[miss], middle]), np.concatenate([right[miss], middle])
        low, high = np.concatenate([low[miss], lows]), np.concatenate([high[miss], highs])
    at, place = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(at)
    return at[order], place[order]


def byte_level(entry: str, of: dict[str, int]) -> bytes:
    return bytes(of[c] for c in entry)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their ids, and a bounded memory of units already aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        of = byte_characters()
        with open(path_a, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            if all(c in of for c in entry):
                self.bytes_a[i] = byte_level(entry, of)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.known = pa.array([], pa.large_string())
        self.groups, self.links = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.sizes = np.zeros((0, 2), np.int32)  # numbers of a and of b
        self.used = [0.0]

    def _aligned(self, units: list[str]) -> list[tuple | None]:
        """(groups, links, number of a | number of b << 32) of a blank and each unit; None where the bytes of either differ.

        The units are encoded and aligned as one text, as no token crosses from one to the next; if their bytes or ends
        are not found again, each half is taken by itself.
        """
        text = " ".join(units)
        raw = b" " + text.encode()
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        found = bool(a and b) and b"".join(parts_a) == raw and b"".join(parts_b) == raw
        if found:
            ends_a, ends_b = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) for parts in (parts_a, parts_b))
            wanted = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
            to_a, to_b = cut_counts(ends_a, ends_b)
            ends = ends_a[to_a - 1]
            last = np.searchsorted(ends, wanted)
            found = bool((ends[last] == wanted).all())
        if not found:
            half = len(units) // 2
            return [*self._aligned(units[:half]), *self._aligned(units[half:])] if half else [None]
        names_a, names_b = list(map(str, a)), list(map(str, b))
        xs, ys = to_a.tolist(), to_b.tolist()
        groups = [
            names_a[i] + "|" + names_b[j] if x - i == 1 and y - j == 1 else ",".join(names_a[i:x]) + "|" + ",".join(names_b[j:y])
            for i, x, j, y in zip([0, *xs], xs, [0, *ys], ys, strict=False)
        ]
        links = (np.array(a, "<u8")[to_a - 1] | np.array(b, "<u8")[to_b - 1] << np.uint64(32)).tobytes()
        sizes = np.diff(to_a[last] | to_b[last] << 32, prepend=0).tolist()
        stops = (last + 1).tolist()
        return [(";".join(groups[i:j]), links[8 * i : 8 * j], n) for i, j, n in zip([0, *stops], stops, sizes, strict=False)]

    def _learn(self, units: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Columns of units that are not known: groups and links (NULL where the bytes differ), sizes, and whose rows they are."""
        # units with blanks of their own are aligned alone: their blanks would not stay single
        loose = np.fromiter((u[0].isspace() or u[-1].isspace() for u in units), bool, len(units))
        alone, joint = np.flatnonzero(loose).tolist(), np.flatnonzero(~loose).tolist()
        parts = [[i] for i in alone] + [joint[i : i + JOINED] for i in range(0, len(joint), JOINED)]
        groups, links, sizes = [self.groups[:0]], [self.links[:0]], [np.zeros(0, np.int64)]
        for part in parts:
            own_groups, own_links, n = zip(*(x or (None, None, 0) for x in self._aligned([units[i] for i in part])), strict=True)
            groups.append(pa.array(own_groups, pa.large_string()))
            links.append(pa.array(own_links, pa.large_binary()))
            sizes.append(np.array(n, np.int64))
        n = np.concatenate(sizes)
        both = np.stack([n & 0xFFFFFFFF, n >> 32], 1).astype(np.int32)
        return pa.concat_arrays(groups), pa.concat_arrays(links), both, np.array([*alone, *joint], np.int64)

    def align(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Groups, links and numbers of a and b of whole texts. A unit is what lies between single blanks; its end is an end of both tokenizations.

        Units are told apart, looked up and put together as columns, Python sees a unit only to align it.
        """
        self.used[0] = time.monotonic()
        cut = [
            (_BETWEEN.split(text) if text[0].isspace() or text[-1].isspace() or _LOOSE.search(text) else text.split(" ")) if text else []
            for text in texts.to_pylist()
        ]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        coded = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        del cut
        codes, words = coded.indices.to_numpy(), coded.dictionary
        place = places(words, self.known)
        missing = np.flatnonzero(place < 0)
        fresh = words.take(pa.array(missing))
        groups, links, sizes, order = self._learn(fresh.to_pylist())
        place[missing[order]] = len(self.known) + np.arange(len(missing))
        short = pc.less_equal(pc.utf8_length(fresh), SHORT).to_numpy(zero_copy_only=False)[order]
        kept = np.flatnonzero(short)[: max(0, ROOM - len(self.known))]  # as many as there is room for stay
        stay, known = pa.array(kept), pa.concat_arrays([self.known, fresh.take(pa.array(order[kept]))])
        all_groups, all_links = pa.concat_arrays([self.groups, groups]), pa.concat_arrays([self.links, links])
        all_sizes = np.concatenate([self.sizes, sizes])
        if len(kept):
            self.groups, self.links = pa.concat_arrays([self.groups, groups.take(stay)]), pa.concat_arrays([self.links, links.take(stay)])
            self.known, self.sizes = known, np.concatenate([self.sizes, sizes[kept]])
        lost = all_groups.is_null().to_numpy(zero_copy_only=False)[place][codes]
        if lost.any():  # texts with such a unit have no tokens
            hit = np.zeros(len(lengths), bool)
            hit[np.searchsorted(np.cumsum(lengths), np.flatnonzero(lost), side="right")] = True
            codes, lengths = codes[~np.repeat(hit, lengths)], np.where(hit, 0, lengths)
        bounds, where = np.concatenate([[0], np.cumsum(lengths)]), place[codes]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), all_groups.take(pa.array(where)))
        shown = pc.binary_join(lists, pa.scalar(";", pa.large_string()))
        picked = all_links.take(pa.array(where))
        ends = np.frombuffer(picked.buffers()[1], np.int64)[: len(where) + 1][bounds] if len(where) else bounds
        joined = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), picked.buffers()[2]])
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(all_sizes[where], 0, np.int64)])[bounds]
        return shown, joined, np.diff(sums, axis=0)


def _digests(column: pa.Array) -> list[str]:
    """The sha256 of each text where it lies; empty ones for empty texts."""
    ends, raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1].tolist(), memoryview(column.buffers()[2] or b"")
    return [hashlib.sha256(raw[a:b]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _pair(path_a: str, path_b: str) -> Pair:
    """One pair for all tasks of a worker process, given up like an encoder once no task has used it for a while."""
    key = path_a, path_b
    if key not in _ENCODERS:
        _ENCODERS[key] = Pair(path_a, path_b), [time.monotonic()]
        threading.Thread(target=_give_up_idle, args=(key,), daemon=True).start()
    found, used = _ENCODERS[key]
    found.used = used
    used[0] = time.monotonic()
    return found


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, digest: bool) -> Iterator[pa.RecordBatch]:
    pair = _pair(path_a, path_b)
    for batch in text_slices(batches, "text"):
        groups, links, n = pair.align(batch.column("text"))
        shown = pa.array(_digests(groups), pa.string()) if digest else groups.cast(pa.string())
        sizes = np.diff(_links(links)[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(sizes), shown, links],
            names=["id", "n_a", "n_b", "n_groups", "groups", "links"],
        )


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Every row with its alignment: id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`, or its sha256), links.

    Byte offsets where a token of each tokenizer ends cut both id lists into groups. A link is the pair of ids that end
    a group: `a | b << 32` as little-endian unsigned 64-bit integers, in order. The text is encoded with a blank
    before it. NULL and empty texts, and texts whose tokens do not join to the same bytes, have no tokens. Rows that
    repeat a text or an id are all returned, NULL ids too. Texts are taken whole, whatever their length; one is held at
    a time beside a slice of others. Other columns are not read, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(lambda b: _align(b, path_a, path_b, digest), f"id {kind}, n_a long, n_b long, n_groups long, groups string, links binary")


#: rows whose links are counted or looked up at once
STEP = 200
#: distinct links that are held before they are merged
HELD = 1_000_000


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The links of all rows where they lie, without a copy, and the number of links before each row and after the last."""
    if not len(column):
        return np.zeros(0, "<u8"), np.zeros(1, np.int64)
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n = int(ends[-1] - ends[0]) // 8
    return np.frombuffer(data, "<u8", n, int(ends[0])) if n else np.zeros(0, "<u8"), (ends - ends[0]) // 8


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    links, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    n = np.zeros(len(links), np.int64)
    np.add.at(n, place, np.concatenate([x for _, x in held]))
    return links, n


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the links of a task; at most `HELD` distinct ones and those of one step are held."""
    give_up()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counts() -> pa.RecordBatch:
        links, n = held[0]
        a, b = links & np.uint64(0xFFFFFFFF), links >> np.uint64(32)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, n)], names=["a", "b", "n"])

    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            held.append(np.unique(_links(whole.slice(at, STEP).column("links"))[0], return_counts=True))
            if sum(len(x) for x, _ in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield counts()
                    held = []
    if held:
        held = [_merged(held)]
        yield counts()
    trim()


def link_counts(rows: DataFrame) -> DataFrame:
    """How many links hold each pair of ids: a, b, n.

    Of two tokens that end together one is a tail of the other, so the table has at most one row for each tail
    of each vocabulary entry, whatever the size of the corpus.
    """
    counted = rows.select("links").mapInArrow(_pairs, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _judge(batches: Iterator[pa.RecordBatch], links: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    give_up()
    for whole in batches:
        names = [c for c in whole.schema.names if c != "links"]
        for at in range(0, whole.num_rows, STEP):
            batch = whole.slice(at, STEP)
            raw, ends = _links(batch.column("links"))
            place = np.searchsorted(links, raw)
            found = []
            for x in (best, counts):
                sums = np.concatenate([[0], np.cumsum(x[place])])
                found.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], names=[*names, "n_best", "count_sum"])


#: rows of the table of linked pairs; two vocabularies of 50,000 entries have some hundred thousand tails
MOST_PAIRS = 5_000_000


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of `aligned` without links, with n_best (links whose count is the highest of their b, ties included) and count_sum."""
    table = counts.limit(MOST_PAIRS + 1).toArrow()
    if table.num_rows > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} linked pairs: these are not two vocabularies of byte strings")
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.lexsort((a, b))
    b, n = b[order], n[order]
    links = (a[order] | b << 32).astype(np.uint64)
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    best = (n == highest[b]).astype(np.int64) if len(n) else n
    kept = [f for f in rows.schema.fields if f.name != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return rows.select(*[f.name for f in kept], "links").mapInArrow(lambda it: _judge(it, links, n, best), schema)


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty without tokens).

    Texts are encoded once: what the counts need is stored before the corpus-wide counts are looked up.
    Edge cases are those of `aligned`.
    """
    found = aligned(docs, path_a, path_b, id_col, text_col, digest=True)
    rows = durable(found.select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.col("groups").alias("groups_sha256"), "links"))
    return scored(rows, link_counts(rows)).withColumnRenamed("id", id_col)
