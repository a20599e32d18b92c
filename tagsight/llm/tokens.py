"""Whole texts to ids of a public tokenizer, with a bounded memory of units already seen."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import threading
import time
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space by Unicode's property. str.isspace() also takes \x1c-\x1f, which the tokenizers' patterns do not.
_ODD = r"[\x00\x1c-\x1f]"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Letters of fixed kind in every version of Unicode (without the one that becomes two when lower-cased), and the signs of
# ASCII: no token of the patterns holds both.
_LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_SIGNED = rf"^(?s:(?P<stem>.*[{_LATIN}])(?P<tail>[!-/:-@\[-\x60{{-~]+))$"
_EDGED = rf"^\x00?{_SPACE}|{_SPACE}$|^\x00?$"
_EMPTY, _FIRST = pa.scalar("", pa.large_string()), pa.scalar("\0", pa.large_string())
#: texts of one slice of a batch, in characters; the encoders take larger ones, where units repeat more often
SLICE = 1_000_000
BULK = 4_000_000
#: units that a worker remembers (about 100 bytes each, with their ids), and the longest of them in characters
ROOM = 1_000_000
SHORT = 48
#: units that are encoded as one text, and texts that the library gets at once
JOINED = 100
TOGETHER = 200
#: units whose ids are put together at once
PART = 100_000


class Encoder:
    """Encodes through the tokenizers library, which sees every distinct unit once as long as there is room.

    A unit is a piece of text that no token crosses. With `spaced` (byte-level patterns, where a word owns the blank
    before it) texts are cut before single blanks, and on both sides of single line breaks, between two other
    characters; otherwise (patterns that drop white space) at blanks and line breaks. Where this does not hold, the
    whole text is encoded at once. The ids equal those of the whole text in every case.

    Units are told apart, looked up and put together as columns; Python sees a unit only to encode it. NUL before a
    unit says that it has no blank before it. New units are encoded without the signs after them, which are units of
    their own, and in small letters where the tokenizer takes them so.
    """

    def __init__(self, path: str, spaced: bool, room: int = ROOM):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.room = spaced, room
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used = [0.0]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(1 + max(vocab.values()), np.int64)  # bytes of each id: one character each in byte-level entries
        for entry, i in vocab.items():
            self.sizes[i] = len(entry)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split, normal = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer
        self.signs, self.lines = len(split("a.")) == 2, not spaced or len(split("a.\nb")) == 4
        self.small = not spaced and normal is not None and normal.normalize_str(ascii_uppercase) == ascii_lowercase

    @property
    def units(self) -> list[str]:
        return self.known.to_pylist()

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a in range(0, len(texts), TOGETHER):
            for e in self.tokenizer.encode_batch_fast(texts[a : a + TOGETHER], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _ids_by_bytes(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and numbers of ids of units, each after a blank, many in one text: ids are dealt out by their bytes."""
        out = []
        parts = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        for part, ids in zip(parts, self._encoded([" " + " ".join(p) for p in parts]), strict=True):
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([1 + len(u.encode()) for u in part])
            last = np.searchsorted(ends, wanted)
            if len(ends) == 0 or last[-1] != len(ends) - 1 or (ends[np.minimum(last, len(ends) - 1)] != wanted).any():
                out += self._ids_alone([" " + u for u in part])
            else:
                out.append((ids, np.diff(last, prepend=-1)))
        return out

    def _ids_between(self, units: list[str], mark: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for units with a mark between them that is one id and that no unit may hold."""
        alone = list(self._encoded([mark]))[0]
        if len(alone) != 1:
            return self._ids_alone(units)
        out = []
        parts = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        for part, ids in zip(parts, self._encoded([mark.join(p) for p in parts]), strict=True):
            marks = ids == alone[0]
            at = np.flatnonzero(marks)
            if len(at) != len(part) - 1:
                out += self._ids_alone(part)
            else:
                out.append((ids[~marks], np.diff(at, prepend=-1, append=len(ids)) - 1))
        return out

    def _ids_alone(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(ids, np.array([len(ids)])) for ids in self._encoded(units)]

    def _new(self, units: list[str], loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, and where each unit's begin and how many they are."""
        alone: list[int] = np.flatnonzero(loose).tolist()
        kept = np.flatnonzero(~loose).tolist()
        if self.spaced:
            inner, first = [i for i in kept if units[i][0] != "\0"], [i for i in kept if units[i][0] == "\0"]
            found = self._ids_by_bytes([units[i] for i in inner])
            found += self._ids_between([units[i][1:] for i in first], "\n")
            found += self._ids_alone([units[i][1:] if units[i][0] == "\0" else " " + units[i] for i in alone])
            order = inner + first + alone
        else:
            inner = [i for i in kept if "|" not in units[i]]
            first = [i for i in kept if "|" in units[i]]
            found = self._ids_between([units[i] for i in inner], " | ") + self._ids_alone([units[i] for i in first + alone])
            order = inner + first + alone
        ids, counts = (np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]).astype(kind) for k, kind in enumerate(("<u4", np.int32)))
        starts, own = np.zeros(len(units), np.int32), np.zeros(len(units), np.int32)
        own[order], starts[order] = counts, _begins(counts)
        return ids, starts, own

    def _keep(self, units: pa.Array, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, lasting: np.ndarray) -> None:
        """Remember units as long as there is room: the short ones of those that are right in every place."""
        short = pc.less_equal(pc.utf8_length(units), SHORT).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(short & lasting)[: max(0, self.room - len(self.known))]
        n = counts[kept]
        self.starts = np.concatenate([self.starts, _begins(n) + np.int32(len(self.ids))])
        self.counts, self.ids = np.concatenate([self.counts, n]), np.concatenate([self.ids, ids[_runs(starts[kept], n)]])
        self.known = pa.concat_arrays([self.known, units.take(pa.array(kept))])

    def _learn(self, fresh: pa.Array, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units that are not known, one after another, and where each unit's begin and how many they are."""
        stems, signed, tails = fresh, np.zeros(len(fresh), bool), fresh.slice(0, 0)
        if self.signs:
            signed = pc.not_equal(pc.ascii_rtrim(fresh, punctuation), fresh).to_numpy(zero_copy_only=False) & ~loose
            found = pc.extract_regex(fresh.filter(pa.array(signed)), _SIGNED)
            signed[signed] = found.is_valid().to_numpy(zero_copy_only=False)
            found = found.drop_null()
            stems = pc.replace_with_mask(fresh, pa.array(signed), pc.struct_field(found, "stem"))
            tails = pc.struct_field(found, "tail")
            if self.spaced:
                tails = pc.binary_join_element_wise(_FIRST, tails, _EMPTY)
        if self.small:
            stems = pc.if_else(pc.match_substring_regex(stems, f"^[{_LATIN}]+$"), pc.ascii_lower(stems), stems)
        coded = pa.concat_arrays([stems, tails]).dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary
        lasting = np.ones(len(parts), bool)
        lasting[codes[np.flatnonzero(loose)]] = False
        place = places(parts, self.known)
        place[~lasting] = -1
        missing = np.flatnonzero(place < 0)
        unknown = parts.take(pa.array(missing))
        ids, starts, counts = self._new(unknown.to_pylist(), ~lasting[missing])
        place[missing] = len(self.known) + np.arange(len(missing))
        pool, all_starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts + np.int32(len(self.ids))])
        runs = np.full((len(fresh), 2), -1, np.int32)
        runs[:, 0] = place[codes[: len(fresh)]]
        runs[signed, 1] = place[codes[len(fresh) :]]
        none = np.zeros(1, np.int32)  # at place -1: no tail
        n = np.concatenate([self.counts, counts, none])[runs]
        own = pool[_runs(np.concatenate([all_starts, none])[runs].ravel(), n.ravel())]
        n = n.sum(1, dtype=np.int32)
        begin = _begins(n)
        self._keep(unknown, ids, starts, counts, lasting[missing])
        return own, begin, n

    def _put_together(self, words: pa.Array, codes: np.ndarray, bounds: np.ndarray, loose: np.ndarray) -> list[bytes]:
        """Ids of texts, of which text i has the words at codes[bounds[i]:bounds[i + 1]]; loose ones are right in this place only."""
        used = np.zeros(len(words), bool)
        used[codes] = True
        place = places(words, self.known)
        place[loose] = -1
        missing = np.flatnonzero((place < 0) & used)
        pool, starts, counts = self.ids, self.starts, self.counts
        place[missing] = len(counts) + np.arange(len(missing))
        if len(missing):
            ids, more, n = self._learn(words.take(pa.array(missing)), loose[missing])
            starts, counts, pool = np.concatenate([starts, more + np.int32(len(pool))]), np.concatenate([counts, n]), np.concatenate([pool, ids])
        out: list[bytes] = []
        first = 0
        while first < len(bounds) - 1:  # some texts at a time, so that no column of all ids is made
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PART, side="right")) - 1)
            where = place[codes[bounds[first] : bounds[last]]]
            n = counts[where]
            raw = memoryview(pool[_runs(starts[where], n)].tobytes())
            ends = 4 * np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[bounds[first : last + 1] - bounds[first]]
            out += [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            first = last
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. NULL texts are empty."""
        self.used[0] = time.monotonic()
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        out = [b""] * len(column)
        unlike = pc.match_substring_regex(column, _ODD)
        for special in self.specials:
            unlike = pc.or_(unlike, pc.match_substring(column, special))
        plain = pc.if_else(unlike, _EMPTY, column)
        if self.spaced:
            plain = pc.binary_join_element_wise(_FIRST, pc.replace_substring(plain, "\n", " \0\n \0") if self.lines else plain, _EMPTY)
        else:
            plain = pc.replace_substring(plain, "\n", " ")
        cut = pc.split_pattern(plain, " ")
        bounds, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        del plain, cut, coded
        rows, odd = np.arange(len(out)), np.zeros(0, np.int64)
        if self.spaced:
            edged = pc.and_(pc.match_substring_regex(words, _EDGED), pc.not_equal(words, "\0\n")).to_numpy(zero_copy_only=False)
            hit = np.zeros(len(out), bool)
            hit[np.searchsorted(bounds, np.flatnonzero(edged[codes]), side="right") - 1] = True
            lengths, rows, odd = np.diff(bounds), np.flatnonzero(~hit), np.flatnonzero(hit & ~unlike.to_numpy(zero_copy_only=False))
            codes, bounds = codes[np.repeat(~hit, lengths)], np.concatenate([[0], np.cumsum(lengths[rows])])
        for i, ids in zip(rows.tolist(), self._put_together(words, codes, bounds, np.zeros(len(words), bool)), strict=True):
            out[i] = ids
        if len(odd):
            units = [["\0" + first, *rest] if first else [] for first, *rest in map(_BETWEEN.split, column.take(pa.array(odd)).to_pylist())]
            coded = pa.array([u for own in units for u in own], pa.large_string()).dictionary_encode()
            loose = np.array([u[-1].isspace() or u.removeprefix("\0")[:1].isspace() for u in coded.dictionary.to_pylist()], bool)
            bounds = np.cumsum([0, *map(len, units)])
            for i, ids in zip(odd.tolist(), self._put_together(coded.dictionary, coded.indices.to_numpy(), bounds, loose), strict=True):
                out[i] = ids
        for i in np.flatnonzero(unlike.to_numpy(zero_copy_only=False)).tolist():
            out[i] = next(self._encoded([column[i].as_py()])).tobytes()
        return out


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word is known, or -1. Both are distinct; the table of hashes is that of the words, however much is known."""
    found = pc.index_in(known, value_set=words)
    out, valid = np.full(len(words), -1, np.int32), found.is_valid().to_numpy(zero_copy_only=False)
    out[found.drop_null().to_numpy()] = np.flatnonzero(valid)
    return out


def _begins(counts: np.ndarray) -> np.ndarray:
    """First places of runs that follow one another."""
    return (np.cumsum(counts) - counts).astype(np.int32)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] and the counts[i] - 1 places after it, for every i."""
    total = int(counts.sum(dtype=np.int64))
    kind = np.int32 if total < 1 << 31 else np.int64
    places = np.repeat(starts - (np.cumsum(counts) - counts).astype(kind), counts)
    places += np.arange(total, dtype=kind)
    return places


#: seconds after which an unused encoder is given up
IDLE = 4.0
_ENCODERS: dict[tuple[str, bool], tuple[Encoder, list[float]]] = {}


def trim() -> None:
    """Give memory that nothing uses back to the machine."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if give_back:
        give_back(0)


def _give_up_idle(key: tuple[str, ...]) -> None:
    while key in _ENCODERS:
        time.sleep(IDLE)
        if key in _ENCODERS and time.monotonic() - _ENCODERS[key][1][0] >= IDLE:
            give_up(key)


def give_up(*keys: tuple[str, ...]) -> None:
    """Forget these encoders, or all: tasks that need none begin with it, as their worker may have encoded just before."""
    found = [_ENCODERS.pop(key, None) for key in keys or list(_ENCODERS)]
    if found:
        del found
        gc.collect()
        trim()


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for all tasks of a worker process; its memory outlasts a task, but not the stage by more than IDLE seconds."""
    key = path, spaced
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaced), [time.monotonic()]
        threading.Thread(target=_give_up_idle, args=(key,), daemon=True).start()
    found, used = _ENCODERS[key]
    found.used = used
    used[0] = time.monotonic()
    return found


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut where a slice's texts pass `size` characters; NULL texts are left as they are."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()
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
