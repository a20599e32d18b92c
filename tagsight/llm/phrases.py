"""Phrases that stick together: exact n-gram counts as sorted streams, joined in lockstep in suffix and in prefix order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import collect_small, durable, small_table

from .tokens import text_slices

#: longest phrase in words
ORDER = 4
#: words that a task counts before it sends the counts on
HELD = 4_000_000
#: bits of the map of frequent entries, at most
MAP_BITS = 1 << 27
#: bits of one row of the map
ROW_BITS = 1 << 15
#: open prefixes of all parts, a few for each
OPEN_ROWS = 1_000_000
_FACTOR = 1_000_003

#: A-Z are lower-cased, [.,;:!?\x0A-\x0D] end a piece, [\x20\x09] end a word. 255 never occurs in UTF-8.
_BYTES = bytearray(range(256))
_BYTES[65:91] = range(97, 123)
_BYTES[9] = 32
for _end in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_end] = 255
_TABLE, _BREAK = bytes(_BYTES), b"\xff"


class _Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words by number, numbers of the words in order) for at most about HELD words at a time."""
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    total = 0
    for batch in text_slices(batches, "text"):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            numbers, runs = held.setdefault(lang, (_Numbers({_BREAK: 0}), []))
            words = _BREAK.join([*texts, b""]).translate(_TABLE).replace(_BREAK, b" \xff ").split()
            runs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            total += len(words)
        if total >= HELD:
            yield from ((lang, list(numbers), np.concatenate(runs)) for lang, (numbers, runs) in held.items())
            held, total = {}, 0
    yield from ((lang, list(numbers), np.concatenate(runs)) for lang, (numbers, runs) in held.items())


def _rows(lang: str, phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 200_000
    for at in range(0, len(phrases), step):
        part = pa.array(phrases[at : at + step], pa.binary()).cast(pa.string())
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([lang])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([names, part, pa.array(counts[at : at + step], pa.int64())], names=["lang", "phrase", "n"])


class _Map:
    """Marks of frequent entries by hashed place; an unmarked entry is not frequent, a marked one may be."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.last = bits, np.uint64(8 * len(bits) - 1)

    def marked(self, places: np.ndarray) -> np.ndarray:
        at = places & self.last
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _sums(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode() + b"\0")
    return np.fromiter((zlib.crc32(w, seed) for w in words), np.uint64, len(words))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, run in _runs(batches):
        counts = np.bincount(run, minlength=len(words))
        counts[0] = len(run) - counts[0]  # the empty phrase stands for all words
        yield from _rows(lang, [b"", *words[1:]], counts)


def _coded(lang: str, words: list[bytes], run: np.ndarray, word_map: _Map) -> tuple[np.ndarray, np.ndarray]:
    """A number for the pair that starts at each place but the last, and whether both its words may be frequent."""
    sums = _sums(lang, words)
    frequent = word_map.marked(sums)
    frequent[0] = False
    ok = frequent[run]
    return sums, ok[:-1] & ok[1:]


def _count_pairs(batches: Iterator[pa.RecordBatch], word_map: _Map) -> Iterator[pa.RecordBatch]:
    for lang, words, run in _runs(batches):
        _, both = _coded(lang, words, run, word_map)
        v = len(words)
        pairs, counts = np.unique((run[:-1] * v + run[1:])[both], return_counts=True)
        phrases = [words[a] + b" " + words[b] for a, b in zip((pairs // v).tolist(), (pairs % v).tolist(), strict=True)]
        yield from _rows(lang, phrases, counts)


def _count_longer(batches: Iterator[pa.RecordBatch], word_map: _Map, pair_map: _Map) -> Iterator[pa.RecordBatch]:
    """Phrases of three and four words whose pairs may all be frequent."""
    for lang, words, run in _runs(batches):
        sums, both = _coded(lang, words, run, word_map)
        at = np.flatnonzero(both)
        at = at[pair_map.marked(sums[run[at]] * np.uint64(_FACTOR) + sums[run[at + 1]])]
        v = len(words)
        pairs, number = np.unique(run[at] * v + run[at + 1], return_inverse=True)
        seat = np.full(len(run) + 2, -1, np.int64)  # number of the pair that starts at each place
        seat[at] = number
        text = [words[a] + b" " + words[b] for a, b in zip((pairs // v).tolist(), (pairs % v).tolist(), strict=True)]
        three = at[seat[at + 1] >= 0]
        codes, counts = np.unique(seat[three] * v + run[np.minimum(three + 2, len(run) - 1)], return_counts=True)
        yield from _rows(lang, [text[a] + b" " + words[b] for a, b in zip((codes // v).tolist(), (codes % v).tolist(), strict=True)], counts)
        four = three[seat[three + 2] >= 0]
        codes, counts = np.unique(seat[four] * max(1, len(text)) + seat[four + 2], return_counts=True)
        yield from _rows(lang, [text[a] + b" " + text[b] for a, b in ((c // len(text), c % len(text)) for c in codes.tolist())], counts)


_COUNTED = "lang string, phrase string, n long"


def _summed(counted: DataFrame, least: int) -> DataFrame:
    """Counts over all tasks, of entries seen `least` times and of the empty phrase."""
    sums = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return durable(sums.where((F.col("n") >= least) | (F.col("phrase") == "")))


def _sum_of(word: Column) -> Column:
    return F.crc32(F.concat(F.col("lang"), F.lit("\0"), word).cast("binary"))


def _map_of(places: DataFrame, entries: int) -> _Map:
    """The map of the column `place`; its size follows the number of entries up to MAP_BITS, which bounds what tasks get."""
    bits = ROW_BITS
    while bits < 16 * entries and bits < MAP_BITS:
        bits *= 2
    at = F.col("place").bitwiseAND(bits - 1) + 1
    rows = places.select(F.bitmap_bucket_number(at).alias("row"), F.bitmap_bit_position(at).alias("bit"))
    rows = rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows:
        out[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return _Map(out.reshape(-1))


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to ORDER words that occur `least` times: (lang, words, f), and words per language: (lang, n).

    Exact at every size: a phrase can only be frequent if its words and pairs are, so tasks send pairs of words and longer
    phrases of pairs that a map of hashed places does not rule out. The map has at most MAP_BITS bits; where it
    fills up it rules out less, and the counts stay the same. Words are compared as bytes, never by hash.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = _summed(rows.mapInArrow(_count_words, _COUNTED), least)
    totals = words.where("phrase = ''").select("lang", "n")
    words = words.where(f"phrase != '' AND n >= {least}")
    word_map = _map_of(words.select(_sum_of(F.col("phrase")).alias("place")), words.count())
    pairs = _summed(rows.mapInArrow(lambda b: _count_pairs(b, word_map), _COUNTED), least)
    part = F.split("phrase", " ")
    place = _sum_of(part[0]) * _FACTOR + _sum_of(part[1])
    pair_map = _map_of(pairs.select(place.alias("place")), pairs.count())
    longer = _summed(rows.mapInArrow(lambda b: _count_longer(b, word_map, pair_map), _COUNTED), least)
    found = words.unionByName(pairs).unionByName(longer)
    return found.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("f")), totals


class _Open:
    """The prefixes of the row at hand, by length: number of the row that holds each, and its count."""

    def __init__(self) -> None:
        self.key: tuple = ()
        self.rows: list[int | None] = [None] * (ORDER + 1)
        self.counts: list[int | None] = [None] * (ORDER + 1)

    def enter(self, key: tuple, row: int, f: int) -> None:
        """key is (lang, word, ...); prefixes that it does not share with the last row are closed."""
        shared = 0
        for a, b in zip(self.key, key, strict=False):
            if a != b:
                break
            shared += 1
        for n in range(max(1, shared), ORDER + 1):
            self.rows[n] = self.counts[n] = None
        self.key = key
        self.rows[len(key) - 1], self.counts[len(key) - 1] = row, f


def _lockstep(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Joins each phrase of a sorted stream with the streams of its shorter prefixes, which stand before it.

    Adds the counts of its prefixes (c1 to c3; -1 for one that stands in an earlier part) and `ext`, the largest count
    of a phrase that has one word more. kind 1 rows hold the prefixes that are open at the end of the part, kind 2
    rows the extensions of prefixes of earlier parts.
    """
    seat = TaskContext.get().partitionId()
    cols = ["lang", "key", "f", *kept]
    names = ["kind", "seat", *cols, "c1", "c2", "c3", "ext"]
    open_, rows, ext, base = _Open(), [], [], 0
    heads: dict[tuple, int] = {}

    def batch_of(out: list[tuple], most: list[int], kind: int) -> pa.RecordBatch:
        data = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.list_(pa.string()), *[pa.int64()] * (len(data) - 2)]
        columns = [pa.array(c, k) for c, k in zip(data, kinds, strict=True)]
        fixed = [pa.array([kind] * len(out), pa.int32()), pa.array([seat] * len(out), pa.int32())]
        return pa.RecordBatch.from_arrays([*fixed, *columns, pa.array(most, pa.int64())], names=names)

    for batch in batches:
        for lang, key, f, *more in zip(*[batch.column(c).to_pylist() for c in cols], strict=True):
            whole, n = (lang, *key), len(key)
            open_.enter(whole, base + len(rows), f)
            if n > 1:
                before = open_.rows[n - 1]
                if before is None:
                    heads[whole[:-1]] = max(f, heads.get(whole[:-1], 0))
                elif f > ext[before - base]:
                    ext[before - base] = f
            parts = [(-1 if open_.counts[k] is None else open_.counts[k]) if k < n else 0 for k in range(1, ORDER)]
            rows.append((lang, key, f, *more, *parts))
            ext.append(0)
        done = min((r for r in open_.rows if r is not None), default=base + len(rows)) - base
        if done:
            yield batch_of(rows[:done], ext[:done], 0)
            del rows[:done], ext[:done]
            base += done
    if rows:
        yield batch_of(rows, ext, 0)
    blank = [0] * (len(kept) + ORDER - 1)
    tails = [(open_.key[0], list(open_.key[1 : n + 1]), c, *blank) for n, c in enumerate(open_.counts) if c is not None]
    if tails:
        yield batch_of(tails, [0] * len(tails), 1)
    if heads:
        yield batch_of([(k[0], list(k[1:]), 0, *blank) for k in heads], list(heads.values()), 2)


def lockstep_counts(stream: DataFrame, key: str, counts: list[str], ext: str) -> DataFrame:
    """The rows of `stream` (lang, `key`, f, ...) with the counts of the key's prefixes and its largest extension.

    The stream is range-partitioned and sorted by language and key, so that a phrase follows its prefixes, and is read
    once. Every key is a row of its own: no part is hot. What crosses from one part to the next, at most
    three open prefixes each, meets on the driver.
    """
    spark = stream.sparkSession
    kept = [c for c in stream.columns if c not in ("lang", key, "f")]
    ordered = stream.select("lang", F.col(key).alias("key"), "f", *kept).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    kinds = ", ".join(f"{c} long" for c in [*kept, "c1", "c2", "c3", "ext"])
    scanned = durable(ordered.mapInArrow(lambda b: _lockstep(b, kept), f"kind int, seat int, lang string, key array<string>, f long, {kinds}"))

    tails: dict[int, list] = {}
    for r in collect_small(scanned.where("kind = 1").select("seat", "lang", "key", "f"), OPEN_ROWS):
        tails.setdefault(r["seat"], []).append((r["lang"], tuple(r["key"]), r["f"]))
    carried: dict[int, tuple] = {}
    inherited = []
    for seat in sorted(tails):
        inherited.append((seat, *[carried[n][2] if n in carried else 0 for n in range(1, ORDER)]))
        own = {len(t[1]): t for t in tails[seat]}
        lang, last, _ = own[max(own)]
        carried = {n: t for n, t in carried.items() if n < len(last) and t[:2] == (lang, last[:n])} | own
    heads: dict[tuple, int] = {}
    for r in collect_small(scanned.where("kind = 2").select("lang", "key", "ext"), OPEN_ROWS):
        at = (r["lang"], tuple(r["key"]))
        heads[at] = max(heads.get(at, 0), r["ext"])

    rows = scanned.where("kind = 0").join(small_table(spark, inherited, "seat int, i1 long, i2 long, i3 long"), "seat")
    late = small_table(spark, [(a, list(b), e) for (a, b), e in heads.items()], "lang string, key array<string>, late long")
    rows = rows.join(late, ["lang", "key"], "left")
    found = [F.when(F.col(f"c{n}") < 0, F.col(f"i{n}")).otherwise(F.col(f"c{n}")).alias(c) for n, c in enumerate(counts, 1)]
    return rows.select("lang", F.col("key").alias(key), "f", *kept, *found, F.greatest("ext", F.coalesce("late", F.lit(0))).alias(ext))


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang", salts: int = 16
) -> DataFrame:
    """The first `top` phrases of 2 to 4 words of every language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its lowest-scoring cut (ties: the first), n all words; score is
    floor(2000000 * a / (l + r)), exact. Phrases seen under `least` times are left out, and so are those that lie in a
    longer one with at least `share` percent of their count: as counts never grow with length, the longest one need
    not be looked at beyond one more word. Order: score, a, both descending, then the phrase by UTF-8 bytes.

    A-Z are lower-cased, pieces end at [.,;:!?\\x0A-\\x0D], words at [\\x20\\x09]. NULL and empty texts count nothing, a
    NULL language is `und`. Repeated rows count as often as they stand there; ids are not read; very long texts are
    counted in runs of some million words. Other columns are not read, an empty table gives an empty result.
    """
    counts, totals = phrase_counts(docs, least, text_col, lang_col)
    turned = counts.select("lang", F.reverse("words").alias("turned"), "f")
    by_end = lockstep_counts(turned, "turned", ["s1", "s2", "s3"], "left_ext")
    by_start = by_end.select("lang", F.reverse("turned").alias("words"), "f", "s1", "s2", "s3", "left_ext")
    joined = lockstep_counts(by_start, "words", ["p1", "p2", "p3"], "right_ext")

    size = F.size("words")
    wide = lambda c: c.cast("decimal(19,0)")
    longer = F.greatest("left_ext", "right_ext")
    alone = wide(longer) * 100 < wide(F.col("f")) * share
    kept = joined.where((size > 1) & ((longer < least) | alone))
    cuts = []
    for k in range(1, ORDER):
        rest = f"CASE size(words) WHEN {k + 1} THEN s1 WHEN {k + 2} THEN s2 ELSE s3 END"
        score = f"CAST(2000000 AS DECIMAL(8,0)) * CAST(f AS DECIMAL(19,0)) DIV (CAST(p{k} AS DECIMAL(19,0)) + CAST({rest} AS DECIMAL(19,0)))"
        cuts.append(F.expr(f"CASE WHEN size(words) > {k} THEN struct(CAST({score} AS BIGINT) AS score, {k} AS k, p{k} AS l, {rest} AS r) END"))
    scored = kept.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), F.array_min(F.array_compact(F.array(*cuts))).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    order = "ORDER BY score DESC, a DESC, phrase"
    some = scored.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
