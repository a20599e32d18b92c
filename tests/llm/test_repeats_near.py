import hashlib

import numpy as np
import pytest
from plain import OTHER, PROSE, TEXTS, byte_repeats, near, rows, table, tiling, word_repeats
from pyspark.sql import functions as F

from tagsight.llm import debruijn, minmax, suffixes, tiling as tiles, words
from tagsight.llm.components import components

DOCS = list(enumerate(TEXTS))


@pytest.mark.parametrize("span,hot", [(100, None), (100, 2), (24, None), (7, 1)])
def test_bytes_of_repeated_strings(spark, span, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.drop_repeats(table(spark), span, hot=hot).collect()}
    assert got == byte_repeats(DOCS, span)


def test_maximal_repeats_list_all_occurrences(spark):
    text = dict(DOCS)
    found = suffixes.maximal_repeats(table(spark, TEXTS[:14]), 40).collect()
    by = {}
    for r in found:
        by.setdefault((r["group_id"], r["length"]), []).append((r["id"], r["start"]))
    assert by
    for (_, length), places in by.items():
        strings = {(text[i] or "").encode()[p : p + length] for i, p in places}
        assert len(strings) == 1 and len(places) > 1 and length >= 40
    everywhere = max(by.values(), key=lambda v: len({i for i, _ in v}))
    assert {6, 7, 8} <= {i for i, _ in everywhere}


@pytest.mark.parametrize("width", [13, 3, 1])
def test_words_of_repeated_windows(spark, width):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in debruijn.drop_repeats(table(spark), width).collect()}
    assert got == word_repeats(DOCS, width)


def test_repeats_without_ids_and_rows(spark):
    texts = [PROSE, PROSE, PROSE, None]
    for got in (suffixes.drop_repeats(table(spark, texts, [4, None, 2, 9])), debruijn.drop_repeats(table(spark, texts, [4, None, 2, 9]))):
        kept = {r["doc_id"]: r["n_removed"] for r in got.collect()}
        assert kept[2] == 0 and kept[9] == 0 and kept[4] > 0 and kept[None] == kept[4]
    again = debruijn.drop_repeats(table(spark, [PROSE, PROSE, PROSE], [1, 5, 5])).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in again) == [(1, False), (5, True), (5, True)]
    assert suffixes.drop_repeats(table(spark).limit(0)).count() == 0 and debruijn.drop_repeats(table(spark).limit(0)).count() == 0


def test_intervals_of_sorted_texts():
    words = sorted(["banana", "bandana", "ban", "can", "cantor", "x"])
    lcp = [0] + [suffixes.common(a.encode(), b.encode()) for a, b in zip(words[:-1], words[1:], strict=True)]
    found = {(d, tuple(words[a:b])) for d, a, b in suffixes.intervals(lcp, 1)}
    assert found == {(3, ("ban", "banana", "bandana")), (3, ("can", "cantor"))}


def chain():
    """Texts where each is near to the next alone, in a mixed order, beside a crowd around one text."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    out = []
    for step in range(12):
        own = base.copy()
        own[step * 8 : step * 8 + 8] = [f"new{step}x{k}" for k in range(8)]
        base = own
        out.append(" ".join(own))
    center = [f"c{i}" for i in range(200)]
    for n in range(25):
        own = center.copy()
        for p in rng.choice(200, 9, replace=False):
            own[p] = f"edit{n}y{p}"
        out.append(" ".join(own))
    out.append(" ".join(center))
    order = rng.permutation(len(out))
    return [out[i] for i in order]


@pytest.mark.parametrize("width,block,crowd", [(2, 2000, 64), (2, 4, 3), (2, 3, 1000), (5, 2000, 0)])
def test_near_groups(spark, width, block, crowd):
    texts = TEXTS + chain()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_groups(table(spark, texts), width, block=block, crowd=crowd).collect()}
    assert got == near(list(enumerate(texts)), width)


def test_every_pair_off_the_star_is_a_candidate_once():
    """Pairs at similarity 0.80 to 0.85, each beside a third row: one candidate in the keys that the two share, none lost."""
    rng = np.random.default_rng(11)
    lost = repeated = at_risk = 0
    for _ in range(3000):
        size, extra = 180, int(rng.integers(16, 23))
        values = rng.integers(0, 1 << 63, size + 2 * extra, dtype=np.uint64)
        pair = [minmax.signature(values[: size + extra]), minmax.signature(np.concatenate([values[:size], values[size + extra :]]))]
        keys = [minmax.mix(minmax.shingles_of_rows(v.reshape(minmax.BANDS, minmax.ROWS)) + np.arange(1, minmax.BANDS + 1, dtype=np.uint64)).view(np.int64) for v in pair]
        sketches = [minmax.mix(v).astype(np.uint8) for v in pair]
        near_miss = (sketches[0] == sketches[1]).reshape(minmax.BANDS, minmax.ROWS).all(1) & (keys[0] != keys[1])
        shared = np.flatnonzero(keys[0] == keys[1])
        at_risk += bool(len(shared)) and bool(near_miss[: shared[0]].any())
        seen = 0
        for band in shared.tolist():
            members = [{"id": i, "n": size + extra, "label": i, "own": 0, "low": 0, "high": 0, "band": band, "sketch": sketches[i].tobytes(), "keys": keys[i]} for i in (0, 1)]
            seen += sum(len(rest) for _, rest in minmax._candidates(members, 80))
        lost += seen == 0 and len(shared) > 0
        repeated += seen > 1
    assert at_risk > 0 and lost == 0 and repeated == 0


def test_near_nulls_repeats_and_empty(spark):
    texts = [PROSE, PROSE + " more", PROSE, None, "", OTHER]
    got = rows(minmax.near_groups(table(spark, texts, [8, 3, 3, None, 1, None])).select("doc_id", "component_id", "kept"))
    assert sorted(got, key=str) == sorted([(8, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (1, 1, True), (None, None, True)], key=str)
    left = minmax.drop_near(table(spark, texts))
    assert rows(left.select("doc_id")) == [(0,), (3,), (4,), (5,)] and left.columns == table(spark).columns
    assert minmax.near_groups(table(spark).limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1400)] + [(5, 5)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long").repartition(4))))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1400)) and got[5] == 5


ITEMS = [
    (0, " ".join(PROSE.split()[10:40])), (1, "Only three words"), (2, None), (3, ""), (None, PROSE[:200]), (5, " ".join(OTHER.split()[5:60])), (5, " ".join(OTHER.split()[5:60])), (6, "the a the a the a the a the a"),
]
PROBES = [
    None, "", "see " + ITEMS[0][1].upper() + ", end", "moved: " + " ".join(PROSE.split()[25:40]) + " - then - " + " ".join(PROSE.split()[10:25]),
    " ".join(PROSE.split()[10:30]), "ONLY three, words!", "only three other words", OTHER, "a the a the a the a the a the a", PROSE + " " + OTHER,
]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_tiling(spark, sent):
    items = spark.createDataFrame([(*i, "t") for i in ITEMS], "item_id long, text string, doc_id string")
    got = rows(tiles.contamination(table(spark, PROBES), items, threshold=0.5, sent_bytes=sent).select("doc_id", "item_id", "n_words", "n_covered"))
    want = set()
    for d, probe in enumerate(PROBES):
        for i, item in ITEMS:
            covered, n = tiling(probe, item, tiles.LEAST)
            if i is not None and n and covered >= 0.5 * n:
                want.add((d, i, n, covered))
    assert got == sorted(want, key=str)
    left = tiles.drop_contaminated(table(spark, PROBES), items, sent_bytes=sent)
    assert rows(left.select("doc_id")) == [(0,), (1,), (4,), (6,)] and left.columns == table(spark).columns
    assert tiles.contamination(table(spark).limit(0), items, sent_bytes=sent).count() == 0
    assert tiles.contamination(table(spark), items.limit(0), sent_bytes=sent).count() == 0


def test_digests_follow_what_is_kept(spark):
    got = suffixes.drop_repeats(table(spark)).select("doc_id", F.sha2("kept", 256)).collect()
    want = byte_repeats(DOCS, 100)
    assert all(r[1] == hashlib.sha256(want[r[0]][3]).hexdigest() for r in got)


def test_short_hashes_follow_the_bytes():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 400), np.zeros(40), np.full(40, 255), rng.integers(0, 256, 50)]).astype(np.uint8)
    for width in range(1, 17):
        got = words.short_hashes(data, width).tolist()
        strings = [data[p : p + width].tobytes() for p in range(len(data) - width + 1)]
        assert len(got) == len(strings) and len(set(zip(strings, got, strict=True))) == len(set(strings)) == len(set(got))
        assert len(words.short_hashes(data[: width - 1], width)) == 0


def test_seeds_are_cut_without_prefix_sums(monkeypatch):
    def refuse(*_):
        raise AssertionError("prefix sums over whole texts")

    monkeypatch.setattr(words, "_Sums", refuse)
    found, begin = suffixes._cut(100)(["x" * 300, None, "word and word " * 40])
    assert found.windows.sum() == 201 + 461 and begin.tolist() == [0, 301, 302]
