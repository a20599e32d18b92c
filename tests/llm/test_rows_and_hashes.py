import time

import numpy as np
from plain import OTHER, PROSE, byte_repeats, rows, table, word_repeats, words

from tagsight.llm import debruijn, exact, minmax, secrets, suffixes, tiling
from tagsight.llm.tokens import Encoder
from tagsight.llm.words import Words


def morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_out_modulo_powers_of_two_differ():
    for n in (1024, 2048, 65536):
        a, b = Words([morse(n, "ab") + " " + morse(n, "ba")]).hash
        assert a != b
    rng = np.random.default_rng(1)
    text = " ".join("w" * int(k) + str(int(v)) for k, v in rng.integers(0, 60, (60_000, 2)))
    w = Words([text, text[7:], "é " + text])
    by = {}
    for s, e, h in zip(w.start.tolist(), w.end.tolist(), w.hash.tolist(), strict=True):
        assert by.setdefault(w.data[s:e].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


def test_texts_with_such_words_are_not_linked_or_cut(spark):
    one, other = morse(2048, "ab"), morse(2048, "ba")
    got = rows(minmax.near_groups(table(spark, [one, other]), width=2).select("doc_id", "component_id"))
    assert got == [(0, 0), (1, 1)]
    tail = " ".join(f"x{i}" for i in range(12))
    assert rows(debruijn.drop_repeats(table(spark, [f"{one} {tail}", f"{other} {tail}"])).select("doc_id", "n_removed")) == [(0, 0), (1, 0)]


def test_near_groups_with_repeated_and_missing_ids(spark):
    p, q = PROSE, OTHER
    docs = table(spark, [p, q, p + " x", q + " x", q + " y", "alone here", "alone here"], [7, 7, 20, 30, None, None, None])
    got = rows(minmax.near_groups(docs, width=2).select("doc_id", "component_id", "kept"))
    assert got == sorted([(7, 7, True), (7, 7, True), (20, 7, False), (30, 7, False), (None, 7, False), (None, None, True), (None, None, True)], key=str)
    left = rows(minmax.drop_near(docs, width=2).select("doc_id", "text"))
    assert left == sorted([(7, p), (7, q), (None, "alone here"), (None, "alone here")], key=str)


def test_dropping_goes_by_row(spark):
    p, r = PROSE, OTHER
    left = rows(exact.drop_copies(table(spark, [p, r, p], [5, 5, 3])).select("doc_id", "text"))
    assert left == sorted([(3, p), (5, r)], key=str)
    left = rows(exact.drop_copies(table(spark, ["a b", "ab", "ab", "c", None, "", "ab"], [7, 7, 7, None, None, None, 9])).select("doc_id", "text"))
    assert {(i, t or "") for i, t in left} == {(7, "a b"), (None, "c"), (None, "")} and len(left) == 3
    left = rows(minmax.drop_near(table(spark, [p, r, p], [5, 5, 3])).select("doc_id", "text"))
    assert left == sorted([(3, p), (5, r)], key=str)
    bench = spark.createDataFrame([(1, " ".join(words(p)[:40]))], "item_id long, text string")
    left = rows(tiling.drop_contaminated(table(spark, [p, r, p, r], [5, 5, None, None]), bench).select("doc_id", "text"))
    assert left == sorted([(5, r), (None, r)], key=str)


def test_repeats_with_repeated_and_missing_ids(spark):
    p, q = PROSE, OTHER
    texts, ids = [p, p + " end", q, q + " " + q, "end " + p], [1, 5, 5, 5, None]
    docs = table(spark, texts, ids)
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0))
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in debruijn.drop_repeats(docs).collect()}
    total = {i: len(words(t)) for i, t in enumerate(texts)}
    assert got[1, total[0]] == 0 and got[5, total[1]] == total[0] and got[None, total[4]] == total[0]
    assert {got[5, total[2]], got[5, total[3]]} in ({0, total[2]}, {0, total[3]}, {total[2], 0})
    sizes = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.drop_repeats(docs).collect()}
    size = [len(t.encode()) for t in texts]
    assert sizes[1, size[0]] == byte_repeats([(0, p)], 100)[0][2] and sizes[5, size[1]] >= size[0] and sizes[None, size[4]] >= size[0]
    assert order and len(sizes) == 5


def test_log_ratio_is_linear_and_wide(spark):
    model = [30_000] * secrets.SIZE**2
    start = time.time()
    got = secrets.find_secrets(table(spark, ["x " + "aB3/" * 500_000 + " end", "k" * 25]), model).select("doc_id", secrets.joined(secrets.F.col("extra")).alias("s"))
    assert rows(got) == [(0, "markov:2:2000002"), (1, "markov:0:25")]
    assert time.time() - start < 120


def test_joined_units_keep_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [" ".join(f"é{i}wörd{i % 7}'s 中{i}" for i in range(k, k + 300)) for k in (0, 200)] + ["x" * 200 + " y" * 50]
    small = Encoder(path, True, room=20)
    for t, ids in zip(texts * 2, small.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(small.units) <= 20 and max(map(len, small.units)) <= 49
