import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import LOWER, OTHER, PROSE, TEXTS, rows, table
from tokenizers import Tokenizer

from tagsight.llm import crosstok, phrases, quantised

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_phrases(docs, least, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    found = defaultdict(list)
    for p, a in f.items():
        lang, words = p[0], p[1:]
        if len(words) < 2:
            continue
        inside = (q for q in f if len(q) > len(p) and q[0] == lang and any(q[i : i + len(words)] == words for i in range(1, len(q))))
        if any(100 * f[q] >= 80 * a for q in inside):
            continue
        cuts = [(2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, r, w.decode(), -a, left, right, n[lang], -s) for lang, all_ in found.items() for r, (s, a, w, left, right) in enumerate(sorted(all_)[:top], 1))


REPEATED = ["a b c d. A B c\x01 d " * 9, "the\tcat sat on the cat sat; the cat", "x x x x x x x x", "né né né! né né", "a b\na b\x0ba b", "b c d e f b c d", None, "", " .,; "] * 4


@pytest.mark.parametrize(("texts", "least", "parts"), [(REPEATED, 3, 8), (REPEATED, 30, 1), (TEXTS, 4, 5)])
def test_phrases_against_plain_counts(spark, texts, least, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # prefixes then cross many parts
    docs = table(spark, texts)
    got = rows(phrases.collocations(docs, least=least))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_phrases(((r["lang"], r["text"]) for r in docs.collect()), least)
    assert got == sorted(want, key=str) and len(got) > 3


def test_phrases_small_maps_small_runs_and_empty(spark, monkeypatch):
    docs = table(spark, REPEATED)
    want = rows(phrases.collocations(docs, least=3, top=5))
    monkeypatch.setattr(phrases, "MAP_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "HELD", 10)
    assert rows(phrases.collocations(docs, least=3, top=5)) == want and max(r[1] for r in want) == 5
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert rows(phrases.collocations(table(spark, [None, "", "one two"]))) == []


def test_common_cuts_on_random_ends():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
        both = sorted(set(a) & set(b))
        assert crosstok.common_cuts(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in both]
    far = [*range(1, 40_000, 2), 40_001], [*range(2, 40_000, 2), 40_001]
    assert crosstok.common_cuts(*far) == [(len(far[0]), len(far[1]))]


def plain_alignments(docs):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of = {v: k for k, v in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    chars = crosstok.byte_characters()

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    out, counts, links = {}, Counter(), {}
    for i, text in docs:
        out[i], links[i] = (0, 0, 0, ""), []
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a, parts_b = [bytes(chars[c] for c in of[t]) for t in ids_a], [bytes_b(t) for t in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        groups, x, y = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[x:u])) + "|" + ",".join(map(str, ids_b[y:v])))
            links[i].append((ids_a[u - 1], ids_b[v - 1]))
            x, y = u, v
        counts.update(links[i])
        out[i] = (len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = defaultdict(int)
    for (_, v), c in counts.items():
        best[v] = max(best[v], c)
    return sorted(((i, *v[:3], v[2], v[3], sum(counts[k] == best[k[1]] for k in links[i]), sum(counts[k] for k in links[i])) for i, v in out.items()), key=str)


def test_alignment_against_whole_text_encoding(spark):
    odd = ["a▁b", " lead", "end ", "a  b   c", "<s> </s> <unk> <0x0A> <|endoftext|> x", "tab\tnl\n\n x\x1cy \x1c z", "é中 🎉　ﬁ \xa0x Å", "don't I'll 12 3a", " ", "\0", "x" * 3000 + " y"]
    texts = [t[:20_000] if t else t for t in TEXTS] + odd
    docs = table(spark, texts)
    got = rows(crosstok.alignment_report(docs, A, B))
    assert got == plain_alignments(enumerate(texts))
    few = table(spark, ["a b", "a b", None], [None, 7, 7])
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in crosstok.alignment_report(few, A, B).collect()) == [("7", 0, 0), ("7", 2, 4), ("None", 2, 4)]
    assert crosstok.alignment_report(docs.limit(0), A, B).count() == 0
    shown = {r["id"]: r["groups"] for r in crosstok.aligned(table(spark, ["hello  world"]), A, B).collect()}
    assert shown[0].count(";") >= 2


def plain_near(vectors, least=0.93):
    n = len(vectors)
    ok = [quantised.clean(v) and label is not None for _, v, label in vectors]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                x, y = (np.array(vectors[k][1]) / max(map(abs, vectors[k][1])) for k in (i, j))
                if float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += (more := links[todo.pop()] - seen)
            seen |= more
        ids = [vectors[k][0] for k in seen if vectors[k][0] is not None]
        least_id = min(ids, default=None)
        out.append((vectors[i][0], len(links[i]), least_id, vectors[i][0] == least_id))
    return sorted(out, key=str)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = []
    for label in (1, 2):
        for _ in range(6):
            c = rng.normal(size=16)
            for spread in (0.02, 0.05, 0.1, 0.18):
                v += [(None, (c + spread * rng.normal(size=16) * 2).tolist(), label) for _ in range(5)]
    v = [(i, x, y) for i, (_, x, y) in enumerate(v)]
    v += [(900 + i, x, y) for i, (_, x, y) in enumerate(v[:7])]
    v += [(901, v[0][1], 1), (None, v[1][1], 1), (None, None, 1), (990, [0.0] * 16, 1), (991, [float("nan")] * 16, 1), (992, [None, 1.0], 1), (993, v[3][1], None), (994, [1.0, 0.0], 1),
          (995, [2.0, -0.0], 1), (996, [], 1), (997, [1e300] * 16, 2), (998, [3e-300] * 16, 2), (999, [float("inf")] + [1.0] * 15, 2)]
    df = spark.createDataFrame([(i, x, y, 0, "c") for i, x, y in v], "vec_id long, embedding array<double>, label int, key long, cell string").repartition(3)
    want = plain_near(v)
    for more in ({}, {"cells": 7, "block": 9}, {"cells": 1, "fit_rows": 30}):
        assert rows(quantised.near_vectors(df, sigmas=4.0, **more)) == want
    got = rows(quantised.near_vectors(df, cells=20))
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.9 * all_ <= found <= all_
    assert quantised.near_vectors(df.limit(0)).count() == 0


def test_dense_group_is_counted_not_compared(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    v = [(i, (c + 0.02 * rng.normal(size=32)).tolist(), 1) for i in range(3000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    got = quantised.near_vectors(df, cells=1).collect()
    assert {tuple(r)[1:] for r in got if r["vec_id"]} == {(2999, 0, False)} and len(got) == 3000


def test_prose_phrases_keep_their_counts(spark):
    counts, totals = phrases.phrase_counts(table(spark, [PROSE, PROSE, OTHER]), least=2)
    got = {(r["lang"], *r["words"]): r["f"] for r in counts.collect()}
    assert got and min(got.values()) >= 2 and sum(r["n"] for r in totals.collect()) == 3 * 320
