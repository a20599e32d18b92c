import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import TEXTS, by_sequence, ids_of, pieces, table
from tokenizers import Tokenizer

from tagsight.llm import packing, planes
from tagsight.llm.tokens import Encoder
from tagsight.plans.lineage import scratch_path

FILES = {True: "byte_bpe_50k.json", False: "word_bpe_49k.json"}


@pytest.mark.parametrize("spaced", [True, False])
def test_units_encode_like_whole_texts(spaced):
    rng = random.Random(3)
    bits = [" ", " ", "\n", "\t", "a", "B", "é", "'s", "'", " 1", "?", "\x1c", "\0", "中", "ß", "İ", "é", "<|endoftext|>", "Σ", "  ", "'ll", "\x85", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)] + [t or "" for t in TEXTS]
    whole = Tokenizer.from_file(public_tokenizers.path(FILES[spaced]))
    for room in (0, 50, 10**6):
        own = Encoder(public_tokenizers.path(FILES[spaced]), spaced, room)
        for a in range(0, len(texts), 700):
            part = texts[a : a + 700]
            want = [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
            assert own.encode(part) == want
        assert len(own.units) <= room


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    given_ids = np.array(ids, "<u4")
    assert planes.from_planes(planes.to_planes(given_ids, kind), len(ids), kind).tolist() == ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_joined_checksums(parts):
    assert planes.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[True]))
    ids = [*range(len(TEXTS) - 2), None, 3]  # a missing and a repeated id
    docs = list(zip(ids, TEXTS, strict=True))
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want, at = [], 0
    for i, text in ordered:
        raw = ids_of(tokenizer, text, 2)
        want.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    for kind, block in (("byte", 1000), ("bit", 65_536)):
        out = scratch_path(spark, "ids")
        planes.write_token_files(table(spark, TEXTS, ids), out, public_tokenizers.path(FILES[True]), kind=kind, block=block)
        got = sorted((tuple(r) for r in planes.read_documents(spark, out).collect()), key=lambda r: r[1])
        assert got == want
        index = spark.read.parquet(f"{out}/index").orderBy("first_id").collect()
        assert sum(r["n_ids"] for r in index) == at and all(r["n_ids"] <= block for r in index)
        assert [r["first_id"] for r in index] == np.cumsum([0, *[r["n_ids"] for r in index]]).tolist()[:-1]
    out = scratch_path(spark, "ids")
    planes.write_token_files(table(spark).limit(0), out, public_tokenizers.path(FILES[True]))
    assert planes.read_documents(spark, out).count() == 0


def test_pack(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[False]))
    docs = list(enumerate(TEXTS))
    got = packing.pack(table(spark), public_tokenizers.path(FILES[False]), limit=256).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces(tokenizer, docs, 0, 256)
    assert len(got) == len(pieces(tokenizer, docs, 0, 256))
    total = sum(r["length"] for r in got)
    for own in by_sequence(got).values():
        ends = np.cumsum([0, *[n for _, n in sorted(own)]]).tolist()
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 256
    assert len(by_sequence(got)) <= -(-total // 256) + 1
    repeated = packing.pack(table(spark, ["a b", "a b", None], [1, 1, None]), public_tokenizers.path(FILES[False])).collect()
    assert sorted((r["doc_id"] or -1, r["length"], r["offset"]) for r in repeated)[0][:2] == (-1, 1) and len(repeated) == 3
    assert packing.pack(table(spark).limit(0), public_tokenizers.path(FILES[False])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_plans_hold_every_piece(counts):
    histogram = np.zeros(61, np.int64)
    for k, v in counts.items():
        histogram[k] = v
    plan = packing.plan_sequences(histogram, 60)
    held = np.zeros(61, np.int64)
    for content, n in plan:
        assert sum(content) <= 60 and n > 0
        for length in content:
            held[length] += n
    assert (held == histogram).all()
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(histogram, 60))


def test_the_program_beats_best_fit_where_lengths_must_be_matched():
    histogram = np.bincount([700] * 900 + [690] * 900 + [660] * 900 + [650] * 900, minlength=2049)
    assert sum(n for _, n in packing.plan_sequences(histogram, 2048)) < sum(n for _, n in packing.best_fit(histogram, 2048))
