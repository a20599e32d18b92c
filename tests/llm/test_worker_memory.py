"""What a Python worker holds besides its results."""

import gc
import tracemalloc

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from tagsight.llm import crosstok
from tagsight.llm.tokens import Encoder
from tagsight.plans.lineage import BATCH, BATCH_CONF, durable


def test_ids_are_put_together_in_parts():
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = pa.array([" ".join(f"w{i % 50}" for i in range(k, k + 2000)) for k in range(500)], pa.large_string())
    own.encode(texts)
    tracemalloc.start()
    got = own.encode(texts)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(map(len, got)) >= 4 * 1_000_000
    assert peak - now < 12_000_000


def test_stored_stages_hand_rows_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = durable(rows.mapInArrow(sizes, "n long, size long")).agg(F.sum("n").alias("n"), F.max("size").alias("size")).first()
    assert got["n"] == 3000 and got["size"] < BATCH + 100_000  # 30 MB at once before
    assert spark.conf.get(BATCH_CONF, None) is None


def test_aligned_units_are_held_as_columns_and_only_while_texts_are_aligned():
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    units = [f"{x}{y}{i}{z}" for x in ("pre", "un", "Re") for y in "klmnopqrst" for z in ("ing", "ed") for i in range(500)]
    batch = pa.record_batch({"id": pa.array([0]), "text": pa.array([" ".join(units)])})
    crosstok._ENCODERS.clear()
    crosstok._pair(a, b)
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    assert sum(x.num_rows for x in crosstok._align(iter([batch]), a, b, True)) == 1
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 200 * len(units)  # 322 bytes a unit as Python objects
    list(crosstok._pairs(iter([])))  # a task that only counts links
    assert (a, b) not in crosstok._ENCODERS
