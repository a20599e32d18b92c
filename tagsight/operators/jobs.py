"""User-supplied predictors run over batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import debate_confusing
from ..plans.lineage import durable
from .votes import majority_vote

PREDICTED = "sample_id string, batch_id bigint, position int, pred_label string, confidence double, raw string, error string, attempts int, elapsed_s double"
ARROW = {
    "sample_id": pa.string(), "batch_id": pa.int64(), "position": pa.int32(), "pred_label": pa.string(), "confidence": pa.float64(),
    "raw": pa.string(), "error": pa.string(), "attempts": pa.int32(), "elapsed_s": pa.float64(),
}
#: rows that a task turns into Python objects at once
SLICE_ROWS = 256


def batch_predict(
    batches: DataFrame,
    fn: Callable[..., Sequence],
    *,
    retries: int = 2,
    backoff_s: float = 0.0,
    max_backoff_s: float = 8.0,
    context: str | None = None,
) -> DataFrame:
    """M2: call ``fn(texts)`` once per batch and key the answers by sample.

    ``batches`` has (batch_id, position, sample_id, text).  Batches have a fixed
    size and are spread over the partitions, which is the concurrency.  A task reads its
    rows in order of batches as one stream and holds only the batch that is still open.  ``fn``
    returns one label, or one dict with ``label`` / ``confidence`` / ``raw``, per text.
    A batch that still fails after ``retries`` repeats gives NULL labels and the error.
    ``context`` names a column passed as a second list.
    """
    keep = ["batch_id", "position", "sample_id", "text"] + ([context] if context else [])

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        args = [rows["text"].tolist()] + ([rows[context].tolist()] if context else [])
        answers, error, start, tries = None, None, time.perf_counter(), 0
        while answers is None and tries <= retries:
            tries += 1
            try:
                answers = list(fn(*args))
                if len(answers) != len(rows):
                    raise ValueError(f"{len(answers)} answers for {len(rows)} texts")
            except Exception as exc:  # noqa: BLE001 - the message becomes data
                answers, error = None, f"{type(exc).__name__}: {exc}"
                if backoff_s and tries <= retries:
                    time.sleep(min(max_backoff_s, backoff_s * 2 ** (tries - 1)))
        failed = answers is None
        flat = [
            a if isinstance(a, dict) else {"label": a} for a in (answers or [{}] * len(rows))
        ]
        return pd.DataFrame(
            {
                "sample_id": rows["sample_id"].tolist(),
                "batch_id": rows["batch_id"].tolist(),
                "position": rows["position"].tolist(),
                "pred_label": [a.get("label") for a in flat],
                "confidence": [a.get("confidence") for a in flat],
                "raw": [a.get("raw") for a in flat],
                "error": error if failed else None,
                "attempts": tries,
                "elapsed_s": time.perf_counter() - start,
            }
        )

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS).to_pandas()

    def handed(batches):
        for out in answered(sliced(batches)):
            columns = [pa.Array.from_pandas(out[c], type=t) for c, t in ARROW.items()]
            yield pa.RecordBatch.from_arrays(columns, names=list(ARROW))

    def answered(frames):
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame])
            last = rows["batch_id"].iloc[-1]
            open_ = rows["batch_id"].isna() if pd.isna(last) else rows["batch_id"] == last
            whole, held = rows[~open_], rows[open_]
            if len(whole):
                yield pd.concat([call(batch) for _, batch in whole.groupby("batch_id", sort=False, dropna=False)])
        if held is not None:
            yield call(held)

    sorted_ = batches.select(*keep).repartition("batch_id").sortWithinPartitions("batch_id", "position")
    return sorted_.mapInArrow(handed, PREDICTED)


def two_pass_predict(batches: DataFrame, first: Callable, second: Callable, **kw) -> DataFrame:
    """M7: the second pass sees the first pass's labels; unequal or missing labels are confusing."""
    # stored, so that no batch is sent to the first predictor twice
    a = durable(
        batch_predict(batches, first, **kw).select(
            "sample_id", F.col("pred_label").alias("a_label"), F.col("confidence").alias("a_conf")
        )
    )
    b = batch_predict(batches.join(a, "sample_id"), second, context="a_label", **kw).select(
        "sample_id", "batch_id", F.col("pred_label").alias("b_label"), F.col("confidence").alias("b_conf")
    )
    both = b.join(a, "sample_id")
    confusing = debate_confusing(F.col("a_label"), F.col("b_label"))
    return both.withColumns(
        {"is_confusing": confusing, "pred_label": F.when(~confusing, F.col("b_label"))}
    )


def committee_predict(batches: DataFrame, members: dict[str, Callable], **kw) -> DataFrame:
    """M8: several predictors on the same batches; majority label, ties by name, members kept."""
    if len(members) < 2:
        raise ValueError("a committee needs at least 2 members")
    batches, votes = durable(batches), None
    for name, fn in members.items():
        part = batch_predict(batches, fn, **kw).select(
            "sample_id", F.col("pred_label").alias("label"), F.lit(name).alias("member")
        )
        votes = part if votes is None else votes.unionByName(part)
    votes = durable(votes)  # every member is called once
    vote = majority_vote(votes, ["sample_id"]).select(
        "sample_id", F.col("vote").alias("pred_label"), F.col("vote_share").alias("confidence")
    )
    per = votes.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("member").alias("name"), F.col("label").alias("pred_label")))).alias(
            "members"
        )
    )
    return vote.join(per, "sample_id")
