"""Raw model responses to prediction tables, and prompts from batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions.scores import clip01

# Response markers and wrapper keys.
FENCE_OPEN = r"^```[a-zA-Z0-9_-]*\s*"
FENCE_CLOSE = r"\s*```$"
JSON_ARRAY = r"\[[\s\S]*\]"
JSON_ANY = r"(\[[\s\S]*\]|\{[\s\S]*\})"
THOUGHT_BLOCK = r"(?i)<thought>[\s\S]*?</thought>"
FINAL_ANSWER = r"(?i)final\s+answer\s*:?\s*"
WRAPPER_KEYS = ("predictions", "items", "data", "results")
FUZZY_KEYS = ("category", "label", "class", "answer", "prediction")

ITEM = "struct<id:string,label:string,pred_label:string,prediction:string>"
DEBATE = "struct<id:string,label:string,pred_label:string,confidence:string,reasoning:string,reason:string>"
MULTI = "struct<id:string,labels:string,label:string>"


def strip_fences(col: Column) -> Column:
    text = L.strip(col)
    bare = L.strip(F.regexp_replace(F.regexp_replace(text, FENCE_OPEN, ""), FENCE_CLOSE, ""))
    return F.when(F.startswith(text, F.lit("```")), bare).otherwise(text)


def strip_thoughts(col: Column) -> Column:
    return L.strip(F.regexp_replace(F.coalesce(col, F.lit("")), THOUGHT_BLOCK, ""))


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def _unwrapped(blob: Column, item: str) -> Column:
    """Rows of a JSON object: under a wrapper key, or an ``{id: label}`` mapping."""
    wrapper = F.from_json(blob, "struct<" + ",".join(f"{k}:array<{item}>" for k in WRAPPER_KEYS) + ">")
    return F.coalesce(*[wrapper[k] for k in WRAPPER_KEYS])


def _last_by_id(rows: Column) -> Column:
    """A repeated id keeps its last row; rows without an id are dropped."""
    ids = F.reverse(F.transform(rows, lambda r: r["id"]))
    n = F.size(rows)
    return F.filter(rows, lambda r, i: r["id"].isNotNull() & (F.array_position(ids, r["id"]) == n - i))


def _explode(df: DataFrame, rows: Column, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    return (
        df.select(*keep, rows.alias("_rows"))
        .withColumn("parse_status", F.when(F.col("_rows").isNull(), "error").otherwise("ok"))
        .select(*keep, "parse_status", F.explode_outer("_rows").alias("_r"))
        .select(*keep, "parse_status", F.col("_r.id").alias("item_id"), *[c.alias(n) for n, c in fields.items()])
    )


def parse_label_responses(df: DataFrame, allowed: list[str], *, raw: str = "raw_text", keep: list[str]) -> DataFrame:
    """M3: one row per item of a batch response.

    Fences are stripped; a JSON array anywhere in the text is tried first, then an
    object with a wrapper key, then an ``{id: label}`` object.  A response that
    yields nothing stays as one row with ``parse_status='error'``.
    """
    text = strip_fences(F.col(raw))
    array = F.from_json(first_match(text, JSON_ARRAY), f"array<{ITEM}>")
    blob = first_match(text, JSON_ANY)
    pairs = F.transform(
        F.map_entries(F.from_json(blob, "map<string,string>")),
        lambda e: F.struct(
            e["key"].alias("id"), e["value"].alias("label"),
            F.lit(None).cast("string").alias("pred_label"), F.lit(None).cast("string").alias("prediction"),
        ),
    )
    rows = _last_by_id(F.coalesce(array, _unwrapped(blob, ITEM), pairs))
    label = F.coalesce("_r.label", "_r.pred_label", "_r.prediction")
    names = F.array(*[F.lit(a) for a in allowed])
    return _explode(df, rows, keep, {"pred_label": L.match_allowed(label, names)})


def _preference(rows: list) -> tuple[bool, bool, int]:
    """Arrays of labelled items come first, then arrays of objects, then the one with more elements."""
    objects = bool(rows) and all(isinstance(r, dict) for r in rows)
    labelled = objects and any({"id", "labels"} <= r.keys() or {"id", "label"} <= r.keys() for r in rows)
    return labelled, objects, len(rows) if objects else 0


def _json_arrays(text: str) -> Iterator[tuple[int, int, list]]:
    """(begin, end, rows) of the valid JSON arrays of a text.

    The inside of an array of objects is passed over, as it holds nothing that is preferred; so every character is
    decoded a bounded number of times unless arrays nest in arrays.
    """
    decoder, at = json.JSONDecoder(), text.find("[")
    while at >= 0:
        end = at + 1
        try:
            rows, stop = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            pass
        else:
            yield at, stop, rows
            if _preference(rows)[1]:
                end = stop
        at = text.find("[", end)


@F.pandas_udf(T.StringType())
def best_json_array(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The preferred valid JSON array inside each text; of equals the longest, then the first."""

    def best(text: str | None) -> str | None:
        found = max(_json_arrays(text or ""), key=lambda a: (_preference(a[2]), a[1] - a[0], -a[0]), default=None)
        return text[found[0] : found[1]] if found else None

    for chunk in texts:
        yield chunk.map(best)


def answer_array(raw: Column) -> Column:
    """The JSON array of a reasoning response: thoughts dropped, text after 'Final Answer:' preferred."""
    clean = strip_thoughts(strip_fences(raw))
    after = F.regexp_replace(clean, r"^[\s\S]*?" + FINAL_ANSWER, "")
    body = F.when(F.regexp_like(clean, F.lit(FINAL_ANSWER)), after).otherwise(clean)
    return best_json_array(body)


def parse_multilabel_responses(df: DataFrame, allowed: list[str], *, raw: str = "raw_text", keep: list[str]) -> DataFrame:
    """M4: one row per item with its allowed labels, the confusion flag and the scored label."""
    src = df.select(*keep, answer_array(F.col(raw)).alias("_json"))
    rows = _last_by_id(F.from_json("_json", f"array<{MULTI}>"))
    given = F.coalesce("_r.labels", "_r.label")
    many = F.coalesce(F.from_json(given, "array<string>"), F.array(given))
    lookup = L.literal_map({a.strip().lower(): a for a in allowed})
    found = F.filter(
        F.transform(many, lambda x: F.try_element_at(lookup, F.lower(L.strip(x)))), lambda x: x.isNotNull()
    )
    out = _explode(src, rows, keep, {"pred_labels": F.when(F.col("_r").isNotNull(), F.coalesce(found, F.array().cast("array<string>")))})
    single = F.size("pred_labels") == 1
    return out.withColumns(
        {
            "n_pred_labels": F.when(F.col("pred_labels").isNotNull(), F.size("pred_labels")),
            "confusion_kind": F.when(F.col("pred_labels").isNotNull(), L.confusion_kind(F.col("pred_labels"))),
            "is_confusing": ~F.coalesce(single, F.lit(False)),
            "pred_label": F.when(single, F.col("pred_labels")[0]),
        }
    )


def parse_debate_responses(df: DataFrame, allowed: list[str], *, raw: str = "raw_text", keep: list[str]) -> DataFrame:
    """M5: label, confidence clamped to [0, 1] (0 when unusable) and reasoning per item."""
    src = df.select(*keep, answer_array(F.col(raw)).alias("_json"))
    rows = _last_by_id(F.from_json("_json", f"array<{DEBATE}>"))
    lookup = L.literal_map({a.strip().lower(): a for a in allowed})
    label = F.try_element_at(lookup, F.lower(L.strip(F.coalesce("_r.label", "_r.pred_label"))))
    conf = F.coalesce(clip01(F.col("_r.confidence").try_cast("double")), F.lit(0.0))
    return _explode(
        src, rows, keep,
        {
            "pred_label": label,
            "confidence": F.when(F.col("_r").isNotNull(), conf),
            "reasoning": L.strip(F.coalesce("_r.reasoning", "_r.reason", F.lit(""))),
        },
    )


def parse_label_array(df: DataFrame, allowed: list[str], *, n: str | int, raw: str = "raw_text", keep: list[str]) -> DataFrame:
    """M6: a JSON or Python-style label list, cut or padded to n; unknown labels read 'error'."""
    size = F.lit(n) if isinstance(n, int) else F.col(n).cast("int")
    text = F.coalesce(first_match(F.col(raw), JSON_ARRAY), F.col(raw))
    given = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    fixed = F.slice(F.concat(given, F.array_repeat(F.lit("error"), size)), F.lit(1), size)
    names = [a.strip().lower() for a in allowed]
    clean = F.transform(
        fixed,
        lambda x: F.when(F.lower(L.strip(x)).isin(names), F.lower(L.strip(x))).otherwise("error"),
    )
    return df.select(*keep, F.posexplode(clean).alias("position", "pred_label"))


def match_allowed_fuzzy(raw: Column, allowed: list[str]) -> Column:
    """Exact, then first label contained, then a JSON field, then the first label; with the kind."""
    text = F.lower(L.strip(raw))
    exact = F.coalesce(*[F.when(text == a.lower(), F.lit(a)) for a in allowed])
    inside = F.coalesce(*[F.when(F.contains(text, F.lit(a.lower())), F.lit(a)) for a in allowed])
    field = F.lower(L.strip(F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in FUZZY_KEYS])))
    as_json = F.coalesce(*[F.when(field == a.lower(), F.lit(a)) for a in allowed])
    return F.struct(
        F.coalesce(exact, inside, as_json, F.lit(allowed[0])).alias("label"),
        F.when(exact.isNotNull(), "exact")
        .when(inside.isNotNull(), "substring")
        .when(as_json.isNotNull(), "json")
        .otherwise("fallback")
        .alias("match_kind"),
    )


TEMPLATES = {
    "baseline": (
        "Classify every item with one of the allowed labels and answer in JSON only.",
        '[{"id": "...", "label": "..."}]',
    ),
    "rationale": (
        "Classify every item with one of the allowed labels and give a short reason. Answer in JSON only.",
        '[{"id": "...", "label": "...", "reasoning": "..."}]',
    ),
    "multilabel": (
        "List every allowed label that fits an item; the list may be empty. Answer in JSON only.",
        '[{"id": "...", "labels": ["..."]}]',
    ),
    "debate_a": (
        "Argue for the best label of every item and state how sure you are. Answer in JSON only.",
        '[{"id": "...", "label": "...", "confidence": 0.0, "reasoning": "..."}]',
    ),
    "debate_b": (
        "Review the earlier label of every item and correct it where it is wrong. Answer in JSON only.",
        '[{"id": "...", "label": "...", "confidence": 0.0, "reasoning": "..."}]',
    ),
}


def render_prompts(
    batches: DataFrame, allowed: list[str], *, template: str = "baseline", few_shot: DataFrame | None = None,
    extra: str | None = None,
) -> DataFrame:
    """M1: one prompt row per batch: system text, and user text with labels, examples and a JSON payload.

    ``batches`` has (batch_id, position, text); item ids count from 0 inside the
    batch.  ``extra`` names a column passed along with each item, such as the label
    of a first pass.
    """
    task, schema = TEMPLATES[template]
    fields = [F.col("position").cast("string").alias("id"), "text"] + ([F.col(extra)] if extra else [])
    rows = batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("item")))), lambda s: s["item"]
        ).alias("items"),
    )
    names = F.array(*[F.lit(a) for a in allowed])
    payload = F.to_json(
        F.struct(names.alias("allowed_labels"), "items", F.lit(schema).alias("output_schema"))
    )
    shots = F.lit("")
    if few_shot is not None:
        text = few_shot.agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", "text", "label"))),
                    lambda s: F.concat(F.lit("- text: "), s["text"], F.lit("\n  label: "), s["label"]),
                ),
                "\n",
            )
        ).scalar()
        shots = F.concat(F.lit("Examples:\n"), text, F.lit("\n\n"))
    return rows.select(
        "batch_id",
        "n_items",
        F.lit(f"{task}\nAnswer format: {schema}").alias("system_text"),
        F.concat(F.lit("Allowed labels: " + json.dumps(allowed) + "\n\n"), shots, F.lit("Items:\n"), payload).alias(
            "user_text"
        ),
    )
