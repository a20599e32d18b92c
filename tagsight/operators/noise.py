"""Controlled label and text noise with lineage columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import literal_map
from ..functions.text import corrupt_words
from ..plans.lineage import durable
from ..plans.order import md5_head, md5_rank, seeded_key
from .sampling import assign_spans, label_sizes, proportional_quotas, stratified_take, take_quotas

# Labels that are easily taken for each other.
RCT_NEIGHBOURS = {
    "background": ("objective",),
    "objective": ("background", "methods"),
    "methods": ("objective", "results"),
    "results": ("methods", "conclusions"),
    "conclusions": ("results",),
}
TEXT_MODES = ("word_dropout", "word_shuffle", "truncate", "swap_adjacent")


def _chosen(df: DataFrame, quotas: dict[str, int], label: str, seed: int, id_col: str) -> DataFrame:
    """``df`` with ``_hit`` on the quota of every label."""
    hit = take_quotas(df, quotas, label=label, seed=seed, id_col=id_col).select(
        id_col, F.lit(True).alias("_hit")
    )
    return df.join(hit, id_col, "left")


def _draw(seed: int | str, id_col: str, n: Column | int) -> Column:
    """Integer in [0, n) from md5 of ``seed-label|id``."""
    hexed = F.substring(seeded_key(f"{seed}-label", id_col), 1, 8)
    return F.pmod(F.conv(hexed, 16, 10).cast("bigint"), n)


def _with_lineage(df: DataFrame, new_label: Column, kind: str, label: str) -> DataFrame:
    changed = F.col("_hit") & new_label.isNotNull()
    return df.withColumns(
        {
            "observed_label": F.when(changed, new_label).otherwise(F.col(label)),
            "is_corrupted": F.coalesce(changed, F.lit(False)),
            "corruption_kind": F.when(changed, kind).otherwise(""),
            "corruption_detail": F.when(changed, F.concat(F.col(label), F.lit("->"), new_label)).otherwise(""),
        }
    ).drop("_hit")


def _other_label(names: list[str], label: str, seed: int, id_col: str) -> Column:
    """A seeded choice among the labels other than the row's own."""
    others = F.filter(F.array(*[F.lit(x) for x in names]), lambda x: x != F.col(label))
    return F.try_element_at(others, (_draw(seed, id_col, max(1, len(names) - 1)) + 1).cast("int"))


def _near_label(neighbours: dict[str, tuple[str, ...]], names: list[str], label: str, seed: int, id_col: str) -> Column:
    """A seeded choice among the label's neighbours that occur in the data."""
    pairs = [(k, [x for x in neighbours.get(k, ()) if x in names]) for k in names]
    table = F.create_map(
        *[v for k, near in pairs for v in (F.lit(k), F.array(*[F.lit(x) for x in near]).cast("array<string>"))]
    )
    near = F.try_element_at(table, F.col(label))
    pick = _draw(seed, id_col, F.greatest(F.lit(1), F.size(near))) + 1
    return F.try_element_at(near, pick.cast("int"))


def noise_quotas(sizes: dict[str, int], frac: float) -> dict[str, int]:
    """``max(1, round(n x frac))`` per class, none for a fraction of 0."""
    if frac <= 0:
        return {k: 0 for k in sizes}
    return {k: min(n, max(1, round(n * frac))) for k, n in sizes.items()}


def corrupt_labels_random(
    df: DataFrame, frac: float, *, seed: int, label: str = "true_label", id_col: str = "sample_id"
) -> DataFrame:
    """A share of every class gets one of the other labels."""
    sizes = label_sizes(df, label)
    marked = _chosen(df, noise_quotas(sizes, frac), label, seed, id_col)
    return _with_lineage(marked, _other_label(sorted(sizes), label, seed, id_col), "random_label", label)


def corrupt_labels_correlated(
    df: DataFrame, frac: float, *, neighbours: dict[str, tuple[str, ...]], seed: int, label: str = "true_label",
    id_col: str = "sample_id",
) -> DataFrame:
    """A share of every class gets a neighbouring label."""
    sizes = label_sizes(df, label)
    marked = _chosen(df, noise_quotas(sizes, frac), label, seed, id_col)
    new = _near_label(neighbours, sorted(sizes), label, seed, id_col)
    return _with_lineage(marked, new, "correlated_label", label)


def corrupt_labels_swap(
    df: DataFrame, pairs: list[tuple[str, str]], rate: float, *, seed: int, label: str = "true_label",
    id_col: str = "sample_id",
) -> DataFrame:
    """``int(n x rate)`` rows of either class of a pair swap their label."""
    sizes = label_sizes(df, label)
    partner = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    quotas = {k: int(sizes.get(k, 0) * rate) for k in partner}
    new = F.try_element_at(literal_map(partner), F.col(label))
    return _with_lineage(_chosen(df, quotas, label, seed, id_col), new, "swap_label", label)


def corrupt_labels_boundary(
    df: DataFrame, boundary: dict[str, str], *, boundary_frac: float = 0.08, random_frac: float = 0.02, seed: int,
    label: str = "true_label", id_col: str = "sample_id",
) -> DataFrame:
    """A boundary map on one share of the rows, a random label on a disjoint smaller share."""
    sizes = label_sizes(df, label)
    n, names = sum(sizes.values()), sorted(sizes)
    n_edge, n_rand = int(n * boundary_frac), int(n * random_frac)
    head = md5_head(df, n_edge + n_rand, seed=seed, id_col=id_col).select(id_col)
    ranked = md5_rank(head, by=[], seed=seed, id_col=id_col, out="_r")
    joined = df.join(ranked, id_col, "left").withColumn("_hit", F.col("_r").isNotNull())
    near = F.try_element_at(literal_map(boundary), F.col(label))
    new = F.when(F.col("_r") <= n_edge, near).otherwise(_other_label(names, label, seed, id_col))
    return _with_lineage(joined, new, "boundary_label", label).drop("_r")


def corrupt_labels_shift(
    df: DataFrame, n: int, *, labels: list[str], seed: int, label: str = "true_label", id_col: str = "sample_id"
) -> DataFrame:
    """``n`` rows move to the next class, the last class to the first."""
    hit = md5_head(df, n, seed=seed, id_col=id_col).select(id_col, F.lit(True).alias("_hit"))
    follow = {a: labels[(i + 1) % len(labels)] for i, a in enumerate(labels)}
    new = F.try_element_at(literal_map(follow), F.col(label))
    return _with_lineage(df.join(hit, id_col, "left"), new, "shift_label", label)


def corrupt_text(
    df: DataFrame, frac: float, *, mode: str = "word_dropout", seed: int, label: str = "true_label",
    text: str = "text", id_col: str = "sample_id", keep_least: int = 2,
) -> DataFrame:
    """Word-level noise on a share of every class, in column expressions; dropout keeps ``keep_least`` words."""
    marked = _chosen(df, noise_quotas(label_sizes(df, label), frac), label, seed, id_col)
    return _noisy_text(marked, mode, seed, text, id_col, keep_least)


def _noisy_text(marked: DataFrame, mode: str, seed: int, text: str, id_col: str, keep_least: int = 2) -> DataFrame:
    on = F.coalesce("_hit", F.lit(False))
    key = F.concat_ws("|", F.lit(f"{seed}-words"), F.col(id_col).cast("string"))
    return marked.withColumns(
        {
            "observed_text": F.when(on, corrupt_words(F.col(text), key, mode, keep_least=keep_least)).otherwise(F.col(text)),
            "is_corrupted": on,
            "corruption_kind": F.when(on, f"text_{mode}").otherwise(""),
            "corruption_detail": F.when(on, mode).otherwise(""),
        }
    ).drop("_hit")


def corruption_eval_frame(
    df: DataFrame, n: int, *, share: float, seed: int, neighbours: dict[str, tuple[str, ...]],
    text_mode: str = "word_dropout", label: str = "true_label", text: str = "text", id_col: str = "sample_id",
) -> DataFrame:
    """A stratified sample cut into disjoint groups with random-label, correlated-label and
    text noise (``share`` of the sample each); the rest stays clean.

    The groups follow from label counts, so one ranked pass over the sample is enough.
    """
    base = durable(stratified_take(df, n, label=label, seed=seed, id_col=id_col))
    left = label_sizes(base, label)
    names, total = sorted(left), sum(left.values())
    kinds = ["random_label", "correlated_label", f"text_{text_mode}"]
    per, extra = divmod(round(total * share * len(kinds)), len(kinds))
    plan = []
    for i, kind in enumerate(kinds):
        want = min(per + (i < extra), sum(left.values()))
        quotas = proportional_quotas({k: v for k, v in left.items() if v}, want)
        plan.append((kind, quotas))
        left = {k: v - quotas.get(k, 0) for k, v in left.items()}
    parts = assign_spans(base, plan, label=label, seed=seed, id_col=id_col, out="kind").withColumn(
        "_hit", F.lit(True)
    )
    near = _near_label(neighbours, names, label, seed, id_col)
    rand = _other_label(names, label, seed, id_col)
    out = _with_lineage(parts.filter("kind = 'random_label'"), rand, "random_label", label)
    for frame in (
        _with_lineage(parts.filter("kind = 'correlated_label'"), near, "correlated_label", label),
        _noisy_text(parts.filter(F.col("kind") == kinds[2]), text_mode, seed, text, id_col),
        parts.filter("kind IS NULL").withColumns(
            {"kind": F.lit("clean"), "is_corrupted": F.lit(False), "corruption_kind": F.lit("clean"),
             "corruption_detail": F.lit("")}
        ).drop("_hit"),
    ):
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.withColumns(
        {
            "observed_label": F.coalesce("observed_label", F.col(label)),
            "observed_text": F.coalesce("observed_text", F.col(text)),
        }
    )
