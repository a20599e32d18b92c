"""Deterministic draws, splits and tiers.

Order inside a class is md5 of ``seed|id``.  Only label counts reach the driver,
where the quotas are worked out; rows are picked by :func:`md5_take`, which
shuffles just the md5 buckets that can hold chosen rows and never puts a whole
class into one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.lineage import collect_small, durable, small_table
from ..plans.order import md5_head, md5_rank, md5_take, seeded_key
from .joins import exclude_ids, select_ids

LABEL = "true_label"


def label_sizes(df: DataFrame, label: str = LABEL) -> dict[str, int]:
    """Rows per label on the driver; the number of labels is checked."""
    rows = collect_small(df.groupBy(F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")))
    return {r["l"]: r["n"] for r in rows}


def take_quotas(
    df: DataFrame, quotas: dict[str, int], *, label: str = LABEL, seed: int | str, id_col: str = "sample_id",
    prefix: int | None = None,
) -> DataFrame:
    """The given number of rows of each label in md5 order."""
    table = small_table(df.sparkSession, list(quotas.items()), f"`{label}` string, quota bigint")
    return md5_take(df, table, by=[label], seed=seed, id_col=id_col, prefix=prefix)


def _label_arrays(sizes: dict[str, int], order) -> tuple[list[str], np.ndarray]:
    names = sorted(sizes, key=order)
    return names, np.array([sizes[k] for k in names], np.int64)


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest keys; of equal keys the earlier place."""
    return np.argsort(-keys, kind="stable")[: max(0, k)]


def proportional_quotas(sizes: dict[str, int], n: int) -> dict[str, int] | None:
    """Largest-remainder shares with one row per class where the budget allows.

    Each step is one ranking: the largest remainders take the spare rows; classes without a row take the highest
    units that other classes hold above their first; what passes a class's size fills the classes with most room.
    None means that no allocation adds up to ``n``.
    """
    names, size = _label_arrays(sizes, lambda k: k)
    exact = n * (size / size.sum())
    share = np.floor(exact).astype(np.int64)
    share[_top(exact - share, n - int(share.sum()))] += 1
    bare = np.flatnonzero(share == 0)
    if n >= len(names) and len(bare):
        units = [(height, j) for j, top in enumerate(share) for height in range(max(2, top - len(bare) + 1), top + 1)]
        givers = [j for _, j in sorted(units, reverse=True)[: len(bare)]]
        share -= np.bincount(givers, minlength=len(names)) if givers else 0
        share[bare[: len(givers)]] = 1
    share = np.minimum(share, size)
    order = _top(size - share, len(names))
    room = (size - share)[order]
    share[order] += np.clip(n - share.sum() - (np.cumsum(room) - room), 0, room)
    return dict(zip(names, share.tolist(), strict=True)) if share.sum() == n else None


def stratified_take(
    df: DataFrame, n: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id", prefix: int | None = None,
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """exactly ``n`` rows with the label shares of the table."""
    if n < 0:
        raise ValueError("n must be >= 0")
    if n == 0:
        return df.limit(0)
    sizes = sizes if sizes is not None else label_sizes(df, label)
    if n >= sum(sizes.values()):
        return df
    quotas = proportional_quotas(sizes, n) if len(sizes) > 1 and None not in sizes else None
    if quotas is None:
        return md5_head(df, n, seed=seed, id_col=id_col)
    return take_quotas(df, quotas, label=label, seed=seed, id_col=id_col, prefix=prefix)


def even_quotas(labels: list[str], n: int) -> dict[str, int]:
    """Equal shares, the remainder to the first labels."""
    base, rest = divmod(n, len(labels))
    return {k: base + (i < rest) for i, k in enumerate(labels)}


def balanced_sample(
    df: DataFrame, n: int, *, labels: list[str], label: str = LABEL, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """equal quota per label; a short class is not refilled."""
    if n <= 0:
        return df.limit(0)
    return take_quotas(df, even_quotas(labels, n), label=label, seed=seed, id_col=id_col)


def sample_per_class(
    df: DataFrame, n: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """up to ``n`` rows of every class."""
    quotas = df.select(label).distinct().withColumn("quota", F.lit(int(n)).cast("bigint"))
    return md5_take(df, quotas, by=[label], seed=seed, id_col=id_col)


def sample_min_per_class(
    df: DataFrame, n: int, *, floor: int, labels: list[str], label: str = LABEL, seed: int,
    id_col: str = "sample_id", on_short: str = "error",
) -> DataFrame:
    """``floor`` rows per class, the rest at random; output carries the shuffle key."""
    if n < floor * len(labels):
        raise ValueError("n is below floor x labels")
    sub = df.filter(F.col(label).isin(labels))
    sizes = label_sizes(sub, label)
    short = [x for x in labels if sizes.get(x, 0) < floor]
    if short and on_short == "error":
        raise ValueError(f"not enough rows for {short}")
    base = take_quotas(sub, {x: floor for x in labels}, label=label, seed=seed, id_col=id_col)
    rest = exclude_ids(sub, base, id_col)
    left = n - sum(min(floor, sizes.get(x, 0)) for x in labels)
    both = base.unionByName(md5_head(rest, left, seed=f"{seed}-rest", id_col=id_col)) if left else base
    return shuffled(both, seed=seed, id_col=id_col)


def balanced_fewshot(
    df: DataFrame, n: int, *, labels: list[str], label: str = LABEL, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """even spread over the labels, then random rows up to ``n``."""
    sizes = label_sizes(df, label)
    quotas = {k: min(v, sizes.get(k, 0)) for k, v in even_quotas(labels, n).items()}
    base = take_quotas(df, quotas, label=label, seed=seed, id_col=id_col)
    need = min(n, sum(sizes.values())) - sum(quotas.values())
    if need <= 0:
        return base
    return base.unionByName(md5_head(exclude_ids(df, base, id_col), need, seed=f"{seed}-rest", id_col=id_col))


def balanced_with_replacement(
    df: DataFrame, n: int, *, labels: list[str] | None = None, label: str = LABEL, seed: int,
    id_col: str = "sample_id",
) -> DataFrame:
    """equal quota per present label; a short class repeats its rows (column ``copy_no``)."""
    sizes = label_sizes(df, label)
    present = [x for x in (labels or sorted(sizes)) if sizes.get(x)]
    quotas = even_quotas(present, n)
    ranked = md5_rank(
        df.filter(F.col(label).isin(present)), by=[label], seed=seed, id_col=id_col, out="_r"
    )
    table = small_table(
        df.sparkSession, [(x, quotas[x], sizes[x]) for x in present], f"`{label}` string, _q bigint, _n bigint"
    )
    copies = F.ceil((F.col("_q") - F.col("_r") + 1) / F.col("_n")).cast("int")
    return (
        ranked.join(table, label)
        .withColumn("_k", copies)
        .filter("_k > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_k"))))
        .drop("_r", "_q", "_n", "_k")
    )


def loose_quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """truncated shares, one per class while the budget lasts, the rest by fraction."""
    names, size = _label_arrays(sizes, lambda k: (-sizes[k], k))
    exact = n * size / size.sum()
    share = exact.astype(np.int64)
    share[np.flatnonzero(share == 0)[: max(0, n - int(share.sum()))]] = 1
    by_name = np.argsort(names, kind="stable")
    by_fraction = by_name[_top((exact % 1)[by_name], len(names))]
    open_ = by_fraction[share[by_fraction] < size[by_fraction]]
    share[open_[: max(0, n - int(share.sum()))]] += 1
    return dict(zip(names, np.minimum(share, size).tolist(), strict=True))


def sample_proportional(df: DataFrame, n: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id") -> DataFrame:
    """proportional sample with a random refill."""
    sizes = label_sizes(df, label)
    quotas = loose_quotas(sizes, n)
    base = take_quotas(df, quotas, label=label, seed=seed, id_col=id_col)
    need = min(n, sum(sizes.values())) - sum(quotas.values())
    if need <= 0:
        return base
    return base.unionByName(md5_head(exclude_ids(df, base, id_col), need, seed=f"{seed}-rest", id_col=id_col))


def sample_labels_then_rows(df: DataFrame, n: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id") -> DataFrame:
    """F8: when there are more labels than rows wanted, choose labels, then one row of each."""
    names = md5_head(df.select(label).distinct(), n, seed=seed, id_col=label)
    return sample_per_class(select_ids(df, names, label), 1, label=label, seed=seed, id_col=id_col)


def train_test_split(
    df: DataFrame, n_test: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """stratified split (unstratified when it cannot be) as a ``split`` column."""
    test = stratified_take(df.select(id_col, label), n_test, label=label, seed=seed, id_col=id_col)
    mark = test.select(id_col, F.lit(True).alias("_t"))
    return df.join(mark, id_col, "left").withColumn(
        "split", F.when(F.col("_t"), "test").otherwise("train")
    ).drop("_t")


def train_valid_test_split(
    df: DataFrame, n_holdout: int, *, label: str = LABEL, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """F9 nested: a hold-out that is then halved into valid and test."""
    hold = durable(
        stratified_take(df.select(id_col, label), n_holdout, label=label, seed=seed, id_col=id_col)
    )
    halves = train_test_split(hold, n_holdout // 2, label=label, seed=seed + 1, id_col=id_col).select(
        id_col, F.when(F.col("split") == "test", "test").otherwise("valid").alias("split")
    )
    return df.join(halves, id_col, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def take_with_policy(
    df: DataFrame, n: int, *, policy: str = "error", label: str = LABEL, seed: int, id_col: str = "sample_id",
) -> tuple[DataFrame, str]:
    """F1, or all rows with status 'clipped', or an error when the table is too small."""
    sizes = label_sizes(df, label)
    if n <= sum(sizes.values()):
        return stratified_take(df, n, label=label, seed=seed, id_col=id_col, sizes=sizes), "ok"
    if policy == "clip":
        return df, "clipped"
    raise ValueError(f"requested {n} rows, {sum(sizes.values())} available")


def vault_quotas(
    sizes: dict[str, int], tiers: list[int], clip: set[int]
) -> tuple[list[tuple[int, dict[str, int]]], dict[str, str]]:
    """Per-tier label quotas of ascending disjoint draws, worked out from label counts alone."""
    left, plan, status = dict(sizes), [], {}
    for n in sorted(set(tiers)):
        have = sum(left.values())
        if n > have and n not in clip:
            raise ValueError(f"tier {n}: only {have} rows left")
        status[f"train_seed_{n}"] = "ok" if n <= have else "clipped"
        if n >= have:
            quotas = dict(left)
        else:
            quotas = proportional_quotas({k: v for k, v in left.items() if v}, n)
            if quotas is None:
                raise ValueError(f"tier {n} has no stratified allocation")
        plan.append((n, quotas))
        left = {k: v - quotas.get(k, 0) for k, v in left.items()}
    return plan, status


def assign_spans(
    df: DataFrame, plan: list[tuple[object, dict[str, int]]], *, label: str, seed: int, id_col: str, out: str
) -> DataFrame:
    """Name the part of every row when parts are consecutive quotas of the md5 order of each label.

    Rows beyond all quotas get NULL.
    """
    spans: dict[str, list] = {}
    for part, quotas in plan:
        for k, q in quotas.items():
            lo = spans[k][-1][2] if spans.get(k) else 0
            spans.setdefault(k, []).append((str(part), lo, lo + q))
    table = small_table(
        df.sparkSession, list(spans.items()),
        f"`{label}` string, _spans array<struct<part:string,lo:bigint,hi:bigint>>",
    )
    inside = F.filter("_spans", lambda s: (F.col("_r") > s["lo"]) & (F.col("_r") <= s["hi"]))
    return (
        md5_rank(df, by=[label], seed=seed, id_col=id_col, out="_r")
        .join(table, label, "left")
        .withColumn(out, F.try_element_at(F.transform(inside, lambda s: s["part"]), F.lit(1)))
        .drop("_r", "_spans")
    )


def build_seed_vault(
    train: DataFrame, test: DataFrame, *, seed: int, train_tiers: list[int], test_tiers: list[int],
    label: str = LABEL, clip: tuple[int, ...] = (5000,), id_col: str = "sample_id",
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """ascending disjoint train tiers with the remaining pool, and overlapping test tiers.

    Quotas depend only on label counts, so one ranked pass assigns every train row
    to its tier (``tier`` NULL is the remaining pool).
    """
    plan, status = vault_quotas(label_sizes(train, label), train_tiers, set(clip))
    train_out = assign_spans(train, plan, label=label, seed=seed, id_col=id_col, out="tier").withColumn(
        "tier", F.col("tier").cast("bigint")
    )
    test_out, t_sizes = None, label_sizes(test, label)
    for n in test_tiers:
        if n > sum(t_sizes.values()) and n not in clip:
            raise ValueError(f"test tier {n}: only {sum(t_sizes.values())} rows")
        status[f"test_{n}"] = "ok" if n <= sum(t_sizes.values()) else "clipped"
        part = stratified_take(test, n, label=label, seed=seed, id_col=id_col, sizes=t_sizes).withColumn(
            "tier", F.lit(int(n)).cast("bigint")
        )
        test_out = part if test_out is None else test_out.unionByName(part)
    return train_out, test_out, status


def test_pool(df: DataFrame, frac: float, *, label: str = LABEL, seed: int, id_col: str = "sample_id") -> DataFrame:
    """deterministic stratified fraction (at least one row)."""
    if frac >= 1.0:
        return df
    sizes = label_sizes(df, label)
    n = max(1, int(round(sum(sizes.values()) * frac)))
    return stratified_take(df, n, label=label, seed=seed, id_col=id_col, sizes=sizes)


test_pool.__test__ = False


def shuffled(df: DataFrame, *, seed: int | str, id_col: str = "sample_id") -> DataFrame:
    """seeded order as a column; sort by it where rows leave Spark."""
    return df.withColumn("shuffle_key", seeded_key(seed, id_col))


def cap_rows(df: DataFrame, n: int, *, seed: int, id_col: str = "sample_id") -> DataFrame:
    """``n`` seeded rows in id order."""
    return md5_head(df, n, seed=seed, id_col=id_col).orderBy(id_col)


def few_shot_examples(
    df: DataFrame, n: int, *, exclude: DataFrame | None = None, seed: int | None = None,
    dataset: str | None = None, id_col: str = "sample_id",
) -> DataFrame:
    """F16: the first ``n`` rows in id order, or in seeded order, as (position, text, label)."""
    src = df if exclude is None else exclude_ids(df, exclude, id_col)
    order = F.col(id_col) if seed is None else seeded_key(seed, id_col)
    top = src.select(F.struct(order.alias("k"), F.col(id_col).alias("id"), "text",
                              L.canonical(F.col(LABEL), dataset).alias("label")).alias("s"))
    picked = top.orderBy("s.k", "s.id").limit(int(n)).agg(F.array_sort(F.collect_list("s")).alias("a"))
    return picked.select(F.posexplode("a").alias("position", "s")).select(
        "position", F.col("s.id").alias(id_col), F.col("s.text").alias("text"), F.col("s.label").alias("label")
    )


def confusing_rows(preds: DataFrame, n: int, *, seed: int, id_col: str = "sample_id") -> DataFrame:
    """``n`` rows an earlier run flagged as confusing; an error when there are fewer."""
    pool = preds.filter(F.coalesce("is_confusing", F.lit(False)))
    out = md5_head(pool, n, seed=seed, id_col=id_col)
    if out.count() < n:
        raise ValueError(f"fewer than {n} confusing rows")
    return out.orderBy(id_col)


def one_per_label(df: DataFrame, *, label: str = LABEL, id_col: str = "sample_id") -> DataFrame:
    """the first row of each label in id order, found by a mergeable aggregate."""
    rest = [c for c in df.columns if c not in (label, id_col)]
    return df.groupBy(label).agg(F.min(F.struct(id_col, *rest)).alias("s")).select("s.*", label)


def consensus_select(df: DataFrame, *, a: str, b: str, labels: list[str]) -> DataFrame:
    """F32: rows on which two labelers give the same valid label."""
    return df.filter((F.col(a) == F.col(b)) & F.col(a).isin(list(labels))).withColumn("accepted_label", F.col(a))


def swap_overlap(
    train: DataFrame, val: DataFrame, candidates: DataFrame, *, labels: list[str], seed: int,
    label: str = LABEL, id_col: str = "sample_id",
) -> DataFrame:
    """U4: train ids without those in val, topped up by a balanced draw outside both."""
    common = select_ids(train, val, id_col)
    n = common.count()
    kept = exclude_ids(train.select(id_col), val, id_col)
    if n == 0:
        return kept
    pool = exclude_ids(exclude_ids(candidates, kept, id_col), val, id_col)
    extra = balanced_sample(pool, n, labels=labels, label=label, seed=seed, id_col=id_col).select(id_col)
    return exclude_ids(kept.union(extra).distinct(), val, id_col)


def durable_ids(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Distinct ids written to the shared folder, for draws that build on each other."""
    return durable(df.select(id_col).distinct())
