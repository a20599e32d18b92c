"""Label scalars, canonical names and row correctness as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names by id, spelling aliases and missing marks.
RCT_DATASET = "pubmed_20k_rct"
RCT_LABELS = ("background", "objective", "methods", "results", "conclusions")
RCT_ALIASES = {
    "conclusion": "conclusions",
    "concl": "conclusions",
    "method": "methods",
    "result": "results",
    "objective(s)": "objective",
}
MISSING_MARKS = ("nan", "none", "?")
SAFETY_LEVELS = {
    "casual": 0,
    "possibly_needs_caution": 1,
    "probably_needs_caution": 2,
    "needs_caution": 3,
    "needs_intervention": 4,
}
SAFETY_TO_THREE = {
    "possibly_needs_caution": "needs_caution",
    "probably_needs_caution": "needs_caution",
    "needs_caution": "needs_caution",
}


def literal_map(pairs: dict) -> Column:
    """A small constant dictionary as a map column."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strip(col: Column) -> Column:
    """Trim any white space on both sides (``trim`` alone only drops blanks)."""
    return F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")


def norm_label(col: Column, *, numeric: bool = False) -> Column:
    """Stable label string; ``4.0`` becomes ``4``, blanks and missing marks become NULL."""
    text = strip(col)
    marks = [*MISSING_MARKS, "infinity", "-infinity"] if numeric else list(MISSING_MARKS)
    whole = F.regexp_replace(text, r"^(-*[0-9]+)\.0$", "$1")
    if numeric:
        num = col.cast("double")
        whole = F.when(
            (num == F.floor(num)) & (F.abs(num) < 1e18), num.cast("bigint").cast("string")
        ).otherwise(whole)
    return F.when((text != "") & ~F.lower(text).isin(marks), whole)


def rct_name(col: Column) -> Column:
    """Id, name or alias of the abstract-sentence labels to the name; unknown text stays."""
    raw = F.lower(strip(col))
    lookup = {str(i): name for i, name in enumerate(RCT_LABELS)} | RCT_ALIASES
    return F.coalesce(F.element_at(literal_map(lookup), raw), raw)


def canonical(col: Column, dataset: Column | str | None = None) -> Column:
    """Canonical form of a label for its dataset; NULL stays NULL."""
    plain = F.lower(strip(col))
    if dataset is None:
        return plain
    if isinstance(dataset, str):
        return rct_name(col) if dataset == RCT_DATASET else plain
    return F.when(dataset == RCT_DATASET, rct_name(col)).otherwise(plain)


def canonical_pred(col: Column, dataset: Column | str | None = None) -> Column:
    """Scalar clean-up, then the canonical form."""
    return canonical(norm_label(col), dataset)


def label_from_id_or_name(col: Column, names: tuple[str, ...] = RCT_LABELS) -> Column:
    """Int-like value or name to the label name; other text is lower-cased."""
    text = F.lower(strip(norm_label(col)))
    by_id = {str(i): n for i, n in enumerate(names)}
    return F.coalesce(F.element_at(literal_map(by_id), text), text)


def normalize_text_label(col: Column, style: str = "dunder") -> Column:
    """P10: ``dunder`` strips ``__x__``; ``words`` keeps letters and digits; ``snake`` joins with ``_``."""
    text = F.lower(strip(col))
    if style == "dunder":
        bare = F.regexp_replace(text, r"^__([\s\S]*)__$", "$1")
        return F.replace(bare, F.lit(" "), F.lit("_"))
    if style == "words":
        return strip(F.regexp_replace(text, r"[^a-z0-9]+", " "))
    if style == "snake":
        return F.regexp_replace(text, r"[\s_-]+", "_")
    raise ValueError(f"unknown style {style!r}")


def match_allowed(pred: Column, allowed: Column) -> Column:
    """Exact match first, then ignoring case and outer blanks (last such label wins)."""
    wanted = F.lower(strip(pred))
    loose = F.filter(allowed, lambda a: F.lower(strip(a)) == wanted)
    return F.when(F.array_contains(allowed, pred), pred).otherwise(F.try_element_at(loose, F.lit(-1)))


def labels_equal(gold: Column, pred: Column, dataset: Column | str | None = None) -> Column:
    """Canonical equality; a missing prediction is never equal."""
    return F.coalesce(canonical(gold, dataset) == canonical_pred(pred, dataset), F.lit(False))


def is_correct(
    gold: Column, pred: Column, confusing: Column, dataset: Column | str | None = None
) -> Column:
    """Canonical equality, False for confusing rows and for missing gold."""
    return ~F.coalesce(confusing, F.lit(False)) & labels_equal(gold, pred, dataset)


def parse_label_list(col: Column, allowed: list[str]) -> Column:
    """Comma-separated string to lower-cased labels that are allowed."""
    parts = F.transform(F.split(col, ","), lambda x: F.lower(strip(x)))
    return clean_label_array(parts, allowed)


def clean_label_array(col: Column, allowed: list[str]) -> Column:
    """P41 for arrays."""
    names = F.array(*[F.lit(a.lower()) for a in allowed])
    low = F.transform(col, lambda x: F.lower(strip(x)))
    return F.filter(low, lambda x: F.array_contains(names, x))


def confusion_kind(labels: Column) -> Column:
    """None / single / multi."""
    n = F.size(labels)
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("multi")


def debate_confusing(a: Column, b: Column, *, errors_confuse: bool = True) -> Column:
    """Missing, failed or unequal debate labels are confusing.

    ``errors_confuse=False`` is the older rule, in which a failed side never counts.
    """
    failed = (a == "error") | (b == "error")
    unequal = a.isNull() | b.isNull() | (a != b)
    if errors_confuse:
        return F.coalesce(failed, F.lit(False)) | unequal
    return ~F.coalesce(failed, F.lit(False)) & unequal


def rubric_label(label: Column, rubric: Column, allowed: list[str], levels: int = 4) -> Column:
    """Struct of label and scaled rubric; rubric 1 abstains, unknown labels are errors."""
    r = F.coalesce(rubric.cast("int"), F.lit(2))
    name = F.coalesce(label, F.lit("error"))
    out = F.when(r == 1, "abstain").when(name.isin(list(allowed)), name).otherwise("error")
    return F.struct(
        out.alias("pred_label"),
        r.alias("rubric"),
        F.round(r / F.lit(float(levels)), 4).alias("rubric_scaled"),
    )
