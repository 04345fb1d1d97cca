"""Label and row predicates as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = "noise"
#: Slack of a confidence range's ends: the column holds 32-bit values.
SLACK = 1e-6


def export_label() -> Column:
    """The label that exports and statistics use: '' stays ''."""
    return F.coalesce("new_label", "label")


def review_label() -> Column:
    """The label that review uses: '' counts as none."""
    return F.coalesce(F.nullif("new_label", F.lit("")), "label")


def verified() -> Column:
    return F.coalesce(F.col("verified") == 1, F.lit(False))


def curated(exclude_noise: bool = True, require_verified: bool = True) -> Column:
    """Rows that count as curated; a label is always needed."""
    found = export_label().isNotNull()
    if require_verified:
        found = verified() & found
    return found & (export_label() != NOISE) if exclude_noise else found


def confidence_range(low: float | None = None, high: float | None = None) -> Column:
    """Inclusive at both ends; an end at its extreme adds no condition, so null confidence shows at full range only."""
    value, found = F.col("confidence").cast("double"), F.lit(True)
    if low is not None and low > 0:
        found = found & (value >= low - SLACK)
    if high is not None and high < 1:
        found = found & (value <= high + SLACK)
    return found


def narrowed(low: float | None, high: float | None) -> bool:
    return bool(low is not None and low > 0 or high is not None and high < 1)


def review_filter(label: str | None = None, hide_verified: bool = False, hide_unverified: bool = False, low: float | None = None, high: float | None = None) -> Column:
    found = confidence_range(low, high)
    if label is not None:
        found = found & (review_label() == label)
    if hide_verified:
        found = found & ~verified()
    if hide_unverified:
        found = found & verified()
    return found


def only_ids(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose roi_index is in a list given as a DataFrame."""
    return df if ids is None else df.join(ids.select("roi_index").distinct(), "roi_index", "left_semi")


def pool_filter(label: str | None = None, mode: str = "effective", with_vector: str | None = None, **filters) -> Column:
    """Similarity pool: like the review filter, the label taken from ``new``, ``original`` or ``effective``."""
    found = review_filter(None, **filters)
    if label is not None:
        found = found & ({"new": F.col("new_label"), "original": F.col("label"), "effective": review_label()}[mode] == label)
    return found & F.col(with_vector).isNotNull() if with_vector else found


def _width() -> Column:
    return (F.col("x_max") - F.col("x_min")).cast("double")


def _height() -> Column:
    return (F.col("y_max") - F.col("y_min")).cast("double")


SORTS = {
    "New Label": (lambda: F.col("new_label"), False),
    "Original Label": (lambda: F.col("label"), False),
    "Image Name": (lambda: F.col("image_name"), False),
    "Sharpness": (lambda: F.col("sharpness"), True),
    "Aspect Ratio": (lambda: _width() / F.nullif(_height(), F.lit(0.0)), False),
    "Confidence (Low-High)": (lambda: F.col("confidence"), False),
    "Confidence (High-Low)": (lambda: F.col("confidence"), True),
    "Box Size": (lambda: _width() * _height(), False),
}


def sort_columns(sorts: list[tuple[str, bool | None]]) -> list[Column]:
    """Stacked sort keys, nulls last in either direction, ties by id. An unknown name sorts by 'New Label'."""
    if not sorts:
        raise ValueError("a sort needs at least one key")
    out = []
    for name, descending in sorts:
        key, usual = SORTS.get(name, SORTS["New Label"])
        down = usual if descending is None else descending
        out.append(key().desc_nulls_last() if down else key().asc_nulls_last())
    return [*out, F.col("id").asc()]


def sort_text(sorts: list[tuple[str, bool | None]]) -> str:
    """'New Label (A-Z), then Box Size (high-low)'."""
    words = []
    for name, descending in sorts:
        down = SORTS.get(name, SORTS["New Label"])[1] if descending is None else descending
        texts = name in ("New Label", "Original Label", "Image Name")
        words.append(f"{name} ({('Z-A' if down else 'A-Z') if texts else ('high-low' if down else 'low-high')})")
    return ", then ".join(words)
