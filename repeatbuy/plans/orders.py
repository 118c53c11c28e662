"""From raw order lines to the staged tables every feature reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from repeatbuy.functions.skew import Sizes
from repeatbuy.operators import clean, timeline
from repeatbuy.operators.features import streak_walk
from repeatbuy.operators.outliers import remove_gap_outliers
from repeatbuy.plans.staging import by_customer, discard, stage_as_it_lies, stage_by_customer


# What the purchase-gap table needs of a line; the rest would only widen its shuffle.
GAP_COLUMNS = [
    "cid", "bid", "catid", "classid", "checkoutdate", "days", "price", "cat_reordered",
    "days_since_prior_order", "from_last",
    *[f"{c}_{k}" for k in timeline.LEVELS for c in ("anchor", "label_gap")],
]


class Walks(Mapping[str, DataFrame]):
    """Streak walks by product key, each built when it is first asked for."""

    def __init__(self, keys: list[str], build: Callable[[str], DataFrame]):
        self._keys, self._build = keys, build
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._keys:
            raise KeyError(key)
        if key not in self._built:
            self._built[key] = self._build(key)
        return self._built[key]

    def __iter__(self):
        return iter(self._keys)

    def __len__(self) -> int:
        return len(self._keys)


class Orders:
    """Enriched lines, basket timeline, streak walks by product key and, at category grain, lines
    with purchase gaps. All of them serve every holdout level. Walks and gaps are staged for the
    first query that reads them."""

    def __init__(self, lines: DataFrame, baskets: DataFrame, gaps: bool, sizes: Sizes):
        self.lines, self.baskets, self.sizes, self._gaps = lines, baskets, sizes, gaps
        self.walks = Walks([k for k in ("iid", "catid") if k in lines.columns], self._walk)

    def _walk(self, key: str) -> DataFrame:
        return stage_by_customer(streak_walk(self.lines, ["cid", key], self.sizes), "walk", self.sizes)

    @cached_property
    def gapped(self) -> DataFrame | None:
        if not self._gaps:
            return None
        rows = self.lines.select(*GAP_COLUMNS)
        return stage_by_customer(timeline.purchase_gaps(rows, ["cid", "catid"], self.sizes), "gapped", self.sizes)


def valid_lines(lines: DataFrame, min_price: float = 300) -> DataFrame:
    """Complete lines with plausible price and quantity and a segment label."""
    return clean.fill_label(clean.range_filter(clean.drop_missing(lines), min_price))


def popular_lines(
    lines: DataFrame, min_orders: int, rare_class: int, staged: bool = False
) -> DataFrame:
    """Lines of customers with enough baskets, in classes with enough lines."""
    sizes = Sizes(lines, staged)
    return clean.drop_rare_classes(
        clean.min_orders(lines, min_orders, sizes), rare_class, sizes
    )


def item_lines(
    raw: DataFrame, min_price: float = 300, min_orders: int = 2, rare_class: int = 25
) -> DataFrame:
    """Cleaned item lines; ``raw`` should be a columnar table, it is read more than once."""
    return popular_lines(valid_lines(raw, min_price), min_orders, rare_class, staged=True)


def rolled_lines(raw: DataFrame, min_price: float = 300) -> DataFrame:
    return clean.category_rollup(valid_lines(raw, min_price))


def staged_rollup(raw: DataFrame, min_price: float = 300) -> DataFrame:
    return stage_by_customer(rolled_lines(raw, min_price), "rolled", Sizes(raw, staged=True))


def category_lines(
    raw: DataFrame, min_price: float = 300, min_orders: int = 2, rare_class: int = 25,
) -> DataFrame:
    return popular_lines(staged_rollup(raw, min_price), min_orders, rare_class, staged=True)


def build_orders(cleaned: DataFrame, gaps: bool, otli: int | None = None) -> Orders:
    """Enrich cleaned lines and stage them with their basket timeline.

    Re-order flags come from all cleaned lines. With ``otli`` the gap rules then drop customers
    and baskets, and the timeline and holdout columns are built on what is left. Tables lie by
    customer where none is hot; those that nothing reads later are deleted.
    """
    base = stage_as_it_lies(cleaned, "cleaned")
    sizes = Sizes(base, staged=True)
    done = [base]
    dealt = by_customer(base) if sizes.plain(["cid"]) else base
    flagged = timeline.enrich(dealt, sizes).drop(*timeline.FIRST_NAMES.values())
    if otli is not None:
        before = timeline.basket_timeline(timeline.basket_rows(base), sizes)
        before = stage_by_customer(before, "timeline", sizes)
        flagged = stage_by_customer(
            remove_gap_outliers(flagged, before, otli, sizes=sizes), "without_gaps", sizes
        )
        done += [before, flagged]
        base, sizes = flagged, Sizes(flagged, staged=True)
    walked = timeline.basket_timeline(timeline.basket_rows(base), sizes)
    walked = stage_by_customer(walked, "timeline", sizes)
    done.append(walked)
    baskets = timeline.holdout_columns(walked, sizes=Sizes(walked, staged=True))
    baskets = stage_by_customer(baskets, "baskets", sizes)
    lines = stage_by_customer(timeline.with_timeline(flagged, baskets, sizes), "lines", sizes)
    for table in done:
        discard(table)
    return Orders(lines, baskets, gaps, Sizes(lines, staged=True))
