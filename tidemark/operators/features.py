"""Feature views, point-in-time joins, the latest-value table and lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.plans.blocks import TimeBlocks

DAY = 86_400.0


@dataclass(frozen=True)
class FeatureView:
    """A named group of features of one entity with event time and time to live (seconds)."""

    name: str
    entity: str
    ts: str
    features: tuple[str, ...]
    ttl: float = 365 * DAY
    transform: Callable[[DataFrame], DataFrame] | None = None

    def rows(self, source: DataFrame) -> DataFrame:
        """Source rows through the user transform, cut to the declared columns."""
        out = source.transform(self.transform) if self.transform else source
        return out.select(self.entity, self.ts, *[F.col(f).cast("double").alias(f) for f in self.features])


CATALOG: dict[str, FeatureView] = {}


def register_view(view: FeatureView) -> FeatureView:
    CATALOG[view.name] = view
    return view


def newest_row(cols: Sequence[str], ts: str) -> Column:
    """The columns of one newest row, as a struct; of rows with equal times the one that is greatest by its columns."""
    row = F.struct(*cols)
    return F.max_by(row, F.when(F.col(ts).isNotNull(), F.struct(F.col(ts), row)))


def point_in_time(spine: DataFrame, features: DataFrame, entity: str, ts: str, feature_ts: str, cols: Sequence[str],
                  ttl: float = 365 * DAY, block: float | None = None, rows: int | None = None) -> DataFrame:
    """Each spine row with the newest feature row of its entity at or before its time, not older than ``ttl``.

    Of feature rows with equal times the one that is greatest by its columns counts, as a whole. Rows are
    grouped by entity and block, blocks being cut by the rows of both sides in them (``plans.blocks``; ``block`` and
    ``rows`` are the length in seconds and the number of rows), so an entity with a third of all rows, or a burst of one, spreads over many
    tasks. Inside a block the two sides are merged by time and the last feature row is carried forward.
    A block that starts without one takes it from a table holding the newest feature row of each
    (entity, block), which combines map-side and has no more rows than the features.
    """
    carried = ["_f_us", *cols]
    left = spine.withColumns({"_us": micros(F.col(ts)), "_side": F.lit(1)})
    right = features.select(F.col(entity), micros(F.col(feature_ts)).alias("_us"), F.lit(0).alias("_side"), *cols)
    right = right.where(F.col("_us").isNotNull()).withColumn("_f_us", F.col("_us"))
    blocks = TimeBlocks(left.select(entity, "_us").union(right.select(entity, "_us")), [entity], "_us", block, rows)
    left, right = blocks.place(left.drop(*[c for c in cols if c in spine.columns])), blocks.place(right)

    newest = right.groupBy(entity, "_blk").agg(newest_row(["_f_us", *cols], "_us").alias("_row")).select(entity, "_blk", "_row.*")
    stops = left.select(entity, "_blk").distinct().withColumn("_stop", F.lit(True))
    ladder = stops.join(newest.withColumn("_has", F.lit(True)), [entity, "_blk"], "full")
    earlier = Window.partitionBy(entity).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    packed = F.when(F.col("_has"), F.struct(*carried))
    start = (
        ladder.withColumn("_start", F.last(packed, True).over(earlier))
        .where("_stop").select(entity, "_blk", F.col("_start"))
    )

    merged = left.unionByName(right, allowMissingColumns=True)
    upto = Window.partitionBy(entity, "_blk").orderBy("_us", "_side", *cols).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("_side") == 0, F.struct(*carried)), True).over(upto)
    local = merged.withColumn("_local", inside).where("_side = 1").drop(*carried)
    both = local.join(start, [entity, "_blk"], "left").withColumn("_hit", F.coalesce("_local", "_start"))
    fresh = F.col("_us") - F.col("_hit._f_us") <= int(ttl * 1e6)
    own = [c for c in spine.columns if c not in cols]
    return both.select(*own, *[F.when(fresh, F.col(f"_hit.{c}")).alias(c) for c in cols])


def materialize_latest(rows: DataFrame, entity: str, ts: str, cols: Sequence[str], as_of: str | None = None,
                       ttl: float | None = None) -> DataFrame:
    """Newest row per entity, optionally as of a moment and no older than ``ttl`` seconds before it."""
    if as_of is not None:
        end = F.lit(as_of).cast("timestamp_ntz")
        rows = rows.where(F.col(ts) <= end)
        if ttl is not None:
            rows = rows.where(F.col(ts) >= end - F.make_dt_interval(secs=F.lit(float(ttl))))
    best = rows.groupBy(entity).agg(F.max(ts).alias(ts), newest_row(cols, ts).alias("_row"))
    return best.select(entity, ts, *[F.col("_row")[c].alias(c) for c in cols])


def online_lookup(latest: DataFrame, keys: DataFrame, entity: str) -> DataFrame:
    """Features of the asked entities; unknown ones give nulls. The join strategy follows the measured sizes."""
    return keys.join(latest, entity, "left")


def training_set(view: DataFrame, labels: DataFrame, entity: str, target: str) -> DataFrame:
    """Features joined with the label table by entity."""
    return view.join(labels.select(entity, target), entity)


def merge_latest(current: DataFrame | None, batch: DataFrame, entity: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """The latest-value table after a batch of new or changed rows."""
    rows = batch.select(entity, ts, *cols)
    if current is not None:
        rows = current.select(entity, ts, *cols).unionByName(rows)
    return materialize_latest(rows, entity, ts, cols)
