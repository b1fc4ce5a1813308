"""Running, strictly-prior, fill and change-point columns over ordered rows.

A plain window puts every row of one key into one task. ``ordered`` therefore measures the largest key
first. When no key is larger than ``hot_rows`` the ordinary window is planned. Otherwise the rows of
the few hot keys are cut into consecutive pieces along the order; each piece is scanned on its own and
picks up what it needs from the pieces before (or after) it through one small table of piece
summaries. Both routes give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.session import shuffle_width

PIECE = "_piece"
HOT_ROWS = 2_000_000
SAMPLED = 32  # rows looked at for every piece of a hot sequence
CALENDAR_DAYS = 40_000  # more days than a century: no table of distinct dates is longer


@dataclass(frozen=True)
class Ordered:
    """A DataFrame, the key its sequences belong to, and the columns that order each sequence."""

    df: DataFrame
    part: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False
    largest: int | None = None

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return replace(self, df=self.df.withColumns(columns))

    def where(self, condition: Column) -> Ordered:
        return replace(self, df=self.df.where(condition))

    def result(self) -> DataFrame:
        return self.df.drop(PIECE)


@dataclass(frozen=True)
class Scan:
    """One scanned column: what to carry between pieces and how to read it inside a piece."""

    kind: str
    value: Column
    default: Column | None = None


def running_sum(value: Column) -> Scan:
    return Scan("sum", value)


def prior_sum(value: Column, default: Column | None = None) -> Scan:
    """Sum of strictly earlier rows; ``default`` where there is none."""
    return Scan("prior_sum", value, default)


def running_max(value: Column) -> Scan:
    return Scan("max", value)


def row_number() -> Scan:
    return Scan("sum", F.lit(1).cast("bigint"))


def prior_count() -> Scan:
    return Scan("prior_sum", F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))


def ffill(value: Column) -> Scan:
    """Latest non-null value at or before this row."""
    return Scan("ffill", value)


def bfill(value: Column) -> Scan:
    """Earliest non-null value at or after this row."""
    return Scan("bfill", value)


def lag(value: Column, default: Column | None = None) -> Scan:
    """Value of the row before, null or not; ``default`` on the first row."""
    return Scan("lag", value, default)


def constants(values: Sequence[float]) -> Column:
    """A literal array of doubles, handed over as one text so that long lists stay one expression."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _literal(row: Row, types: Sequence[T.DataType]) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(row, types, strict=True))])


def _rank_below(value: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds lie below ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.array(*bounds)
    strides = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def advance(at: Column, stride: Column) -> Column:
        probe = at + stride
        below = (probe <= len(bounds)) & (F.get(table, probe - 1) < value)
        return F.when(below, probe).otherwise(at)

    return F.aggregate(F.array(*[F.lit(i) for i in strides]), F.lit(0), advance)


def _cut(df: DataFrame, part: tuple[str, ...], order: tuple[str, ...], hot: DataFrame, pieces: int) -> DataFrame:
    """Number the pieces of hot sequences from 1; every other key stays whole as piece 0.

    As in a range exchange, the ends of the pieces are taken from a sample of the hot rows' own orders: at most
    ``SAMPLED`` rows for a piece are fetched. Ends are compared with the whole order, whatever its types, so an instant or
    a text that holds a large share of the rows is divided along the columns behind it. Any ends give the same
    result; the sample only evens the pieces out.
    """
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)).withColumnsRenamed({c: f"_hot_{c}" for c in part}))
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    kept = df.columns
    df = df.join(mark, same, "left").select(*kept, F.coalesce("_hot", F.lit(False)).alias("_hot"))
    types = [df.schema[c].dataType for c in order]
    sample = df.where("_hot").select(*order).orderBy(F.rand(17)).limit(SAMPLED * pieces).orderBy(*order).collect()
    chosen = [sample[i * len(sample) // pieces] for i in range(1, pieces)] if sample else []
    ends = [_literal(row, types) for row in dict.fromkeys(chosen)]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return df.select(*kept, F.when(F.col("_hot"), _rank_below(at, ends) + 1).otherwise(F.lit(0)).alias(PIECE))


def ordered(df: DataFrame, part: Sequence[str], order: Sequence[str], hot_rows: int | None = None,
            at_most: int | None = None) -> Ordered:
    """Prepare a sequence per ``part`` key, measured for skew.

    The measurement is one map-side combined count per key that returns a single row. Only if some key
    exceeds ``hot_rows`` are the hot keys fetched; their number is at most four per shuffle partition.
    ``at_most`` is a proven bound on the largest key (say, from the table this one was grouped from);
    within the limit it saves the measurement.
    """
    part, order = tuple(part), tuple(order)
    spark = df.sparkSession
    if hot_rows is None:
        hot_rows = int(spark.conf.get("spark.playtape.hotRows", str(HOT_ROWS)))
    if at_most is not None and at_most <= hot_rows:
        return Ordered(df, part, order, largest=at_most)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows"))
    top = sizes.agg(F.max("_rows").alias("largest"), F.sum("_rows").alias("total")).first()
    if not top.largest or top.largest <= hot_rows:
        return Ordered(df, part, order, largest=top.largest or 0)
    width = shuffle_width(spark)
    limit = max(hot_rows, top.total // (4 * width))
    hot = sizes.where(F.col("_rows") > limit).select(*part)
    known = spark.createDataFrame(hot.collect(), hot.schema)
    pieces = max(2, min(4 * width, -(-top.largest // hot_rows)) * 2)
    return Ordered(_cut(df, part, order, known, pieces), part, order, True, top.largest)


def _local(s: Scan, running, prior, backwards, step) -> Column:
    if s.kind == "sum":
        return F.sum(s.value).over(running)
    if s.kind == "prior_sum":
        return F.sum(s.value).over(prior)
    if s.kind == "max":
        return F.max(s.value).over(running)
    if s.kind == "ffill":
        return F.last(s.value, ignorenulls=True).over(running)
    if s.kind == "bfill":
        return F.last(s.value, ignorenulls=True).over(backwards)
    return F.lag(F.struct(s.value.alias("v"))).over(step)


def _summary(s: Scan, at: Column) -> Column:
    known_at = F.when(s.value.isNotNull(), at)
    if s.kind in ("sum", "prior_sum"):
        return F.sum(s.value)
    if s.kind == "max":
        return F.max(s.value)
    if s.kind == "ffill":
        return F.max_by(s.value, known_at)
    if s.kind == "bfill":
        return F.min_by(s.value, known_at)
    return F.max_by(F.struct(s.value.alias("v")), at)


def _carry(s: Scan, name: str, before, later, step) -> Column:
    c = F.col(name)
    if s.kind in ("sum", "prior_sum"):
        return F.sum(c).over(before)
    if s.kind == "max":
        return F.max(c).over(before)
    if s.kind == "ffill":
        return F.last(c, ignorenulls=True).over(before)
    if s.kind == "bfill":
        return F.last(c, ignorenulls=True).over(later)
    return F.lag(c).over(step)


def _merge(s: Scan, local: Column, carry: Column) -> Column:
    if s.kind in ("sum", "prior_sum"):
        out = F.coalesce(local + carry, local, carry)
    elif s.kind == "max":
        out = F.greatest(local, carry)
    else:
        out = F.coalesce(local, carry)
    return out


def _finish(s: Scan, merged: Column) -> Column:
    if s.kind == "lag":
        value = merged["v"]
        return value if s.default is None else F.when(merged.isNull(), s.default).otherwise(value)
    return merged if s.default is None else F.coalesce(merged, s.default)


def scan(o: Ordered, **columns: Scan) -> Ordered:
    """Add the scanned columns; all of them share one sort."""
    keys = list(o.part) + ([PIECE] if o.split else [])
    step = Window.partitionBy(*keys).orderBy(*o.order)
    running = step.rowsBetween(Window.unboundedPreceding, 0)
    prior = step.rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in o.order])
    backwards = reverse.rowsBetween(Window.unboundedPreceding, 0)
    if not o.split:
        done = {n: _finish(s, _local(s, running, prior, backwards, step)) for n, s in columns.items()}
        return o.with_columns(done)

    at = F.struct(*o.order)
    pieces = o.df.where(F.col(PIECE) != 0).groupBy(*keys).agg(
        *[_summary(s, at).alias(f"_s_{n}") for n, s in columns.items()]
    )
    along = Window.partitionBy(*o.part).orderBy(PIECE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*o.part).orderBy(F.col(PIECE).desc())
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[_carry(s, f"_s_{n}", before, later, along).alias(f"_c_{n}") for n, s in columns.items()],
    )
    local = o.df.withColumns({f"_l_{n}": _local(s, running, prior, backwards, step) for n, s in columns.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carried, same, "left")
    kept = [c for c in o.df.columns if c not in columns]
    done = [
        _finish(s, _merge(s, F.col(f"_l_{n}"), F.col(f"_c_{n}"))).alias(n) for n, s in columns.items()
    ]
    return replace(o, df=joined.select(*kept, *done))


def run_id(o: Ordered, keys: Sequence[str], out: str = "run_id") -> Ordered:
    """Number the unbroken runs of equal ``keys`` inside each sequence, from 1."""
    o = scan(o, _was=lag(F.struct(*[F.col(k) for k in keys])))
    changed = ~F.struct(*[F.col(k) for k in keys]).eqNullSafe(F.col("_was"))
    o = scan(o, **{out: running_sum(changed.cast("bigint"))})
    return replace(o, df=o.df.drop("_was"))


def fill_both(o: Ordered, column: str, out: str) -> Ordered:
    """Forward fill, then backward fill what is still missing."""
    o = scan(o, _fwd=ffill(F.col(column)), _bwd=bfill(F.col(column)))
    o = o.with_columns({out: F.coalesce("_fwd", "_bwd")})
    return replace(o, df=o.df.drop("_fwd", "_bwd"))


def fixed_running_max(o: Ordered, column: str, out: str) -> Ordered:
    """Missing values carried forward (zero at the start), then forced non-decreasing."""
    o = scan(o, _seen=ffill(F.col(column)))
    o = o.with_columns({"_seen": F.coalesce(F.col("_seen"), F.lit(0))})
    o = scan(o, **{out: running_max(F.col("_seen"))})
    o = o.with_columns({f"{out}_corrected": (F.col(out) != F.col("_seen"))})
    return replace(o, df=o.df.drop("_seen"))


def whole(df: DataFrame) -> DataFrame:
    """One constant key, for sequences that run over the whole table."""
    return df.withColumn("_all", F.lit(0))
