"""Sample and frame series: level, frames, silence segments, lag."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.operators.skew import keyed_join

TINY = 1e-12


def level_stats(samples: DataFrame, keys: Sequence[str], value: str = "value", target: float = -23.0) -> DataFrame:
    """RMS level in dB, peak, and the gain to ``target`` after peak limiting at 0.99."""
    v = F.col(value)
    stats = samples.groupBy(*keys).agg(
        F.count(v).alias("n_samples"),
        (20.0 * F.log10(F.sqrt(F.avg(v * v) + TINY))).alias("rms_dbfs"),
        F.max(F.abs(v)).alias("peak"),
    )
    gain = F.pow(F.lit(10.0), (F.lit(float(target)) - F.col("rms_dbfs")) / 20.0)
    stats = stats.withColumn("gain", gain)
    limited = F.when(F.col("peak") * F.col("gain") > 0.99, 0.99 / F.col("peak")).otherwise(F.col("gain"))
    return stats.withColumn("limited_gain", limited)


def normalize_level(samples: DataFrame, keys: Sequence[str], value: str = "value", target: float = -23.0) -> DataFrame:
    """Samples scaled to the target level and peak-limited."""
    gains = level_stats(samples, keys, value, target).select(*keys, "limited_gain")
    return keyed_join(samples, gains, keys).withColumn(value, F.col(value) * F.col("limited_gain")).drop("limited_gain")


def frame_rms(samples: DataFrame, keys: Sequence[str], frame_len: int, hop: int, index: str = "i", value: str = "value") -> DataFrame:
    """RMS of overlapping frames; the tail and missing samples count as zeros.

    Every frame of the series has a row, also one in which no sample falls.

    A sample belongs to at most ceil(frame_len / hop) frames. It is sent to those
    frames and summed map-side, so no series is ever gathered in one task.
    """
    ends = samples.groupBy(*keys).agg((F.max(index) + 1).alias("__len"))
    n_frames = 1 + F.ceil(F.greatest(F.col("__len") - frame_len, F.lit(0)) / F.lit(float(hop)))
    ends = ends.withColumn("__nf", n_frames.cast("long"))
    i = F.col(index)
    first = F.greatest(F.lit(0), F.ceil((i - frame_len + 1) / F.lit(float(hop))))
    last = F.floor(i / F.lit(float(hop)))
    hits = samples.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    sums = hits.groupBy(*keys, F.col("frame").cast("long").alias("frame")).agg(F.sum(F.col(value) * F.col(value)).alias("__e"))
    rms = F.sqrt(F.coalesce("__e", F.lit(0.0)) / float(frame_len) + TINY)
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nf") - 1)).alias("frame"))
    return keyed_join(grid, sums, [*keys, "frame"], "left").select(*keys, "frame", rms.alias("rms"), (20.0 * F.log10(rms + TINY)).alias("db"))


def silence_segments(
    frames: DataFrame,
    keys: Sequence[str],
    threshold_db: float,
    hop: float = 1.0,
    max_gap_frames: int = 1,
    min_length: float = 0.0,
    pad: float = 0.0,
    length: str | None = None,
    drop_first: bool = False,
    chunk: int = 65_536,
) -> DataFrame:
    """Active segments of each recording from its frame levels.

    Runs of active frames at most ``max_gap_frames`` silent frames apart are merged,
    padded, clipped to the recording, and dropped when shorter than ``min_length``
    (tested after padding). Frames absent from the table are silent; ``length`` names a
    column with the recording length, else it ends with its last frame.

    Runs are found per chunk of ``chunk`` frames. Only a chunk's first and last run can go on
    in another chunk, so only these, two rows a chunk at most, are stitched in one window
    for a recording; segments are numbered by chunk with the counts of earlier chunks.
    """
    span = frames.groupBy(*keys).agg(
        (F.max(F.col(length).cast("double")) if length else ((F.max("frame") + 1) * float(hop)).cast("double")).alias("__end")
    )
    active = frames.filter(F.col("db") > threshold_db).select(*keys, "frame").withColumn("__c", F.floor(F.col("frame") / F.lit(chunk)))

    def runs(df: DataFrame, part: list[str], start: str, stop: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(start)
        new = F.col(start) - F.lag(stop).over(w) > max_gap_frames
        numbered = df.withColumn("__run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
        return numbered.groupBy(*part, "__run").agg(F.min(start).alias("__s"), F.max(stop).alias("__e")).drop("__run")

    local = runs(active.withColumn("__stop", F.col("frame") + 1), [*keys, "__c"], "frame", "__stop")
    ends = Window.partitionBy(*keys, "__c")
    local = local.withColumn("__edge", (F.col("__s") == F.min("__s").over(ends)) | (F.col("__s") == F.max("__s").over(ends)))
    stitched = runs(local.filter("__edge").withColumnsRenamed({"__s": "__s0", "__e": "__e0"}), list(keys), "__s0", "__e0")
    merged = stitched.unionByName(local.filter("not __edge").select(*keys, "__s", "__e"))
    padded = keyed_join(merged, span, keys).select(
        *keys, "__s",
        F.greatest(F.lit(0.0), F.col("__s") * float(hop) - float(pad)).alias("segment_start"),
        F.least(F.col("__end"), F.col("__e") * float(hop) + float(pad)).alias("segment_end"),
    )
    kept = padded.filter(F.col("segment_end") - F.col("segment_start") >= float(min_length))
    kept = kept.withColumn("__c", F.floor(F.col("__s") / F.lit(chunk)))
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    order = Window.partitionBy(*keys, "__c").orderBy("__s")
    numbered = keyed_join(kept, before, [*keys, "__c"]).withColumn("segment", F.col("__before") + F.row_number().over(order) - 1)
    if drop_first:
        numbered = numbered.filter(F.col("segment") > 0).withColumn("segment", F.col("segment") - 1)
    return numbered.withColumn("duration", F.col("segment_end") - F.col("segment_start")).select(
        *keys, "segment", "segment_start", "segment_end", "duration"
    )


def standardise(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Zero mean and unit population deviation (plus 1e-8) inside each series."""
    stats = series.groupBy(*keys).agg(F.avg(value).alias("__m"), (F.stddev_pop(value) + 1e-8).alias("__s"))
    return keyed_join(series, stats, keys).withColumn(value, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


#: Numbers that the Fourier products of one step may hold.
CELLS = 1 << 20


def _correlate(names: list[str], reach: int):
    """Correlations of blocks by FFT: a row per pair of blocks and lag.

    Products are as long as the longest block of their step needs, so short series cost little.
    A step takes as many pairs of blocks as ``CELLS`` allows, and nothing of it is kept.
    """

    def spread(cells: pa.Array, width: int) -> np.ndarray:
        """(2 x blocks x width): values and whether a sample is there."""
        rows = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        at, v = rows * width + flat.field("i").to_numpy(), flat.field("v").to_numpy()
        n = len(cells) * width
        return np.stack([np.bincount(at, weights=v, minlength=n), np.bincount(at, minlength=n).astype(float)]).reshape(2, len(cells), width)

    def extent(cells: pa.ListArray) -> int:
        return 1 + int(cells.flatten().field("i").to_numpy().max())

    def lags_of(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
        width = extent(left)
        size = 1 << (max(extent(right), width + 2 * reach) - 1).bit_length()
        x, y = np.fft.rfft(spread(left, width), size), np.fft.rfft(spread(right, size), size)
        return np.fft.irfft(y * np.conj(x), size)[..., : 2 * reach + 1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column("__r"), batch.column("__t")
            longest = 1 << (max(extent(left) + 2 * reach, extent(right)) - 1).bit_length()
            step = max(1, CELLS // longest)
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                total, pairs = lags_of(part.column("__r"), part.column("__t"))
                which, met = np.nonzero(np.rint(pairs) > 0)
                columns = [part.column(n).take(pa.array(which)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(met - reach, pa.int32()), pa.array(total[which, met])], names=[*names, "lag", "correlation"])

    return run


def correlations(
    ref: DataFrame, test: DataFrame, keys: Sequence[str], max_lag: int, index: str = "i", value: str = "value", block: int | None = None
) -> DataFrame:
    """Plain cross-correlation of standardised series for every lag within ``max_lag`` at which samples meet.

    Series are cut into blocks of ``block`` reference samples; the test samples up to
    ``max_lag`` around a block go with it, so a sample is in a few blocks however many lags
    there are. A pair of blocks gives its part of all lags by one Fourier product (overlap-save),
    and the parts are summed by lag. One long series is thus many tasks.
    """
    block = block or max(8192, 1 << (2 * max_lag).bit_length())
    r = standardise(ref.select(*keys, index, value), keys, value).filter(F.col(value).isNotNull())
    t = standardise(test.select(*keys, index, value), keys, value).filter(F.col(value).isNotNull())

    def cells(df: DataFrame, first: int, out: str) -> DataFrame:
        cell = F.struct((F.col(index) - F.col("__b") * block + first).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
        return df.groupBy(*keys, "__b").agg(F.collect_list(cell).alias(out))

    part = lambda shift: F.floor((F.col(index) + F.lit(shift)) / F.lit(block)).cast("long")
    left = cells(r.withColumn("__b", part(0)), 0, "__r")
    right = cells(t.withColumn("__b", F.explode(F.sequence(part(-max_lag), part(max_lag)))), max_lag, "__t")
    both = keyed_join(left, right, [*keys, "__b"]).select(*keys, "__r", "__t")
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema)
    parts = both.mapInArrow(_correlate(list(keys), max_lag), f"{typed}{', ' if keys else ''}lag int, correlation double")
    return parts.groupBy(*keys, "lag").agg(F.sum("correlation").alias("correlation"))


def estimate_lag(
    ref: DataFrame, test: DataFrame, keys: Sequence[str], max_lag: int, scale: float = 1.0, index: str = "i", value: str = "value"
) -> DataFrame:
    """Lag of the test series with the largest correlation; the smallest lag wins a tie (to nine decimals).

    ``scale`` converts the (coarser) grid of the inputs to the fine grid.
    """
    best = correlations(ref, test, keys, max_lag, index, value).groupBy(*keys).agg(
        F.max_by("lag", F.struct(F.round("correlation", 9), -F.col("lag"))).alias("lag"), F.max("correlation").alias("correlation")
    )
    return best.withColumn("lag_samples", F.rint(F.col("lag") * float(scale)).cast("long"))


def align_by_lag(ref: DataFrame, test: DataFrame, lags: DataFrame, keys: Sequence[str], index: str = "i", value: str = "value") -> DataFrame:
    """Both series on a common index, cut to their overlap. A pair without overlap gives no rows.

    ``check_overlap`` reports such pairs.
    """
    l = lags.select(*keys, "lag_samples")
    t = keyed_join(test, l, keys)
    moved = t.select(*keys, (F.col(index) - F.col("lag_samples")).alias(index), F.col(value).alias("test_value"), "lag_samples")
    both = keyed_join(ref.select(*keys, index, F.col(value).alias("ref_value")), moved, [*keys, index])
    start = F.greatest(F.lit(0), -F.col("lag_samples"))
    return both.select(*keys, (F.col(index) - start).alias(index), "ref_value", "test_value")


def check_overlap(ref: DataFrame, test: DataFrame, lags: DataFrame, keys: Sequence[str], index: str = "i") -> DataFrame:
    """Overlap length per pair; zero or less means the lag leaves nothing to compare."""
    sizes = keyed_join(
        ref.groupBy(*keys).agg((F.max(index) + 1).alias("__nr")), test.groupBy(*keys).agg((F.max(index) + 1).alias("__nt")), keys
    )
    lag = F.col("lag_samples")
    overlap = F.least(F.col("__nr") - F.greatest(-lag, F.lit(0)), F.col("__nt") - F.greatest(lag, F.lit(0)))
    return keyed_join(lags.select(*keys, "lag_samples"), sizes, keys).withColumn("overlap", overlap).drop("__nr", "__nt")
