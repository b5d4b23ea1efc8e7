"""Exploratory analysis and data quality.

Every statistic is one aggregation pass (partial aggregation before the
shuffle); per-column results are produced wide and turned long with ``stack``
so no job runs per column.  Window work is partitioned by station.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.functions.windows import HALO, chunk_window, with_position_chunks
from airgrid.schemas import KEY, TIME


def _numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _long(wide: DataFrame, names: list[str], keys: list[str], name_col: str,
          value_col: str) -> DataFrame:
    """Unpivot the named columns of a (small) aggregate into rows."""
    return wide.unpivot(keys, names, name_col, value_col) if keys else \
        wide.unpivot([], names, name_col, value_col)


def missing_pct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL share x 100 per column (sort by ``missing_pct`` desc to read)."""
    cols = cols or df.columns
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return _long(wide, cols, [], "column_name", "missing_pct")


def missing_by_station(df: DataFrame, cols: list[str] | None = None,
                       digits: int = 1) -> DataFrame:
    """NULL % per station x column, rounded half-even, all-zero columns removed."""
    cols = cols or [c for c in df.columns if c != KEY]
    wide = df.groupBy(KEY).agg(*[F.bround(F.avg(F.col(c).isNull().cast("double")) * 100, digits)
                                 .alias(c) for c in cols])
    long = _long(wide, cols, [KEY], "column_name", "missing_pct")
    keep = long.groupBy("column_name").agg(F.max("missing_pct").alias("_mx")).where("_mx > 0")
    return long.join(keep.select("column_name"), "column_name", "left_semi")


def negative_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count of values < 0 per numeric column, only columns with any."""
    cols = cols or _numeric(df)
    wide = df.agg(*[F.count(F.when(F.col(c) < 0, 1)).alias(c) for c in cols])
    return _long(wide, cols, [], "column_name", "neg_count").where("neg_count > 0")


def time_steps(df: DataFrame, top: int = 10) -> DataFrame:
    """Distribution of consecutive time differences per station, most frequent first.

    Differences inside a (station, day) come from that day's window; the step into a
    day from the last reading before it comes from the small table of first and last
    readings per day, so a station's readings are never in one task together.
    """
    day = F.date_trunc("day", TIME)
    rows = df.where(F.col(TIME).isNotNull()).select(KEY, TIME, day.alias("_day"))
    inside = rows.select((F.unix_seconds(TIME) - F.unix_seconds(F.lag(TIME, 1).over(
        Window.partitionBy(KEY, "_day").orderBy(TIME)))).alias("step_seconds"))
    days = rows.groupBy(KEY, "_day").agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
    between = days.select((F.unix_seconds("lo") - F.unix_seconds(F.lag("hi", 1).over(
        Window.partitionBy(KEY).orderBy("_day")))).alias("step_seconds"))
    counts = (inside.unionByName(between).where("step_seconds IS NOT NULL")
              .groupBy("step_seconds").agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.desc("n"), "step_seconds").limit(top)


def duplicate_keys(df: DataFrame, keys: tuple[str, str] = (TIME, KEY)) -> DataFrame:
    """Rows repeating a key after its first occurrence."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def continuity_violations(df: DataFrame, hours: int = 1) -> DataFrame:
    """Consecutive differences per station that are not exactly ``hours`` hours."""
    w = Window.partitionBy(KEY).orderBy(TIME)
    step = F.unix_seconds(F.col(TIME)) - F.unix_seconds(F.lag(TIME, 1).over(w))
    s = df.select(step.alias("s")).where("s IS NOT NULL")
    return s.agg(F.count(F.lit(1)).alias("checked"),
                 F.count(F.when(F.col("s") != hours * 3600, 1)).alias("violations"))


def summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles (linear), max per column, as rows.

    Moments and extremes come from one aggregation; quartiles from the
    distributed exact quantiles (one pass over all columns), never from a
    one-task buffer of all values.
    """
    from airgrid.functions.quantiles import exact_quantiles_many
    cols = cols or _numeric(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
    row = df.agg(*aggs).first()
    rows = []
    quartiles = exact_quantiles_many(df, cols, [0.25, 0.5, 0.75])
    for c in cols:
        q1, q2, q3 = quartiles[c]
        stats = [("count", row[f"{c}|count"]), ("mean", row[f"{c}|mean"]), ("std", row[f"{c}|std"]),
                 ("min", row[f"{c}|min"]), ("25%", q1), ("50%", q2), ("75%", q3), ("max", row[f"{c}|max"])]
        rows += [(c, s, None if v is None else float(v)) for s, v in stats]
    return df.sparkSession.createDataFrame(rows, "column_name string, stat string, value double")


def histogram(df: DataFrame, col: str = "pm25", bins: int = 100) -> DataFrame:
    """All ``bins`` equal-width bins between min and max, empty ones too; the last is closed."""
    x = F.col(col)
    b = df.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


KDE_CELLS = 1 << 16          # cells of the fine grid that E09 counts values on


def kde(df: DataFrame, col: str = "pm25", points: int = 200, cut: float = 3.0, exact: bool = False,
        cells: int = KDE_CELLS) -> DataFrame:
    """Gaussian kernel density on a ``points`` grid, Scott bandwidth, ``cut`` bandwidths past the data.

    Values are shared out linearly between the two nearest of ``cells`` grid points in
    one partial aggregate; the weights (``cells`` numbers) are convolved with the kernel
    on the driver.  With a cell width d and bandwidth h a density differs from the exact
    sum by at most d**2 / (8 h**2) * 1 / (h sqrt(2 pi)): ``kde_error``.  ``exact`` sums
    the kernel of every distinct value on every point in Spark instead.
    """
    x = F.col(col)
    s = df.where(x.isNotNull()).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"),
                                    F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, sd = s["n"], s["sd"]
    if not n or sd is None or sd == 0:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    h = sd * n ** (-1.0 / 5.0)
    g0, g1 = s["lo"] - cut * h, s["hi"] + cut * h
    step = (g1 - g0) / (points - 1)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    if not exact:
        width = (s["hi"] - s["lo"]) / (cells - 1)
        at = (x - F.lit(s["lo"])) / F.lit(width)
        low = F.least(F.floor(at), F.lit(cells - 2))
        share = at - low
        both = F.array(F.struct(low.alias("j"), (1 - share).alias("w")), F.struct((low + 1).alias("j"), share.alias("w")))
        held = (df.where(x.isNotNull()).select(F.explode(both).alias("e")).select("e.j", "e.w")
                .groupBy("j").agg(F.sum("w").alias("w")).collect())                  # at most ``cells`` rows
        place = s["lo"] + np.array([r["j"] for r in held]) * width
        weight = np.array([r["w"] for r in held])
        rows = [(i, g0 + i * step, float((weight * np.exp(-0.5 * ((g0 + i * step - place) / h) ** 2)).sum() * norm))
                for i in range(points)]
        return df.sparkSession.createDataFrame(rows, "i int, x double, density double")
    vals = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    grid = vals.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.lit(g0) + F.col("i") * F.lit(step)
    z = (gx - F.col("v")) / F.lit(h)
    contrib = F.col("c") * F.exp(F.lit(-0.5) * z * z)
    return (grid.groupBy("i").agg(F.sum(contrib).alias("s"))
            .select("i", (F.lit(g0) + F.col("i") * F.lit(step)).alias("x"),
                    (F.col("s") * F.lit(norm)).alias("density")))


def kde_error(low: float, high: float, sd: float, n: int, cells: int = KDE_CELLS) -> float:
    """Largest difference of a binned density from the exact sum: the kernel's curvature is at most one over h**2."""
    h = sd * n ** (-1.0 / 5.0)
    return ((high - low) / (cells - 1) / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi))


def box_stats(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside) and outlier count per station."""
    x = F.col(col)
    q = (df.where(x.isNotNull()).groupBy(KEY)
         .agg(F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.5).alias("median"),
              F.percentile(x, 0.75).alias("q3")))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.where(x.isNotNull()).select(KEY, x.alias("x")).join(q, KEY)
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    return j.groupBy(KEY, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("whisker_high"),
        F.count(F.when((F.col("x") < lo_f) | (F.col("x") > hi_f), 1)).alias("n_outliers"))


def zscore_outliers(df: DataFrame, col: str = "pm25", threshold: float = 5.0) -> DataFrame:
    """Rows whose per-station z-score (sample std) exceeds ``threshold`` in absolute value."""
    stats = df.groupBy(F.col(KEY).alias("_key")).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    z = (F.col(col) - F.col("_m")) / F.col("_s")
    joined = df.join(stats, F.col(KEY).eqNullSafe(F.col("_key"))).withColumn("z", z)
    return joined.where(F.abs("z") > threshold).drop("_key", "_m", "_s")


def clip_log(df: DataFrame, col: str = "pm25", upper: float = 300.0) -> DataFrame:
    """The two outlier treatments: upper clip and ``log1p`` (the one used)."""
    return df.withColumns({f"{col}_clip": F.least(F.col(col), F.lit(upper)),
                           f"{col}_log": F.log1p(col)})


def seasonality(df: DataFrame, col: str = "pm25") -> DataFrame:
    """Mean by station x hour / weekday / month in one grouping-sets pass (long form)."""
    parts = df.select(KEY, col, F.hour(TIME).alias("hour"),
                      F.weekday(TIME).alias("weekday"), F.month(TIME).alias("month"))
    g = parts.groupingSets([[KEY, "hour"], [KEY, "weekday"], [KEY, "month"]],
                           KEY, "hour", "weekday", "month").agg(
        F.avg(col).alias(f"mean_{col}"),
        F.grouping("hour").alias("gh"), F.grouping("weekday").alias("gw"))
    profile = F.when(F.col("gh") == 0, "hour").when(F.col("gw") == 0, "weekday").otherwise("month")
    period = F.coalesce("hour", "weekday", "month")
    return g.select(profile.alias("profile"), period.alias("period"), KEY, f"mean_{col}")


CHUNK_ROWS = 720             # rows of a station that one window of E14 and E15 owns


def lag_correlation(df: DataFrame, col: str = "pm25", max_lag: int = 24, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per-station Pearson corr of x with x[-k] (pairwise complete), mean over stations.

    A station's rows are dealt by position into blocks with a halo, so no window holds
    a whole station; correlations add up over blocks.
    """
    laid = with_position_chunks(df.select(KEY, TIME, col), chunk_rows, max_lag)
    w = chunk_window()
    lags = range(1, max_lag + 1)
    lagged = laid.select(KEY, HALO, col, *[F.lag(col, k).over(w).alias(f"l{k}") for k in lags]).where(~F.col(HALO))
    per = lagged.groupBy(KEY).agg(*[F.corr(col, f"l{k}").alias(f"{k}") for k in lags])
    long = per.unpivot([KEY], [f"{k}" for k in lags], "lag", "corr")
    return long.groupBy(F.col("lag").cast("int").alias("lag")).agg(F.avg("corr").alias("mean_corr"))


def acf(df: DataFrame, col: str = "pm25", max_lag: int = 48, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per-station autocorrelation of the NULL-free series (biased, global mean).

    Lags count the rows that are left, so blocks are cut by position; the products of
    a block's own rows with the rows up to ``max_lag`` before them add up over blocks.
    """
    s = df.where(F.col(col).isNotNull()).select(KEY, TIME, col)
    m = s.groupBy(F.col(KEY).alias("_k")).agg(F.avg(col).alias("_m"))
    laid = with_position_chunks(s, chunk_rows, max_lag)
    c = laid.join(m, F.col(KEY).eqNullSafe(F.col("_k"))).withColumn("_d", F.col(col) - F.col("_m"))
    w = chunk_window()
    lags = range(0, max_lag + 1)
    prods = c.select(KEY, HALO, *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"{k}") for k in lags]).where(~F.col(HALO))
    sums = prods.groupBy(KEY).agg(*[F.sum(f"{k}").alias(f"{k}") for k in lags])
    long = sums.withColumn("_den", F.col("0")).unpivot([KEY, "_den"], [f"{k}" for k in lags], "lag", "num")
    return long.select(KEY, F.col("lag").cast("int").alias("lag"), (F.col("num") / F.col("_den")).alias("acf"))


def missing_map(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL count per hour and column across stations (the data behind the matrix plot)."""
    cols = cols or [c for c in df.columns if c not in (KEY, TIME)]
    wide = df.groupBy(TIME).agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return _long(wide, cols, [TIME], "column_name", "n_missing")


def station_series(df: DataFrame, location: str, col: str = "pm25") -> DataFrame:
    """One station's series."""
    return df.where(F.col(KEY) == location).select(TIME, col)


def pca_variance(df: DataFrame, cols: list[str], target_share: float = 0.95) -> DataFrame:
    """Standardize, full PCA, explained and cumulative variance per component.

    Complete rows only (as the reference drops NULL rows before PCA).  The
    covariance is a distributed aggregation; only the k x k matrix reaches the driver.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    data = df.select(*cols).na.drop()
    k = len(cols)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"),
                            StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
                            PCA(k=k, inputCol="_s", outputCol="_pca")])
    model = pipe.fit(data)
    ev = [float(v) for v in model.stages[-1].explainedVariance]
    rows, cum = [], 0.0
    for i, v in enumerate(ev):
        cum += v
        rows.append((i + 1, v, cum, int(cum >= target_share)))
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_variance double, cumulative double, reaches_target int")


def pca_projection(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """2-D projection of the standardized complete rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    data = df.select(*keys, *cols).na.drop()
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"),
                            StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
                            PCA(k=2, inputCol="_s", outputCol="_pca")])
    out = pipe.fit(data).transform(data)
    arr = vector_to_array("_pca")
    return out.select(*keys, arr[0].alias("pc1"), arr[1].alias("pc2"))


def kmeans_elbow(df: DataFrame, cols: list[str], ks: range = range(2, 10), seed: int = 42,
                 label_k: int = 5, keys: tuple[str, ...] = (KEY, TIME)) -> tuple[DataFrame, DataFrame | None]:
    """K-means inertia for each k (elbow) and the cluster of every complete row for ``label_k``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    data = df.select(*keys, *[c for c in cols if c not in keys]).na.drop(subset=cols)
    prep = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"),
                            StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True)])
    scaled = prep.fit(data).transform(data).select(*keys, "_s").cache()
    rows, labels = [], None
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster").fit(scaled)
        rows.append((k, float(m.summary.trainingCost)))
        if k == label_k:
            labels = m.transform(scaled).select(*keys, "cluster")
    elbow = df.sparkSession.createDataFrame(rows, "k int, inertia double")
    return elbow, labels
