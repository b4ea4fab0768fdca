"""State models with separate fit and classify, and the diagnostics of their states.

A fitted model is a small table or a bounded set of numbers; classifying joins it back or is an expression, so
the rows that are labelled need not be the rows it was fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import nullif
from . import markov, states


@dataclass(frozen=True)
class RichConfig:
    """Default thresholds of the rich rules."""

    horizons: tuple[int, int, int] = (5, 20, 60)
    vol_regime: float = 0.15
    vol_zscore: float = 0.5
    acceleration: float = 0.002
    overbought: float = 70.0
    oversold: float = 30.0
    atr_move: float = 1.0
    expansion: float = 1.25
    contraction: float = 0.8
    persistence: tuple[int, ...] = (3, 10)
    components: tuple[str, ...] = ("trend", "volatility", "acceleration", "extension", "volume", "persistence")
    collapse_volatility: bool = False
    collapse_momentum: bool = False
    collapse_extension: bool = False


def rich_states(frame: DataFrame, c: RichConfig = RichConfig()) -> DataFrame:
    """States of six parts: a vote of six trends, volatility, acceleration, extension, volume, persistence. A
    column that ``frame`` does not have counts as 0; a null meets no threshold."""
    have = set(frame.columns)
    x = lambda name: F.col(name) if name in have else F.lit(0.0)
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    short, medium, long = c.horizons
    votes = [x(f"return_{h}") for h in c.horizons] + [x(f"ma_gap_{w}") for w in (20, 50, 200)]
    score = sum((F.when(v > 0, 1).when(v < 0, -1).otherwise(0) for v in votes), F.lit(0))
    wide, z = x("vol_expansion_20"), x("vol_zscore_20")
    accel = [F.col(n) for n in (f"return_accel_{short}_{medium}", f"return_accel_{medium}_{long}") if n in have]
    known = sum((a.isNotNull().cast("int") for a in accel), F.lit(0))
    push = sum((F.coalesce(a, F.lit(0.0)) for a in accel), F.lit(0.0)) / nullif(known.cast("double")) if accel else F.lit(0.0)
    rsi, stretch, volume, age = x("rsi_14"), x("atr_normalized_close_to_sma20"), x("volume_ratio_20"), x("trend_persistence")
    parts = {
        "trend": F.when(score >= 4, "up").when(score <= -4, "down").otherwise("mixed"),
        "volatility": F.when(yes((wide > c.vol_regime) | (z > c.vol_zscore)), "expanding").when(yes((wide < -c.vol_regime) | (z < -c.vol_zscore)), "compressing").otherwise("stable"),
        "acceleration": F.when(push > c.acceleration, "accelerating").when(push < -c.acceleration, "decelerating").otherwise("steady"),
        "extension": F.when(yes((rsi >= c.overbought) | (stretch >= c.atr_move)), "stretched_up").when(yes((rsi <= c.oversold) | (stretch <= -c.atr_move)), "stretched_down").otherwise("normal"),
        "volume": F.when(volume >= c.expansion, "expanding").when(volume <= c.contraction, "contracting").otherwise("normal"),
        "persistence": F.when(age <= min(c.persistence), "fresh").when(age <= max(c.persistence), "established").otherwise("extended"),
    }
    for part, collapse, calm, other in (("volatility", c.collapse_volatility, "stable", "unstable"), ("acceleration", c.collapse_momentum, "steady", "active"), ("extension", c.collapse_extension, "normal", "stretched")):
        if collapse:
            parts[part] = F.when(parts[part] == calm, calm).otherwise(other)
    chosen = [p for p in c.components if p in parts] or ["trend", "volatility", "extension"]
    out = frame.withColumns({f"state_{p}": parts[p] for p in chosen})
    return out.withColumn("state", F.concat_ws("|", *(f"state_{p}" for p in chosen)))


def sparse_levels(frame: DataFrame, parts: list[str], priority: list[str], merged: str = "any") -> list[Column]:
    """The labels of each level: all parts, then with one more part merged at a time, in order of priority."""
    levels, gone = [], set()
    for part in [None, *priority]:
        gone |= {part} - {None}
        levels.append(F.concat_ws("|", *(F.lit(merged) if p in gone else F.col(p) for p in parts)))
    return levels


def fit_sparse(frame: DataFrame, parts: list[str], priority: list[str]) -> DataFrame:
    """(level, label, n): how often each label of each level occurs. One pass over the rows."""
    rows = frame.select(F.posexplode(F.array(*sparse_levels(frame, parts, priority))).alias("level", "label"))
    return rows.groupBy("level", "label").agg(F.count("*").alias("n"))


def apply_sparse(frame: DataFrame, fitted: DataFrame, parts: list[str], priority: list[str], least: int, rare: str = "rare_state") -> DataFrame:
    """``frame`` with the most detailed label that ``fitted`` saw ``least`` times. Labels that qualify are one
    row each; the rules bound how many there are."""
    out = frame
    for k, level in enumerate(sparse_levels(frame, parts, priority)):
        known = fitted.where((F.col("level") == k) & (F.col("n") >= least)).select(F.col("label").alias(f"_l{k}"))
        out = out.withColumn(f"_x{k}", level)
        out = out.join(known, out[f"_x{k}"] == known[f"_l{k}"], "left").drop(f"_x{k}")
    names = [f"_l{k}" for k in range(len(priority) + 1)]
    return out.withColumn("merged_state", F.coalesce(*names, F.lit(rare))).drop(*names)


def fit_groups(frame: DataFrame, members: list[str]) -> DataFrame:
    """One row of means and sample deviations of the members of a feature group."""
    return frame.agg(*(F.avg(m).alias(f"_m_{m}") for m in members), *(F.stddev_samp(m).alias(f"_s_{m}") for m in members))


def apply_groups(frame: DataFrame, fitted: DataFrame, members: list[str], name: str) -> DataFrame:
    """The group's value: the mean of its members' z-scores by the fitted numbers, over the members that are
    there. A member without spread is only centred."""
    parts = [(F.col(m) - F.coalesce(F.col(f"_m_{m}"), F.lit(0.0))) / F.coalesce(nullif(F.col(f"_s_{m}")), F.lit(1.0)) for m in members]
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return frame.crossJoin(F.broadcast(fitted)).withColumn(name, total / nullif(seen.cast("double"))).drop(*fitted.columns)  # one row


def fit_edges(frame: DataFrame, columns: dict[str, int], strategy: str = "quantile") -> DataFrame:
    """One row with the inner edges of every column's bins, as arrays without repeats: quantiles with linear
    interpolation, or equal widths between the ends."""
    def edges(c: str, n: int) -> Column:
        if strategy == "quantile":
            raw = F.percentile(c, F.array(*(F.lit(k / n) for k in range(1, n)))) if n > 1 else F.array().cast("array<double>")
        else:
            raw = F.array(*(F.min(c) + (F.max(c) - F.min(c)) * (k / n) for k in range(1, n)))
        return F.array_distinct(raw).alias(f"_e_{c}")

    return frame.agg(*(edges(c, n) for c, n in columns.items()))


def _above(column: str):
    return lambda edge: F.col(column) > edge


def apply_edges(frame: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Right-closed bins b0, b1, ... of each column by fitted edges; null is ``missing``; state joins them."""
    out = frame.crossJoin(F.broadcast(fitted))  # one row
    for c in columns:
        edges = F.coalesce(F.col(f"_e_{c}"), F.array().cast("array<double>"))
        bin_ = F.concat(F.lit("b"), F.size(F.filter(edges, _above(c))).cast("string"))
        out = out.withColumn(f"bin_{c}", F.when(F.col(c).isNull(), "missing").otherwise(bin_))
    return out.withColumn("state", F.concat_ws("|", *(f"bin_{c}" for c in columns))).drop(*fitted.columns)


def cluster_count(requested: int, samples: int, least: int) -> int:
    """Clusters for that many samples: as requested, but none smaller than ``least`` on average."""
    if samples <= 1:
        return 1
    k = max(requested, 1)
    return min(k if least <= 0 else min(k, max(samples // least, 1)), samples)


def merge_small(sizes: dict[int, int], centres: dict[int, list[float]], least: int) -> dict[int, int]:
    """Cluster -> final number: clusters under ``least`` go to the nearest centre of one that is large enough
    (or took in another), and what is left is numbered from 0. There is an entry for each cluster."""
    valid = {c for c, n in sizes.items() if n >= least} or {min(sizes, key=lambda c: (-sizes[c], c))}
    target = {c: c for c in sizes}
    for c in sorted(c for c in sizes if sizes[c] < least):
        if c in valid:
            continue
        target[c] = min(sorted(valid), key=lambda v: sum((a - b) ** 2 for a, b in zip(centres[c], centres[v], strict=True)))
        valid.add(target[c])
    number = {c: k for k, c in enumerate(sorted(set(target.values())))}
    return {c: number[t] for c, t in target.items()}


@dataclass
class Clusters:
    """A fitted cluster model: preparation, k-means and the merged numbers; without k-means all is cluster 0."""

    prepare: PipelineModel
    kmeans: KMeansModel | None
    numbers: dict[int, int] = field(default_factory=dict)


def fit_clusters(frame: DataFrame, features: list[str], k: int, least: int = 1, pca: int | None = None, seed: int = 7) -> Clusters:
    """Medians for nulls, standardising by the population, optional PCA, then k-means; small clusters merged."""
    known = frame.agg(F.count("*").alias("n"), *(F.count(f).alias(f) for f in features)).first()
    features = [f for f in features if known[f]]
    if not features:
        raise ValueError("no feature has a value")
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=[f"_f_{f}" for f in features], relativeError=0.0), VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
    ]
    if pca and 0 < pca < len(features):
        stages.append(PCA(k=pca, inputCol="_scaled", outputCol="_x"))
    else:
        stages.append(VectorAssembler(inputCols=["_scaled"], outputCol="_x"))
    from pyspark.ml import Pipeline

    prepare = Pipeline(stages=stages).fit(frame)
    count = cluster_count(k, known["n"], least)
    if count <= 1:
        return Clusters(prepare, None, {0: 0})
    ready = prepare.transform(frame)
    model = KMeans(k=count, seed=seed, featuresCol="_x", predictionCol="_c", maxIter=50).fit(ready)
    sizes = {r[0]: r[1] for r in model.transform(ready).groupBy("_c").count().collect()}  # a row for each cluster
    return Clusters(prepare, model, merge_small(sizes, {c: list(map(float, v)) for c, v in enumerate(model.clusterCenters())}, least))


def apply_clusters(frame: DataFrame, model: Clusters) -> DataFrame:
    """``frame`` with ``cluster`` (cluster_00, ...): the nearest centre after the fitted preparation."""
    if model.kmeans is None:
        return frame.withColumn("cluster", F.lit("cluster_00"))
    labels = F.create_map(*(F.lit(v) for c, n in sorted(model.numbers.items()) for v in (c, f"cluster_{n:02d}")))
    out = model.kmeans.transform(model.prepare.transform(frame))
    return out.select(*frame.columns, F.coalesce(labels[F.col("_c")], F.lit("cluster_00")).alias("cluster"), vector_to_array("_x").alias("cluster_point"))


def cluster_audit(frame: DataFrame, fitted_on: DataFrame, model: Clusters, least: int) -> DataFrame:
    """(symbol, rows, misplaced, small_clusters): rows whose cluster is not that of the centre nearest to their point, worked
    out anew from the stored centres, and how many clusters have fewer than ``least`` of the rows of the fit. Both must be 0."""
    sizes = apply_clusters(fitted_on, model).groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < least).alias("small_clusters"))
    placed = apply_clusters(frame, model)
    if model.kmeans is None:
        wrong = F.col("cluster") != "cluster_00"
    else:
        centres = F.array(*(F.struct(F.array(*(F.lit(float(x)) for x in v)).alias("at"), F.lit(f"cluster_{model.numbers.get(c, 0):02d}").alias("name")) for c, v in enumerate(model.kmeans.clusterCenters())))
        far = lambda c: F.aggregate(F.zip_with("cluster_point", c["at"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        ranked = F.array_min(F.transform(centres, lambda c: F.struct(far(c).alias("d"), c["name"].alias("name"))))
        own = F.array_min(F.transform(F.filter(centres, lambda c: c["name"] == F.col("cluster")), far))
        wrong = own > ranked["d"] * (1 + 1e-9) + 1e-12
    out = placed.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(wrong).alias("misplaced"))
    return out.crossJoin(sizes)  # one row


def anchor(frame: DataFrame, by: str = "trend", trend: float = 0.01, vol_regime: float = 0.15, vol_zscore: float = 0.5) -> DataFrame:
    """The coarse regime of the hybrid model, by trend or by volatility."""
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    if by == "volatility":
        wide, z = F.col("vol_expansion_20"), F.col("vol_zscore_20")
        regime = F.when(yes((wide > vol_regime) | (z > vol_zscore)), "volatile").when(yes((wide < -vol_regime) | (z < -vol_zscore)), "calm").otherwise("stable")
    else:
        r, fast, slow = F.col("return_20"), F.col("ma_gap_20"), F.col("ma_gap_200")
        regime = F.when(yes((r > trend) & (fast > 0) & (slow > 0)), "uptrend").when(yes((r < -trend) & (fast < 0) & (slow < 0)), "downtrend").otherwise("neutral")
    return frame.withColumn("state_anchor_regime", regime)


def fit_hybrid(anchored: DataFrame, features: list[str], k: int, least_regime: int, least: int = 1) -> dict[str, Clusters]:
    """A cluster model for each of the (at most three) regimes that have ``least_regime`` rows."""
    sizes = {r[0]: r[1] for r in anchored.groupBy("state_anchor_regime").count().collect()}
    return {regime: fit_clusters(anchored.where(F.col("state_anchor_regime") == regime), features, k, least) for regime, n in sorted(sizes.items()) if n >= least_regime}


def apply_hybrid(anchored: DataFrame, models: dict[str, Clusters]) -> DataFrame:
    """Every row's regime and its cluster there; regimes without a model have cluster_00."""
    rest = anchored.where(~F.col("state_anchor_regime").isin(*models)) if models else anchored
    out = rest.withColumn("cluster", F.lit("cluster_00"))
    for regime, model in models.items():
        out = out.unionByName(apply_clusters(anchored.where(F.col("state_anchor_regime") == regime), model).drop("cluster_point"))
    return out.withColumn("state", F.concat_ws("|", "state_anchor_regime", "cluster"))


def state_quality(frame: DataFrame, sparse: int = 15) -> DataFrame:
    """Forward-return statistics of each state with its frequency, entropy, confidence and concentration."""
    samples = markov.labelled(frame)
    e = markov.entropy(markov.matrix(samples)).select("symbol", "state", F.col("entropy").alias("_e"), F.col("confidence").alias("_k"), F.col("concentration").alias("_c"))
    often = states.frequency(frame).withColumnsRenamed({"observations": "occupancy", "frequency": "occupancy_share"})
    out = markov.state_returns(samples).join(often, ["symbol", "state"], "left").join(e, ["symbol", "state"], "left")
    return out.withColumns({
        "transition_entropy": F.coalesce("_e", F.lit(1.0)), "transition_confidence": F.coalesce("_k", F.lit(0.0)), "transition_concentration": F.coalesce("_c", F.lit(0.0)), "sparse_warning": F.col("observations") < sparse,
    }).drop("_e", "_k", "_c")


def transition_quality(frame: DataFrame) -> DataFrame:
    """Forward returns of each transition with its probability and count."""
    samples = markov.labelled(frame)
    m = markov.matrix(samples).select("symbol", "current_state", "next_state", F.col("prob").alias("transition_probability"), F.col("count").alias("transition_count"))
    return markov.transition_returns(samples).join(m, ["symbol", "current_state", "next_state"], "left")


def tradability(frame: DataFrame, trades: DataFrame) -> DataFrame:
    """Each state's frequency with the trades entered in it; none is zero. ``trades``: symbol, entry_state,
    return_pct, expected_value."""
    t = trades.groupBy("symbol", F.col("entry_state").alias("state")).agg(F.count("*").alias("trade_count"), F.avg("return_pct").alias("mean_trade_return"), F.avg("expected_value").alias("mean_expected_value"))
    out = states.frequency(frame).join(t, ["symbol", "state"], "left").na.fill(0, ["trade_count"]).na.fill(0.0, ["mean_trade_return", "mean_expected_value"])
    return out.withColumn("trade_generating", F.col("trade_count") > 0)


def full_summary(frame: DataFrame, trades: DataFrame, sparse: int = 15) -> DataFrame:
    """The twelve scalars of each symbol's states."""
    q = state_quality(frame, sparse)
    n = F.col("observations")
    weighted = lambda x: F.coalesce(F.sum(x * n) / nullif(F.sum(n).cast("double")), F.lit(0.0))
    steady = q.groupBy("symbol").agg(weighted(1 - F.col("transition_entropy")).alias("transition_stability"), weighted(F.col("transition_concentration")).alias("transition_concentration"))
    held = states.persistence(frame).groupBy("symbol").agg(F.avg("mean_duration").alias("mean_state_persistence"))
    used = tradability(frame, trades).groupBy("symbol").agg(F.avg(F.col("trade_generating").cast("double")).alias("trade_generating_state_percentage"))
    total = trades.groupBy("symbol").agg(F.count("*").alias("out_of_sample_trade_count"))
    out = states.summary(frame, sparse).withColumn("sparse_state_ratio", F.col("sparse_state_count") / F.greatest("unique_states", F.lit(1)))
    out = out.join(steady, "symbol", "left").join(held, "symbol", "left").join(used, "symbol", "left").join(total, "symbol", "left")
    return out.na.fill(0, ["out_of_sample_trade_count"]).na.fill(0.0, ["transition_stability", "transition_concentration", "mean_state_persistence", "trade_generating_state_percentage"])
