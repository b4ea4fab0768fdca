"""Quality gates on signal candidates, and the reports on what they let through.

Quality tables are built from trades that ended before the candidates (``trades.edge_quality``). They have one
row for each (asset class, key), so a candidate looks its record up by a left join; a candidate without a
record has the defaults, which is not the same as a table that is absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif
from . import signals, trades

#: The gate checks in the order of the funnel.
GATE_CHECK_ORDER = (
    "family_allowed_pass", "family_excluded_pass", "family_top_count_pass", "family_bottom_exclusion_pass",
    "state_quality_score_pass", "state_quality_percentile_pass", "state_quality_rank_pass", "state_trade_count_pass",
    "state_active_folds_pass", "state_positive_fold_fraction_pass", "state_expectancy_variance_pass", "state_sharpe_variance_pass",
    "transition_quality_score_pass", "transition_quality_percentile_pass", "transition_quality_rank_pass", "transition_trade_count_pass",
    "transition_active_folds_pass", "transition_positive_fold_fraction_pass", "transition_expectancy_variance_pass", "transition_sharpe_variance_pass",
    "consistency_score_pass", "consistency_percentile_pass", "consistency_rank_pass",
)
#: A missing rank counts as this one.
NO_RANK = 1_000_000
#: Upper edges and names of the score bins and of the component bins; a bin holds its upper edge.
SCORE_BINS = ((-0.001, 0.2, "0.0-0.2"), (0.2, 0.4, "0.2-0.4"), (0.4, 0.6, "0.4-0.6"), (0.6, 0.8, "0.6-0.8"), (0.8, 1.0, "0.8-1.0"), (1.0, 10.0, ">1.0"))
COMPONENT_BINS = ((-0.001, 0.05, "0.00-0.05"), (0.05, 0.15, "0.05-0.15"), (0.15, 0.30, "0.15-0.30"), (0.30, 0.50, "0.30-0.50"), (0.50, 1.0, "0.50-1.00"), (1.0, 10.0, ">1.00"))
SCORES = ("state_quality_score", "transition_quality_score", "fold_consistency_score", "sample_size_score", "tradability_score", "signal_score")
COMPONENTS = ("base_signal", "opportunity_score", "state_quality", "transition_quality", "family_rank", "fold_consistency", "sample_size", "trade_count", "tradability")
#: Default weights of the components.
WEIGHTS = {"base_signal": 0.20, "state_quality": 0.20, "transition_quality": 0.20, "fold_consistency": 0.15, "sample_size": 0.10, "tradability": 0.15}


@dataclass(frozen=True)
class KindLimits:
    """Limits on a record of state or transition quality; None is no limit."""

    min_score: float = 0.0
    min_percentile: float = 0.0
    max_rank: int | None = None
    min_trades: int = 0
    min_folds: int = 0
    min_positive_folds: float = 0.0
    max_expectancy_variance: float | None = None
    max_sharpe_variance: float | None = None


@dataclass(frozen=True)
class GatePolicy:
    """What a candidate must pass; the defaults let everything through."""

    state: KindLimits = KindLimits()
    transition: KindLimits = KindLimits()
    min_consistency_score: float = 0.0
    min_consistency_percentile: float = 0.0
    max_consistency_rank: int | None = None
    min_sample_score: float = 0.0
    min_observations: int = 25
    allowed_families: tuple[str, ...] = ()
    excluded_families: tuple[str, ...] = ()
    family_mode: str = "none"
    top_count: int | None = None
    top_percentile: float | None = None
    bottom_count: int | None = None
    bottom_percentile: float | None = None
    min_family_consistency: float = 0.0
    components: tuple[str, ...] = ()
    legacy_mode: str = "off"
    hard: tuple[str, ...] = ()
    mode: str = "hard_gate_only"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    per_time: int | None = None
    per_class: int | None = None
    per_model: int | None = None

    def gate_components(self) -> tuple[str, ...]:
        legacy = {"state": ("state",), "transition": ("transition",), "both": ("state", "transition")}
        return self.components or legacy.get(self.legacy_mode, ())


def quality_tables(past: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    """The three gate tables, each keyed by (asset_class, key): of states, transition setups and families."""
    keys = {"state": "entry_state", "transition": "entry_transition_setup", "family": "entry_state_family"}
    tables = trades.edge_tables(past, [("asset_class", key) for key in keys.values()], least)
    return {kind: table.withColumnRenamed(key, "key") for (kind, key), table in zip(keys.items(), tables, strict=True)}


def ranked_report(table: DataFrame, n: int = 20) -> DataFrame:
    """The best and the worst ``n`` rows of a gate table; a top-k report, so the limit is what it is for."""
    best = table.orderBy(F.col("quality_score").desc(), F.col("expectancy").desc(), "asset_class", "key").limit(n).withColumn("side", F.lit("best"))
    worst = table.orderBy("quality_score", "expectancy", "asset_class", "key").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


_RECORD = ("quality_score", "quality_percentile", "quality_rank", "quality_group_size", "sample_size", "active_fold_count", "positive_fold_fraction",
           "expectancy_variance", "sharpe_variance", "consistency_score", "consistency_percentile", "consistency_rank", "sample_size_score")


def with_records(candidates: DataFrame, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Candidates with their records, as ``<kind>_<field>``, and ``<kind>_found``. A table of None is absent;
    a null, empty or "None" key finds nothing. Tables have a row for each state, setup or family and are broadcast:
    there are few keys, so an exchange by them would put the candidates into as few tasks."""
    out = candidates
    for kind, key in (("state", "state"), ("transition", "transition_setup"), ("family", "state_family")):
        table = tables.get(kind)
        if table is None:
            out = out.select("*", F.lit(False).alias(f"{kind}_found"), *(F.lit(None).cast("double").alias(f"{kind}_{f}") for f in _RECORD))
            continue
        side = table.select(F.col("asset_class").alias("_c"), F.col("key").alias("_k"), F.lit(True).alias(f"{kind}_found"), *(F.col(f).alias(f"{kind}_{f}") for f in _RECORD))
        usable = ~F.coalesce(F.col(key), F.lit("")).isin("", "None")
        out = out.join(F.broadcast(side), (out["asset_class"] == side["_c"]) & (out[key] == side["_k"]) & usable, "left").drop("_c", "_k")
        out = out.withColumn(f"{kind}_found", F.coalesce(f"{kind}_found", F.lit(False)))
    return out


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def _at_most(name: str, limit: float | None, default: float) -> Column:
    return F.lit(True) if limit is None else _or(name, default) <= limit


def _present(name: str, fold) -> Column:
    """``fold`` (least or greatest) over the records that are there; null where none is."""
    return fold(*(F.when(F.col(f"{kind}_found"), _or(f"{kind}_{name}", NO_RANK if name.endswith("rank") else 0)) for kind in ("state", "transition")))


def _all(checks: dict[str, Column]) -> Column:
    out = F.lit(True)
    for check in checks.values():
        out = out & check
    return out


def kind_checks(kind: str, p: KindLimits, present: bool) -> dict[str, Column]:
    """The eight checks of a state or transition record; all pass where the table is absent."""
    field_ = lambda name: f"{kind}_{name}"
    checks = {
        "quality_score": _or(field_("quality_score"), 0) >= p.min_score, "quality_percentile": _or(field_("quality_percentile"), 0) >= p.min_percentile,
        "quality_rank": _at_most(field_("quality_rank"), p.max_rank, NO_RANK), "trade_count": _or(field_("sample_size"), 0) >= p.min_trades,
        "active_folds": _or(field_("active_fold_count"), 0) >= p.min_folds, "positive_fold_fraction": _or(field_("positive_fold_fraction"), 0) >= p.min_positive_folds,
        "expectancy_variance": _at_most(field_("expectancy_variance"), p.max_expectancy_variance, 0), "sharpe_variance": _at_most(field_("sharpe_variance"), p.max_sharpe_variance, 0),
    }
    return {f"{kind}_{name}_pass": check if present else F.lit(True) for name, check in checks.items()}


def family_checks(p: GatePolicy, present: bool) -> dict[str, Column]:
    rank, size = _or("family_quality_rank", NO_RANK), _or("family_quality_group_size", 0)
    percentile = F.col("family_quality_percentile")
    yes = F.lit(True)
    known = lambda limit, check: check if present and limit is not None else yes
    checks = {
        "family_allowed_pass": F.col("state_family").isin(*p.allowed_families) if p.allowed_families else yes,
        "family_excluded_pass": ~F.col("state_family").isin(*p.excluded_families) if p.excluded_families else yes,
        "family_top_count_pass": known(p.top_count, rank <= F.lit(p.top_count)),
        "family_top_percentile_pass": known(p.top_percentile, F.coalesce(percentile >= F.lit(p.top_percentile), F.lit(False))),
        "family_bottom_exclusion_pass": known(p.bottom_count, (size <= 0) | (rank < F.greatest(size - F.lit(p.bottom_count) + 1, F.lit(1)))),
        "family_bottom_percentile_pass": known(p.bottom_percentile, F.coalesce(percentile > F.lit(p.bottom_percentile), F.lit(False))),
        "family_consistency_pass": known(0, F.coalesce(F.col("family_consistency_score") >= p.min_family_consistency, F.lit(False))),
    }
    by_mode = {
        "top_count": "family_top_count_pass", "top_percentile": "family_top_percentile_pass", "exclude_bottom_count": "family_bottom_exclusion_pass",
        "exclude_bottom_percentile": "family_bottom_percentile_pass", "consistency_threshold": "family_consistency_pass",
    }
    checks["family_mode_pass"] = checks[by_mode[p.family_mode]] if p.family_mode in by_mode else yes
    return checks


def gated(candidates: DataFrame, tables: dict[str, DataFrame | None], p: GatePolicy) -> DataFrame:
    """Each candidate with its scores, all checks, gates, the first block, and what is left of its signal.

    ``candidates``: asset_class, state, transition_setup, state_family, candidate_signal (long, short, flat),
    block_reason (of flat ones), observations, base_score.
    """
    has = {kind: tables.get(kind) is not None for kind in ("state", "transition", "family")}
    any_quality = has["state"] or has["transition"]
    n = F.col("observations").cast("double")
    out = with_records(candidates, tables)
    fallback = F.least(F.greatest(F.log1p(n) / F.log1p(F.lit(float(max(p.min_observations * 4, 2)))), F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({
        "state_quality_score": _or("state_quality_score", 0), "transition_quality_score": _or("transition_quality_score", 0), "state_family_quality_score": _or("family_quality_score", 0),
        "family_rank_score": _or("family_quality_percentile", 0), "fold_consistency_score": F.coalesce(_present("consistency_score", F.least), F.lit(0.0)),
        "consistency_percentile": F.coalesce(_present("consistency_percentile", F.least), F.lit(0.0)), "consistency_rank": F.coalesce(_present("consistency_rank", F.greatest), F.lit(float(NO_RANK))),
        "sample_size_score": F.coalesce(_present("sample_size_score", F.least), fallback),
    })
    parts = ("state_quality_score", "transition_quality_score", "fold_consistency_score", "sample_size_score", "state_family_quality_score")
    out = out.withColumns({"trade_count_score": F.col("sample_size_score"), "tradability_score": sum((F.greatest(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0)) / len(parts), "opportunity_score": signals.bounded(F.col("base_score"))})
    component = {
        "base_signal": F.col("opportunity_score"), "opportunity_score": F.col("opportunity_score"), "state_quality": F.col("state_quality_score"), "transition_quality": F.col("transition_quality_score"),
        "family_rank": F.col("family_rank_score"), "fold_consistency": F.col("fold_consistency_score"), "sample_size": F.col("sample_size_score"), "trade_count": F.col("trade_count_score"), "tradability": F.col("tradability_score"),
    }
    weights = {name: w for name, w in p.weights.items() if name in component and w > 0}
    share = {name: F.greatest(component[name], F.lit(0.0)) * weights[name] / sum(weights.values()) if name in weights else F.lit(0.0) for name in component}
    out = out.withColumns({f"score_component_{k}": v for k, v in component.items()} | {f"score_contribution_{k}": v for k, v in share.items()})
    blended = sum((F.col(f"score_contribution_{k}") for k in weights), F.lit(0.0))
    out = out.withColumn("signal_score", F.col("base_score") if p.mode == "hard_gate_only" else blended)
    state, transition, family = kind_checks("state", p.state, has["state"]), kind_checks("transition", p.transition, has["transition"]), family_checks(p, has["family"])
    consistency = {
        "consistency_score_pass": F.col("fold_consistency_score") >= p.min_consistency_score, "consistency_percentile_pass": F.col("consistency_percentile") >= p.min_consistency_percentile,
        "consistency_rank_pass": F.lit(True) if p.max_consistency_rank is None else F.col("consistency_rank") <= p.max_consistency_rank,
    }
    sample = {
        "sample_size_score_pass": F.col("sample_size_score") >= p.min_sample_score, "observation_count_pass": n >= p.min_observations,
        "state_trade_count_gate_pass": _or("state_sample_size", 0) >= p.state.min_trades, "transition_trade_count_gate_pass": _or("transition_sample_size", 0) >= p.transition.min_trades,
    }
    if not any_quality:
        consistency = dict.fromkeys(consistency, F.lit(True))
        sample |= {"state_trade_count_gate_pass": F.lit(True), "transition_trade_count_gate_pass": F.lit(True)}
    out = out.withColumns(state | transition | consistency | sample | family)
    passes = lambda checks: _all({name: F.col(name) for name in checks})
    out = out.withColumns({
        "state_gate_pass": passes(state), "transition_gate_pass": passes(transition), "consistency_gate_pass": passes(consistency), "sample_size_gate_pass": passes(sample),
        "family_list_pass": F.col("family_allowed_pass") & F.col("family_excluded_pass"),
    })
    out = out.withColumn("family_gate_pass", F.col("family_list_pass") & F.col("family_mode_pass"))
    out = out.withColumn("component_gate_pass", _all({c: F.col(f"{c}_gate_pass") for c in p.gate_components()}))
    out = out.withColumn("gate_passed", F.col("family_gate_pass") & F.col("component_gate_pass"))
    block = F.when(F.col("candidate_signal") == "flat", _block("candidate", F.coalesce("block_reason", F.lit("negative_expected_value")))).when(~F.col("family_list_pass"), _block("family", F.lit("excluded_state_family")))
    if p.hard:
        named = {
            "state": ("state_gate_pass", "state_gate_failed"), "transition": ("transition_gate_pass", "transition_gate_failed"), "consistency": ("consistency_gate_pass", "consistency_gate_failed"),
            "family": ("family_mode_pass", "family_filter_failed"), "sample_size": ("sample_size_gate_pass", "minimum_sample_size_failed"),
        }
        for component_ in p.hard:
            gate, reason = named[component_]
            block = block.when(~F.col(gate), _block(component_, F.lit(reason)))
    elif p.mode != "soft_scoring_only":
        for component_, gate in (("family", "family_mode_pass"), ("state", "state_gate_pass"), ("transition", "transition_gate_pass"), ("consistency", "consistency_gate_pass")):
            block = block.when(~F.col("gate_passed") & ~F.col(gate), _block(component_, F.lit(f"{component_}_gate_failed")))
        block = block.when(~F.col("gate_passed"), _block("gate", F.lit("legacy_gate_failed")))
    out = out.withColumn("_block", block)
    out = out.withColumns({"hard_block_category": F.col("_block.category"), "hard_block_reason": F.col("_block.reason"), "hard_filter_passed": F.col("_block").isNull()}).drop("_block")
    return out.withColumns({"selection_passed": F.col("hard_filter_passed"), "signal": F.when(F.col("hard_filter_passed"), F.col("candidate_signal")).otherwise("flat")})


def _block(category: str, reason: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), reason.alias("reason"))


def _limit(value: Column) -> Column:
    """A limit as a number; blank, not a number, zero or less is none."""
    parsed = value.cast("string").try_cast("double").cast("int")
    return F.when(parsed > 0, parsed)


def with_limits(candidates: DataFrame, p: GatePolicy) -> DataFrame:
    """The policy's caps as columns; the cap of a rebalance is the lesser of the overall and the model's."""
    cap = lambda v: F.lit(v).cast("int")
    out = candidates.withColumns({"selection_cap_overall_limit": cap(p.per_time), "selection_cap_asset_class_limit": cap(p.per_class), "selection_cap_model_limit": cap(p.per_model)})
    return out.withColumn("rebalance_limit", F.least(_limit(F.col("selection_cap_overall_limit")), _limit(F.col("selection_cap_model_limit"))))


def annotated(candidates: DataFrame, *scope: str, tie: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Ranks by score over all rows of ``scope``, its asset classes and its models, and which caps they pass."""
    best = [F.col("signal_score").desc_nulls_last(), *tie]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*scope, *keys).orderBy(*best))
    out = candidates.withColumns({"selection_rank": rank(), "asset_class_rank": rank("asset_class"), "model_rank": rank("model_name")})
    within = lambda r, limit: limit.isNull() | (F.col(r) <= limit)
    out = out.withColumns({
        "rebalance_cap_pass": within("selection_rank", F.col("rebalance_limit")), "asset_class_cap_pass": within("asset_class_rank", _limit(F.col("selection_cap_asset_class_limit"))),
        "model_cap_pass": within("model_rank", _limit(F.col("selection_cap_model_limit"))),
    })
    out = out.withColumn("cap_passed", F.col("rebalance_cap_pass") & F.col("asset_class_cap_pass") & F.col("model_cap_pass"))
    return out.withColumn("final_selection_passed", F.coalesce("selection_passed", F.lit(False)) & F.col("cap_passed"))


def universe(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("candidate_signal").isin("long", "short"))


def binned(candidates: DataFrame, metrics: tuple[str, ...], bins: tuple, *groups: str) -> DataFrame:
    """(groups, metric, score_bin, count), empty bins too: a metric's bins for each value of the groups that
    has it. Values outside all bins are not counted."""
    rows = candidates.unpivot(list(groups), list(metrics), "metric", "value").where("value is not null")
    name = F.lit(None).cast("string")
    for low, high, label in bins:
        name = F.when((F.col("value") > low) & (F.col("value") <= high), label).otherwise(name)
    held = rows.groupBy(*groups, "metric").agg(*(F.count_if(name == label).alias(label) for _, _, label in bins))
    return held.unpivot([*groups, "metric"], [F.col(f"`{label}`") for _, _, label in bins], "score_bin", "count")


def component_summary(candidates: DataFrame, metrics: tuple[str, ...], *groups: str) -> DataFrame:
    """Mean, median, extremes and number of each component for selected and rejected candidates."""
    rows = candidates.withColumn("selection_status", F.when(F.coalesce("final_selection_passed", F.lit(False)), "selected").otherwise("rejected"))
    long = rows.unpivot([*groups, "selection_status"], list(metrics), "component", "value").where("value is not null")
    v = F.col("value")
    return long.groupBy(*groups, "selection_status", "component").agg(F.avg(v).alias("mean_value"), F.median(v).alias("median_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.count(v).alias("count"))


def hard_filter_summary(candidates: DataFrame, *groups: str) -> DataFrame:
    """How many candidates each reason blocks, and their share of the group's candidates."""
    passed = F.coalesce("selection_passed", F.lit(False))
    counts = candidates.groupBy(*groups, "hard_block_category", "hard_block_reason", passed.alias("_passed")).agg(F.count("*").alias("blocked_count"))
    counts = counts.withColumn("candidate_count", F.sum("blocked_count").over(Window.partitionBy(*groups))).where("not _passed").drop("_passed")
    return counts.withColumn("blocked_rate", F.col("blocked_count") / F.greatest("candidate_count", F.lit(1)))


def family_summary(candidates: DataFrame, *groups: str) -> DataFrame:
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return candidates.groupBy(*groups, "state_family").agg(
        F.count("state_family").alias("candidate_count"), rate("family_gate_pass").alias("family_gate_pass_rate"), rate("hard_filter_passed").alias("hard_filter_pass_rate"), rate("final_selection_passed").alias("selected_rate"),
        F.avg("state_family_quality_score").alias("mean_family_quality_score"), F.avg("family_rank_score").alias("mean_family_rank_score"), F.avg("family_consistency_score").alias("mean_family_consistency_score"),
    )


def top_n_summary(candidates: DataFrame, *groups: str) -> DataFrame:
    """What the caps leave of the candidates that passed selection."""
    chosen = candidates.where("selection_passed")
    return chosen.groupBy(*groups).agg(
        F.count("*").alias("pre_cap_count"), F.count_if("final_selection_passed").alias("post_cap_count"), F.count_if(~F.coalesce("cap_passed", F.lit(True))).alias("capped_out_count"),
        F.median("selection_rank").alias("median_selection_rank"), F.median("asset_class_rank").alias("median_asset_class_rank"),
    )


def comparison_scores(models: DataFrame, sparsity: tuple[str, ...], tradability: dict[str, float]) -> DataFrame:
    """Min-max blended scores of models and their rank. There is a row for each model, so the windows range
    over a table that does not grow with the data."""
    def blend(weights: dict[str, float]) -> Column:
        everything = Window.partitionBy()
        out = F.lit(0.0)
        for name, w in weights.items():
            x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
            low, high = F.min(x).over(everything), F.max(x).over(everything)
            out = out + F.when(high == low, 0.5).otherwise((x - low) / nullif(high - low)) * w
        return out / sum(weights.values())

    out = models.withColumns({"sparsity_score": blend(dict.fromkeys(sparsity, 1.0)), "tradability_score": blend(tradability)})
    order = Window.orderBy(F.col("tradability_score").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in tradability), "model_name")
    return out.withColumn("comparison_rank", F.row_number().over(order))


def ranked_opportunities(chosen: DataFrame, n: int) -> DataFrame:
    """The ``n`` best opportunities, by score, then expected value; a top-k report, so the limit comes before
    the window and no task ranks them all."""
    order = [F.col("signal_score").desc(), F.col("base_score").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    return chosen.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
