"""Queries of the quality gates and of the reports on selection, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from ..operators.gates import GatePolicy, KindLimits
from ..sources import bars as sources
from . import sql
from .registry import add

_Y = sources.PAST_YEAR


def _norm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.5 ELSE (({x}) - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0) END"


def _fall(keys: str, part: str, group: str) -> str:
    w = f"({part} ORDER BY exit_ts, trade_order ROWS UNBOUNDED PRECEDING)"
    return f"SELECT {keys} max(1 - exp(c - greatest(0, m))) AS fall FROM (SELECT *, max(c) OVER {w} AS m FROM (SELECT *, sum(ln(1 + return_pct)) OVER {w} AS c FROM past)) {group}"


def _quality(key: str) -> str:
    both = f"asset_class, {key}"
    sharpe = "coalesce(avg(return_pct) / nullif(stddev_samp(return_pct), 0), 0)"
    rank = lambda x: f"dense_rank() OVER (PARTITION BY asset_class ORDER BY round({x}_score, 9) DESC) AS {x}_rank, 1 - (dense_rank() OVER (PARTITION BY asset_class ORDER BY round({x}_score, 9) DESC) - 1) / count(*) OVER (PARTITION BY asset_class) AS {x}_percentile"
    return f"""SELECT *, {key} AS key, count(*) OVER (PARTITION BY asset_class) AS quality_group_size, {rank('quality')}, {rank('consistency')} FROM (SELECT *, {_norm('ln(1 + sample_size)')} AS sample_size_score,
    ({_norm('expectancy')}) * 0.25 + ({_norm('sharpe')}) * 0.25 + ({_norm('win_rate')}) * 0.10 + ({_norm('ln(1 + sample_size)')}) * 0.15 + ({_norm('consistency_score')}) * 0.20 + ({_norm('-share')}) * 0.05 AS quality_score
    FROM (SELECT *, (({_norm('active_fold_count')}) + ({_norm('positive_fold_fraction')}) + ({_norm('-expectancy_variance')}) + ({_norm('-sharpe_variance')})) / 4 AS consistency_score FROM
    (SELECT g.*, f.* EXCLUDE ({both}), b.fall / (SELECT fall FROM ({_fall('', '', '')})) AS share FROM
    (SELECT {both}, count(*) AS sample_size, avg(return_pct) AS expectancy, {sharpe} AS sharpe, avg((return_pct > 0)::INT) AS win_rate FROM past GROUP BY ALL) g
    JOIN (SELECT {both}, count(*) AS active_fold_count, avg((e > 0)::INT) AS positive_fold_fraction, coalesce(var_samp(e), 0) AS expectancy_variance, coalesce(var_samp(s), 0) AS sharpe_variance
          FROM (SELECT {both}, fold_id, avg(return_pct) AS e, {sharpe} AS s FROM past GROUP BY ALL) GROUP BY ALL) f USING ({both}) JOIN ({_fall(both + ',', f'PARTITION BY {both}', f'GROUP BY {both}')}) b USING ({both}))))"""


#: The policy of the queries: limits that some candidates pass and some do not.
STRICT = GatePolicy(
    state=KindLimits(0.4, 0.2, 5, 20, 3, 0.4, 0.001, 10.0), transition=KindLimits(0.35, 0.15, 9, 5, 2, 0.3, None, None), min_consistency_score=0.3, min_consistency_percentile=0.2, max_consistency_rank=11,
    min_sample_score=0.2, min_observations=5, family_mode="top_count", top_count=1, top_percentile=0.6, bottom_count=1, bottom_percentile=0.4, min_family_consistency=0.3, components=("state", "consistency"),
    hard=("transition", "sample_size", "state", "consistency", "family"), mode="hybrid", per_time=3, per_class=2, per_model=2,
)
#: Without an order of hard filters the components of the gate decide.
LEGACY = GatePolicy(state=STRICT.state, transition=STRICT.transition, legacy_mode="both", excluded_families=("F",), min_observations=5)

sql.CTES |= {
    "setups": (("trades",), "SELECT *, entry_state || '>' || exit_reason AS entry_transition_setup FROM trades"),
    "past": (("setups",), f"SELECT * FROM setups WHERE fold_id <= {_Y}"),
    "q_state": (("past",), _quality("entry_state")),
    "q_transition": (("past",), _quality("entry_transition_setup")),
    "q_family": (("past",), _quality("entry_state_family")),
    "cands": ((), f"""SELECT *, CASE WHEN candidate_signal = 'flat' THEN ['insufficient_observations', 'low_confidence', 'negative_expected_value'][l_partkey % 3 + 1] END AS block_reason FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS symbol,
        CASE WHEN l_returnflag = 'R' THEN 'crypto' ELSE 'equity' END AS asset_class, CASE WHEN l_partkey % 11 = 0 THEN 'unseen' ELSE l_linestatus || '|' || l_linenumber END AS state,
        CASE WHEN l_partkey % 13 <> 0 THEN l_linestatus || '|' || l_linenumber || '>' || ['state_change', 'time_exit', 'signal_flip'][l_linenumber % 3 + 1] END AS transition_setup, l_linestatus AS state_family,
        ['flat', 'short', 'long', 'long', 'long'][l_suppkey % 5 + 1] AS candidate_signal, trunc(l_quantity)::INT AS observations, l_discount / 5 - 0.002::DOUBLE AS base_score, 'm' || (l_suppkey % 2) AS model_name,
        CASE WHEN year(l_shipdate) = {_Y + 1} THEN 'validation' ELSE 'test' END AS split, l_shipdate AS ts FROM lineitem WHERE year(l_shipdate) > {_Y})"""),
    "looked": (("cands", "q_state", "q_transition", "q_family"), """SELECT c.*, s.key IS NOT NULL AS s_found, t.key IS NOT NULL AS t_found, f.key IS NOT NULL AS f_found,
        coalesce(s.quality_score, 0) AS state_quality_score, coalesce(s.quality_percentile, 0) AS s_pct, coalesce(s.quality_rank, 1000000) AS s_rank, coalesce(s.sample_size, 0) AS s_n, coalesce(s.active_fold_count, 0) AS s_folds,
        coalesce(s.positive_fold_fraction, 0) AS s_pos, coalesce(s.expectancy_variance, 0) AS s_ev, coalesce(s.sharpe_variance, 0) AS s_sv,
        coalesce(t.quality_score, 0) AS transition_quality_score, coalesce(t.quality_percentile, 0) AS t_pct, coalesce(t.quality_rank, 1000000) AS t_rank, coalesce(t.sample_size, 0) AS t_n, coalesce(t.active_fold_count, 0) AS t_folds,
        coalesce(t.positive_fold_fraction, 0) AS t_pos, coalesce(f.quality_score, 0) AS state_family_quality_score, coalesce(f.quality_percentile, 0) AS family_rank_score, coalesce(f.quality_rank, 1000000) AS f_rank,
        f.quality_percentile AS f_pct, coalesce(f.quality_group_size, 0) AS f_size, f.consistency_score AS family_consistency_score, coalesce(least(s.consistency_score, t.consistency_score), 0) AS fold_consistency_score,
        coalesce(least(s.consistency_percentile, t.consistency_percentile), 0) AS consistency_percentile, coalesce(greatest(s.consistency_rank, t.consistency_rank), 1000000) AS consistency_rank,
        coalesce(least(s.sample_size_score, t.sample_size_score), least(greatest(ln(1 + observations) / ln(21), 0), 1)) AS sample_size_score, CASE WHEN base_score > 0 THEN tanh(100 * base_score) ELSE 0 END AS opportunity_score
        FROM cands c LEFT JOIN q_state s ON s.asset_class = c.asset_class AND s.key = c.state LEFT JOIN q_transition t ON t.asset_class = c.asset_class AND t.key = c.transition_setup LEFT JOIN q_family f ON f.asset_class = c.asset_class AND f.key = c.state_family"""),
    "checked": (("looked",), """SELECT *, (0.20 * opportunity_score + 0.20 * greatest(state_quality_score, 0) + 0.20 * greatest(transition_quality_score, 0) + 0.15 * greatest(fold_consistency_score, 0) + 0.10 * sample_size_score + 0.15 * tradability_score) / 1.0 AS signal_score,
        state_quality_score >= 0.4 AND s_pct >= 0.2 AND s_rank <= 5 AND s_n >= 20 AND s_folds >= 3 AND s_pos >= 0.4 AND s_ev <= 0.001 AND s_sv <= 10 AS state_gate_pass,
        transition_quality_score >= 0.35 AND t_pct >= 0.15 AND t_rank <= 9 AND t_n >= 5 AND t_folds >= 2 AND t_pos >= 0.3 AS transition_gate_pass,
        fold_consistency_score >= 0.3 AND consistency_percentile >= 0.2 AND consistency_rank <= 11 AS consistency_gate_pass, sample_size_score >= 0.2 AND observations >= 5 AND s_n >= 20 AND t_n >= 5 AS sample_size_gate_pass,
        f_rank <= 1 AS family_mode_pass, coalesce(f_pct >= 0.6, false) AS family_top_percentile_pass, f_size <= 0 OR f_rank < greatest(f_size - 1 + 1, 1) AS family_bottom_exclusion_pass, coalesce(f_pct > 0.4, false) AS family_bottom_percentile_pass,
        coalesce(family_consistency_score >= 0.3, false) AS family_consistency_pass FROM (SELECT *, (greatest(state_quality_score, 0) + greatest(transition_quality_score, 0) + fold_consistency_score + sample_size_score + greatest(state_family_quality_score, 0)) / 5 AS tradability_score FROM looked)"""),
    "chosen": (("checked",), """SELECT *, hard_block_reason IS NULL AS selection_passed, CASE WHEN hard_block_reason IS NULL THEN candidate_signal ELSE 'flat' END AS signal FROM (SELECT *,
        CASE WHEN candidate_signal = 'flat' THEN 'candidate' WHEN NOT transition_gate_pass THEN 'transition' WHEN NOT sample_size_gate_pass THEN 'sample_size' WHEN NOT state_gate_pass THEN 'state' WHEN NOT consistency_gate_pass THEN 'consistency' WHEN NOT family_mode_pass THEN 'family' END AS hard_block_category,
        CASE WHEN candidate_signal = 'flat' THEN block_reason WHEN NOT transition_gate_pass THEN 'transition_gate_failed' WHEN NOT sample_size_gate_pass THEN 'minimum_sample_size_failed' WHEN NOT state_gate_pass THEN 'state_gate_failed' WHEN NOT consistency_gate_pass THEN 'consistency_gate_failed' WHEN NOT family_mode_pass THEN 'family_filter_failed' END AS hard_block_reason FROM checked)"""),
    "ranked": (("chosen",), """SELECT *, cap_passed AND selection_passed AS final_selection_passed FROM (SELECT *, selection_rank <= 2 AS rebalance_cap_pass, asset_class_rank <= 2 AS asset_class_cap_pass, model_rank <= 2 AS model_cap_pass, selection_rank <= 2 AND asset_class_rank <= 2 AND model_rank <= 2 AS cap_passed FROM (SELECT *,
        row_number() OVER (PARTITION BY ts ORDER BY round(signal_score, 9) DESC, symbol, l_orderkey, l_linenumber, l_partkey) AS selection_rank, row_number() OVER (PARTITION BY ts, asset_class ORDER BY round(signal_score, 9) DESC, symbol, l_orderkey, l_linenumber, l_partkey) AS asset_class_rank,
        row_number() OVER (PARTITION BY ts, model_name ORDER BY round(signal_score, 9) DESC, symbol, l_orderkey, l_linenumber, l_partkey) AS model_rank FROM chosen))"""),
    "ranked_universe": (("ranked",), "SELECT * FROM ranked WHERE candidate_signal IN ('long', 'short')"),
}


sql.CTES |= {
    "v": (("ranked_universe",), "SELECT split, asset_class, unnest(['state_quality_score', 'fold_consistency_score', 'signal_score']) AS metric, unnest([state_quality_score, fold_consistency_score, round(signal_score, 9)]) AS value FROM ranked_universe"),
    "w": (("ranked_universe",), "SELECT split, asset_class, CASE WHEN final_selection_passed THEN 'selected' ELSE 'rejected' END AS selection_status, unnest(['score_component_base_signal', 'score_contribution_fold_consistency']) AS metric, unnest([opportunity_score, 0.15 * fold_consistency_score]) AS value FROM ranked_universe"),
}


def _tables(s, d) -> dict[str, DataFrame]:
    return gates.quality_tables(sources.setups(s, d).where(F.col("fold_id") <= _Y))


def _gated(s, d, policy=STRICT) -> DataFrame:
    return gates.gated(sources.candidates(s, d), _tables(s, d), policy)


def _ranked(s, d) -> DataFrame:
    scored = gates.with_limits(_gated(s, d), STRICT).withColumn("signal_score", F.round("signal_score", 9))
    return gates.annotated(scored, "ts", tie=("symbol", "l_orderkey", "l_linenumber", "l_partkey"))


def _universe(s, d) -> DataFrame:
    return gates.universe(_ranked(s, d))


_ID = "l_orderkey l_linenumber l_partkey l_suppkey"
for _kind, _key in (("state", "entry_state"), ("transition", "entry_transition_setup"), ("family", "entry_state_family")):
    add(f"eq_table_{_kind}", "asset_class key sample_size quality_score:7 quality_rank quality_group_size quality_percentile:7 consistency_score:7 consistency_rank consistency_percentile:7 sample_size_score:7",
        lambda s, d, k=_kind: _tables(s, d)[k], f"q_{_kind}", f"q_{_kind}")
add("eq_report", "side asset_class key quality_score:7 expectancy:8", lambda s, d: gates.ranked_report(_tables(s, d)["transition"], 5),
    "(SELECT *, 'best' AS side FROM (SELECT * FROM q_transition ORDER BY quality_score DESC, expectancy DESC, asset_class, key LIMIT 5) UNION ALL SELECT *, 'worst' FROM (SELECT * FROM q_transition ORDER BY quality_score, expectancy, asset_class, key LIMIT 5))", "q_transition")
add("sg_lookup_quality", f"{_ID} state_found transition_found family_found state_quality_score:7 transition_quality_score:7 state_family_quality_score:7", _gated,
    "(SELECT *, s_found AS state_found, t_found AS transition_found, f_found AS family_found FROM looked)", "looked")
add("sg_sample_score", f"{_ID} sample_size_score:7", _gated, "looked", "looked")
add("sg_gate_state", f"{_ID} state_gate_pass state_quality_rank_pass state_active_folds_pass state_expectancy_variance_pass", _gated, "(SELECT *, s_rank <= 5 AS state_quality_rank_pass, s_folds >= 3 AS state_active_folds_pass, s_ev <= 0.001 AS state_expectancy_variance_pass FROM checked)", "checked")
add("sg_gate_transition", f"{_ID} transition_gate_pass transition_quality_score_pass transition_trade_count_pass", _gated, "(SELECT *, transition_quality_score >= 0.35 AS transition_quality_score_pass, t_n >= 5 AS transition_trade_count_pass FROM checked)", "checked")
add("sg_gate_consistency", f"{_ID} consistency_gate_pass consistency_score_pass consistency_percentile_pass consistency_rank_pass", _gated,
    "(SELECT *, fold_consistency_score >= 0.3 AS consistency_score_pass, consistency_percentile >= 0.2 AS consistency_percentile_pass, consistency_rank <= 11 AS consistency_rank_pass FROM checked)", "checked")
add("sg_gate_family", f"{_ID} family_mode_pass family_top_percentile_pass family_bottom_exclusion_pass family_bottom_percentile_pass family_consistency_pass", _gated, "checked", "checked")
add("sg_gate_sample", f"{_ID} sample_size_gate_pass", _gated, "checked", "checked")
add("sg_hard_filters", f"{_ID} signal hard_block_category hard_block_reason", _gated, "chosen", "chosen")
add("sg_component_gate", f"{_ID} component_gate_pass gate_passed hard_block_category hard_block_reason", lambda s, d: _gated(s, d, LEGACY),
    """(SELECT * EXCLUDE (state_gate_pass), c AS component_gate_pass, g AS gate_passed, CASE WHEN candidate_signal = 'flat' THEN 'candidate' WHEN state_family = 'F' THEN 'family' WHEN NOT g AND NOT state_gate_pass THEN 'state' WHEN NOT g AND NOT transition_gate_pass THEN 'transition' END AS hard_block_category,
    CASE WHEN candidate_signal = 'flat' THEN block_reason WHEN state_family = 'F' THEN 'excluded_state_family' WHEN NOT g AND NOT state_gate_pass THEN 'state_gate_failed' WHEN NOT g AND NOT transition_gate_pass THEN 'transition_gate_failed' END AS hard_block_reason
    FROM (SELECT *, state_gate_pass AND transition_gate_pass AS c, state_gate_pass AND transition_gate_pass AND state_family <> 'F' AS g FROM checked))""", "checked")
add("sg_selection_score", f"{_ID} signal_score:7 tradability_score:7 score_contribution_base_signal:7 score_contribution_fold_consistency:7", _gated,
    "(SELECT *, 0.20 * opportunity_score AS score_contribution_base_signal, 0.15 * fold_consistency_score AS score_contribution_fold_consistency FROM checked)", "checked")
add("sg_opportunities_sorted", f"place {_ID} signal_score:7", lambda s, d: gates.ranked_opportunities(_ranked(s, d).where("final_selection_passed"), 50),
    "(SELECT *, row_number() OVER (ORDER BY round(signal_score, 9) DESC, base_score DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM ranked WHERE final_selection_passed QUALIFY place <= 50)", "ranked")
add("sel_limits", f"{_ID} rebalance_limit rebalance_cap_pass asset_class_cap_pass model_cap_pass", _ranked, "(SELECT *, 2 AS rebalance_limit FROM ranked)", "ranked")
add("sel_annotate", f"{_ID} selection_rank asset_class_rank model_rank cap_passed final_selection_passed", _ranked, "ranked", "ranked")
add("sel_score_dist", "split asset_class metric score_bin count", lambda s, d: gates.binned(_universe(s, d), ("state_quality_score", "fold_consistency_score", "signal_score"), gates.SCORE_BINS, "split", "asset_class"),
    """(SELECT g.split, g.asset_class, g.metric, b.label AS score_bin, count(v.value) AS count FROM (SELECT DISTINCT split, asset_class, metric FROM v) g CROSS JOIN (SELECT unnest([-0.001, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS lo, unnest([0.2, 0.4, 0.6, 0.8, 1.0, 10.0]::DOUBLE[]) AS hi,
    unnest(['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0', '>1.0']) AS label) b LEFT JOIN v ON v.split = g.split AND v.asset_class = g.asset_class AND v.metric = g.metric AND v.value > lo AND v.value <= hi GROUP BY ALL)""", "v")
add("sel_component_dist", "split asset_class metric score_bin count", lambda s, d: gates.binned(_universe(s, d), ("score_component_base_signal", "score_contribution_fold_consistency"), gates.COMPONENT_BINS, "split", "asset_class"),
    """(SELECT g.split, g.asset_class, g.metric, b.label AS score_bin, count(w.value) AS count FROM (SELECT DISTINCT split, asset_class, metric FROM w) g CROSS JOIN (SELECT unnest([-0.001, 0.05, 0.15, 0.3, 0.5, 1.0]::DOUBLE[]) AS lo, unnest([0.05, 0.15, 0.3, 0.5, 1.0, 10.0]::DOUBLE[]) AS hi,
    unnest(['0.00-0.05', '0.05-0.15', '0.15-0.30', '0.30-0.50', '0.50-1.00', '>1.00']) AS label) b LEFT JOIN w ON w.split = g.split AND w.asset_class = g.asset_class AND w.metric = g.metric AND w.value > lo AND w.value <= hi GROUP BY ALL)""", "w")
add("sel_component_summary", "asset_class selection_status component mean_value:7 median_value:7 max_value:7 min_value:7 count", lambda s, d: gates.component_summary(_universe(s, d), ("score_component_base_signal", "score_contribution_fold_consistency"), "asset_class"),
    "(SELECT asset_class, selection_status, metric AS component, avg(value) AS mean_value, median(value) AS median_value, max(value) AS max_value, min(value) AS min_value, count(*) AS count FROM w GROUP BY ALL)", "w")
add("sel_hard_filter", "split asset_class hard_block_category hard_block_reason blocked_count candidate_count blocked_rate:8", lambda s, d: gates.hard_filter_summary(_universe(s, d), "split", "asset_class"),
    "(SELECT split, asset_class, hard_block_category, hard_block_reason, count(*) AS blocked_count, any_value(n) AS candidate_count, count(*) / any_value(n) AS blocked_rate FROM (SELECT *, count(*) OVER (PARTITION BY split, asset_class) AS n FROM ranked_universe) WHERE NOT selection_passed GROUP BY ALL)", "ranked_universe")
add("sel_family_report", "asset_class state_family candidate_count family_gate_pass_rate:8 hard_filter_pass_rate:8 selected_rate:8 mean_family_quality_score:7 mean_family_rank_score:7 mean_family_consistency_score:7", lambda s, d: gates.family_summary(_universe(s, d), "asset_class"),
    """(SELECT asset_class, state_family, count(*) AS candidate_count, avg(family_mode_pass::INT) AS family_gate_pass_rate, avg(selection_passed::INT) AS hard_filter_pass_rate, avg(final_selection_passed::INT) AS selected_rate, avg(state_family_quality_score) AS mean_family_quality_score,
    avg(family_rank_score) AS mean_family_rank_score, avg(family_consistency_score) AS mean_family_consistency_score FROM ranked_universe GROUP BY ALL)""", "ranked_universe")
add("sel_top_n", "split asset_class model_name pre_cap_count post_cap_count capped_out_count median_selection_rank:2 median_asset_class_rank:2", lambda s, d: gates.top_n_summary(_ranked(s, d), "split", "asset_class", "model_name"),
    "(SELECT split, asset_class, model_name, count(*) AS pre_cap_count, count(*) FILTER (final_selection_passed) AS post_cap_count, count(*) FILTER (NOT cap_passed) AS capped_out_count, median(selection_rank) AS median_selection_rank, median(asset_class_rank) AS median_asset_class_rank FROM ranked WHERE selection_passed GROUP BY ALL)", "ranked")
