"""Rule-based forecasting of many keyed time series on Spark DataFrames."""

from .functions.intervals import interval_midpoints, label_of
from .operators.forecast import (
    first_moves,
    forecast_by_variable,
    forecast_multiorder,
    forecast_multivar,
    forecast_terms,
    forecast_uni,
    price_from_rate,
    rmse,
    rule_book,
)
from .operators.layout import SeriesLayout, measure_layout
from .operators.population import (
    Search,
    crossover_population,
    init_cuts_random,
    init_cuts_uniform,
    init_population,
    mutate_population,
    next_generation,
    repair_cuts,
    select_elite,
    single_point_crossover,
    tournament_select,
    trim_cuts,
)
from .operators.predicates import filter_by_run, filter_exists, filter_forall, fold_series, longest_run
from .operators.rules import (
    Sets,
    align_covariates,
    antecedent_counts,
    discretize,
    forecast_steps,
    mine_all_rules,
    mine_rules,
)
from .operators.series import (
    assemble_by_time,
    assemble_by_var,
    change_rate,
    filter_series,
    find_series,
    index_series,
    model_keys,
    series_keys,
    series_range,
    series_sizes,
    series_stats,
    transpose_series,
)
from .plans.scoring import (
    mean_score,
    report_slice_mean,
    report_sorted,
    score_models,
    write_scores,
)
from .plans.training import evaluate_population, fit_cuts, train_series, train_series_streamed, train_series_with
from .settle import settle, settle_by
from .sources.observations import (
    derive_series_key,
    read_observations,
    skip_malformed,
    to_series_form,
    write_observations,
)
from .sources.store import open_series, stored_series, write_series

__all__ = [name for name in dir() if not name.startswith("_")]
