"""Public operators. Every function takes DataFrames (plus an optional column
map and literals) and returns a DataFrame.

Names follow the blueprint's signatures; a few carry a more precise name
with the blueprint name kept as an alias (see the bottom of this file).
"""

from mercata.operators.customers import (  # noqa: F401
    cohort_repurchase, cohort_summary, customer_value, f_score_diagnostics, frequency_value_share, gap_buckets, gini,
    group_category_preference, group_payment_mix, group_preference_extremes, lorenz_curve, pareto_shares,
    payment_label, repurchase_gap_distribution, repurchase_gap_stats, rfm_base, rfm_scores, rfm_segments,
    segment_stats, spend_histogram, spend_summary, top_spender_penetration, with_customer_key,
)
from mercata.operators.delivery import (  # noqa: F401
    data_quality_checks, delay_by_category, delay_by_region, delay_dose_response, delay_score_gap, delay_vs_score,
    extremes, fulfilment_durations, fulfilment_summary, stage_boxplot, table_row_counts, total_days_histogram,
)
from mercata.operators.experiment import (  # noqa: F401
    arm_counts, arm_readout, arm_summary, chi_square, chi_square_test, contingency, diff_ci, expected_counts,
    launch_decision,
)
from mercata.operators.growth import (  # noqa: F401
    category_coverage, category_growth, category_month_gmv, category_totals, concentration_summary, customer_trend_edges,
    growth_driver, growth_kpis, monthly_customers, monthly_gmv_trend, period_growth, purchase_frequency,
    region_concentration, repeat_rate, top_gainers_decliners, topk_category_month_matrix, trend_summary,
)
from mercata.operators.scorecard import (  # noqa: F401
    auc, clean_applicants, coefficients, fit_logistic, iv_table, ks, label_summary, overfit_gap, predict,
    quantile_bins, roc_curve, scorecard_points, stratified_split, woe_encode, woe_rows, woe_table,
)

# Blueprint names for operators published under a more precise name.
hv_penetration_by_region = top_spender_penetration   # T5: top spenders, not the RFM segment
topk_share = concentration_summary                   # G14: top-k shares, n_to_reach and verdict
n_to_reach = concentration_summary
