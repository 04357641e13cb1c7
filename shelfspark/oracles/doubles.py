"""Columns of type double in each query's result, which both sides round alike."""

DOUBLES: dict[str, str] = {
    "d01_service_health": "total_lost_sales_revenue total_service_gap_units overall_fill_rate overall_stockout_rate",
    "d02_monthly_service": "lost_sales_revenue avg_days_of_supply promo_mix_rate fill_rate stockout_rate",
    "d03_service_by_region": "lost_sales_revenue avg_row_fill_rate stockout_day_rate fill_rate stockout_rate",
    "d04_service_by_warehouse": "warehouse_service_risk_proxy fill_rate stockout_rate lost_sales_value average_days_of_supply inventory_value capacity_pressure_proxy",
    "d05_service_by_category": "lost_sales_revenue avg_row_fill_rate stockout_day_rate avg_days_of_supply avg_inventory_value fill_rate stockout_rate",
    "d06_inventory_efficiency": "avg_days_of_supply median_days_of_supply p90_days_of_supply p99_days_of_supply avg_inventory_value p95_inventory_value excess_inventory_day_rate slow_moving_day_rate",
    "d07_days_of_supply_histogram": "row_share avg_dos_in_bucket",
    "d08_value_concentration": "avg_inventory_value rank_percentile cumulative_inventory_value total_inventory_value cumulative_value_share",
    "d09_excess_exposure": "excess_inventory_day_rate slow_moving_day_rate avg_inventory_value excess_inventory_value_proxy",
    "d10_stockout_levels": "stockout_rate lost_sales_revenue",
    "d11_stockout_patterns": "avg_stockout_rate avg_active_month_ratio",
    "d12_top_lost_sales": "lost_sales_revenue stockout_rate",
    "d13_supplier_downstream": "on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate supplier_service_risk_proxy downstream_lost_sales_revenue downstream_stockout_rate downstream_fill_rate",
    "d14_tradeoff_zones": "avg_fill_rate avg_stockout_rate avg_days_of_supply total_lost_sales_revenue total_avg_inventory_value",
    "d15_unbalanced_skus": "avg_days_of_supply avg_inventory_value lost_sales_revenue dos_cap fill_rate stockout_rate",
    "d16_action_skus": "governance_priority_score lost_sales_revenue avg_inventory_value avg_days_of_supply avg_fill_rate",
    "d17_action_warehouses": "warehouse_service_risk_proxy fill_rate stockout_rate lost_sales_value average_days_of_supply inventory_value capacity_pressure_proxy",
    "d18_action_suppliers": "on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate supplier_service_risk_proxy downstream_lost_sales_revenue downstream_stockout_rate",
    "d19_action_segments": "avg_governance_priority_score total_lost_sales_revenue total_avg_inventory_value service_risk_driver_share excess_inventory_driver_share supplier_risk_driver_share",
    "d20_headline_facts": "top_20_value_share dual_failure_lost_sales",
    "db01_daily_proxies": "lost_sales_revenue inventory_value days_of_supply excess_inventory_proxy slow_moving_proxy trapped_wc_proxy lost_sales_margin_proxy",
    "db02_monthly_sku_fact": "lost_sales_revenue inventory_value excess_inventory_proxy slow_moving_proxy trapped_wc_proxy lost_sales_margin_proxy avg_days_of_supply",
    "db03_sku_risk_extract": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score",
    "db04_official_snapshot": "overall_fill_rate overall_stockout_rate total_lost_sales_revenue trapped_working_capital_proxy_observed opportunity_total_12m_proxy",
    "db08_fact_slice": "lost_sales_revenue inventory_value excess_inventory_proxy slow_moving_proxy trapped_wc_proxy lost_sales_margin_proxy avg_days_of_supply",
    "db09_slice_totals": "lost_sales inventory excess trapped trapped_scenario slow lost_margin fill_rate stockout_rate scenario_opportunity_12m",
    "db10_slice_by_month": "lost_sales inventory fill_rate stockout_rate",
    "db11_slice_by_warehouse": "lost_sales inventory avg_dos fill_rate stockout_rate",
    "db12_slice_by_category": "lost_sales inventory excess trapped avg_dos fill_rate stockout_rate",
    "db13_slice_by_region": "lost_sales inventory fill_rate stockout_rate",
    "db14_slice_by_supplier": "lost_sales inventory fill_rate stockout_rate on_time_delivery_rate average_delay_days lead_time_variability supplier_service_risk_proxy",
    "db15_slice_by_segment": "lost_sales inventory avg_dos fill_rate stockout_rate",
    "db16_slice_by_sku": "lost_sales inventory excess trapped avg_dos fill_rate stockout_rate stockout_persistence service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score",
    "db17_weighted_supplier_otd": "weighted_supplier_otd",
    "db18_posture": "balanced_share",
    "db20_kpi_tiles": "value",
    "db21_top_supplier_heatmap": "otd_gap avg_delay_norm lt_variability_norm risk_proxy_norm",
    "db22_warehouse_quadrant_means": "fill_rate inventory fill_line value_line",
    "db23_detail_table": "lost_sales inventory excess trapped avg_dos fill_rate stockout_rate stockout_persistence service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score",
    "db24_slice_reconciliation": "fill_diff stockout_diff lost_diff",
    "dp01_table_summary": "null_rate",
    "dp02_null_profile": "null_rate",
    "dp03_cardinality": "top_share",
    "dp04_distribution": "min p50 p95 p99 max mean std skew p99_p50_ratio",
    "dp12_skew_flags": "p99_p50_ratio skew_limit",
    "dp14_generation_health": "fill_rate stockout_day_rate late_rate excess_day_rate",
    "f01_supplier_features": "on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate supplier_service_risk_proxy",
    "f02_product_features": "average_inventory_units average_inventory_value average_days_of_supply stockout_frequency fill_rate_average lost_sales_exposure slow_moving_inventory_proxy excess_inventory_proxy working_capital_risk_proxy",
    "f03_warehouse_features": "fill_rate stockout_rate lost_sales_value average_days_of_supply inventory_value capacity_pressure_proxy warehouse_service_risk_proxy",
    "f04_sku_risk_baseline": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score",
    "g01_unified_checks": "observed",
    "i01_supplier_delay_factor": "supplier_delay_factor on_time_delivery_rate average_delay_days lead_time_variability",
    "i02_daily_impact": "gross_margin_rate supplier_delay_factor lost_sales_revenue lost_sales_margin_proxy excess_inventory_value_proxy trapped_working_capital_proxy slow_moving_value_proxy supplier_delay_impact_proxy",
    "i03a_impact_by_sku": "lost_sales_revenue_observed lost_sales_margin_proxy_observed excess_inventory_value_proxy_observed trapped_working_capital_proxy_observed slow_moving_value_proxy_observed supplier_delay_impact_proxy_observed lost_sales_revenue_annualized lost_sales_margin_proxy_annualized excess_inventory_value_proxy_annualized trapped_working_capital_proxy_annualized slow_moving_value_proxy_annualized supplier_delay_impact_proxy_annualized opportunity_margin_recovery_12m_proxy opportunity_wc_release_12m_proxy opportunity_total_12m_proxy stockout_rate opportunity_share",
    "i03b_impact_by_warehouse": "lost_sales_revenue_observed lost_sales_margin_proxy_observed excess_inventory_value_proxy_observed trapped_working_capital_proxy_observed slow_moving_value_proxy_observed supplier_delay_impact_proxy_observed lost_sales_revenue_annualized lost_sales_margin_proxy_annualized excess_inventory_value_proxy_annualized trapped_working_capital_proxy_annualized slow_moving_value_proxy_annualized supplier_delay_impact_proxy_annualized opportunity_margin_recovery_12m_proxy opportunity_wc_release_12m_proxy opportunity_total_12m_proxy stockout_rate opportunity_share",
    "i03c_impact_by_supplier": "lost_sales_revenue_observed lost_sales_margin_proxy_observed excess_inventory_value_proxy_observed trapped_working_capital_proxy_observed slow_moving_value_proxy_observed supplier_delay_impact_proxy_observed lost_sales_revenue_annualized lost_sales_margin_proxy_annualized excess_inventory_value_proxy_annualized trapped_working_capital_proxy_annualized slow_moving_value_proxy_annualized supplier_delay_impact_proxy_annualized opportunity_margin_recovery_12m_proxy opportunity_wc_release_12m_proxy opportunity_total_12m_proxy stockout_rate opportunity_share on_time_delivery_rate average_delay_days lead_time_variability",
    "i03d_impact_by_category": "lost_sales_revenue_observed lost_sales_margin_proxy_observed excess_inventory_value_proxy_observed trapped_working_capital_proxy_observed slow_moving_value_proxy_observed supplier_delay_impact_proxy_observed lost_sales_revenue_annualized lost_sales_margin_proxy_annualized excess_inventory_value_proxy_annualized trapped_working_capital_proxy_annualized slow_moving_value_proxy_annualized supplier_delay_impact_proxy_annualized opportunity_margin_recovery_12m_proxy opportunity_wc_release_12m_proxy opportunity_total_12m_proxy stockout_rate opportunity_share",
    "i04_impact_overall": "value",
    "i05_opportunity_priority": "opportunity_total_12m_proxy opportunity_margin_recovery_12m_proxy opportunity_wc_release_12m_proxy lost_sales_revenue_annualized trapped_working_capital_proxy_annualized supplier_delay_impact_proxy_annualized opportunity_share",
    "io02_raw_demand_history": "seasonality_index",
    "io02_raw_inventory_snapshots": "inventory_value days_of_supply",
    "io02_raw_products": "unit_cost unit_price target_service_level",
    "io02_raw_suppliers": "reliability_score lead_time_variability",
    "k01_overall_fill_rate": "overall_fill_rate",
    "k02_unit_stockout_rate": "stockout_rate",
    "k03_lost_sales_by_category": "lost_revenue",
    "k04_inventory_value_by_category": "avg_inventory_value peak_inventory_value",
    "k05_days_of_supply_distribution": "dos_min dos_p25 dos_p50 dos_p75 dos_p90 dos_max dos_avg",
    "k06_supplier_on_time_in_full": "on_time_delivery_rate in_full_rate",
    "k07_warehouse_service_comparison": "warehouse_fill_rate warehouse_lost_sales_rate avg_inventory_value avg_days_of_supply",
    "k08_quadrant_summary": "avg_fill_rate avg_stockout_day_rate avg_excess_day_rate total_lost_revenue total_avg_inventory_value",
    "k09_top_risk_skus": "fill_rate stockout_day_rate excess_inventory_day_rate slow_moving_day_rate avg_days_of_supply lost_sales_revenue avg_inventory_value risk_score",
    "k10_working_capital_concentration": "avg_inventory_value rank_percentile cumulative_inventory_value total_portfolio_value cumulative_value_share",
    "p01_daily_duplicate_keys": "observed",
    "p02_daily_fill_rate_bounds": "observed",
    "p03_daily_stockout_logic": "observed",
    "p04_sku_score_bounds": "observed",
    "p05_dashboard_expected_grain": "observed",
    "p06_rowcount_dense_demand_history": "observed",
    "p07_rowcount_daily_equals_demand_history": "observed",
    "p08_rowcount_sku_risk_expected_grain": "observed",
    "p09_duplicates_demand_history": "observed",
    "p10_duplicates_inventory_snapshots": "observed",
    "p11_duplicates_purchase_orders": "observed",
    "p12_duplicates_daily_product_warehouse_metrics": "observed",
    "p13_products_critical_nulls": "observed",
    "p14_suppliers_critical_nulls": "observed",
    "p15_daily_critical_nulls": "observed",
    "p16_sku_risk_critical_nulls": "observed",
    "p17_impossible_negative_values": "observed",
    "p18_fill_rate_logic_bounds_raw": "observed",
    "p19_demand_balance_units": "observed",
    "p20_stockout_flag_logic": "observed",
    "p21_lost_sales_revenue_consistency_daily": "observed",
    "p22_inventory_value_consistency_raw": "observed",
    "p23_available_units_consistency_raw": "observed",
    "p24_working_capital_proxy_overall_consistency": "observed",
    "p25_excess_inventory_proxy_overall_consistency": "observed",
    "p26_supplier_delay_proxy_consistency": "observed",
    "p27_aggregation_lost_sales_sku_to_overall": "observed",
    "p28_aggregation_lost_sales_warehouse_to_overall": "observed",
    "p29_aggregation_lost_sales_supplier_to_overall": "observed",
    "p30_aggregation_lost_sales_category_to_overall": "observed",
    "p31_impact_opportunity_non_negative": "observed",
    "p32_denominator_zero_demand_with_activity_raw": "observed",
    "p33_denominator_zero_demand_with_activity_daily": "observed",
    "p34_scoring_formula_consistency": "observed",
    "p35_scoring_tier_consistency": "observed",
    "p36_scoring_main_driver_consistency": "observed",
    "p37_scoring_action_policy_non_low_not_monitor_only": "observed",
    "p38_scoring_top25_stability_under_weight_perturbation": "observed",
    "p39_data_contract_blocking_failures": "observed",
    "p40_data_contract_warning_sanity": "observed",
    "p41_dashboard_metric_reconciliation": "observed",
    "p42_dashboard_official_snapshot_present_and_reconciled": "observed",
    "q13_value_mismatch_rows": "inventory_value expected_value",
    "s01_supplier_base_score": "on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate supplier_risk_score_base",
    "s02_scoring_input": "demand_weight excess_day slow_moving_day weighted_criticality weighted_dos_cap weighted_supplier_risk",
    "s03_entity_measures_by_region": "fill_rate stockout_rate service_gap_rate excess_day_rate slow_moving_rate dos_stretch stockout_active_month_ratio lost_sales_revenue inventory_value_sum stockout_frequency average_days_of_supply average_inventory_value",
    "s04_component_scores": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score",
    "s06_sku_risk_governed": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score fill_rate stockout_rate service_gap_rate excess_day_rate slow_moving_rate dos_stretch lost_sales_share inventory_value_share lost_sales_revenue inventory_value_sum",
    "s07_supplier_risk": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate fill_rate stockout_rate lost_sales_share inventory_value_share lost_sales_revenue inventory_value_sum",
    "s08_segment_risk": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score fill_rate stockout_rate lost_sales_share inventory_value_share lost_sales_revenue inventory_value_sum",
    "s09_master_priority_queue": "service_risk_score stockout_risk_score excess_inventory_score supplier_risk_score working_capital_risk_score governance_priority_score lost_sales_revenue inventory_value_sum",
    "s10_management_counts": "top_score",
    "s11_legacy_composite": "stockout_day_rate excess_inventory_rate slow_moving_rate demand_cv lead_time_cv composite_risk",
    "v01_daily_product_warehouse_metrics": "fill_rate days_of_supply inventory_value lost_sales_revenue service_gap_units",
    "v02_supplier_performance_summary": "on_time_delivery_rate average_delay_days lead_time_variability received_vs_ordered_fill_rate supplier_service_risk_proxy",
    "v03_product_inventory_profile": "average_inventory_units average_inventory_value average_days_of_supply stockout_frequency fill_rate_average lost_sales_exposure slow_moving_inventory_proxy excess_inventory_proxy working_capital_risk_proxy",
    "v04_warehouse_service_profile": "fill_rate stockout_rate lost_sales_value average_days_of_supply inventory_value capacity_pressure_proxy warehouse_service_risk_proxy",
    "v05_inventory_risk_base": "avg_days_of_supply avg_inventory_value excess_inventory_day_rate slow_moving_day_rate dos_stretch_ratio inventory_risk_score_base",
    "v06_service_risk_base": "fill_rate stockout_rate stockout_day_rate service_gap_rate lost_sales_revenue service_risk_score_base",
    "vz01_monthly_trend": "lost_sales_revenue fill_rate stockout_rate",
    "vz02_fill_rate_by_category": "fill_rate",
    "vz03_lost_sales_by_region": "lost_sales_revenue",
    "vz04_category_inventory_share": "avg_inventory_value total_inventory_value inventory_share cumulative_share",
    "vz05_category_region_scatter": "avg_inventory_value lost_sales_revenue fill_rate",
    "vz06_sku_ranking": "governance_priority_score",
    "vz07_excess_exposure": "excess_inventory_value_proxy avg_excess_rate excess_exposure_proxy",
    "vz08_top_slow_moving": "slow_moving_value_proxy slow_moving_rate",
    "vz09_supplier_heatmap": "otd_gap avg_delay_norm lt_variability_norm risk_proxy_norm",
    "vz10_days_of_supply_bins": "bin_start p90 p99",
    "vz11_warehouse_quadrant": "fill_rate inventory_value fill_line value_line",
}
