"""Result types of oracle columns that DuckDB would otherwise return as DECIMAL or HUGEINT."""

CASTS: dict[str, dict[str, str]] = {
    "f16_daily_scan": {"data_quality": "DOUBLE"},
    "f10_snapshot": {"provider_latency_seconds": "DOUBLE"},
    "v01_validate_raw_series": {"quality_score": "DOUBLE"},
    "v01_validate_clean_series": {"quality_score": "DOUBLE"},
    "v05_batch_quality_and_latency": {"valid": "BIGINT"},
    "snk01_import_bars": {"inserted": "BIGINT", "duplicates": "BIGINT"},
    "in02_ingest_metrics": {"new_bars": "BIGINT", "duplicate_bars": "BIGINT", "revised_bars": "BIGINT"},
    "in02_dry_run": {"bars_valid": "BIGINT", "invalid_bars": "BIGINT", "new_bars": "BIGINT"},
    "in03_merge_counts": {"inserted": "BIGINT", "duplicates": "BIGINT", "revisions": "BIGINT"},
    "v04_in05_symbol_quality": {"bars_received": "BIGINT", "duplicates": "BIGINT", "bars_valid": "BIGINT", "timestamp_error": "BIGINT", "nan_ohlcv": "BIGINT", "invalid_numeric": "BIGINT", "non_positive_price": "BIGINT", "negative_volume": "BIGINT", "ohlc_inconsistency": "BIGINT", "invalid": "BIGINT", "large_gaps": "BIGINT", "zero_volume": "BIGINT"},
    "in10_download_report": {"valid_bars": "BIGINT", "invalid_bars": "BIGINT", "duplicates": "BIGINT", "timestamp_error": "BIGINT", "nan_ohlcv": "BIGINT", "invalid_numeric": "BIGINT", "non_positive_price": "BIGINT", "negative_volume": "BIGINT", "ohlc_inconsistency": "BIGINT"},
    "a02_universe_coverage": {"provider_available": "BIGINT", "fresh": "BIGINT", "eligible": "BIGINT", "stale": "BIGINT", "provider_unavailable": "BIGINT", "limited_history": "BIGINT"},
    "r02_trade_plan": {"risk_reward": "DOUBLE"},
    "r04_research_plan": {"risk_reward": "DOUBLE"},
    "r05_candidate_plans": {"risk_reward": "DOUBLE"},
    "a18_dashboard_performance": {"open_positions": "BIGINT"},
    "a04_daily_summary": {"very_strong": "BIGINT", "strong": "BIGINT", "candidate": "BIGINT", "completed": "BIGINT", "pending": "BIGINT", "partial": "BIGINT", "no_entry": "BIGINT", "stopped": "BIGINT"},
    "a05_bucket_analytics": {"mature_signals": "BIGINT"},
    "a05_rvol_analytics": {"mature_signals": "BIGINT"},
    "a05_momentum_analytics": {"mature_signals": "BIGINT"},
    "a08_shadow_status": {"labeled": "BIGINT"},
    "a09_lifecycle_counts": {"fully_labeled": "BIGINT", "pending": "BIGINT"},
    "m01_feature_vector": {"relative_strength": "DOUBLE", "data_quality": "DOUBLE"},
    "m11_probability_quality": {"sample": "BIGINT"},
    "sc17_sc18_json": {"missing": "DOUBLE"},
}


def typed(name: str, text: str) -> str:
    """The oracle with whole numbers as BIGINT and other numbers as DOUBLE."""
    casts = CASTS.get(name)
    if not casts:
        return text
    listed = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c, kind in casts.items())
    return f"SELECT * REPLACE ({listed}) FROM ({text}) q"
