"""Tables that say what was loaded, checked, fitted, tested and sent, and the raw files of a load."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.keyed_table import KeyedTable

#: Tables by name: columns, and the key by which rows replace each other. Names and columns are fixed values.
TABLES: dict[str, tuple[str, list[str]]] = {
    "ingestion_log": ("source_name string, ingestion_timestamp timestamp, vintage_date date, row_count long, status string, error_message string, metadata map<string,string>", ["source_name", "ingestion_timestamp"]),
    "validation_log": ("table_name string, validation_timestamp timestamp, validation_type string, passed boolean, details map<string,string>", ["table_name", "validation_timestamp", "validation_type"]),
    "feature_registry": ("feature_name string, feature_type string, created_at timestamp, updated_at timestamp, description string, source_tables array<string>, transform_logic string, is_active boolean", ["feature_name"]),
    "model_registry": ("model_name string, model_version string, model_type string, trained_at timestamp, mlflow_run_id string, accuracy_metrics map<string,double>, is_active boolean, deployed_at timestamp", ["model_name", "model_version"]),
    "performance_log": ("model_name string, model_version string, evaluation_date date, target_variable string, actual_value double, predicted_value double, prediction_interval_lower double, prediction_interval_upper double, metrics map<string,double>, vintage_date date", ["model_name", "model_version", "evaluation_date", "target_variable"]),
    "backtest_runs": ("run_id string, model_name string, run_timestamp timestamp, start_date date, end_date date, smape double, mae double, rmse double, crps double, coverage_80 double, coherence_error double, passed_gates boolean, metadata map<string,string>", ["run_id"]),
    "submission_log": ("submission_id string, subnet_id string, adapter_version string, submission_timestamp timestamp, event_id string, event_name string, event_date date, forecast_date date, target string, probability_vector map<string,double>, signed_payload string, payload_hash string, submission_status string, validator_response string, transaction_hash string, reward double, latency_ms int, error_message string, metadata map<string,string>", ["submission_id"]),
    "event_catalog": ("subnet_id string, external_event_id string, event_name string, event_type string, event_date date, target string, bin_definitions string, scoring_rule string, is_active boolean, created_at timestamp, updated_at timestamp", ["subnet_id", "external_event_id"]),
    "seasonal_specs": ("series_name string, spec_file_path string, spec_content string, last_updated timestamp, m_stats map<string,double>, is_active boolean", ["series_name"]),
}


def table_of(spark: SparkSession, base: str, name: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, f"{base.rstrip('/')}/{name}", TABLES[name][1], buckets)


def record(spark: SparkSession, base: str, name: str, rows: DataFrame) -> KeyedTable:
    """Upsert rows that have some of a table's columns: the others are null. A column that the table lacks, or a null key, is an error."""
    schema, keys = TABLES[name]
    whole = spark.createDataFrame([], schema)
    if odd := set(rows.columns) - set(whole.columns):
        raise ValueError(f"{name} has no columns {sorted(odd)}")
    typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.schema])
    required = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{name} needs {k}")).cast(whole.schema[k].dataType)).otherwise(F.col(k)).alias(k) for k in keys]
    own = table_of(spark, base, name)
    own.upsert(typed.select(*required, *[c for c in whole.columns if c not in keys]))
    return own


def save_raw(df: DataFrame, base: str, source: str, at: datetime) -> str:
    """Write what was loaded as it is to ``base``/<source>_<time>, compressed Parquet; a load of that second that is there already stays. Returns the folder."""
    path = f"{base.rstrip('/')}/{source}_{at:%Y%m%d_%H%M%S}"
    df.write.mode("ignore").option("compression", "snappy").parquet(path)
    return path
