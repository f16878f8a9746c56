"""Entity schemas as DDL text, usable in ``spark.read.schema`` and ``createDataFrame``."""

CATALOG = (
    "id STRING, name STRING, description STRING, owner STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, table_ids ARRAY<STRING>"
)
TABLE = (
    "id STRING, name STRING, description STRING, schema_info MAP<STRING,STRING>, "
    "catalog_id STRING, owner STRING, created_at TIMESTAMP, updated_at TIMESTAMP, field_count INT"
)
FIELD = (
    "id STRING, table_id STRING, name STRING, field_type STRING, required BOOLEAN, "
    "description STRING, created_at TIMESTAMP, updated_at TIMESTAMP, created_by STRING"
)
TEMPLATE_FIELD = "STRUCT<field_name:STRING, field_type:STRING, required:BOOLEAN>"
TEMPLATE = (
    f"id STRING, name STRING, description STRING, fields ARRAY<{TEMPLATE_FIELD}>, "
    "catalog_id STRING, created_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
ASSOCIATION = (
    "catalog_id STRING, table_id STRING, template_id STRING, name STRING, "
    "associated_at TIMESTAMP, associated_by STRING"
)
DATASET = (
    "dataset_id STRING, catalog_id STRING, file_name STRING, file_size BIGINT, file_type STRING, "
    "status STRING, uploaded_by STRING, created_at TIMESTAMP, completed_at TIMESTAMP"
)
CONDITION = "STRUCT<field:STRING, operator:STRING, value:STRING, logicalOperator:STRING>"
RULE_DEFINITION = (
    f"type STRING, conditions ARRAY<{CONDITION}>, targetFields ARRAY<STRING>, "
    "expectedBehavior STRING, parameters MAP<STRING,STRING>"
)
RULE = (
    "id STRING, scope STRING, catalog_id STRING, table_id STRING, column_id STRING, "
    "natural_language STRING, status STRING, template_category STRING, author STRING, "
    f"created_at TIMESTAMP, updated_at TIMESTAMP, definition STRUCT<{RULE_DEFINITION}>"
)
RUN_RULE = (
    "id STRING, name STRING, scope STRING, type STRING, targetFields ARRAY<STRING>, "
    f"conditions ARRAY<{CONDITION}>, parameters MAP<STRING,STRING>"
)
RESOLUTION = (
    "rule_pair_key STRING, rule_ids ARRAY<STRING>, priority_rule_id STRING, "
    "overridden_rule_ids ARRAY<STRING>, resolved_by STRING, resolved_at TIMESTAMP"
)
RUN_SUMMARY = (
    "total_records BIGINT, total_evaluations BIGINT, passed BIGINT, failed BIGINT, "
    "errors BIGINT, rules_submitted BIGINT, rules_executed BIGINT, quality_score DOUBLE"
)
VALIDATION_RUN = (
    "id STRING, dataset_id STRING, dataset_path STRING, status STRING, started_at TIMESTAMP, "
    "completed_at TIMESTAMP, triggered_by STRING, rules_count INT, rule_ids ARRAY<STRING>, "
    f"score DOUBLE, error_message STRING, summary STRUCT<{RUN_SUMMARY}>"
)
RECORD_RESULT = (
    "run_id STRING, record_id STRING, rule_id STRING, rule_name STRING, passed BOOLEAN, "
    "message STRING, field_values MAP<STRING,STRING>, evaluated_at TIMESTAMP"
)
CLEANING_SUMMARY = (
    "total_records BIGINT, modified_records BIGINT, unchanged_records BIGINT, "
    "error_records BIGINT, output_records BIGINT, output_path STRING"
)
CLEANING_JOB = (
    "id STRING, dataset_id STRING, dataset_path STRING, issues ARRAY<STRING>, description STRING, "
    "status STRING, created_at TIMESTAMP, executed_at TIMESTAMP, completed_at TIMESTAMP, "
    f"backup_path STRING, error_message STRING, summary STRUCT<{CLEANING_SUMMARY}>"
)
TRAINING_JOB = (
    "id STRING, dataset_id STRING, dataset_path STRING, "
    "hyperparameters STRUCT<learningRate:DOUBLE, epochs:INT, batchSize:INT, encodingDimension:INT>, "
    "status STRING, started_at TIMESTAMP, completed_at TIMESTAMP"
)
MODEL = (
    "kind STRING, feature_names ARRAY<STRING>, mean ARRAY<DOUBLE>, std ARRAY<DOUBLE>, "
    "clip_lo DOUBLE, clip_hi DOUBLE, encoding_dim INT, weights ARRAY<DOUBLE>, threshold DOUBLE, "
    "percentile DOUBLE, training_samples BIGINT, training_loss DOUBLE, validation_loss DOUBLE, "
    "epochs_trained INT"
)
SCORING_SUMMARY = (
    "total_records BIGINT, anomaly_count BIGINT, anomaly_percentage DOUBLE, "
    "severity_counts MAP<STRING,BIGINT>, threshold DOUBLE"
)
SCORING_RUN = (
    "id STRING, model_id STRING, dataset_id STRING, threshold DOUBLE, status STRING, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, "
    f"summary STRUCT<{SCORING_SUMMARY}>"
)
RECORD_SCORE = (
    "scoring_id STRING, record_id STRING, reconstruction_error DOUBLE, severity STRING, "
    "is_anomaly BOOLEAN, field_values MAP<STRING,STRING>, scored_at TIMESTAMP"
)
REPORT_VERSION = (
    "report_id STRING, version INT, title STRING, content STRING, edited_by STRING, edited_at TIMESTAMP"
)
REPORT = (
    "id STRING, title STRING, report_type STRING, dataset_id STRING, content STRING, status STRING, "
    "version INT, created_at TIMESTAMP, updated_at TIMESTAMP, published_at TIMESTAMP"
)
NOTIFICATION = (
    "id STRING, event_type STRING, recipient STRING, subject STRING, status STRING, "
    "sent_at TIMESTAMP, delivered_at TIMESTAMP, retry_count INT, error_message STRING"
)
RECIPIENTS = "event_type STRING, recipients ARRAY<STRING>, updated_at TIMESTAMP, updated_by STRING"
AUDIT = (
    "id STRING, user_id STRING, action_type STRING, resource_type STRING, resource_id STRING, "
    "timestamp TIMESTAMP, details MAP<STRING,STRING>, year_month STRING"
)
