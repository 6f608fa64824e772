"""Table contracts. Every column is nullable: required fields are enforced by
filters (see ``operators.admission``), so a bad row never fails a whole scan."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """``"name type, name type"`` -> StructType (works without a session)."""
    simple = {
        "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
        "double": T.DoubleType(), "boolean": T.BooleanType(),
        "timestamp_ntz": T.TimestampNTZType(),
        "map": T.MapType(T.StringType(), T.StringType()),
        "counts": T.MapType(T.StringType(), T.LongType()),
    }
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, simple[kind]) for name, kind in fields])


RAW_LEAD = _struct(
    "company_name string, phone string, email string, website string, address string, "
    "city string, state string, category string, rating string, review_count int, "
    "source string, source_url string, scraped_at string"
)

COMPANY = _struct(
    "id string, company_name string, company_name_normalized string, phone string, "
    "phone_normalized string, phone_display string, email string, email_validated boolean, "
    "website string, website_alive boolean, address string, address_normalized string, "
    "city string, state string, zip string, category string, rating double, review_count int, "
    "source string, source_url string, scraped_at timestamp_ntz, enriched_at timestamp_ntz, "
    "social_links map, is_duplicate_of string, needs_review boolean, pipeline_id string, "
    "task_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
)

TASK = _struct(
    "id string, source string, query string, location string, limit int, enrich boolean, "
    "mode string, status string, total_scraped bigint, total_cleaned bigint, "
    "total_deduped bigint, total_exported bigint, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, error_message string, created_at timestamp_ntz"
)

STAGE_STATS = _struct(
    "task_id string, step int, stage string, count_in bigint, count_out bigint, count_removed bigint, "
    "count_modified bigint, duration_ms bigint, details counts, error string, "
    "created_at timestamp_ntz"
)

EXPORT_LOG = _struct(
    "id string, task_id string, format string, file_path string, rows_exported bigint, "
    "exported_at timestamp_ntz"
)

PAGE_SNAPSHOT = _struct(
    "source string, slug_query string, slug_location string, page int, url string, "
    "html string, fetched_at timestamp_ntz"
)

SITE_PAGE = _struct("url string, path string, status_head int, status_get int, html string")

PROGRESS_EVENT = _struct(
    "type string, stage string, task_id string, pages_processed int, pages_total int, "
    "items_found int, errors int, total_scraped bigint, total_cleaned bigint, "
    "total_deduped bigint, error string, new_count bigint, total bigint"
)
