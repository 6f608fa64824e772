"""Queries and edits over the company and task tables."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.session import ensure_checkpoint_dir

# Sortable columns, editable fields, public columns.
SORT_FIELDS = ("company_name", "created_at", "source", "city", "state", "rating")
EDITABLE_FIELDS = (
    "company_name", "phone_display", "email", "website", "address", "city", "state", "zip",
    "category", "needs_review",
)
PUBLIC_COLUMNS = [
    "id", "company_name", "phone_display", "email", "email_validated", "website",
    "website_alive", "address", "city", "state", "zip", "category", "rating", "review_count",
    "source", "source_url", "social_links", "needs_review", "created_at",
]
GRID_COLUMNS = [
    "company_name", "phone_display", "email", "website", "city", "state", "category",
    "rating", "source", "needs_review",
]


def search_companies(
    df: DataFrame,
    *,
    task_id: str | None = None,
    source: str | None = None,
    city: str | None = None,
    state: str | None = None,
    category: str | None = None,
    has_email: bool | None = None,
    has_phone: bool | None = None,
    needs_review: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    """Companies that are not duplicates, filtered. All predicates are plain column tests, so
    they reach the Parquet scan. ``%`` and ``_`` in ``search`` act as wildcards."""
    out = df.filter(F.col("is_duplicate_of").isNull())
    equal = {"task_id": task_id, "source": source, "city": city, "state": state, "category": category}
    for name, value in equal.items():
        if value:
            out = out.filter(F.col(name) == value)
    for name, wanted in (("email", has_email), ("phone_normalized", has_phone)):
        if wanted is not None:
            out = out.filter(F.col(name).isNotNull() if wanted else F.col(name).isNull())
    if needs_review is not None:
        out = out.filter(F.col("needs_review") == needs_review)
    if search:
        pattern = f"%{search}%"
        out = out.filter(F.col("company_name").ilike(pattern) | F.col("email").ilike(pattern)
                         | F.col("phone").ilike(pattern))
    return out


def company_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def sort_order(sort_by: str, descending: bool):
    """NULLs rank above every value, as in the table's store."""
    col = F.col(sort_by)
    return col.desc_nulls_first() if descending else col.asc_nulls_last()


def company_page(
    df: DataFrame, sort_by: str = "created_at", sort_order_name: str = "desc",
    page: int = 1, page_size: int = 50,
) -> DataFrame:
    """One page of a filtered table, ``id`` breaking ties."""
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort_by!r}; choose one of {SORT_FIELDS}")
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page starts at 1; page_size is 1 to 200")
    ordered = df.orderBy(sort_order(sort_by, sort_order_name == "desc"), F.col("id").asc())
    return ordered.offset((page - 1) * page_size).limit(page_size)


class CompanyPages:
    """A sorted table by page number, however deep. Sort values and ids are dealt to ranges once
    and counted; a page sorts the ranges it falls into, one or two, and no others."""

    def __init__(self, df: DataFrame, sort_by: str = "created_at", sort_order_name: str = "desc", ranges: int = 64):
        if sort_by not in SORT_FIELDS:
            raise ValueError(f"cannot sort by {sort_by!r}; choose one of {SORT_FIELDS}")
        self.df, self.order = df, [sort_order("_by", sort_order_name == "desc"), F.col("id").asc()]
        keys = df.select(F.col(sort_by).alias("_by"), "id").repartitionByRange(ranges, *self.order)
        path = f"{ensure_checkpoint_dir(df.sparkSession)}/pages-{uuid.uuid4().hex}"
        keys.withColumn("_range", F.spark_partition_id()).write.parquet(path)
        self.keys = df.sparkSession.read.parquet(path)
        self.counts = sorted(tuple(r) for r in self.keys.groupBy("_range").agg(F.count(F.lit(1))).collect())

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def ranges_of(self, first: int, size: int) -> tuple[list[int], int]:
        """Ranges that hold the rows from ``first`` on, and how many rows come before them."""
        found, before, at = [], 0, 0
        for number, n in self.counts:
            if at + n <= first:
                before = at + n
            elif at < first + size:
                found.append(number)
            at += n
        return found, before

    def page(self, page: int, page_size: int = 50) -> DataFrame:
        if page < 1 or not 1 <= page_size <= 200:
            raise ValueError("page starts at 1; page_size is 1 to 200")
        first = (page - 1) * page_size
        found, before = self.ranges_of(first, page_size)
        rows = self.keys.filter(F.col("_range").isin(*found)) if found else self.keys.limit(0)
        chosen = rows.orderBy(*self.order).offset(first - before).limit(page_size)
        # at most a page of ids is broadcast
        met = self.df.join(F.broadcast(chosen.select("id", "_by").distinct()), "id")
        return met.orderBy(*self.order).select(self.df.columns)


def get_company(df: DataFrame, company_id: str) -> DataFrame:
    """The one row with this id; an unknown id is an error, and so is one that several rows bear."""
    row = df.filter(F.col("id") == company_id)
    found = len(row.select("id").take(2))
    if found != 1:
        raise LookupError(f"company not found: {company_id}" if not found else f"several companies with the id {company_id}")
    return row


def public_view(df: DataFrame) -> DataFrame:
    return df.select(PUBLIC_COLUMNS)


def check_edits(edits: DataFrame, companies: DataFrame | None = None) -> None:
    """Fields that may not be edited are an error; so are ids that ``companies`` lacks."""
    bad = edits.filter(~F.col("field").isin(*EDITABLE_FIELDS)).select("field").limit(1).collect()
    if bad:
        raise ValueError(f"field {bad[0][0]!r} is not editable")
    if companies is not None:
        lost = unknown_ids(edits, companies).limit(1).collect()
        if lost:
            raise LookupError(f"company not found: {lost[0][0]}")


def unknown_ids(edits: DataFrame, companies: DataFrame) -> DataFrame:
    return edits.select("id").distinct().join(companies.select("id"), "id", "left_anti")


def apply_edits(companies: DataFrame, edits: DataFrame, edited_at=None) -> DataFrame:
    """Apply ``edits(id, field, value[, edit_no])``, one row per changed field; a NULL value
    clears the field. Of several edits of one field the one with the greatest ``edit_no``
    counts, without numbers the greatest value. Edited rows get a new ``updated_at``."""
    check_edits(edits)
    kinds = {f.name: f.dataType for f in companies.schema}
    fields = [name for name in EDITABLE_FIELDS if name in kinds]
    number = F.col("edit_no") if "edit_no" in edits.columns else F.lit(0)
    # plain aggregates, so that an id with any number of edit rows is folded on the map side
    by_id = edits.groupBy("id").agg(F.lit(True).alias("_edited"), *[
        F.max(F.when(F.col("field") == name, F.struct(number.alias("n"), F.col("value").alias("v")))).alias(f"_edit_{name}")
        for name in fields
    ])
    changed = {
        name: F.when(F.col(f"_edit_{name}").isNotNull(), F.col(f"_edit_{name}.v").cast(kinds[name]))
        .otherwise(F.col(name))
        for name in fields
    }
    if "updated_at" in kinds:
        now = F.current_timestamp().cast("timestamp_ntz") if edited_at is None else edited_at
        changed["updated_at"] = F.when(F.col("_edited"), now).otherwise(F.col("updated_at"))
    return companies.join(by_id, "id", "left").withColumns(changed).select(companies.columns)


def quick_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows whose displayed columns contain every typed word, in any case."""
    shown = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in GRID_COLUMNS if c in df.columns]))
    out = df
    for word in text.lower().split():
        out = out.filter(shown.contains(word))
    return out


def grid_view(
    df: DataFrame, filters: dict[str, str] | None = None, sorts: list[tuple[str, bool]] = ()
) -> DataFrame:
    """Column filters (contains, any case) and multi-column sort of the result grid."""
    out = df
    for name, text in (filters or {}).items():
        if name not in GRID_COLUMNS:
            raise ValueError(f"not a grid column: {name}")
        out = out.filter(F.lower(F.col(name).cast("string")).contains(text.lower()))
    keys = [F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_first() for n, desc in sorts]
    return out.orderBy(*keys, F.col("id")) if keys else out


def company_page_after(
    df: DataFrame, sort_by: str, sort_order_name: str, last: tuple, page_size: int = 50,
) -> DataFrame:
    """The page after the row whose (sort value, id) is ``last``. No earlier page is gathered:
    every partition hands over ``page_size`` rows at most, however deep the page."""
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort_by!r}; choose one of {SORT_FIELDS}")
    if not 1 <= page_size <= 200:
        raise ValueError("page_size is 1 to 200")
    value, last_id = last
    col, down = F.col(sort_by), sort_order_name == "desc"
    same = col.isNull() if value is None else col == F.lit(value)
    if value is None:  # NULLs rank above every value
        beyond = col.isNotNull() if down else F.lit(False)
    else:
        beyond = col < F.lit(value) if down else (col > F.lit(value)) | col.isNull()
    later = df.filter(F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & (F.col("id") > last_id)))
    return later.orderBy(sort_order(sort_by, down), F.col("id").asc()).limit(page_size)


def task_count(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count(F.lit(1)).alias("total"))


def get_task(tasks: DataFrame, task_id: str) -> DataFrame:
    """The one row with this id, its error included; an unknown id is an error."""
    row = tasks.filter(F.col("id") == task_id)
    if row.isEmpty():
        raise LookupError(f"task not found: {task_id}")
    return row


def list_tasks(tasks: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Newest tasks first, one page; ``task_count`` has the total."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page starts at 1; page_size is 1 to 200")
    return tasks.orderBy(F.col("created_at").desc(), F.col("id")).offset((page - 1) * page_size).limit(page_size)


def cancel_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending and running tasks among ``ids(id)`` become cancelled; others stay."""
    marked = ids.select("id").distinct().withColumn("_cancel", F.lit(True))
    return tasks.join(marked, "id", "left").withColumn("status", F.when(
        F.col("_cancel") & F.col("status").isin("pending", "running"), F.lit("cancelled")
    ).otherwise(F.col("status"))).select(tasks.columns)


def reset_mode(
    tasks: DataFrame, companies: DataFrame, mode: str = "demo"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, companies, one-row count): what is left after removing a mode's tasks."""
    doomed = tasks.filter(F.col("mode") == mode).select(F.col("id").alias("task_id"))
    left = tasks.filter((F.col("mode") != mode) | F.col("mode").isNull())
    kept = companies.join(doomed, "task_id", "left_anti").select(companies.columns)
    return left, kept, doomed.agg(F.count(F.lit(1)).alias("deleted_tasks"))
