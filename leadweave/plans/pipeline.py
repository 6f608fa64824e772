"""The stage chain: admit -> clean -> validate -> deduplicate -> (enrich), with counters."""

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave import schemas
from leadweave.operators.admission import admit, with_pipeline_id
from leadweave.operators.cleaning import clean_strings
from leadweave.operators.enrichment import enrich, enrich_counters
from leadweave.operators.exact_dedup import dedup_exact, duplicate_map, last_survivors
from leadweave.operators.fuzzy_dedup import (
    AUTO_MERGE, REVIEW, dedup_fuzzy, fuzzy_counters, record_owners, resolve_leaders)
from leadweave.operators.validation import validate_fields, validator_counters
from leadweave.session import cut_lineage, drop_folder, ensure_checkpoint_dir

_IDENTITY = ("pipeline_id",)


@dataclass
class Stage:
    """A named ``DataFrame -> DataFrame`` step. ``counters`` are aggregates over its output,
    measured while the output is written; they may refer to ``_before``, a struct of the input
    columns in ``remembers``. ``late_counters`` is called with the input count after the stage.
    ``by_row``: each row is judged by itself, so that the stage may be written with the next."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    counters: list[Column] = field(default_factory=list)
    late_counters: Callable[[int], dict] | None = None
    remembers: tuple[str, ...] = ()
    by_row: bool = False


def clean_stage() -> Stage:
    return Stage("html_cleaner", lambda df: clean_strings(df, skip=_IDENTITY), by_row=True)


def validate_stage(**tables: DataFrame) -> Stage:
    return Stage("field_validator", lambda df: validate_fields(df, **tables), validator_counters(),
                 remembers=("email", "phone", "website"), by_row=True)


def dedup_stage(
    auto: int = AUTO_MERGE,
    review: int = REVIEW,
    scorer: str = "token_set_ratio",
    generic_emails: list[str] | None = None,
    **batching: int,
) -> Stage:
    done = {}

    def apply(df: DataFrame) -> DataFrame:
        watch = Observation("exact passes")
        counted = exact_passes(df, generic_emails).observe(
            watch,
            F.coalesce(F.sum("_email_absorbed"), F.lit(0)).alias("exact_email_matches"),
            F.count(F.lit(1)).alias("left"),
        )
        exact = cut_lineage(counted)
        survivors, leaders = dedup_fuzzy(exact, auto, review, scorer, size_col="_fuzzy", **batching)
        done.update(exact=watch.get, leaders=leaders)
        return survivors

    def late(count_in: int) -> dict:
        exact, fuzzy = done["exact"], fuzzy_counters(done["leaders"], auto).first().asDict()
        by_email = exact["exact_email_matches"]
        counts = {
            # what left in the exact passes, less what the e-mail pass took
            "exact_phone_matches": count_in - exact["left"] - by_email,
            "exact_email_matches": by_email,
            **fuzzy,
        }
        return {**counts, "total_duplicates": sum(counts.values())}

    return Stage("deduplicator", apply, [], late)


def exact_passes(df: DataFrame, generic_emails: list[str] | None = None) -> DataFrame:
    """Phone pass, then e-mail pass over its merged survivors. The phone pass folds all columns, so
    that rows with and without an e-mail come from one and the same phone aggregate, not from
    one for each."""
    by_phone = dedup_exact(df, "phone_normalized", "_phone_absorbed", whole=True)
    return dedup_exact(by_phone, "email", "_email_absorbed", generic_emails)


def chain_duplicates(
    df: DataFrame,
    auto: int = AUTO_MERGE,
    review: int = REVIEW,
    scorer: str = "token_set_ratio",
    generic_emails: list[str] | None = None,
    **batching: int,
) -> DataFrame:
    """(removed_id, survivor_id) over the phone, e-mail and name passes: every removed lead with
    the lead that stands for it at the end."""
    by_phone = cut_lineage(dedup_exact(df, "phone_normalized", "_phone_absorbed"))
    by_both = cut_lineage(dedup_exact(by_phone, "email", "_email_absorbed", generic_emails))
    found = resolve_leaders(by_both, auto, review, scorer, **batching)
    ids = by_both.select("ord", "pipeline_id")
    by_name = record_owners(by_both, found, auto, scorer).join(ids, "ord").join(
        ids.select(F.col("ord").alias("owner_ord"), F.col("pipeline_id").alias("survivor_id")), "owner_ord").select(
        F.col("pipeline_id").alias("removed_id"), "survivor_id")
    return last_survivors(
        duplicate_map(df, "phone_normalized"), duplicate_map(by_phone.drop("_phone_absorbed"), "email", generic_emails), by_name)


def enrich_stage(site_pages: DataFrame) -> Stage:
    return Stage("enricher", lambda df: enrich(df, site_pages), enrich_counters(), remembers=("email",))


def prepare(raw: DataFrame, id_col: str = "lead_id", **tables: DataFrame) -> DataFrame:
    """Raw leads to validated leads, ready for deduplication, in one pass without a shuffle."""
    return (
        admit(raw)
        .withColumns({"ord": F.col(id_col), "pipeline_id": F.col(id_col).cast("string")})
        .drop(id_col)
        .transform(clean_strings, _IDENTITY)
        .transform(validate_fields, **tables)
    )


def stage_stats(before: DataFrame, after: DataFrame, id_col: str = "pipeline_id") -> DataFrame:
    """count_in, count_out, count_removed, count_modified of any two states of a table."""
    added = [c for c in after.columns if c not in before.columns]
    kept = [c for c in before.columns if c in after.columns and c != id_col]
    old = before.select(id_col, F.struct(*kept).alias("_old"))
    new = after.select(id_col, F.struct(*kept).alias("_new"), F.struct(
        F.lit(1).alias("_"), *added).alias("_added"))
    same = F.col("_new").eqNullSafe(F.col("_old"))
    for c in added:
        same = same & F.col(f"_added.`{c}`").isNull()
    return old.join(new, id_col, "full").agg(
        F.count("_old").alias("count_in"),
        F.count("_new").alias("count_out"),
        F.count_if(F.col("_new").isNotNull() & ~same).alias("count_modified"),
    ).withColumn("count_removed", F.col("count_in") - F.col("count_out"))


@dataclass
class PipelineRun:
    leads: DataFrame
    stats: list[dict]

    def stats_frame(self, spark: SparkSession, task_id: str) -> DataFrame:
        rows = [{**s, "task_id": task_id} for s in self.stats]
        names = schemas.STAGE_STATS.fieldNames()
        return spark.createDataFrame(
            [tuple(r.get(n) for n in names) for r in rows], schemas.STAGE_STATS)


def _mark(df: DataFrame, name: str) -> Column:
    """A value as eight bytes; maps have no hash of their own."""
    kind = df.schema[name].dataType
    return F.xxhash64(F.to_json(F.col(name)) if isinstance(kind, T.MapType) else F.col(f"`{name}`"))


def _counted(df: DataFrame, stage: Stage) -> tuple[DataFrame, Observation]:
    """The output of a stage, counted while it is written. What a row was before the stage travels
    as a hash per column, not as a second copy."""
    given = df.columns
    marked = df.withColumn("_marks", F.array(*[_mark(df, c) for c in given]))
    if stage.remembers:
        marked = marked.withColumn("_before", F.struct(*stage.remembers))
    out = stage.apply(marked)
    kept = [c for c in out.columns if not c.startswith("_")]
    same = F.lit(True)
    for c in kept:
        same = same & (_mark(out, c) == F.col("_marks")[given.index(c)] if c in given else F.col(c).isNull())
    watch = Observation(stage.name)
    measured = out.observe(
        watch,
        F.count(F.lit(1)).alias("count_out"),
        F.count_if(~same).alias("count_modified"),
        *stage.counters,
    )
    return measured.select(kept), watch


class _Cuts:
    """Where a run's data stand: one Parquet folder, replaced by the next that is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
        self.last = self.next = None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.next = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(self.next)
        return self.spark.read.schema(df.schema).parquet(self.next)

    def settle(self, good: bool) -> None:
        """Keep what was written last and drop what stood before, or the other way round."""
        gone = self.last if good else self.next
        if good:
            self.last = self.next
        self.next = None
        if gone:
            drop_folder(self.spark, gone)


def _fused(stages: list[Stage]) -> list[list[Stage]]:
    """Stages that may be written together: row stages that follow each other."""
    groups: list[list[Stage]] = []
    for stage in stages:
        if groups and stage.by_row and groups[-1][-1].by_row:
            groups[-1].append(stage)
        else:
            groups.append([stage])
    return groups


def run_pipeline(
    df: DataFrame, stages: list[Stage], skip: tuple[str, ...] = ()
) -> PipelineRun:
    """Run the stages in order over admitted leads carrying ``ord`` and ``pipeline_id``.

    A stage's output is written to the checkpoint folder as a table and counted while it is
    written, so a lost executor costs one stage at most and no stage is computed twice; row stages
    that follow each other are written once, each with counts of its own. A cut goes once the
    next one stands. A failing stage reports its error, leaves the data as it was and ends the
    run.
    """
    stats: list[dict] = []
    cuts = _Cuts(df.sparkSession)
    count_in = None
    for group in _fused([s for s in stages if s.name not in skip]):
        if count_in is None:
            count_in = df.count()
        df, count_in, failed = _run_group(df, group, count_in, stats, cuts)
        if failed:
            break
    return PipelineRun(df, stats)


def _run_group(df: DataFrame, group: list[Stage], count_in: int, stats: list[dict], cuts: _Cuts) -> tuple[DataFrame, int, bool]:
    started = time.time()
    if len(group) > 1:
        try:
            out, watches = df, []
            for stage in group:
                out, watch = _counted(out, stage)
                watches.append(watch)
            out = cuts.write(out, "-".join(s.name for s in group))
            counted = [dict(w.get) for w in watches]
        except Exception:  # noqa: BLE001 - written one by one, the stage that fails is found
            cuts.settle(False)
            for stage in group:
                df, count_in, failed = _run_group(df, [stage], count_in, stats, cuts)
                if failed:
                    return df, count_in, True
            return df, count_in, False
        for stage, counts in zip(group, counted, strict=True):
            count_in = _filled(_stat(stats, stage, count_in), counts, count_in, started)
        cuts.settle(True)
        return out, count_in, False
    stage = group[0]
    row = _stat(stats, stage, count_in)
    try:
        out, watch = _counted(df, stage)
        out = cuts.write(out, stage.name)
        counts = dict(watch.get)
        if stage.late_counters:
            counts.update(stage.late_counters(count_in))
        # only a stage that succeeded in every part changes the row and the data
        count_in = _filled(row, counts, count_in, started)
        cuts.settle(True)
        return out, count_in, False
    except Exception as problem:  # noqa: BLE001 - any failure of a stage is reported, not raised
        cuts.settle(False)
        row.update(error=str(problem), duration_ms=int((time.time() - started) * 1000))
        return df, count_in, True


def _stat(stats: list[dict], stage: Stage, count_in: int) -> dict:
    row = {"step": len(stats) + 1, "stage": stage.name,
           "created_at": datetime.now(timezone.utc).replace(tzinfo=None), "count_in": count_in, "count_out": count_in,
           "count_removed": 0, "count_modified": 0, "details": {}, "error": None}
    stats.append(row)
    return row


def _filled(row: dict, counts: dict, count_in: int, started: float) -> int:
    count_out, modified = counts.pop("count_out"), counts.pop("count_modified")
    row.update(count_out=count_out, count_modified=modified, count_removed=count_in - count_out, details=counts,
               duration_ms=int((time.time() - started) * 1000))
    return count_out


def process_batch(
    raw: DataFrame, key_cols: list[str], ord_col: str, site_pages: DataFrame | None = None,
    skip: tuple[str, ...] = (), tables: dict[str, DataFrame] | None = None, **dedup_options,
) -> PipelineRun:
    """The standard chain over a raw lead table. ``tables`` go to the validator: area_codes,
    mail_domains, verdicts."""
    leads = admit(raw).transform(with_pipeline_id, key_cols).withColumn("ord", F.col(ord_col).cast("bigint"))
    stages = [clean_stage(), validate_stage(**(tables or {})), dedup_stage(**dedup_options)]
    if site_pages is not None:
        stages.append(enrich_stage(site_pages))
    return run_pipeline(leads, stages, skip)


def task_totals(stats: DataFrame) -> DataFrame:
    """Per task: scraped = input of the first stage, cleaned = validator output, deduped =
    deduplicator output; a stage that did not run leaves its total at the scraped count."""
    first_in = F.min_by("count_in", "step")
    def out_of(word):
        return F.max(F.when(F.lower("stage").contains(word), F.col("count_out")))
    return stats.groupBy("task_id").agg(
        first_in.alias("total_scraped"),
        F.coalesce(out_of("validator"), first_in).alias("total_cleaned"),
        F.coalesce(out_of("dedup"), first_in).alias("total_deduped"),
    )


def stage_history(stats: DataFrame, task_id: str) -> DataFrame:
    return stats.filter(F.col("task_id") == task_id).orderBy("created_at", "step")
