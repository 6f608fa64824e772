import json
import time

from leadweave.plans.pipeline import prepare
from leadweave.streaming import leads as stream_leads
from leadweave.streaming import progress
from leadweave.streaming.run import drain

SCHEMA = "event_seq bigint, channel bigint, value string"


def messages(spark, path, rows):
    table = spark.createDataFrame([(s, c, json.dumps({"type": t, "stage": g})) for s, c, t, g in rows], SCHEMA)
    table.coalesce(1).write.mode("append").parquet(path)


def keys(df):
    return sorted((r.channel, r.event_seq) for r in df.collect())


def test_state_goes_on_and_ends(spark, tmp_path):
    """What one run has seen holds in the next one, until its time to live is over."""
    def run(name, fn, ttl):
        path, base = str(tmp_path / name / "in"), str(tmp_path / name / "out")

        def more(rows):
            messages(spark, path, rows)
            return keys(drain(fn(progress.parse_progress(progress.read_messages(spark, path)), ttl), base))

        return more

    first = [(1, 7, "progress", "a"), (2, 7, "task_completed", None), (3, 7, "progress", "late"), (1, 8, "progress", "a")]
    later = [(4, 7, "progress", "b"), (2, 8, "progress", "a"), (3, 8, "task_failed", "c")]
    day = progress.FORGET_MS
    more = run("until", progress.until_terminal, day)
    assert more(first) == [(7, 1), (7, 2), (8, 1)]
    assert more(later) == [(7, 1), (7, 2), (8, 1), (8, 2), (8, 3)]
    more = run("stages", progress.stage_changes, day)
    assert more(first) == [(7, 1), (7, 2), (7, 3), (8, 1)]
    assert more(later) == [(7, 1), (7, 2), (7, 3), (7, 4), (8, 1), (8, 3)]
    more = run("latest", progress.latest_changes, day)
    more(first)
    assert more(later + [(1, 7, "progress", "old")]) == [(7, 3), (7, 4), (8, 1), (8, 3)]
    # after its time to live a task that had ended, or its stage, is forgotten
    for name, fn, again in (("until_ttl", progress.until_terminal, [(7, 1), (7, 2), (7, 4), (8, 1), (8, 2)]),
                            ("stages_ttl", progress.stage_changes, [(7, 1), (7, 2), (7, 3), (7, 4), (8, 1), (8, 2)])):
        more = run(name, fn, 1000)
        more(first)
        time.sleep(1.5)
        assert more([(4, 7, "progress", "late"), (2, 8, "progress", "a")]) == again


def test_stages_in_any_order_of_arrival(spark, tmp_path):
    stages = [None, None, "a", "a", "b", None, "b", "b", "a"]
    rows = [(k, 1, "progress", g) for k, g in enumerate(stages)]
    messages(spark, str(tmp_path / "m"), rows[::-1])
    events = progress.parse_progress(progress.read_messages(spark, str(tmp_path / "m")))
    want = [(1, k) for k, g in enumerate(stages) if k == 0 or g != stages[k - 1]]
    assert keys(drain(progress.stage_changes(events))) == want
    batch = progress.parse_progress(spark.read.parquet(str(tmp_path / "m")))
    assert keys(progress.stage_changes_batch(batch)) == want


def raw_leads(spark, n):
    return spark.createDataFrame(
        [(k, f" Shop {k} &amp; Sons, LLC " if k % 9 else None, f"(201) 234-{5000 + k}", f"A{k}@Mail{k % 3}.Example.com" if k % 4 else "bad", f"shop{k}.example.org/?utm_source=x",
          f"{k} Main St", "bbb", f"https://d.example.org/{k}", "2026-01-01") for k in range(n)],
        "lead_id bigint, company_name string, phone string, email string, website string, address string, source string, source_url string, scraped_at string")


def test_leads_stream_equals_batch_and_replays(spark, tmp_path):
    raw = raw_leads(spark, 40)
    tables = {
        "mail_domains": spark.createDataFrame([("mail0.example.com",), ("MAIL1.example.com",)], "domain string"),
        "verdicts": spark.createDataFrame([(f"A{k}@mail{k % 3}.example.com", k % 2 == 0) for k in range(40)], "email string, accepted boolean"),
        "area_codes": spark.createDataFrame([("201",)], "area_code string")}
    path, base = str(tmp_path / "raw"), str(tmp_path / "out")
    raw.repartition(4).write.parquet(path)

    def row_set(df):
        return sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))

    def stream():
        return stream_leads.prepared(stream_leads.read_raw(spark, path, files=1), **tables)

    want = prepare(raw, **tables)
    out = stream_leads.drain_leads(stream(), base)
    assert want.count() == 35 and row_set(out) == row_set(want)
    # a replayed batch, and a run from the start, add nothing; new files do
    stream_leads.save_batches(stream(), f"{base}/rows", f"{base}/other-state")
    assert row_set(stream_leads.drain_leads(stream(), base)) == row_set(want)
    more = raw_leads(spark, 44).filter("lead_id >= 40")
    more.coalesce(1).write.mode("append").parquet(path)
    assert row_set(stream_leads.drain_leads(stream(), base)) == row_set(prepare(raw.union(more), **tables))
    empty = str(tmp_path / "none")
    raw.limit(0).write.parquet(empty)
    assert stream_leads.drain_leads(stream_leads.prepared(stream_leads.read_raw(spark, empty)), str(tmp_path / "none-out")).count() == 0
