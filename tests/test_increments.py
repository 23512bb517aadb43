from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from reading import read

from lodestream.operators.increments import first_rows, p1_found
from lodestream.operators.ledger import StaleLease, WorkLedger
from lodestream.session import fresh_dir, table


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_uncovered_records_by_hand(spark, sf):
    rows = {t: table(spark, sf, t).collect() for t in ("azure_updates", "techcommunity_posts", "videos", "crawl_checkpoints", "video_checkpoints", "source_profiles")}
    prof = {(p.tab, p.scope): (p.tz_name, p.date_order) for p in rows["source_profiles"]}
    last = {}
    for c in rows["crawl_checkpoints"]:
        if c.run_status == "succeeded" and (c.crawler not in last or c.last_run > last[c.crawler].last_run):
            last[c.crawler] = c
    want = set()
    for tab, key, body, crawler in (("azure_updates", "update_id", "summary", "azure-updates"), ("techcommunity_posts", "post_id", "body_text", "techcommunity")):
        seen, state = set(), last[crawler]
        for r in sorted(rows[tab], key=lambda r: r[key]):
            same = (r.url, r.title, r[body])
            if same in seen:
                continue
            seen.add(same)
            scope = r.blog_section if tab == "techcommunity_posts" else None
            mark = (state.last_seen_per_section or {}).get(scope) if scope else state.last_seen_published_at
            at, upto = read(r.published_at, *prof[tab, scope]), read(mark, None, None)
            if at is not None and upto is not None and at > upto or r.crawled_at and r.crawled_at > state.last_run or scope and scope not in state.last_seen_per_section:
                want.add((tab, r[key]))
    listed = {v for c in rows["video_checkpoints"] if c.run_status == "succeeded" for v in c.processed_video_ids or []}
    for r in sorted(rows["videos"], key=lambda r: r.video_row):
        if r.video_id not in listed:
            listed.add(r.video_id)
            want.add(("videos", r.video_row))
    got = p1_found(spark, sf).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_first_rows_null_blank_ties_and_empty(spark):
    df = spark.createDataFrame([(3, None, "x"), (1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "z", "z"), (9, "a" * 100000, None)], "id long, u string, t string")
    assert sorted(r[0] for r in first_rows(df, "id", ["u", "t"], []).collect()) == [1, 2, 9]
    assert first_rows(df.limit(0), "id", ["u", "t"], []).count() == 0


def test_ledger_runs_each_item_once_and_survives_failures(spark):
    clock = Clock()
    ledger = WorkLedger(spark, fresh_dir(spark, "led"), units=5, lease_seconds=10, clock=clock)
    items = spark.range(40).withColumn("tab", F.lit("t"))
    ledger.enqueue(items, ["tab", "id"], "g1")
    ledger.enqueue(items, ["tab", "id"], "g1")  # repeated call
    slow = ledger.lease("slow", 2)
    assert set(ledger.states().values()) == {"leased", "pending"}
    with pytest.raises(ZeroDivisionError):
        ledger.run(slow, lambda d: 1 // 0)
    clock.now = 11.0
    assert set(ledger.states().values()) == {"pending"}
    path = f"{ledger.root}/out/token-{slow.token:012d}"
    while lease := WorkLedger(spark, ledger.root, units=5, lease_seconds=10, clock=clock).lease("quick", 3):
        ledger.run(lease, lambda d: d.select("id"))
    with pytest.raises(StaleLease):
        ledger.complete(slow, path)
    assert sorted(r[0] for r in ledger.results().collect()) == list(range(40))
    assert ledger.lease("more") is None
    ledger.enqueue(spark.range(40, 50).withColumn("tab", F.lit("t")), ["tab", "id"], "g2")
    lease = ledger.lease("next")
    ledger.run(lease, lambda d: d.select("id"))
    ledger.complete(lease, "ignored")  # a retried commit of the same token changes nothing
    assert sorted(r[0] for r in ledger.results().collect()) == list(range(50))


def test_ledger_empty(spark):
    ledger = WorkLedger(spark, fresh_dir(spark, "led"))
    ledger.enqueue(spark.range(0).withColumn("tab", F.lit("t")), ["tab", "id"], "g")
    assert ledger.lease("w") is None and ledger.results() is None
    assert datetime.now(UTC)


def test_a_renewed_lease_is_kept(spark):
    now = [0.0]
    ledger = WorkLedger(spark, fresh_dir(spark, "led"), units=2, lease_seconds=10, clock=lambda: now[0])
    ledger.enqueue(spark.range(20), ["id"], "g")
    lease = ledger.lease("slow")
    now[0] = 8
    lease = ledger.renew(lease)
    now[0] = 15
    assert ledger.lease("other") is None and lease.until == 18
    now[0] = 19
    taken = ledger.lease("other")
    assert taken.units == lease.units
    with pytest.raises(StaleLease):
        ledger.renew(lease)
