"""Purges with recompute, against plain Python, and what they leave untouched."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import retention

NOW = dt.datetime(2026, 1, 31, 12)
FIELDS = ("display_name", "phone", "website", "domain", "website_kind", "address_line1", "city")
KINDS = ("own_site", "builder_subdomain", "social_profile", "none")


def values_of(rng, businesses):
    rows = []
    for b in businesses:
        for r in range(rng.randint(1, 5)):
            said = {f: rng.choice([None, f"{f}{rng.randrange(3)}"]) for f in FIELDS} | {"website_kind": rng.choice([None, *KINDS])}
            source, at = rng.choice(["google_places", "demo_fixture", "zeta"]), dt.datetime(2025, 1, 1 + rng.randrange(5))
            rows += [(b, 10 * b + r, f, v, source, at, rng.choice([None, NOW - dt.timedelta(days=1), NOW + dt.timedelta(days=rng.randint(0, 9))]), None) for f, v in said.items()]
    return rows


def shown_by_hand(rows):
    """What businesses show, record by record."""
    out = {}
    for b in {r[0] for r in rows}:
        live = [r for r in rows if r[0] == b and r[7] is None]
        if not live:
            continue
        order = lambda r: ({"google_places": 0, "demo_fixture": 1}.get(r[4], 2), -r[5].timestamp(), -r[1])
        best = dict.fromkeys(FIELDS)
        for f in ("display_name", "phone"):
            known = [r for r in live if r[2] == f and r[3] is not None]
            best[f] = min(known, key=order)[3] if known else None
        by = {}
        for r in live:
            by.setdefault(r[1], {})[r[2]] = r
        of = lambda own, f: own[f][3] if f in own else None
        for group, telling, rank in (
            (("website", "domain", "website_kind"), ("website", "domain"), lambda own: KINDS.index(of(own, "website_kind") or "none")),
            (("address_line1", "city"), ("address_line1", "city"), lambda own: int(of(own, "address_line1") is None)),
        ):
            able = [own for own in by.values() if any(of(own, f) is not None for f in telling)]
            won = min(able, key=lambda own: (rank(own), min(order(own[f]) for f in group if f in own)), default={})
            best |= {f: of(won, f) for f in group}
        until = [r[6] for r in live if r[6] is not None]
        out[b] = tuple(best[f] for f in FIELDS) + (min(until) if until else None,)
    return out


@pytest.fixture
def stored(spark, tmp_path):
    rng = random.Random(4)
    rows = values_of(rng, range(40)) + [r[:6] + (None, None) for r in values_of(rng, range(40, 80))]
    values = retention.Buckets(spark, f"{tmp_path}/values", "business_id", 16).create(spark.createDataFrame(rows, retention.VALUE))
    shown = retention.shown(values.read(), FIELDS)
    ids = spark.range(80).withColumnRenamed("id", "business_id")
    businesses = retention.Buckets(spark, f"{tmp_path}/businesses", "business_id", 16).create(ids.join(shown, "business_id", "left").withColumn("status", F.lit("kept")))
    return rows, values, businesses


def test_shown_by_hand(stored):
    rows, values, _ = stored
    got = {r.business_id: tuple(r)[1:] for r in retention.shown(values.read(), FIELDS).collect()}
    assert got == shown_by_hand(rows)


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.path) for f in names if f.startswith("part-")}


def test_purge_recomputes_what_it_touched_and_writes_no_other_bucket(stored):
    rows, values, businesses = stored
    due = {r[0] for r in rows if r[6] and r[6] < NOW}
    before = [files(t) for t in (values, businesses)]
    told = retention.purge_values(values, businesses, F.lit(NOW), FIELDS)
    assert told["businesses"] == len(due) and told["values"] == sum(1 for r in rows if r[6] and r[6] < NOW)
    want_rows = [r[:3] + (None,) + r[4:7] + (NOW,) if r[6] and r[6] < NOW else r for r in rows]
    key = lambda r: tuple(map(str, r))
    names = [c.split(" ")[0] for c in retention.VALUE.split(", ")]
    assert sorted(map(tuple, values.read().select(*names).collect()), key=key) == sorted(want_rows, key=key)
    want = shown_by_hand(want_rows)
    for r in businesses.read().select("business_id", *FIELDS, "content_expires_at", "status").collect():
        mine = list(want.get(r.business_id, (None,) * 8))
        if r.business_id in due:
            mine[0] = mine[0] or f"[expired] {r.business_id}"
        assert (list(r)[1:-1], r.status) == (mine, "kept")
    buckets = {r.bucket for r in values._with_bucket(values.spark.createDataFrame([(b,) for b in due], "business_id long")).select("bucket").collect()}
    for table, old in zip((values, businesses), before):
        now = files(table)
        untouched = {f for f in old if int(f.split("bucket=")[1].split("/")[0]) not in buckets}
        assert untouched and all(now.get(f) == old[f] for f in untouched)
        assert not any(f in now for f in set(old) - untouched)
    assert retention.purge_values(values, businesses, F.lit(NOW), FIELDS) == {"values": 0, "businesses": 0, "buckets": 0}


def test_json_keys_go_in_place(spark, tmp_path):
    text = '{"business_summary": "we \\"fix\\" it, \\"business_summary\\": \\"no\\"", "n": {"business_summary": 12.5e3, "other": "business_summary"}, "list": [1]}'
    rows = [(1, text, "raw", NOW - dt.timedelta(days=1), None), (2, text, "raw", NOW, None), (3, None, None, NOW - dt.timedelta(days=1), None), (4, "{}", "raw", None, None)]
    table = retention.Buckets(spark, f"{tmp_path}/answers", "id", 4).create(spark.createDataFrame(rows, "id long, output string, raw_output string, content_expires_at timestamp, purged_at timestamp"))
    for n in (2, 0):
        assert retention.purge_rows(table, F.lit(NOW), ["raw_output"], {"output": ["business_summary"]}) == n
        got = {r.id: r for r in table.read().collect()}
        assert got[1].output == '{"business_summary": null, "n": {"business_summary": null, "other": "business_summary"}, "list": [1]}' and got[1].raw_output is None and got[1].purged_at == NOW
        assert got[2].output == text and got[2].purged_at is None and got[3].output is None and got[4].raw_output == "raw"


def test_hot_business_and_empty_table(spark, tmp_path):
    rows = [(1, r, "phone", str(r), "zeta", NOW, NOW - dt.timedelta(days=1) if r % 2 else None, None) for r in range(500)]
    values = retention.Buckets(spark, f"{tmp_path}/v", "business_id", 4).create(spark.createDataFrame(rows, retention.VALUE))
    businesses = retention.Buckets(spark, f"{tmp_path}/b", "business_id", 4).create(spark.createDataFrame([(1, "499", None)], "business_id long, phone string, content_expires_at timestamp"))
    assert retention.purge_values(values, businesses, F.lit(NOW), ("phone",)) == {"values": 250, "businesses": 1, "buckets": 2}
    assert businesses.read().head().phone == "498"
    assert retention.shown(values.read().limit(0), ("phone",)).collect() == []
