"""Resolution, leads, pages, feeds, reports and streams on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tamarack.functions import geo, pii, signatures, web
from tamarack.functions import records as records_of
from tamarack.operators import leads, lifecycle, pages, relational, reports, resolution
from tamarack.sources import csv_sink, destinations, feeds
from tamarack.streaming import limits

NOW = dt.datetime(2026, 1, 31, 12)


def records(spark, rows):
    names = ("record_id", "seq", "domain", "phone", "name", "name_key", "postal", "street", "lat", "lng")
    return spark.createDataFrame([tuple(r.get(n, r["record_id"] if n == "seq" else None) for n in names) for r in rows], resolution.RECORD)


def test_resolution_replays_in_order(spark):
    rows = [
        {"record_id": 1, "domain": "a.com", "phone": "+15125550001", "name": "abc plumbing", "postal": "78701", "street": "1 main street", "lat": 30.0, "lng": -97.0},
        {"record_id": 2, "domain": "a.com", "phone": "+15125550001", "name": "abc plumbing", "postal": "78701", "street": "1 main street", "lat": 30.0, "lng": -97.0},
        {"record_id": 3, "domain": "a.com", "name": "other shop"},
        {"record_id": 4, "domain": "b.com", "phone": "+15125550001", "name": "abc plumbing"},
        {"record_id": 5, "name": "abc plumbing", "name_key": "ABK", "postal": "99999"},
        {"record_id": 6, "domain": "x.com", "phone": "+15125550009", "name": "q"},
    ]
    got = {r.record_id: (r.business_id, r.decision) for r in resolution.resolve(spark, records(spark, rows)).collect()}
    assert got[1] == (1, "new") and got[2] == (1, "auto_merge")
    assert got[3] == (None, "review")
    assert got[4] == (None, "review") or got[4] == (4, "new")
    assert got[5] == (5, "new") and got[6] == (6, "new")


def one_by_one(df):
    """The sequential replay of all records in one group."""
    frame = df.withColumns({c: F.col(c) if c in df.columns else F.lit(0).cast(k) for c, k in resolution.BESIDES.items()}).toPandas()
    done = resolution._replay(frame)
    decided = done[done["kind"] == "decision"]
    states = done[done["kind"] == "state"]
    whole = lambda x: None if x is None or x != x or str(x) == "<NA>" else int(x)
    shown = {whole(r.business_id): tuple(None if v != v or v is None else v for v in (getattr(r, c) for c in resolution._FIELDS)) for r in states.itertuples()}
    return {(whole(r.record_id), whole(r.business_id), r.decision) for r in decided.itertuples()}, shown


def in_spark(spark, df, **how):
    rows = resolution.replayed(spark, df, **how).collect()
    return {(r.record_id, r.business_id, r.decision) for r in rows if r.kind == "decision"}, {r.business_id: tuple(getattr(r, c) for c in resolution._FIELDS) for r in rows if r.kind == "state"}


def test_resolution_of_a_long_chain(spark):
    rows = [{"record_id": i, "domain": f"d{i // 2}.com", "phone": f"+1512555{(i + 1) // 2:04}", "name": f"shop {i // 2}"} for i in range(300)]
    df = records(spark, rows)
    assert in_spark(spark, df) == one_by_one(df)


def listings(rng, n, hub):
    """Records that share keys by chance; of a hub, a third of all hang together."""
    one = lambda i: {
        "record_id": 1000 + i, "domain": rng.choice([None, f"d{rng.randrange(n // 3)}.com"]), "phone": rng.choice([None, f"+1{rng.randrange(n // 2)}"]), "name": rng.choice(["abc plumbing", "abc plumbing co", "city dental", "joe diner"]),
        "name_key": rng.choice([None, "ABK", "STN", "JTN"]), "postal": rng.choice([None, *[str(p) for p in range(n // 8)]]), "street": rng.choice([None, f"{rng.randrange(4)} main street"]),
    }
    rows = [one(i) for i in range(n)]
    for i in range(1, n):
        if rng.random() < 0.5:
            rows[i] = rows[rng.randrange(i)] | {"record_id": 1000 + i} | {rng.choice(["domain", "phone", "street", "name_key", "seq"]): None}
    for i in rng.sample(range(n), n // 3 if hub else 0):
        k = rng.randrange(8)
        rows[i] |= {"phone": rng.choice([None, f"+9{k // 2}"]), "domain": rng.choice([None, f"h{k}.com", f"h{k}.com"]), "name": rng.choice(["abc plumbing", "abc plumbing co"]), "name_key": rng.choice(["ABK", "STN"]), "postal": rng.choice([None, "1", "2"]), "street": f"{k} main street"}
    return rows


@pytest.mark.parametrize(("seed", "hub", "how"), [(1, False, {}), (2, True, {"whole": 10, "window": 40}), (3, True, {"whole": 0, "window": 60})])
def test_resolution_in_windows_as_one_by_one(spark, seed, hub, how):
    import random

    rng = random.Random(seed)
    rows = listings(rng, 150, hub)
    order = rng.sample(range(5000), len(rows))
    base = records(spark, [r | {"seq": q} for r, q in zip(rows, order)])
    df = base.withColumns({"source_rank": (F.col("record_id") % 3).cast("int"), "observed_at": (F.col("record_id") * 7 % 11).cast("double")})
    got, want = in_spark(spark, df, **how), one_by_one(df)
    assert got == want and len({d for _, _, d in got[0]}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_replay_decides_as_if_all_pairs_were_scored(seed, monkeypatch):
    import random

    import pandas as pd

    rng = random.Random(seed)
    names = ("record_id", "seq", "domain", "phone", "name", "name_key", "postal", "street", "lat", "lng")
    place = lambda: rng.choice([(None, None), (30 + rng.randrange(9) * 0.0007, -97 + rng.randrange(9) * 0.0007)])
    rows = [dict.fromkeys(names) | r | dict(zip(("lat", "lng"), place())) | {"seq": i} for i, r in enumerate(listings(rng, 400, True))]
    frame = pd.DataFrame(rows)[list(names)].assign(source_rank=0, observed_at=[float(rng.randrange(5)) for _ in rows])
    frame = frame.astype({c: "object" for c in ("domain", "phone", "name_key", "postal", "street")}).where(lambda x: x.notna(), None)

    def every_pair(known, r):
        rank = lambda b: min((k for k, key in resolution._keys(r) if key in {own for _, own in resolution._keys(b, own=True)}), default=9)
        met = sorted((rank(b), b["created"], at) for at, b in enumerate(known.made))
        met = [at for k, _, at in met if k < 3 or k == 3 and resolution.text.token_set(r["name"], known.made[at]["name"]) >= resolution.BLOCK_NAME][: resolution.CANDIDATES]
        assert known.near(r) == met
        differ = lambda b, c: r[c] and b[c] and r[c] != b[c]
        ranked = sorted(((resolution._pair(r, b), at) for at in met if not (differ(b := known.made[at], "domain") and differ(b, "phone"))), key=lambda x: -x[0][0])
        if ranked and ranked[0][0][0] >= 0.85 and ranked[0][0][1]:
            return "auto_merge", ranked[0][1]
        return ("review" if any(p[2] for p, _ in ranked) else "new"), None

    told, decide = [], resolution._Businesses.decide

    def both(known, r):
        told.append((decide(known, r), every_pair(known, r)))
        return told[-1][0]

    monkeypatch.setattr(resolution._Businesses, "decide", both)
    resolution._replay(frame)
    assert len(told) == 400 and all(a == b for a, b in told) and len({a[0] for a, _ in told}) == 3


def test_replay_compares_few_names(monkeypatch):
    import pandas as pd

    n, compared, common = 2000, [], resolution.text._common
    monkeypatch.setattr(resolution.text, "_common", lambda a, b: compared.append(1) or common(a, b))
    one = lambda i: {"record_id": i, "seq": i, "domain": None, "phone": f"+1{i % 10}", "name": f"few names {i}", "name_key": "FN", "postal": str(i % 40), "street": f"{i} main street", "lat": None, "lng": None, "source_rank": 0, "observed_at": 0.0}
    done = resolution._replay(pd.DataFrame([one(i) for i in range(n)]))
    # the same phone is to be reviewed whatever the names are
    assert (done[done["kind"] == "decision"]["decision"] == "review").sum() == n - 10 and len(compared) <= n // 10


def test_windows_write_few_tables(spark, monkeypatch):
    from tamarack.scratch import Scratch

    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(name) or keep(self, df, name))
    df = records(spark, [{"record_id": i, "phone": f"+1{i % 3}", "domain": "a.com", "name": f"shop {i}"} for i in range(60)])
    tables = []
    for window in (30, 10):
        written.clear()
        assert in_spark(spark, df, whole=0, window=window) == one_by_one(df)
        tables.append(len(written))
    assert tables[1] - tables[0] <= 3 * 4, written  # four windows more


def test_shown_values_equal_a_full_recompute(spark):
    import random

    rows = listings(random.Random(5), 120, True)
    df = records(spark, [{k: v for k, v in r.items() if k != "seq"} for r in rows]).withColumns({"source_rank": (F.col("record_id") % 3).cast("int"), "observed_at": (F.col("record_id") * 7 % 11).cast("double")})
    decided, shown = in_spark(spark, df)
    plain = {r.record_id: r for r in df.collect()}
    for business, fields in shown.items():
        own = [plain[i] for i, b, _ in decided if b == business]
        best = lambda known, rank=lambda r: 0: min((r for r in own if known(r)), key=lambda r: (rank(r), r.source_rank, -r.observed_at, -r.seq), default=None)  # noqa: B023, E731
        want = [getattr(best(lambda r, c=c: getattr(r, c) is not None), c, None) for c in ("domain", "phone", "name", "name_key")]
        place = best(lambda r: r.postal or r.street, lambda r: not r.street)
        assert fields == (*want, *((place.postal, place.street, None, None) if place else (None,) * 4))


def test_pairs_and_decisions(spark):
    rows = records(spark, [{"record_id": 1, "domain": "a.com", "phone": "p", "name": "abc", "postal": "1", "street": "s"}, {"record_id": 2, "domain": "z.com", "phone": "q", "name": "abc"}])
    pairs = resolution.blocked_pairs(rows, rows.withColumnsRenamed({"record_id": "business_id", "seq": "created_seq"}))
    assert {(r.record_id, r.business_id) for r in pairs.collect()} == {(1, 1), (2, 2)}
    both = spark.createDataFrame(
        [(1, 7, 1, "a.com", "p", "abc", "1", "s", None, None, "a.com", "p", "abc", "1", "s", None, None), (2, 7, 1, "a.com", "p", "abc", None, None, None, None, "b.com", "q", "abc", None, None, None, None)],
        "record_id long, business_id long, place int, r_domain string, r_phone string, r_name string, r_postal string, r_street string, r_lat double, r_lng double, b_domain string, b_phone string, b_name string, b_postal string, b_street string, b_lat double, b_lng double",
    )
    scored = resolution.scored(both).collect()
    assert [(r.record_id, r.score, r.strong) for r in scored] == [(1, 0.95, True)]
    assert resolution.decided(resolution.scored(both)).head().decision == "auto_merge"


def test_merge_of_rules_and_model(spark):
    rules = spark.createDataFrame([(1, "seo_gbp", 0.6, "r"), (1, "booking_setup", 0.5, "s")], "business_id long, service string, confidence double, reason string")
    model = spark.createDataFrame([(1, "seo_gbp", 0.9, "why"), (1, "ads_social", 0.9, ""), (1, "x", 0.2, "t")], "business_id long, service string, confidence double, rationale string")
    got = {r.service: (r.source, r.confidence, r.reason, r.ai_agrees) for r in leads.merge(rules, model).collect()}
    assert got == {"seo_gbp": ("rules+ai", 0.75, "r why", True), "booking_setup": ("rules", 0.5, "s", False), "ads_social": ("ai", 0.6, None, True), "x": ("ai", 0.2, "t", True)}


def test_guardrails(spark):
    rows = spark.createDataFrame(
        [("seo_gbp", 0.5, "fine", "a “quote”", "no_h1"), ("none", 0.5, "", "a", None), ("seo_gbp", 1.5, "", "a", None), ("seo_gbp", 0.5, "", "missing", None), ("seo_gbp", 0.5, "mail me@x.com", "a", None), ("seo_gbp", 0.5, "", "a", "invented")],
        "service string, confidence double, rationale string, quote string, finding_code string",
    )
    got = [r.rejected for r in leads.guarded(rows, F.array(F.lit('has a "quote" in it')), F.array(F.lit("no_h1"))).collect()]
    assert got == [None, "unknown_service", "bad_confidence", "quote_not_found", "personal_data", "unknown_finding"]


def test_review_rules(spark):
    rows = spark.createDataFrame([(1, "pending", None, 1), (2, "pending", NOW, 1), (3, "approved", None, 1), (4, "pending", None, 2)], "id long, status string, withdrawn_at timestamp, version int")
    asked = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 1)], "id long, version int")
    assert {r.id: r.verdict for r in leads.decide(asked, rows).collect()} == {1: "ok", 2: "withdrawn", 3: "closed", 4: "stale", 9: "not_found"}
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "business_id long, service string")
    stored = spark.createDataFrame([(1, "a", "pending", None), (1, "b", "pending", NOW)], "business_id long, service string, status string, withdrawn_at timestamp")
    blocked = spark.createDataFrame([(1, "a"), (1, "c")], "business_id long, service string")
    assert {r.service: r.action for r in leads.upsert_opportunities(found, stored, blocked).collect()} == {"a": "update", "b": "revive", "c": "skip", "d": "create"}
    fires, opened = spark.createDataFrame([("x", ""), ("y", "")], "rule string, details string"), spark.createDataFrame([("y",), ("z",)], "rule string")
    assert {r.rule: r.action for r in leads.alerts(fires, opened).collect()} == {"x": "raise", "y": "refresh", "z": "clear"}


def test_page_checks():
    html = """<html lang="en"><head><title>Home | Business</title><meta name="viewport" content="width=device-width, user-scalable=no">
    <script type="application/ld+json">{"@graph": [{"@type": "Plumber"}, {"@type": ["A", "B"]}]}</script><script>var x = "hidden words"</script></head>
    <body><h1>One</h1><h3>Skip</h3><a href="tel:+1">call</a><a href="mailto:me@example.com">m</a><a href="https://www.facebook.com/us">f</a>
    <form><label for="a">A</label><input id="a"><input id="b"><input type="hidden"></form><img src="x"><p>Lorem ipsum &copy; 2019-2021 Us</p></body></html>"""
    got = pages.checks_of(html)
    assert got["title"] == "Home | Business" and got["h1_count"] == 1 and got["heading_skips"] == 1 and got["viewport_zoom_blocked"]
    assert got["structured_types"] == ["Plumber", "A", "B"] and got["local_business"] and got["tel_link"] and got["placeholder_email"]
    assert got["copyright_year"] == 2021 and got["placeholder_text"] == "lorem ipsum" and got["images_without_alt"] == 1 and got["unlabelled_inputs"] == 1
    assert got["social_links"] == ["facebook"] and "hidden" not in html[:0] and got["contact_form"]
    assert pages.checks_of("")["title"] is None and pages.checks_of("<b <<>")["h1_count"] == 0
    assert pages.json_ld_types("{broken") == ([], True) and pages.json_ld_types('<!-- {"@type": "A"} -->') == (["A"], False)
    assert pages.copyright_year("© 2015 - present")[:2] == (None, True)


@pytest.mark.parametrize(
    ("text", "year", "open_range"),
    [
        ("© 20015 Us", None, False), ("© 2006 - | all rights", None, True), ("Copyright notice text here and 2035 goals", None, False), ("© 2035 Us", 2035, False), ("Copyright © 2018-2035", 2035, False),
        ("© 2018–2024 Us", 2024, False), ("© Us, 2100 Lamar Blvd", None, False), ("(c) 1980", None, False), ("no notice 2020", None, False), ("© 2016 Us © 2019 Them", 2019, False), ("© 2099", None, False), ("Copyright notices © 2030 Us", 2030, False), ("© 2018-20351", 2018, False),
    ],
)
def test_copyright_year(text, year, open_range):
    assert pages.copyright_year(text, 2026)[:2] == (year, open_range)


@pytest.mark.parametrize(
    ("html", "value", "method", "label"),
    [
        ('<script src="https://assets.calendly.com/w.js"></script><a href="/book">x</a>', True, "widget", "Calendly"),
        ('<a href="https://www.fresha.com/a/b">x</a>', True, "booking_host", "Fresha"),
        ('<a href="/visit">Book  now</a>', None, "cta", "link text: Book now"),
        ('<button aria-label="Schedule a visit"></button>', None, "cta", "link text: Schedule a visit"),
        ('<a href="/appointments/">Hier</a>', None, "path", "link href: /appointments/"),
        ('<a href="/contact/">Book now</a>', False, None, None), ('<a href="/bookkeeping">Our books</a>', False, None, None), ('<a href="https://maps.google.com/book">x</a>', None, "path", "link href: https://maps.google.com/book"),
    ],
)
def test_booking(html, value, method, label):
    got = pages.checks_of(html, "https://www.a.com/contact")
    assert (got["booking"], got["booking_method"], got["booking_label"]) == (value, method, label)


def test_nested_items_own_their_properties():
    html = """<div itemscope itemtype="https://schema.org/Plumber"><h1 itemprop="name">Joe &amp; Son</h1>
    <div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">12 Main <b>St</b></span><meta itemprop="postalCode" content="78701"><span itemprop="name">not the name</span></div>
    <a itemprop="telephone" href="tel:+15125550100">call</a><time itemprop="openingHours" datetime="Mo-Fr 08:00-17:00">weekdays</time><img itemprop="image" src="x.png"><p itemprop="telephone">second</p></div>
    <div vocab="https://schema.org/" typeof="schema:Organization"><span property="name">Other</span><div property="location" typeof="Restaurant"><span property="name">Inner</span></div></div>"""
    got = pages.checks_of(html)
    assert got["structured_types"] == ["Plumber", "PostalAddress", "Organization", "Restaurant"] and got["businesses"] == 2
    assert {k: got["business"][k] for k in ("syntax", "type", "name", "phone", "street", "postal_code", "hours")} == {"syntax": "microdata", "type": "Plumber", "name": "Joe & Son", "phone": "tel:+15125550100", "street": "12 Main St", "postal_code": "78701", "hours": ["Mo-Fr 08:00-17:00"]}
    rdfa = pages.checks_of("<div typeof='Restaurant'><p property='name'>A<p property='description'>B</div><p property='name'>outside</p>")["business"]
    assert rdfa["name"] == "A B" and rdfa["syntax"] == "rdfa"


def test_json_ld_business():
    html = """<script type="application/ld+json; charset=utf-8"><!-- {"@graph": [{"@type": ["Thing", "https://schema.org/Dentist"], "name": {"@value": " Dr  A "}, "telephone": ["", "+1"], "address": [{"streetAddress": "1 A St", "addressCountry": {"name": "US"}}],
    "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "Tuesday"], "opens": "08:00", "closes": "17:00"}, {"opens": "10:00"}], "sameAs": "https://x.com/a"}]} --></script><script type="application/ld+json">{"@type": "Store", "address": "9 B Rd, 78702"}</script>"""
    got = pages.checks_of(html)
    own = got["business"]
    assert got["businesses"] == 2 and not got["broken_structured_data"] and (own["type"], own["name"], own["phone"], own["street"], own["country"]) == ("Dentist", "Dr A", "+1", "1 A St", "US")
    assert own["hours"] == ["Monday, Tuesday 08:00-17:00", "10:00-?"] and own["same_as"] == ["https://x.com/a"]
    assert pages.checks_of(html.split("</script>")[1] + "</script>")["business"]["address_text"] == "9 B Rd, 78702" and pages.checks_of("<p>x")["business"] is None


@pytest.mark.parametrize(
    ("html", "flow", "onward"),
    [
        ('<iframe src="https://a.phorest.com/x"></iframe>', True, False), ('<input type="date">', True, False), ('<select id="visit-time"></select>', True, False), ('<input type="hidden" name="date">', False, False), ('<input name="update">', False, False),
        ('<a href="/reserve-now">x</a>', False, True), ('<a href="/s/1">Our salons</a>', False, False), ('<a href="/s/1">Salon A</a><a href="/s/2">Salon B</a>', False, True), ('<select name="city"><option>a<option>b</select>', False, True),
        ('<a href="https://www.facebook.com/book">x</a>', False, False), ('<a href="/contact">Book now</a>', False, False), ('<a href="https://studio.example">Website crafted</a>', False, False),
    ],
)
def test_what_a_target_shows(html, flow, onward):
    got = pages.checks_of(html, "https://www.a.com/contact/")
    assert (got["booking_flow"] is not None, got["booking_onward"] is not None) == (flow, onward)


def test_second_hop(spark):
    link = lambda to: f'<a href="{to}">Book now</a>'
    rows = [
        (1, "https://a.com/", link("/visit?x=1")), (2, "http://www.a.com/visit/", '<input type="time">'), (3, "https://a.com/visit", "<p>later copy"), (4, "https://b.com/", link("/plain")), (5, "https://b.com/plain", "<p>call us"), (6, "https://c.com/", link("/on")),
        (7, "https://c.com/on", '<a href="https://d.com/booking">x</a>'), (8, "https://e.com/", link("https://gone.com/x")), (9, "https://f.com/", "<button>Book now</button>"), (10, "https://g.com/", "<p>none"), (11, "https://h.com", None), (12, "https://i.com", link("/shell")), (13, "https://i.com/shell", "<script></script>" * 6),
    ]
    got = {r.page_id: r.checks and (r.checks.booking, r.checks.booking_method) for r in pages.follow_bookings(pages.audit(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert {k: got[k] for k in (1, 4, 6, 8, 9, 10, 11, 12)} == {1: (True, "verified_target"), 4: (False, "cta"), 6: (None, "multi_hop"), 8: (None, "unverified"), 9: (None, "unverified"), 10: (False, None), 11: None, 12: (None, "unverified")} and len(got) == 13


def test_listing_against_page(spark):
    item = '<div itemscope itemtype="Plumber"><p itemprop="address">{}</p></div><a href="tel:512-555-2368">c</a>'
    rows = [(1, "https://a.com/", item.format("12 Main St #4, Austin 78701")), (2, "https://www.b.com/", item.format("14 Main St")), (3, "https://c.com/", item.format("1 A St") * 2)]
    listings = spark.createDataFrame([(1, "+15125552368", "12 Main St Suite 4", "78701", "http://a.com"), (2, "+15125552369", "12 Main St", None, "https://b.com"), (3, None, "1 A St", None, None)], "page_id long, phone_e164 string, street string, postal_code string, website string")
    got = {r.page_id: (r.phone, r.address.status, r.website.differs_in) for r in lifecycle.against_listing(pages.audit(spark.createDataFrame(rows, "page_id long, url string, html string")), listings).collect()}
    assert got == {1: ("match", "match", ["http"]), 2: ("mismatch", "mismatch", ["www"]), 3: ("not_compared", "not_compared", None)}


def test_signatures_and_quotes():
    markup = 'some words before <script src="https://embed.tawk.to/x" async></script> and data-reactroot here after that'
    tags = ['<script src="https://embed.tawk.to/x" async>']
    assert signatures.hits(markup, tags, signatures.CHAT) == [("tawk", "Tawk.to", tags[0])]
    (key, label, words), = signatures.hits(markup, tags, signatures.TECH)
    assert (key, label) == ("react", "React") and "data-reactroot here after" in words
    assert signatures.around("a mark", "mark") == "a mark" and signatures.around("w " * 500 + "premark! " + "v " * 500, "mark") == "w w w w w premark! v v v v v"
    assert signatures.booking_host("https://squareup.com/appointments/x") and not signatures.booking_host("https://squareup.com/shop") and not signatures.booking_host("https://notcalendly.com")
    assert [signatures.placeholder_email(m) for m in ("a@mysite.net", "info@email.com", "jane.doe@email.com", "x@real.com", "no")] == [True, True, False, False, False]
    assert signatures.social_platform("https://m.facebook.com/a") == "facebook" and signatures.social_platform("https://google.com/search") is None
    page = pages.checks_of("<footer><p>© 2020 Your Company Name</p></footer>")
    assert page["placeholder_text"] == "your company name" and pages.checks_of("<p>Company name</p>")["placeholder_text"] is None


def test_fetch_checks(spark):
    rows = [
        (1, "http://a.com", "https://a.com/", 200, ["http://a.com"], "text/html", True, None, None),
        (2, "https://b.com", None, None, [], None, False, "bad certificate", "tls"),
        (3, "http://c.com", "http://c.com/", 404, None, "application/pdf", None, None, None),
        (4, "http://d.com", None, None, None, None, None, "timeout", "network"),
    ]
    df = spark.createDataFrame(rows, "id int, url string, final_url string, status_code int, redirect_chain array<string>, content_type string, tls_valid boolean, error string, error_kind string")
    got = {r.id: r.fetch for r in pages.fetch_checks(df).collect()}
    assert [(f.reachable, f.tls_valid, f.https, f.http_redirects_to_https, f.parsed) for f in (got[i] for i in (1, 2, 3, 4))] == [(True, True, True, True, True), (False, False, True, None, False), (True, None, False, False, False), (False, None, None, None, False)]
    assert got[1].redirects == "http://a.com -> https://a.com/" and got[2].evidence == "No answer from https://b.com: bad certificate"


def test_other_findings(spark):
    rows = [
        (1, "none", None, None, None, None, None, 5, "m/1", None, None, None), (2, "social_profile", "https://facebook.com/x", None, None, None, None, 20, None, None, None, None),
        (3, "own_site", "https://a.com", "unreachable", None, False, "expired", None, None, None, None, None), (4, "own_site", "https://b.com", "unreachable", None, None, "timeout", None, None, None, None, None),
        (5, "own_site", "https://c.com", "robots_blocked", "disallow", None, None, None, None, None, None, None), (6, "own_site", "https://d.com", "done", None, True, None, None, None, 49, 89, 60),
    ]
    df = spark.createDataFrame(rows, "business_id int, website_kind string, website string, status string, robots_reason string, tls_valid boolean, error string, user_rating_count int, listing_url string, performance int, accessibility int, best_practices int")
    got = [(r.business_id, r.code, r.severity, r.evidence_url) for r in pages.other_findings(df).orderBy("business_id", "place").collect()]
    assert got == [
        (1, "no_website", "high", None), (1, "few_reviews", "low", "m/1"), (2, "social_profile_only", "high", "https://facebook.com/x"), (3, "tls_invalid", "high", "https://a.com"), (4, "unreachable", "high", "https://b.com"),
        (5, "robots_blocked", "info", "https://c.com"), (6, "slow_mobile", "medium", "https://d.com"), (6, "low_accessibility_score", "low", "https://d.com"), (6, "low_best_practices_score", "medium", "https://d.com"),
    ]
    kept = spark.createDataFrame([("unreachable", "unreachable"), ("no_h1", "unreachable"), ("no_h1", "done"), ("domain_expired", "bot_challenge"), ("no_h1", None)], "code string, audit_status string")
    assert sorted(r.code for r in pages.allowed_findings(kept).collect()) == ["domain_expired", "no_h1", "no_h1", "unreachable"]


def test_findings(spark):
    rows = spark.createDataFrame([(1, "http://a.com", "<title>Home</title><h1>a</h1>"), (2, "https://b.com", None)], "page_id long, url string, html string")
    got = [r.code for r in pages.findings(pages.audit(rows)).orderBy("place").collect()]
    assert got[:3] == ["no_https", "no_mobile_viewport", "default_title"] and "no_contact_on_homepage" in got and "no_click_to_call" not in got
    merged = leads.rule_opportunities(pages.findings(pages.audit(rows)).withColumnRenamed("page_id", "business_id")).collect()
    assert all(r.confidence <= 0.95 for r in merged)


def test_domain_findings(spark):
    rows = spark.createDataFrame([("a", NOW + dt.timedelta(days=10), ["1"], ["m"], ["v=spf1 +all", "v=spf1 -all"], ["v=DMARC1; p=none"]), ("b", None, None, None, None, None), ("c", NOW - dt.timedelta(hours=1), [], [], [], [])], "domain string, expires timestamp, a_records array<string>, mx array<string>, spf array<string>, dmarc array<string>")
    got = {}
    for r in pages.domain_findings(rows, F.lit(NOW)).collect():
        got.setdefault(r.domain, []).append(r.code)
    assert got == {"a": ["domain_expiring_soon", "multiple_spf_records", "spf_allows_all", "dmarc_policy_none"], "c": ["domain_expired", "domain_no_a_record", "no_domain_mx", "no_spf", "no_dmarc"]}


@pytest.mark.parametrize("descending", [True, False])
def test_every_row_on_exactly_one_page(spark, descending):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(23)], "id long, score double").cache()
    seen, after = [], None
    while True:
        page = relational.keyset_page_nulls_last(rows, "score", "id", 5, after, descending).collect()
        seen += [r.id for r in page[:5]]
        if len(page) <= 5:
            break
        after = (page[4].score, page[4].id)
    assert sorted(seen) == list(range(23))


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, 1, 5, "a"), (2, 2, 2, "b")], "k long, first_seen int, seen int, v string")
    new = spark.createDataFrame([(1, 9, "z"), (3, 4, "c")], "k long, seen int, v string")
    once = relational.seen_again(old, new, ["k"], "seen")
    twice = relational.seen_again(once, new, ["k"], "seen")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, 9, "z"), (2, 2, 2, "b"), (3, 4, 4, "c")]
    links = relational.sync_links(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), spark.createDataFrame([(1, 3), (1, 4)], "a int, b int"))
    assert sorted(map(tuple, links.collect())) == [(1, 2, "delete"), (1, 4, "insert")]


def test_feed(spark, tmp_path):
    pages_of = [{"places": [{"id": "a", "displayName": {"text": "Ann LLC"}, "rating": 4.26, "websiteUri": "http://www.ann.com/?q"}, {"displayName": {"text": "no id"}}], "nextPageToken": "t"}, {"places": [{"id": "a"}, {"id": "b", "nationalPhoneNumber": "(512) 555-0123"}], "nextPageToken": "t"}, {"places": [{"id": "b"}], "nextPageToken": "t"}, {"places": [{"id": "c"}]}]
    for i, p in enumerate(pages_of):
        (tmp_path / f"{i}.json").write_text(json.dumps(p))
    rows = feeds.places_pages(spark, str(tmp_path))
    good, bad = feeds.validated(rows)
    flat = feeds.normalized(feeds.candidates(good, "google_places")).orderBy("position").collect()
    assert [r.source_record_id for r in flat] == ["a", "b"] and bad.count() == 1
    assert (flat[0].normalized_name, flat[0].domain, flat[0].rating) == ("ann", "ann.com", 4.3) and flat[1].phone_e164 == "+15125550123"
    assert "demo_fixture" in feeds.names()


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=SUM(A1)", True), (2, 'say "hi", you', None)], "id long, text string, flag boolean").coalesce(1)
    text = "".join(csv_sink.render(rows, ["id", "text", "flag"]))
    assert text == '﻿id,text,flag\r\n1,\'=SUM(A1),true\r\n2,"say ""hi"", you",\r\n'


def test_reports(spark):
    audits = spark.createDataFrame([(1, 1, NOW - dt.timedelta(days=2), "unreachable", 8), (2, 2, NOW - dt.timedelta(days=2), "unreachable", 8), (3, 2, NOW - dt.timedelta(days=9), "unreachable", 8), (4, 3, NOW, "done", 8), (5, 4, NOW, "done", 7), (6, 5, NOW - dt.timedelta(days=31), "done", 8)], "id long, business_id long, created_at timestamp, status string, version int")
    due = reports.needs_audit(spark.range(1, 7).withColumnRenamed("id", "business_id"), audits, F.lit(NOW), 8)
    assert sorted(r.business_id for r in due.collect()) == [1, 4, 5, 6]
    health = spark.createDataFrame([(0.5, 0.1, 0.9, None, 10, 0.1)], "success_rate double, error_rate double, budget_ratio double, backup_age_hours double, queue_length int, calls_ratio double")
    assert [r.rule for r in reports.firing(health).collect()] == ["job_success", "ai_budget", "backup_age"]


def test_streams(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i)) for i in range(20)]
    spark.createDataFrame(rows, "id long, k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))

    def drained(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    passed = drained(limits.token_bucket(read(), "k", "ts", "id", 0.1, 3), "bucket")
    assert len(passed) == 20 and sum(r.allowed for r in passed if r.k == "a") == 4
    days = drained(limits.daily_counts(read(), "k", "ts", 5), "days", "update")
    assert {(r.k, r.n, r.over) for r in days} == {("a", 10, True), ("b", 10, True)}
    assert len(drained(limits.first_sightings(read(), ["k"], "ts"), "first")) == 2


def test_lifecycle(spark):
    from tamarack.operators import lifecycle as life

    stored = spark.createDataFrame([(1, 7, 0.6, "pending"), (1, 8, 0.7, "kept_apart")], "record_id long, business_id long, score double, status string")
    found = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.9), (2, 7, 0.5)], "record_id long, business_id long, score double")
    now = life.upsert_candidates(stored, found)
    assert sorted(map(tuple, now.collect())) == [(1, 7, 0.9, "pending"), (1, 8, 0.7, "kept_apart"), (2, 7, 0.5, "pending")]
    asked = spark.createDataFrame([(2, 7, "keep_apart"), (1, 7, "merge")], "record_id long, business_id long, decision string")
    after = life.apply_decisions(now, asked)
    assert sorted((r.record_id, r.business_id, r.status) for r in after.collect()) == [(1, 7, "merged"), (1, 8, "kept_apart"), (2, 7, "kept_apart")]
    assert [r.record_id for r in life.without_home(after).collect()] == [2]
    rows = spark.createDataFrame([(1, 1, "google_places", 5, "http://fb", None, "social_profile"), (1, 2, "zeta", 1, "http://own", "own", "own_site"), (1, 3, "zeta", 9, None, None, None)], "business_id long, record_id long, source string, observed_at int, website string, domain string, website_kind string")
    assert life.group_survivors(rows, life.WEBSITE_GROUP, ("website", "website_kind"), life.website_rank(F.col("website_kind"))).head().website == "http://own"
    assert [r.x for r in spark.createDataFrame([("audit-8",), ("x",)], "v string").select(life.logic_version(F.col("v")).alias("x")).collect()] == [8, None]
    runs = spark.createDataFrame([(2, "k", NOW), (1, "k", NOW), (3, None, NOW)], "id long, idempotency_key string, created_at timestamp")
    assert sorted(r.id for r in life.enqueued(runs).collect()) == [1, 3]


def test_listing_comparison(spark):
    from tamarack.operators import lifecycle as life

    row = spark.createDataFrame([("+15125550123", ["512-555-0123"], "http://www.a.com/x", "https://a.com/", "https://b.com")], "p string, n array<string>, l string, f string, c string")
    got = row.select(life.compare_phone(F.col("p"), F.col("n")).alias("phone"), life.compare_website(F.col("l"), F.col("f"), F.col("c")).alias("site"), life.compare_address(life.address_numbers(F.lit("12 A St, Suite #11"), F.lit("78701")), life.address_numbers(F.lit("12 B Rd Ste 12"), F.lit("78701-1"))).alias("home")).head()
    assert got.phone == "match" and got.site.status == "mismatch" and got.site.differs_in == ["http", "www"]
    assert got.home.status == "mismatch" and got.home.differs_in == ["unit"]
    said = life.names_business(spark.createDataFrame([("UltimatePlumber.com", "Ultimate Plumber LLC"), ("Welcome", "Ann Electric"), ("Electrical", "Ann Electric"), ("x", "A B")], "t string, n string"), "t", "n").collect()
    assert [r.names_business for r in said] == [True, False, True, None]
    links = spark.createDataFrame([(["facebook", "x"], "facebook: https://fb.com/a; x: nothing")], "p array<string>, e string").select(life.linked_profiles(F.col("p"), F.col("e")).alias("x")).head().x
    assert [(x.platform, x.url) for x in links] == [("facebook", "https://fb.com/a"), ("x", None)]


def test_answers(spark):
    from tamarack.operators import lifecycle as life

    good = {"business_summary": "s", "industry": "i", "industry_matches_listing": True, "opportunities": [{"service": "seo_gbp", "confidence": 0.5, "rationale": "", "evidence": []}], "buying_intent": "explicit", "unknowns": [], "needs_human_review": False}
    bad = [json.dumps(good), "nope", json.dumps(good | {"more": 1}), json.dumps({k: v for k, v in good.items() if k != "industry"}), json.dumps(good | {"buying_intent": "maybe"}), json.dumps(good | {"opportunities": [{"service": "a", "confidence": 2, "rationale": "", "evidence": []}]})]
    got = [r.drift for r in life.parse_answers(spark.createDataFrame([(x,) for x in bad], "raw string")).collect()]
    assert got == [None, "not_json", "extra_key", "missing_key", "bad_value", "bad_value"]


def test_lead_record(spark):
    from tamarack.operators import lifecycle as life

    b = spark.createDataFrame([(1, "Ann", None, "plumbing", "Austin", "TX", "78701", "1 A St", "http://a.com", "+15125550123", ["f1", "f2"])], "business_id long, display_name string, legal_name string, industry string, city string, state string, postal_code string, address_line1 string, website string, phone_e164 string, findings array<string>")
    a = spark.createDataFrame([(1, "SEO", 0.5, "low.", NOW, "me", "n1"), (1, "Web", 0.91, "high.", NOW - dt.timedelta(days=1), "you", "n0")], "business_id long, service_name string, score double, reason string, decided_at timestamp, decided_by string, note string")
    o = spark.createDataFrame([(1, "google_places", "u", 0, NOW)], "business_id long, source string, source_url string, priority int, first_discovered_at timestamp")
    r = life.lead_records(b, a, o, spark.createDataFrame([], "business_id long"), "http://leads.example/").head()
    assert r.services == "Web; SEO" and r.lead_score == 91 and r.why_lead == "high. low." and r.public_phone == "(512) 555-0123" and r.notes == "n1" and r.do_not_contact is False
    assert tuple(r.asDict()) == life.LEAD_FIELDS


def test_queue(spark):
    from tamarack.operators import review

    b = spark.createDataFrame(
        [(i, NOW - dt.timedelta(days=i), f"Shop {i}", f"shop {i}", f"s{i}.com" if i != 4 else None, None, "w" if i % 2 else None, "none" if i == 3 else "own_site", "operational", "plumbing", "Austin", "TX", None if i == 2 else i) for i in range(1, 8)],
        "business_id long, created_at timestamp, display_name string, normalized_name string, domain string, phone_e164 string, website string, website_kind string, business_status string, industry string, city string, state string, user_rating_count int",
    )
    o = spark.createDataFrame(
        [(10 * i + j, i, s, round(0.1 * i + 0.01 * j, 2), c, "rules", "pending", None, NOW) for i in range(1, 8) for j, (s, c) in enumerate([("seo_gbp", 0.6), ("booking_setup", 0.2)]) if not (i == 6 and j == 0)],
        "id long, business_id long, service string, score double, confidence double, source string, status string, withdrawn_at timestamp, created_at timestamp",
    )
    x = spark.createDataFrame([(1, None, "s1.com", None, None), (2, None, "s5.com", None, NOW)], "id long, business_id long, domain string, phone_e164 string, lifted_at timestamp")
    a = spark.createDataFrame([(i, i, NOW, "done", [("no_h1", "low", "seo_gbp"), ("no_https", "high", "website_design")] + ([("thin_content", "low", "seo_gbp")] if i == 7 else [])) for i in range(1, 8)], "id long, business_id long, created_at timestamp, status string, findings array<struct<code: string, severity: string, service: string>>")
    r = spark.createDataFrame([(i, s, NOW - dt.timedelta(days=i)) for i in range(1, 8) for s in ("zeta", "google_places")], "business_id long, source string, first_discovered_at timestamp")
    page = {p.business_id: p for p in review.queue(b, o, x, a, r, limit=3).collect()}
    assert sorted(page) == [3, 4, 5, 7]  # 1 is suppressed, 6 has weak ones only; one row more than the page
    assert page[7].top_score == 0.7 and page[7].weak_hidden == 1 and [q.service for q in page[7].open] == ["seo_gbp"]
    assert [f.code for f in page[7].findings] == ["no_https", "thin_content", "no_h1"] and page[7].findings[2].n == 5 and page[7].sources == ["google_places", "zeta"]
    seen, after = [], None
    while True:
        rows = sorted(review.queue(b, o, x, a, r, sort="reviews", descending=False, limit=2, after=after).collect(), key=lambda p: (p.user_rating_count is None, p.user_rating_count, p.business_id))
        seen += [p.business_id for p in rows[:2]]
        if len(rows) <= 2:
            break
        after = (rows[1].user_rating_count, rows[1].business_id)
    assert seen == [3, 4, 5, 7, 2]
    assert [p.business_id for p in review.queue(b, o, x, a, r, badge="no_website", since=F.lit(NOW - dt.timedelta(days=3))).collect()] == [3]
    assert [p.business_id for p in review.list_businesses(b, a, has_website=False, finding=("no_h1",), q="SHOP _").collect()] == [2, 4, 6]
    assert [p.id for p in review.list_opportunities(o, b, service="seo_gbp", min_score=0.4, limit=1).collect()] == [70, 50]
    assert a.select(review.top_findings(F.col("findings")).alias("x")).head().x == ["no_https", "no_h1"]
    d = spark.createDataFrame([(1, 70, "approve", NOW), (2, 70, "undo", NOW)], "id long, opportunity_id long, decision string, decided_at timestamp")
    one = review.detail(7, b, o, d, a).head()
    assert [q.id for q in one.opportunities] == [71, 70] and [h.decision for h in one.opportunities[1].history] == ["undo", "approve"]
    cited = o.withColumn("cited", F.array(F.when(F.col("business_id") == 7, "thin_content").otherwise("gone")))
    assert {p.id: p.withdraw for p in review.orphans(cited, a).collect()}.keys() == {i for i in [10, 11, 20, 21, 30, 31, 40, 41, 50, 51, 61]}


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    rows = lambda r: [x.k for x in relational.not_in(left, r, "k").collect()]
    assert rows(right(1)) == [2] and rows(right(1, None)) == [] and sorted(rows(right()), key=str) == [1, 2, None]


def test_cursor_page_of_an_empty_table(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, v int")
    assert [r.id for r in relational.keyset_page_at(df, ["v", "id"], 2, df.where("id = 7")).collect()] == [4, 1, 6]
    assert relational.keyset_page_at(df, ["v", "id"], 2, df.where("false")).count() == 0
    assert relational.keyset_page_at(df.where("false"), ["v", "id"], 2, df.where("false")).count() == 0


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "b", None, 1), (1, None, "y", 3), (1, "c", None, 2), (2, "z", None, 1)], "k int, v string, w string, at int")
    for rows in (new, new.orderBy(F.desc("at"))):
        assert {tuple(r) for r in relational.upsert(old, rows, ["k"], ["at"]).collect()} == {(1, "c", "y"), (2, "z", None)}


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [1, 1, 1, 2, 10, 10]] + [("b", 5.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95) for r in reports.percentiles(rows, "k", "v", p50=0.5, p95=0.95).collect()}
    assert got == {"a": (6, 1.5, 10.0), "b": (1, 5.0, 5.0)}


def test_replay_cells_wrap():
    at = lambda lat, lng: {"domain": None, "phone": None, "postal": None, "name_key": None, "lat": lat, "lng": lng}
    own = {k for _, k in resolution._keys(at(10.0, 179.9999), own=True)}
    assert own & {k for _, k in resolution._keys(at(10.0, -179.9999))}
    assert len(list(resolution._keys(at(90.0, 0.0)))) == 6 and resolution.half_up(0.00005, 4) == 0.0001


def test_known_addresses(spark):
    df = spark.createDataFrame([("Come to 5 Old Mill (rear) or 5 old mill.", ["5 Old Mill", "5 Old Mill (rear)", " "]), ("nothing", None)], "t string, k array<string>")
    assert [r[0] for r in df.select(pii.without_known(F.col("t"), F.col("k"))).collect()] == ["Come to [address removed] or [address removed].", "nothing"]


def test_destination(spark, tmp_path):
    leads_of = lambda *rows: spark.createDataFrame(rows, "business_key string, business_name string, notes string, do_not_contact boolean")
    assert destinations.names() == ["table"]
    table = destinations.get("table", spark, str(tmp_path / "crm"))
    assert not table.check()
    first = leads_of(("1", "a", "n1", False), ("2", "b", None, False))
    table.upsert(first)
    table.upsert(first)
    table.mark_do_not_contact(first.where("business_key = '2'"))
    table.withdraw(first.where("business_key = '1'"))
    table.upsert(leads_of(("2", "B", "other", False), ("3", "c", None, False)))
    got = {r.business_key: (r.business_name, r.notes, r.do_not_contact, r.withdrawn) for r in table.read().collect()}
    assert got == {"1": ("a", "n1", False, True), "2": ("B", "other", True, False), "3": ("c", None, False, False)} and table.check()
    assert table.find_by_keys(first).count() == 2
    unused = destinations.get("table", spark, str(tmp_path / "unused"))
    unused.withdraw(first)
    unused.mark_do_not_contact(first)
    assert unused.find_by_keys(first).collect() == [] and not unused.check() and "withdrawn" in unused.read().columns
    table.upsert(leads_of(("4", "x", None, False), ("4", "y", None, False)))
    assert table.find_by_keys(leads_of(("4", "", None, False))).head().business_name == "y"


def test_hosts_cron_and_logs(spark):
    hosts = spark.createDataFrame([("München.DE.",), ("a.com",), (" ",), (None,), ("x" * 70 + ".com",)], "h string")
    assert [r[0] for r in hosts.select(web.ascii_host("h")).collect()] == ["xn--mnchen-3ya.de", "a.com", None, None, None]
    assert lifecycle.cron_from_time("07:05") == "5 7 * * *"
    with pytest.raises(ValueError):
        lifecycle.cron_from_time("25:00")
    line = spark.createDataFrame([('{"api_key": "abc123"} eyJa.eyJb.c d',)], "t string").select(records_of.scrub_log(F.col("t"))).head()[0]
    assert line == '{"api_key": "***"} *** d'


def test_recorded_sites(spark, tmp_path):
    for host, files in {"a.com": {"index.html": "<p>a</p>", "robots.txt": "User-agent: *\nDisallow: /private\n"}, "b.com": {"index.html": "b", "meta.json": '{"status": 503}'}}.items():
        (tmp_path / host).mkdir()
        for name, body in files.items():
            (tmp_path / host / name).write_text(body)
    got = feeds.recorded_sites(spark, str(tmp_path)).orderBy("host")
    assert [(r.host, r.status, r.robots is None) for r in got.collect()] == [("a.com", 200, False), ("b.com", 503, True)]
    rows = got.select(F.explode(F.array(F.lit("https://a.com/private/x"), F.lit("https://a.com/"))).alias("u"), "robots")
    assert [r[0] for r in rows.select(web.robots_allows("robots", "u")).collect()] == [False, True, True, True]


def test_scratch_is_cleared(spark):
    import os

    from tamarack import scratch

    tables = scratch.Scratch(spark, "clear-test")
    tables.keep(spark.range(3), "t")
    folder = tables.root.removeprefix("file:")
    assert os.path.isdir(folder)
    own, scratch._ROOTS[:] = scratch._ROOTS[:], [tables.root]
    scratch.clear(spark)
    scratch._ROOTS.extend(r for r in own if r != tables.root)
    assert not os.path.exists(folder)


def test_alerts_of_a_stream(spark, tmp_path):
    at = lambda m: NOW + dt.timedelta(minutes=m)
    batches = [[("a", at(0), True), ("b", at(0), False), ("a", at(1), True)], [("a", at(3), True), ("a", at(2), False), ("b", at(2), True)], [("b", at(4), False), ("a", at(4), False)]]
    kind = "rule string, ts timestamp, fires boolean"
    rows = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = limits.alert_states(stream, "rule", "ts", "fires").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination()
    rows = [(r.rule, r.action) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rule", "at").collect()]
    assert rows == [("a", "raise"), ("a", "refresh"), ("a", "clear"), ("a", "raise"), ("a", "clear"), ("b", "raise"), ("b", "clear")]


def test_blocked_pairs_meet_the_first_of_a_block_only(spark):
    rows = spark.range(300).selectExpr(
        "id AS record_id", "array('alpha one', 'bravo two', 'carol six')[int(id % 3)] AS name", "if(id % 4 = 0, 'd' || id % 5, null) AS domain", "'p' || id % 2 AS phone", "if(id % 3 = 0, 'z', '') AS postal", "'k' || id % 7 AS name_key",
        "if(id % 2 = 0, 30.0 + id * 0.0001, null) AS lat", "if(id % 2 = 0, -97.0D, null) AS lng",
    )
    businesses = rows.where("record_id % 5 < 2").withColumnRenamed("record_id", "business_id").withColumn("created_seq", 1000 - F.col("business_id"))
    for limit in (2, 30, 1000):
        pairs = resolution.blocked_pairs(rows, businesses, limit)
        a, b = rows.alias("a"), businesses.alias("b")
        cell = F.array_contains(F.coalesce(geo.neighbours(F.col("a.lat"), F.col("a.lng")), F.array().cast("array<string>")), geo.geohash(F.col("b.lat"), F.col("b.lng"))) & F.expr("a.name = b.name")
        rank = F.when(F.expr("a.domain = b.domain"), 0).when(F.expr("a.phone = b.phone"), 1).when(F.expr("a.postal <> '' AND a.postal = b.postal AND a.name_key = b.name_key"), 2).when(cell, 3)
        every = sorted(((r.record_id, r["rank"], r.created_seq, r.business_id) for r in a.crossJoin(b).select("record_id", rank.alias("rank"), "created_seq", "business_id").where("rank IS NOT NULL").collect()))
        want, places = set(), {}
        for record, k, _, business in every:
            places[record] = places.get(record, 0) + 1
            if places[record] <= limit:
                want.add((record, business, k, places[record]))
        assert set(map(tuple, pairs.select("record_id", "business_id", "rank", "place").collect())) == want
    assert resolution.blocked_pairs(rows, businesses)._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2


def test_title_as_written(tmp_path, spark):
    from tamarack.plans import catalogue

    got = pages.checks_of('<html>\n\n <title a="1">A &quot;b&quot;\n c &amp</title></head>\n<svg><title>q</title></svg>')
    assert got["title_markup"] == "A &quot;b&quot;\n c &amp" and got["title"].startswith('A "b" c &')
    assert pages.checks_of("<p>x")["title_markup"] is None and pages.checks_of("<svg>\n<title>&lt;</title>")["title_markup"] == "&lt;"
    spark.createDataFrame([(1, "https://a.com", "<title>Say &quot;a&quot; &lt;b&gt;\n&amp</title>"), (2, "https://b.com", "<p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalogue.QUERIES["page_audit"](spark, str(tmp_path)).select("page_id", "title").collect()
    assert sorted(map(tuple, rows)) == [(1, "Say &quot;a&quot; <b> &amp"), (2, "")]


def test_sightings_of_one_moment_in_lead_records(spark):
    b = spark.createDataFrame([(1, "Ann", None, None, None, None, None, None, None, None, [])], "business_id long, display_name string, legal_name string, industry string, city string, state string, postal_code string, address_line1 string, website string, phone_e164 string, findings array<string>")
    a = spark.createDataFrame([(1, "ads_social", 0.5, "why", NOW, who, None) for who in ("zoe", "ann")], "business_id long, service_name string, score double, reason string, decided_at timestamp, decided_by string, note string")
    seen = [(1, "view", "u", 1, NOW, 7), (1, "signup", "u", 1, NOW, 9)]
    for rows in (seen, seen[::-1]):
        origin = spark.createDataFrame(rows, "business_id long, source string, source_url string, priority int, first_discovered_at timestamp, record_id long").coalesce(1)
        for o, who in ((origin, "View"), (origin.drop("record_id"), "Signup")):
            r = lifecycle.lead_records(b, a.coalesce(1), o, spark.createDataFrame([], "business_id long"), "https://x").head()
            assert (r.source, r.approved_by) == (who, "zoe")
