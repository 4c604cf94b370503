"""Rows over time: match candidates, whole-group survivorship, listing comparison, lead records, run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import pii, places, text, web
from tamarack.operators import pages
from tamarack.operators.resolution import source_rank

# Order of website kinds, groups of fields that come from one record.
WEBSITE_KINDS = ("own_site", "builder_subdomain", "social_profile", "none")
WEBSITE_GROUP = ("website", "domain", "website_kind")
ADDRESS_GROUP = ("address_line1", "address_line2", "street_key", "city", "state", "postal_code", "country", "lat", "lng", "geohash7")
# Columns of a lead record, in order; the last four are set on creation only.
LEAD_FIELDS = (
    "business_key", "business_name", "legal_name", "industry", "city", "state", "postal_code", "address", "website", "public_phone", "services", "lead_score", "why_lead", "top_findings", "source", "source_url", "lead_link",
    "date_discovered", "date_approved", "approved_by", "do_not_contact", "assigned_rep", "status", "follow_up_date", "notes",
)
CREATE_ONLY = LEAD_FIELDS[-4:]


def upsert_candidates(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(record_id, business_id, score, status): new pairs wait, pending ones take the new score, decided ones stay."""
    joined = stored.alias("s").join(found.alias("f"), ["record_id", "business_id"], "full_outer")
    decided = F.coalesce(F.col("s.status") != "pending", F.lit(False))
    return joined.select("record_id", "business_id", F.when(decided, F.col("s.score")).otherwise(F.coalesce("f.score", "s.score")).alias("score"), F.coalesce("s.status", F.lit("pending")).alias("status"))


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after decisions (record_id, business_id, decision): a merge keeps the record's other pending pairs apart."""
    merged = decisions.where("decision = 'merge'").select("record_id", F.lit(True).alias("merged")).distinct()
    joined = candidates.join(decisions.dropDuplicates(["record_id", "business_id"]), ["record_id", "business_id"], "left").join(merged, "record_id", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("decision") == "merge", "merged").when((F.col("decision") == "keep_apart") | F.col("merged"), "kept_apart").otherwise(F.col("status"))
    return joined.select("record_id", "business_id", "score", status.alias("status"))


def without_home(candidates: DataFrame) -> DataFrame:
    """Records all of whose candidates were kept apart: each gets a business of its own."""
    return candidates.groupBy("record_id").agg(F.every(F.col("status") == "kept_apart").alias("apart")).where("apart").select("record_id")


def group_survivors(records: DataFrame, group: tuple[str, ...], identity: tuple[str, ...], rank: Column, priority: tuple[str, ...] = ("google_places", "demo_fixture")) -> DataFrame:
    """(business_id, group...): the whole group from the one record that is best by rank, source and time.

    A record that knows nothing of ``identity`` cannot win, so groups never mix records.
    """
    order = F.struct((-rank).alias("rank"), (-source_rank(F.col("source"), priority)).alias("source"), F.col("observed_at").alias("at"), F.col("record_id").alias("id"))
    known = records.where(F.coalesce(*[F.col(c).cast("string") for c in identity]).isNotNull())
    return known.groupBy("business_id").agg(F.max_by(F.struct(*group), order).alias("g")).select("business_id", "g.*")


def website_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(F.coalesce(kind, F.lit("none")) == k, i) for i, k in enumerate(WEBSITE_KINDS)], F.lit(len(WEBSITE_KINDS)))


def address_rank(street_key: Column, line1: Column) -> Column:
    return F.when(F.coalesce(street_key, line1).isNotNull(), 0).otherwise(1)


def named(businesses: DataFrame, records: DataFrame) -> DataFrame:
    """Businesses whose name is gone show the id that their earliest record has at its source."""
    first = records.groupBy("business_id").agg(F.min_by("source_record_id", F.struct("first_discovered_at", "record_id")).alias("first"))
    return businesses.join(first, "business_id", "left").withColumn("display_name", F.coalesce("display_name", F.concat(F.lit("[expired] "), F.coalesce("first", F.col("business_id").cast("string"))))).drop("first")


def displayed(values: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds ``is_displayed``: the value is there, not purged, and the one that is shown of (business_id, field, shown)."""
    joined = values.join(shown, ["business_id", "field"], "left")
    return joined.withColumn("is_displayed", F.coalesce(F.col("purged_at").isNull() & (F.col("value") == F.col("shown")), F.lit(False))).drop("shown")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``after`` differ from ``before`` and how many do not."""
    rest = [c for c in after.columns if c != key]
    same = F.struct(*[F.col(f"a.{c}").alias(c) for c in rest]).eqNullSafe(F.struct(*[F.col(f"b.{c}").alias(c) for c in rest]))
    return after.alias("a").join(before.alias("b"), key).agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"))


def compare_phone(listed: Column, shown: Column) -> Column:
    """match, mismatch or not_compared of a listing's number and the array of a page's raw numbers."""
    numbers = F.filter(F.transform(shown, places.to_e164), lambda n: n.isNotNull())
    return F.when(listed.isNull() | shown.isNull() | (F.size(numbers) == 0), "not_compared").when(F.array_contains(numbers, listed), "match").otherwise("mismatch")


def compare_address(ours: Column, theirs: Column) -> Column:
    """{status, differs_in} of two {house_number, unit, postal_code}; unknown parts are not compared, a house number is needed."""
    parts = {"street number": "house_number", "unit": "unit", "ZIP code": "postal_code"}
    differs = F.array_compact(F.array(*[F.when(ours[c] != theirs[c], label) for label, c in parts.items()]))
    unknown = F.coalesce(ours["house_number"].isNull() | theirs["house_number"].isNull(), F.lit(True))
    return F.struct(F.when(unknown, "not_compared").when(F.size(differs) > 0, "mismatch").otherwise("match").alias("status"), F.when(~unknown, differs).alias("differs_in"))


def address_numbers(street: Column, postal: Column) -> Column:
    """House number, unit and postal code of a street line; unit designators are one."""
    unit = F.regexp_extract(F.lower(street), r"(?:\b(?:suite|ste|unit|apt|apartment|room|rm)\b\.?\s*#?\s*|#\s*)([a-z0-9\-]+)", 1)
    return F.struct(F.nullif(F.regexp_extract(street, r"^\s*(\d+[A-Za-z]?)\b", 1), F.lit("")).alias("house_number"), F.nullif(unit, F.lit("")).alias("unit"), places.postal_code(postal).alias("postal_code"))


def compare_website(listed: Column, final: Column, canonical: Column) -> Column:
    """{status, differs_in} of a listing's URL and the page's own: http against https, and ``www.``.

    The page's own URL is its canonical one if that lies on the served domain.
    """
    domain = lambda u: F.coalesce(web.registered_domain(web.host_of(u)), web.host_of(u))
    own = F.when(domain(canonical) == domain(final), canonical).otherwise(final)
    raw = lambda u: F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#:]+)", 1))
    differs = F.array_compact(F.array(F.when(F.lower(listed).startswith("http://") & F.lower(own).startswith("https://"), "http"), F.when((raw(listed) != raw(own)) & (web.host_of(listed) == web.host_of(own)), "www")))
    unknown = ~F.coalesce(domain(listed) == domain(own), F.lit(False))
    return F.struct(F.when(unknown, "not_compared").when(F.size(differs) > 0, "mismatch").otherwise("match").alias("status"), F.when(~unknown, differs).alias("differs_in"))


def against_listing(audited: DataFrame, listings: DataFrame) -> DataFrame:
    """(page_id, phone, address, website) of ``listings`` (page_id, phone_e164, street, postal_code, website) against their page: match, mismatch or not_compared.

    The address is that of the page's local business, and is not compared where a page describes several.
    """
    c = F.col("checks")
    own = F.when(c["businesses"] == 1, c["business"])
    street = F.coalesce(own["street"], own["address_text"])
    told = F.coalesce(own["postal_code"], F.get(F.split(own["address_text"], ",", 2), F.lit(1)))
    address = compare_address(address_numbers(F.col("street"), F.col("postal_code")), address_numbers(street, told))
    website = compare_website(F.col("website"), F.col("url"), c["canonical"])
    return listings.join(audited, "page_id").select("page_id", compare_phone(F.col("phone_e164"), c["tel_numbers"]).alias("phone"), address.alias("address"), website.alias("website"))


def names_business(df: DataFrame, said: str, name: str, generic: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Adds ``names_business``: whether a text has a word of a business name (equal, five letters of its start, or run together); null if no word of the name counts."""
    ready = df.withColumn("__said", text.normalize_name(F.col(said))).withColumn("__name", text.normalize_name(F.col(name)))
    words = F.filter(F.split("__name", " "), lambda w: (F.length(w) >= least) & ~w.isin(*(generic or ("",))))
    theirs, squashed = F.split("__said", " "), F.replace(F.col("__said"), F.lit(" "), F.lit(""))
    start = lambda a, b: (F.left(a, F.lit(5)) == F.left(b, F.lit(5))) & (F.length(a) >= 5) & (F.length(b) >= 5)
    short = lambda a, b: (F.least(F.length(a), F.length(b)) >= 4) & (a.startswith(b) | b.startswith(a))
    met = F.exists(words, lambda w: ((F.length(w) >= 4) & F.contains(squashed, w)) | F.exists(theirs, lambda t: (t == w) | start(t, w) | short(t, w)))
    return ready.withColumn("names_business", F.when(F.size(words) > 0, F.coalesce(met, F.lit(False)))).drop("__said", "__name")


def linked_profiles(platforms: Column, evidence: Column, limit: int = 300) -> Column:
    """[{platform, url}] from ``key: href; key: href``; a last pair that may be cut off gives no url."""
    pairs = F.split(evidence, "; ")
    whole = F.when(F.length(evidence) >= limit, F.slice(pairs, F.lit(1), F.size(pairs) - 1)).otherwise(pairs)
    parsed = F.filter(F.transform(whole, lambda p: F.struct(F.trim(F.substring_index(p, ": ", 1)).alias("k"), F.trim(F.regexp_replace(p, "^.*?: ", "")).alias("u"))), lambda x: x["u"].rlike("^https?://"))
    url = lambda k: F.get(F.filter(parsed, lambda x: x["k"] == k), F.lit(0))["u"]
    return F.transform(platforms, lambda k: F.struct(k.alias("platform"), url(k).alias("url")))


def data_providers(records: DataFrame) -> DataFrame:
    """(business_id, providers): distinct providers in the order in which records (place, payload JSON) name them."""
    own = F.from_json(F.get_json_object("payload", "$.attributions"), "array<struct<provider: string, providerUri: string>>")
    rows = records.select("business_id", "place", F.posexplode(own).alias("at", "p")).where("p.provider is not null").groupBy("business_id", "p.provider").agg(F.min(F.struct("place", "at")).alias("first"))
    return rows.groupBy("business_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "provider"))), lambda x: x["provider"]).alias("providers"))


ANSWER = "business_summary string, industry string, industry_matches_listing boolean, opportunities array<struct<service: string, confidence: double, rationale: string, evidence: array<struct<finding_code: string, quote: string, source_url: string>>>>, buying_intent string, unknowns array<string>, needs_human_review boolean"
_ANSWER_KEYS = ("business_summary", "industry", "industry_matches_listing", "opportunities", "buying_intent", "unknowns", "needs_human_review")


def parse_answers(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``answer`` and ``drift``: why a model's text is not the schema (extra keys count), else null."""
    parsed = raw.withColumn("answer", F.from_json(column, ANSWER + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    keys = F.json_object_keys(column)
    a = F.col("answer")
    broken = a["_bad"].isNotNull() | F.exists(F.coalesce(a["opportunities"], F.array()), lambda o: ~F.coalesce(o["confidence"].between(0, 1), F.lit(False)))
    drift = F.when(keys.isNull(), "not_json").when(F.size(F.array_except(keys, F.array(*map(F.lit, _ANSWER_KEYS)))) > 0, "extra_key").when(F.size(F.array_except(F.array(*map(F.lit, _ANSWER_KEYS)), keys)) > 0, "missing_key").when(broken | ~a["buying_intent"].isin("none_detected", "explicit"), "bad_value")
    return parsed.withColumn("drift", drift).withColumn("answer", F.when(F.col("drift").isNull(), F.col("answer").dropFields("_bad")))


def build_input(rows: DataFrame, limit: int = 6000) -> DataFrame:
    """(business_id, input JSON) of what a model may see: scrubbed of personal data, cut, without findings that nothing is sold for.

    ``rows``: (business_id, display_name, industry, city, state, website, address_line1, address_line2, postal_code,
    page_url, findings array of {code, message, evidence_text, evidence_url}, psi_score, platforms, page_text).
    """
    unsold = [code for code, _, service, _ in pages.CATALOGUE if service is None]
    known = F.array_compact(F.array("address_line1", "address_line2", "postal_code"))
    clean = lambda c: F.nullif(pii.scrub(c, known), F.lit(""))
    kept = F.filter("findings", lambda f: f["code"].isNotNull() & ~f["code"].isin(*unsold))
    told = F.transform(kept, lambda f: F.struct(f["code"].alias("code"), f["message"].alias("message"), clean(f["evidence_text"]).alias("evidence_text"), f["evidence_url"].alias("evidence_url")))
    body = F.struct(
        clean(F.col("display_name")).alias("business_name"), "industry", "city", "state", F.col("website").alias("website_url"), "page_url", told.alias("findings"), "psi_score",
        F.coalesce("platforms", F.array().cast("array<string>")).alias("tech_stack"), F.coalesce(clean(F.left(F.coalesce("page_text", F.lit("")), F.lit(limit))), F.lit("")).alias("page_text"), F.lit(limit).alias("page_text_limit"),
    )
    return rows.select("business_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("input"))


def lead_records(businesses: DataFrame, approved: DataFrame, origin: DataFrame, suppressed: DataFrame, base_url: str) -> DataFrame:
    """The 25 columns of a lead: one row for each business with an approved opportunity.

    ``approved``: (business_id, service_name, score, reason, decided_at, decided_by, note); ``origin``:
    (business_id, source, source_url, priority, first_discovered_at), if known with record_id, whose least one
    breaks ties, then source and source_url; ``suppressed``: (business_id).
    """
    row = F.struct((-F.col("score")).alias("s"), "service_name", "reason", "decided_at", "decided_by", "note")
    sold = approved.groupBy("business_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("score").alias("score"), F.max(F.when(F.col("decided_at").isNotNull(), F.struct("decided_at", "decided_by", "note"))).alias("last"))
    first = F.struct("priority", "first_discovered_at", *[c for c in ("record_id",) if c in origin.columns], "source", "source_url")
    came = origin.groupBy("business_id").agg(F.min_by(F.struct("source", "source_url"), first).alias("o"), F.min("first_discovered_at").alias("since"))
    out = businesses.join(sold, "business_id").join(came, "business_id", "left").join(suppressed.select("business_id", F.lit(True).alias("dnc")).distinct(), "business_id", "left")
    part = lambda c: F.transform("rows", lambda r: r[c])
    nothing = F.lit(None).cast("string")
    columns = {
        "business_key": F.col("business_id").cast("string"), "business_name": F.col("display_name"), "legal_name": F.col("legal_name"), "industry": text.humanize(F.col("industry")), "city": F.col("city"), "state": F.col("state"), "postal_code": F.col("postal_code"), "address": F.col("address_line1"), "website": F.col("website"), "public_phone": places.national(F.col("phone_e164")),
        "services": F.array_join(F.array_distinct(part("service_name")), "; "), "lead_score": F.round(F.col("score") * 100).cast("int"), "why_lead": text.clip(F.array_join(part("reason"), " "), 1000), "top_findings": F.array_join(F.slice("findings", 1, 3), "\n"), "source": text.humanize(F.col("o.source")), "source_url": F.col("o.source_url"),
        "lead_link": F.concat(F.lit(base_url.rstrip("/") + "/leads/"), F.col("business_id").cast("string")), "date_discovered": F.date_format("since", "yyyy-MM-dd"), "date_approved": F.date_format("last.decided_at", "yyyy-MM-dd"), "approved_by": F.col("last.decided_by"), "do_not_contact": F.coalesce("dnc", F.lit(False)),
        "assigned_rep": nothing, "status": F.lit("New"), "follow_up_date": nothing, "notes": F.col("last.note"),
    }
    return out.select(*[columns[c].alias(c) for c in LEAD_FIELDS])


def to_export(leads: DataFrame, batches: DataFrame, scope: str = "new") -> DataFrame:
    """Leads in no batch yet, or all, those never synced last."""
    rows = leads if scope == "all" else leads.join(batches.select("lead_id").distinct(), "lead_id", "left_anti")
    return rows.orderBy(F.col("last_synced_at").asc_nulls_last(), "lead_id")


def enqueued(requests: DataFrame) -> DataFrame:
    """Requests with one idempotency key are one run: the earliest."""
    rest = [c for c in requests.columns if c != "idempotency_key"]
    keyed = requests.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")).select("idempotency_key", "r.*").select(*requests.columns)
    return keyed.unionByName(requests.where("idempotency_key is null"))


def time_limit(businesses: Column, default: int = 3600, each: int = 210) -> Column:
    return F.greatest(F.lit(default), businesses * each)


def cron_from_time(at: str) -> str:
    """Cron entry of a time of day: ``07:30`` gives ``30 7 * * *``."""
    hours, minutes = (int(x) for x in at.split(":"))
    if not (0 <= hours < 24 and 0 <= minutes < 60):
        raise ValueError(f"{at} is no time of day")
    return f"{minutes} {hours} * * *"


def logic_version(rules_version: Column) -> Column:
    """The number of ``audit-N``; null for other texts."""
    return F.when(rules_version.rlike(r"^audit-\d+$"), F.regexp_extract(rules_version, r"(\d+)$", 1).cast("int"))


def industries(jobs: DataFrame) -> DataFrame:
    """(slug, text, label) of saved searches: the first text of each industry, by label."""
    rows = jobs.withColumn("slug", places.industry_from_text(F.col("industry")))
    return rows.groupBy("slug").agg(F.min_by("industry", F.struct("created_at", "id")).alias("text")).select("slug", "text", text.humanize(F.col("slug")).alias("label")).orderBy("label")


def estimate(spark: SparkSession, limit: int, businesses: int, price_per_call: float, calls_left: int) -> DataFrame:
    """One row: calls, cost and blockers of a run, before it starts."""
    calls = F.ceil(F.lit(limit) / 20)
    return spark.range(1).select(calls.alias("calls"), F.round(calls * price_per_call, 6).alias("cost"), F.lit(businesses).alias("audits"), time_limit(F.lit(businesses)).alias("seconds"), F.array_compact(F.array(F.when(calls > calls_left, "daily_cap"), F.when(F.lit(limit <= 0), "nothing_asked"))).alias("blockers"))
