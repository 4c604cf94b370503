"""What a reviewer reads: filtered lists, the queue with its pages, one business in detail, suppressions.

Tables: ``businesses`` (business_id, created_at, display_name, normalized_name, domain, phone_e164, website, website_kind,
business_status, industry, city, state, user_rating_count), ``opportunities`` (id, business_id, service, score, confidence,
source, status, withdrawn_at, created_at), ``audits`` (id, business_id, created_at, status, findings: array of structs with
code, severity, service), ``records`` (business_id, source, first_discovered_at), ``suppressions`` (business_id, domain,
phone_e164, lifted_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.scores import WEAK
from tamarack.operators.leads import severity_rank
from tamarack.operators.relational import any_key_anti, keyset_page, keyset_page_nulls_last, newest

TOP = 3


def _filtered(df: DataFrame, **by: tuple[str, object, str]) -> DataFrame:
    """Conditions joined by AND; those whose value is None are left out."""
    for column, value, kind in by.values():
        if value is None:
            continue
        c = F.col(column)
        df = df.where({"eq": lambda c=c, v=value: c == v, "lower": lambda c=c, v=value: F.lower(c) == str(v).lower(), "upper": lambda c=c, v=value: F.upper(c) == str(v).upper(), "least": lambda c=c, v=value: c >= v, "known": lambda c=c, v=value: c.isNotNull() if v else c.isNull()}[kind]())
    return df


def _searched(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Rows with ``q`` in a column, in any case; % and _ in it are wildcards."""
    if not q:
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(c, F.lit(""))).like(f"%{q.strip().lower()}%")
    return df.where(found)


def latest_audits(audits: DataFrame) -> DataFrame:
    return newest(audits, "business_id", ["created_at", "id"])


def with_findings(businesses: DataFrame, audits: DataFrame, codes: tuple[str, ...] = (), audit_status: str | None = None) -> DataFrame:
    """Businesses whose newest audit has all of the codes, and the status if one is given."""
    if not codes and audit_status is None:
        return businesses
    has = lambda code: lambda f: f["code"] == code
    last = latest_audits(audits)
    for code in codes:
        last = last.where(F.exists("findings", has(code)))
    return businesses.join(_filtered(last, s=("status", audit_status, "eq")).select("business_id"), "business_id", "left_semi")


def list_businesses(
    businesses: DataFrame, audits: DataFrame, *, industry: str | None = None, city: str | None = None, state: str | None = None, has_website: bool | None = None, website_kind: str | None = None, business_status: str | None = None,
    q: str | None = None, finding: tuple[str, ...] = (), audit_status: str | None = None, limit: int = 50, after: tuple | None = None,
) -> DataFrame:
    """Newest first; ``limit`` + 1 rows."""
    rows = _filtered(businesses, a=("industry", industry, "eq"), b=("city", city, "lower"), c=("state", state, "upper"), d=("website", has_website, "known"), e=("website_kind", website_kind, "eq"), f=("business_status", business_status, "eq"))
    rows = with_findings(_searched(rows, q, "display_name", "normalized_name"), audits, finding, audit_status)
    return keyset_page(rows, ["created_at", "business_id"], limit, after)


def list_opportunities(
    opportunities: DataFrame, businesses: DataFrame, *, service: str | None = None, status: str | None = "pending", include_withdrawn: bool = False, min_score: float | None = None, industry: str | None = None, city: str | None = None, state: str | None = None,
    source: str | None = None, business_id: object = None, sort: str = "score", limit: int = 50, after: tuple | None = None,
) -> DataFrame:
    """Best or newest first; ``limit`` + 1 rows."""
    rows = opportunities if include_withdrawn else opportunities.where("withdrawn_at is null")
    rows = _filtered(rows, a=("service", service, "eq"), b=("status", status, "eq"), c=("score", min_score, "least"), d=("source", source, "eq"), e=("business_id", business_id, "eq"))
    own = _filtered(businesses.select("business_id", "display_name", "industry", "city", "state"), a=("industry", industry, "lower"), b=("city", city, "lower"), c=("state", state, "upper"))
    return keyset_page(rows.join(own, "business_id"), ["created_at" if sort == "created_at" else "score", "id"], limit, after)


def not_suppressed(businesses: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Businesses that no active suppression matches by id, domain or phone."""
    active = suppressions.where("lifted_at is null")
    return any_key_anti(businesses, active, [("business_id", "business_id"), ("domain", "domain"), ("phone_e164", "phone_e164")])


def discovered_within(businesses: DataFrame, records: DataFrame, since: Column) -> DataFrame:
    """Businesses first found since then; those without a record are not."""
    first = records.groupBy("business_id").agg(F.min("first_discovered_at").alias("first")).where(F.col("first") >= since)
    return businesses.join(first.select("business_id"), "business_id", "left_semi")


def finding_counts(businesses: DataFrame, audits: DataFrame) -> DataFrame:
    """(code, n): of how many of the businesses the newest audit has it."""
    last = latest_audits(audits.join(businesses.select("business_id"), "business_id", "left_semi"))
    return last.select("business_id", F.explode("findings.code").alias("code")).where("code is not null").groupBy("code").agg(F.countDistinct("business_id").alias("n"))


def queue(
    businesses: DataFrame, opportunities: DataFrame, suppressions: DataFrame, audits: DataFrame, records: DataFrame, *, status: str = "pending", service: str | None = None, city: str | None = None, state: str | None = None, industry: str | None = None, min_score: float | None = None,
    include_weak: bool = False, q: str | None = None, since: Column | None = None, badge: str | None = None, sort: str = "score", descending: bool = True, limit: int = 50, after: tuple | None = None,
) -> DataFrame:
    """A page of the review queue (``limit`` + 1 rows) with its opportunities, sources and ranked findings.

    A business shows its best score among what is shown; ``service`` picks businesses, not opportunities. Ranks
    of findings count over all that pass the filters, so they do not change from page to page.
    """
    strong = F.col("confidence") >= WEAK
    shown = F.lit(True) if include_weak else strong
    live = opportunities.where((F.col("status") == status) & F.col("withdrawn_at").isNull())
    own = F.struct((-F.col("score")).alias("by"), F.col("id").alias("id"), "service", "score", "confidence")
    grouped = live.groupBy("business_id").agg(F.max(F.when(shown, F.col("score"))).alias("top_score"), F.count_if(~shown).alias("weak_hidden"), F.bool_or(F.col("service") == (service or "")).alias("__has"), F.array_sort(F.collect_list(F.when(shown, own))).alias("open"))
    grouped = grouped.where("top_score is not null")
    grouped = (grouped.where("__has") if service else grouped).drop("__has")
    badges = {"no_website": ("website_kind", "none", "eq"), "closed_permanently": ("business_status", "closed_permanently", "eq")}
    rows = _filtered(businesses, a=("city", city, "lower"), b=("state", state, "upper"), c=("industry", industry, "lower"), **({"d": badges[badge]} if badge else {}))
    rows = not_suppressed(_searched(rows, q, "display_name", "domain"), suppressions)
    rows = rows if since is None else discovered_within(rows, records, since)
    passed = _filtered(rows.join(grouped, "business_id"), a=("top_score", min_score, "least"))
    rarity = finding_counts(passed, audits)
    page = keyset_page_nulls_last(passed, "top_score" if sort == "score" else "user_rating_count", "business_id", limit, after, descending)
    last = latest_audits(audits.join(page.select("business_id"), "business_id", "left_semi"))
    found = last.select("business_id", F.inline("findings")).where("code is not null").join(rarity, "code", "left")
    found = found.groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), F.coalesce("n", F.lit(0)).alias("n"), "code", "severity", F.col("service").isNull().alias("context")))).alias("findings"))
    sources = records.join(page.select("business_id"), "business_id", "left_semi").groupBy("business_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return page.join(found, "business_id", "left").join(sources, "business_id", "left")


def top_findings(findings: Column, sellable_only: bool = False) -> Column:
    """The first three codes by severity; equal ones in the order in which they were told."""
    own = F.filter(findings, lambda f: f["code"].isNotNull() & (f["service"].isNotNull() if sellable_only else F.lit(True)))
    ranked = F.array_sort(F.transform(own, lambda f, i: F.struct(severity_rank(f["severity"]).alias("r"), i.alias("i"), f["code"].alias("code"))))
    return F.transform(F.slice(ranked, 1, TOP), lambda x: x["code"])


def badges(website_kind: Column, business_status: Column) -> Column:
    """What a listing shows at a glance."""
    return F.array_compact(F.array(F.when(website_kind == "none", "no_website"), F.when(business_status == "closed_permanently", "closed_permanently")))


def finding_count(status: Column, findings: Column) -> Column:
    """Number of findings with a code; null if nothing was read."""
    return F.when(status.isin("done", "skipped"), F.size(F.filter(findings, lambda f: f["code"].isNotNull())))


def detail(business_id: object, businesses: DataFrame, opportunities: DataFrame, decisions: DataFrame, audits: DataFrame) -> DataFrame:
    """One row: the business, its opportunities best first with their decisions newest first, and its newest audit."""
    history = decisions.groupBy("opportunity_id").agg(F.sort_array(F.collect_list(F.struct("decided_at", F.col("id").alias("decision_id"), "decision")), asc=False).alias("history"))
    rows = opportunities.where(F.col("business_id") == F.lit(business_id)).join(history, F.col("id") == F.col("opportunity_id"), "left")
    own = rows.groupBy("business_id").agg(F.sort_array(F.collect_list(F.struct("score", "created_at", "id", "service", "status", "history")), asc=False).alias("opportunities"))
    last = latest_audits(audits.where(F.col("business_id") == F.lit(business_id))).select("business_id", F.col("status").alias("audit_status"), "findings")
    return businesses.where(F.col("business_id") == F.lit(business_id)).join(own, "business_id", "left").join(last, "business_id", "left")


def orphans(opportunities: DataFrame, audits: DataFrame, judged: tuple[str, ...] = ("done", "skipped")) -> DataFrame:
    """Open or approved rows whose cited findings (``cited``) the newest audit no longer has; ``withdraw`` for pending ones of an audit that can judge."""
    last = latest_audits(audits).select("business_id", F.col("status").alias("audit_status"), F.transform("findings", lambda f: f["code"]).alias("codes"))
    rows = opportunities.where(F.col("status").isin("pending", "needs_enrichment", "approved") & F.col("withdrawn_at").isNull()).join(last, "business_id")
    return rows.where((F.size("cited") > 0) & ~F.arrays_overlap("cited", "codes")).withColumn("withdraw", (F.col("status") == "pending") & F.col("audit_status").isin(*judged)).drop("codes")


def lifted(suppressions: DataFrame, ids: list, now: Column) -> DataFrame:
    """Suppressions with those of ``ids`` lifted; one that is lifted keeps its time."""
    return suppressions.withColumn("lifted_at", F.when(F.col("id").isin(*ids), F.coalesce("lifted_at", now)).otherwise(F.col("lifted_at")))
