"""From findings to leads: rule opportunities, merge with a model's answers, guardrails, review, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import pii, scores, text

# What may be sold, and which findings speak for it without a page having been read.
SERVICES = ("website_design", "seo_gbp", "booking_setup", "ai_chat_setup", "ads_social")
_SEVERITY_ORDER = ("high", "medium", "low", "info")
# Findings that name servers and the registry tell, never the page.
DOMAIN_CODES = ("domain_expired", "domain_no_a_record", "domain_expiring_soon", "multiple_spf_records", "spf_allows_all", "no_spf", "no_dmarc", "dmarc_policy_none", "no_domain_mx")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(_SEVERITY_ORDER)], F.lit(len(_SEVERITY_ORDER)))


def rule_opportunities(findings: DataFrame) -> DataFrame:
    """(business_id, service, confidence, reason, evidence) from rows (business_id, place, code, severity, service, message, evidence_text, evidence_url)."""
    base = F.coalesce(*[F.when(F.col("severity") == s, c) for s, c in scores.SEVERITY.items()], F.lit(0.0))
    row = F.struct("place", base.alias("c"), "message", F.struct("code", "evidence_text", "evidence_url").alias("e"))
    grouped = findings.where(F.col("service").isin(*SERVICES)).groupBy("business_id", "service").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    part = lambda name: F.transform("rows", lambda r: r[name])
    return grouped.select("business_id", "service", scores.combine(part("c")).alias("confidence"), F.array_join(part("message"), " ").alias("reason"), part("e").alias("evidence"))


def ads_social(audits: DataFrame) -> DataFrame:
    """Opportunities, as ``rule_opportunities`` gives them, of pages that were read and link to no social profile.

    ``audits``: (business_id, status, parsed, social_links, url). Unknown links tell nothing.
    """
    reason = "The homepage links to no social profile."
    evidence = F.array(F.struct(F.lit(None).cast("string").alias("code"), F.lit(reason).alias("evidence_text"), F.col("url").alias("evidence_url")))
    rows = audits.where((F.col("status") == "done") & F.col("parsed") & (F.size("social_links") == 0) & F.col("social_links").isNotNull())
    return rows.select("business_id", F.lit("ads_social").alias("service"), F.lit(scores.SOCIAL_CONFIDENCE).alias("confidence"), F.lit(reason).alias("reason"), evidence.alias("evidence"))


def merge(rules: DataFrame, model: DataFrame, answered: Column | None = None) -> DataFrame:
    """Rules and model answers by (business_id, service): the model may confirm, raise a little or add, never remove.

    ``ai_agrees`` is null for businesses the model gave no answer on (column ``answered`` false, if given).
    """
    m = model.select("business_id", "service", F.col("confidence").alias("said"), "rationale")
    both = rules.join(m, ["business_id", "service"], "full_outer")
    rule, ai = F.col("confidence"), F.col("said")
    raised = F.round(F.greatest(rule, F.least(ai, rule + scores.AI_RAISE)), 3)
    agrees = F.when(ai.isNotNull(), True).otherwise(F.lit(False)) if answered is None else F.when(ai.isNotNull(), True).when(answered, False)
    return both.select(
        "business_id", "service", F.when(rule.isNull(), "ai").when(ai.isNull(), "rules").otherwise("rules+ai").alias("source"), F.when(rule.isNull(), F.round(F.least(ai, F.lit(scores.AI_ONLY_MOST)), 3)).when(ai.isNull(), rule).otherwise(raised).alias("confidence"),
        F.nullif(F.trim(F.concat_ws(" ", "reason", F.nullif(F.col("rationale"), F.lit("")))), F.lit("")).alias("reason"), agrees.alias("ai_agrees"),
    )


def guarded(claims: DataFrame, corpus: Column, codes: Column) -> DataFrame:
    """Adds ``rejected`` to rows (service, confidence, rationale, quote, finding_code): the first rule broken, or null."""
    made_up = F.col("rationale").rlike(f"{pii.EMAIL}|{pii.PHONE}")
    return claims.withColumn(
        "rejected",
        F.when(~F.coalesce(F.col("service").isin(*SERVICES), F.lit(False)), "unknown_service").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence").when(F.col("finding_code").isNotNull() & ~F.array_contains(codes, F.col("finding_code")), "unknown_finding").when(~text.contains_quote(corpus, F.col("quote")), "quote_not_found").when(made_up, "personal_data"),
    )


def escalate(valid: Column, js_shell: Column, confidence: Column, industry_matches: Column) -> Column:
    """Reasons to ask a larger model; none is an empty array."""
    return F.array_compact(F.array(F.when(~valid, "schema_invalid"), F.when(js_shell, "js_shell"), F.when(confidence.between(0.40, 0.60), "unclear"), F.when(~industry_matches, "industry_mismatch")))


def withdrawn(opportunities: DataFrame) -> DataFrame:
    """Adds ``withdraw``: pending rows whose cited findings (``cited``) are all gone from the newest audit (``codes``)."""
    gone = (F.size("cited") > 0) & ~F.arrays_overlap("cited", "codes")
    return opportunities.withColumn("withdraw", F.coalesce((F.col("status") == "pending") & F.col("withdrawn_at").isNull() & gone, F.lit(False)))


def judged(rows: DataFrame) -> DataFrame:
    """Adds ``domain_codes``, ``page_codes``, ``rests_on_page`` and ``can_judge`` to rows (cited, audit_status, answered).

    An audit can judge a row if it looked at every kind of evidence that the row rests on: page evidence, or
    none at all, needs one that read the page; domain evidence needs an answer (``answered``) to each code cited.
    """
    known = F.array(*map(F.lit, DOMAIN_CODES))
    out = rows.withColumn("domain_codes", F.array_intersect("cited", known)).withColumn("page_codes", F.array_except("cited", known))
    out = out.withColumn("rests_on_page", (F.size("page_codes") > 0) | (F.size("cited") == 0))
    read = ~F.col("rests_on_page") | F.coalesce(F.col("audit_status").isin("done", "skipped"), F.lit(False))
    return out.withColumn("can_judge", read & (F.size(F.array_except("domain_codes", F.coalesce("answered", F.array().cast("array<string>")))) == 0))


def wrongly_withdrawn(rows: DataFrame, audits: DataFrame, live: DataFrame) -> DataFrame:
    """(id, held) of withdrawn rows whose reason names no audit that could judge them; ``held`` says why one stays so.

    ``rows``: (id, business_id, service, status, cited, withdrawn_reason, business_status); ``audits``: (audit_id,
    audit_status, answered); ``live``: (business_id, service) of rows that wait. Audits are named in the reason as
    36-digit ids.
    """
    ids = F.array_distinct(F.regexp_extract_all("withdrawn_reason", F.lit("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit(0)))
    named = rows.select("id", "cited", F.explode(ids).alias("audit_id")).join(audits, "audit_id")
    able = judged(named).groupBy("id").agg(F.every("can_judge").alias("fine"))
    open_pairs = live.select("business_id", "service", F.lit(True).alias("__live")).distinct()
    out = rows.join(able, "id", "left").join(open_pairs, ["business_id", "service"], "left").where(~F.coalesce("fine", F.lit(False)))
    held = F.when(F.col("fine").isNull(), "names no audit").when(F.col("business_status") == "closed_permanently", "closed").when((F.col("status") == "pending") & F.col("__live"), "a live row waits")
    return out.select("id", held.alias("held"))


def undo(requests: DataFrame, decisions: DataFrame, rows: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """(id, verdict, restore_to) for requests (id, actor, is_admin) to undo a decision.

    ``decisions``: (id, opportunity_id, decided_by, decided_at, undone_at, from_status, to_status); ``rows``:
    (opportunity_id, status). Of several reasons the first counts: not_found, already_undone, not_allowed,
    closed (the window has passed), conflict (the row has changed since), else ok with the status to restore.
    """
    joined = requests.alias("q").join(decisions.alias("d"), "id", "left").join(rows.alias("r"), "opportunity_id", "left")
    late = now > F.col("d.decided_at") + F.expr(f"interval {minutes} minutes")
    verdict = F.when(F.col("d.to_status").isNull(), "not_found").when(F.col("d.undone_at").isNotNull(), "already_undone").when(~F.col("q.is_admin") & ~F.col("d.decided_by").eqNullSafe(F.col("q.actor")), "not_allowed")
    verdict = verdict.when(late, "closed").when(~F.col("r.status").eqNullSafe(F.col("d.to_status")), "conflict").otherwise("ok")
    return joined.select("id", verdict.alias("verdict"), F.when(verdict == "ok", F.col("d.from_status")).alias("restore_to"))


def due_leads(leads: DataFrame, destination: str, now: Column, limit: int = 100) -> DataFrame:
    """The next scheduled deliveries to ``destination``: those due, earliest first, ``limit`` at most."""
    due = leads.where((F.col("status") == "scheduled") & (F.col("destination") == destination) & (F.col("due_at") <= now))
    return due.orderBy("due_at", "lead_id").limit(limit)


def carried(leads: DataFrame, links: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(lead_id, carried): the opportunities (id, service, score) that a lead delivers, best first."""
    rows = links.join(opportunities, links["opportunity_id"] == opportunities["id"]).join(leads.select("lead_id"), "lead_id")
    row = F.struct((-F.col("score")).alias("by"), "id", "service", "score")
    grouped = rows.groupBy("lead_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    return grouped.select("lead_id", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["service"].alias("service"), x["score"].alias("score"))).alias("carried"))


def upsert_opportunities(found: DataFrame, stored: DataFrame, blocked: DataFrame) -> DataFrame:
    """What to do with each found (business_id, service): update, revive, skip or create.

    ``stored`` has one open row at most for each pair (status, withdrawn_at); ``blocked`` pairs are approved
    or cooling down and get no new row.
    """
    s = stored.where("status = 'pending'").select("business_id", "service", F.lit(True).alias("open"), F.col("withdrawn_at").isNotNull().alias("was_withdrawn"))
    b = blocked.select("business_id", "service", F.lit(True).alias("blocked")).distinct()
    joined = found.join(s, ["business_id", "service"], "left").join(b, ["business_id", "service"], "left")
    return joined.select(*found.columns, F.when(F.col("open") & F.col("was_withdrawn"), "revive").when(F.col("open"), "update").when(F.col("blocked"), "skip").otherwise("create").alias("action"))


def pending(opportunities: DataFrame) -> DataFrame:
    """Of each business and service the open row to write to: a live pending one, else a withdrawn pending one, else one that
    needs enrichment; of equals the newest, then the last id."""
    rank = F.when(F.col("status") == "pending", F.when(F.col("withdrawn_at").isNull(), 0).otherwise(1)).otherwise(2)
    rows = opportunities.where(F.col("status").isin("pending", "needs_enrichment"))
    rest = [c for c in opportunities.columns if c not in ("business_id", "service")]
    best = rows.groupBy("business_id", "service").agg(F.max_by(F.struct(*rest), F.struct((-rank).alias("rank"), F.col("created_at").alias("at"), F.col("id").alias("last"))).alias("r"))
    return best.select("business_id", "service", "r.*").select(*opportunities.columns)


def approved(opportunities: DataFrame, limit: int, after: DataFrame | None = None) -> DataFrame:
    """A page of the approved list, last decided first; withdrawn ones stay in it. ``after``: one row (decided_at, id) of the page before."""
    rows = opportunities.where("status = 'approved'")
    if after is not None:
        cursor = F.broadcast(after.select(F.struct("decided_at", "id").alias("__cursor")).limit(1))
        rows = rows.crossJoin(cursor).where(F.struct("decided_at", "id") < F.col("__cursor")).drop("__cursor")
    return rows.orderBy(F.desc("decided_at"), F.desc("id")).limit(limit)


def blocked_services(decisions: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(business_id, service, why): approved, or rejected fewer than ``days`` ago; approval wins."""
    why = F.when(F.col("status") == "approved", "approved").when((F.col("status") == "rejected") & (F.col("decided_at") > now - F.expr(f"interval {days} days")), "cooldown")
    return decisions.withColumn("why", why).where("why is not null").groupBy("business_id", "service").agg(F.min("why").alias("why"))


def decide(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdict for each requested id once: not_found, withdrawn, stale (version moved on), closed, or ok."""
    asked = requests.groupBy("id").agg(F.max("version").alias("version"))
    joined = asked.alias("q").join(rows.alias("r"), "id", "left")
    verdict = F.when(F.col("r.status").isNull(), "not_found").when(F.col("r.withdrawn_at").isNotNull(), "withdrawn").when(F.col("r.version") != F.col("q.version"), "stale").when(F.col("r.status") != "pending", "closed").otherwise("ok")
    return joined.select("id", verdict.alias("verdict"))


def sync_action(leads: DataFrame, now: Column, delay_minutes: int = 30) -> DataFrame:
    """Adds ``action`` to rows (suppressed, approved, decided_at, external_id, sent_hash, new_hash)."""
    early = F.col("decided_at") + F.expr(f"interval {delay_minutes} minutes") > now
    return leads.withColumn(
        "action", F.when(F.col("suppressed"), "mark_do_not_contact").when(~F.col("approved"), F.when(F.col("external_id").isNotNull(), "withdraw").otherwise("skip")).when(early, "reschedule").when(F.col("external_id").isNull(), "create").when(F.col("sent_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("update")
    )


def after_failure(attempts: DataFrame, now: Column, base_seconds: int = 60, most: int = 5) -> DataFrame:
    """Adds ``next_status`` and ``due_at`` to failed rows (attempts, retryable)."""
    again = F.col("retryable") & (F.col("attempts") < most)
    wait = scores.doubling_backoff(F.lit(base_seconds), F.col("attempts"))
    return attempts.withColumn("next_status", F.when(again, "scheduled").otherwise("held")).withColumn("due_at", F.when(again, F.timestamp_seconds(F.unix_timestamp(now) + wait)))


def alerts(conditions: DataFrame, opened: DataFrame) -> DataFrame:
    """(rule, action): raise, refresh or clear, from firing conditions (rule, details) and open alerts (rule)."""
    joined = conditions.select("rule", F.lit(True).alias("fires")).distinct().join(opened.select("rule", F.lit(True).alias("stands")).distinct(), "rule", "full_outer")
    return joined.select("rule", F.when(F.col("stands").isNull(), "raise").when(F.col("fires").isNull(), "clear").otherwise("refresh").alias("action"))


def previous_decision(decisions: DataFrame) -> DataFrame:
    """Adds ``previous``: the decision before each one that stands, per opportunity by (decided_at, id)."""
    w = Window.partitionBy("opportunity_id").orderBy("decided_at", "id")
    return decisions.where(~F.coalesce(F.col("undone"), F.lit(False))).withColumn("previous", F.lag("decision").over(w))


_TRANSITIONS = {"queued": ("running", "cancelled", "failed"), "running": ("done", "failed", "cancelled", "queued"), "failed": ("queued",), "done": (), "cancelled": ()}


def transitions(moves: DataFrame) -> DataFrame:
    """Adds ``allowed`` to rows (status, wanted) of job runs."""
    pairs = [f"{a}>{b}" for a, to in _TRANSITIONS.items() for b in to]
    return moves.withColumn("allowed", F.concat_ws(">", "status", "wanted").isin(*pairs))
