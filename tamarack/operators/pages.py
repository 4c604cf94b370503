"""Page analytics: an HTML page to checks, checks to findings.

A page is parsed once, with the standard library's parser, in Arrow batches; what follows from its checks
is a list of conditions over columns, so rules stay in Spark. False says looked and absent, null not known.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tamarack.functions import signatures, structured, web
from tamarack.session import ship

# Limits of the findings.
SHORT_TITLE, LONG_TITLE, THIN_WORDS, STALE_YEARS, SHELL_TEXT, SHELL_SCRIPTS = 20, 60, 200, 3, 200, 5
SLOW_SCORE, QUALITY_SCORE, QUALITY_MEDIUM, FEW_REVIEWS, FIRST_YEAR, YEARS_AHEAD = 50, 90, 70, 20, 1995, 30
# Titles that templates ship with.
TEMPLATE_TITLES = (
    "home", "homepage", "home page", "welcome", "untitled", "untitled document", "untitled page", "site", "my site", "my website", "website", "my wordpress site", "wordpress", "just another wordpress site",
    "new page", "new site", "index", "business", "my business", "company", "page", "default", "blank", "document", "main", "coming soon", "under construction", "react app",
)
# Finding code, severity, service (None: none is sold for it); then our wording, {} for what was found.
CATALOGUE = (
    ("no_website", "high", "website_design", "The listing gives no website."),
    ("social_profile_only", "high", "website_design", "The listing gives a social profile where a website would be."),
    ("unreachable", "high", "website_design", "The homepage did not load: {}."),
    ("no_https", "high", "website_design", "The homepage is served without https."),
    ("tls_invalid", "high", "website_design", "The certificate of the homepage could not be verified: {}."),
    ("builder_subdomain", "medium", "website_design", "The homepage is on a subdomain of a website builder, {}."),
    ("site_builder", "low", "website_design", "The homepage is made with a website builder: {}."),
    ("no_mobile_viewport", "high", "website_design", "The homepage has no viewport tag for phones."),
    ("viewport_blocks_zoom", "medium", "website_design", "The viewport tag keeps visitors on phones from zooming: {}."),
    ("missing_title", "medium", "seo_gbp", "The homepage has no title."),
    ("default_title", "medium", "seo_gbp", "The title is one that templates ship with: {}."),
    ("short_title", "low", "seo_gbp", "The title is short: {}."),
    ("long_title", "low", "seo_gbp", "The title is long: {}."),
    ("missing_meta_description", "medium", "seo_gbp", "The homepage has no description for search engines."),
    ("no_h1", "low", "seo_gbp", "The homepage has no main heading."),
    ("multiple_h1", "low", "seo_gbp", "The homepage has several main headings: {}."),
    ("no_structured_data", "low", "seo_gbp", "The homepage has no structured data."),
    ("no_local_business_schema", "low", "seo_gbp", "The structured data names no local business: {}."),
    ("invalid_structured_data", "medium", "seo_gbp", "A block of structured data cannot be read."),
    ("nap_phone_mismatch", "low", "seo_gbp", "The phone number of the page is not the listing's: {}."),
    ("listing_website_http", "low", "seo_gbp", "The listing links to http where the site answers on https: {}."),
    ("listing_website_host_mismatch", "low", "seo_gbp", "The listing's link and the site differ in www: {}."),
    ("no_online_booking", "medium", "booking_setup", "The homepage offers no online booking."),
    ("no_live_chat", "medium", "ai_chat_setup", "The homepage has no live chat."),
    ("no_contact_on_homepage", "high", "website_design", "The homepage has neither a phone link nor a mail link nor a form."),
    ("no_click_to_call", "medium", "website_design", "The homepage has no phone link."),
    ("placeholder_email", "high", "website_design", "The homepage links to a template's mail address: {}."),
    ("placeholder_text", "medium", "website_design", "The homepage shows a template's text: {}."),
    ("images_without_alt", "low", "website_design", "Images without a text alternative: {}."),
    ("unlabelled_form_fields", "low", "website_design", "Form fields without a label: {}."),
    ("thin_content", "low", "seo_gbp", "The homepage has little text, in words: {}."),
    ("no_section_headings", "low", "seo_gbp", "The homepage has no headings below the main one."),
    ("heading_level_skipped", "low", "website_design", "Heading levels are skipped: {}."),
    ("stale_copyright", "low", "website_design", "The copyright notice is old: {}."),
    ("future_copyright", "medium", "website_design", "The copyright notice is of a year to come: {}."),
    ("slow_mobile", "medium", "website_design", "The page is slow on phones, with a score of {}."),
    ("low_accessibility_score", "low", "website_design", "The accessibility score is low: {}."),
    ("low_best_practices_score", "low", "website_design", "The score for good practice is low: {}."),
    ("js_shell_suspected", "info", None, "The homepage seems to be built by scripts, so its text was not seen."),
    ("few_reviews", "low", "seo_gbp", "The listing has few reviews: {}."),
    ("robots_blocked", "info", None, "The site asks not to be read: {}."),
    ("domain_expired", "high", "website_design", "The domain has expired."),
    ("domain_no_a_record", "high", "website_design", "The domain has no address record."),
    ("domain_expiring_soon", "medium", "website_design", "The domain expires soon."),
    ("multiple_spf_records", "medium", None, "The domain has several SPF records."),
    ("spf_allows_all", "medium", None, "The SPF record lets anyone send mail."),
    ("no_spf", "low", None, "The domain has no SPF record."),
    ("no_dmarc", "low", None, "The domain has no DMARC record."),
    ("dmarc_policy_none", "low", None, "The DMARC policy asks for nothing."),
    ("no_domain_mx", "low", None, "The domain has no mail server."),
)
# Findings that an audit of this status may contribute; other statuses keep all.
DOMAIN_FINDINGS = ("domain_expired", "domain_no_a_record", "domain_expiring_soon")
ALLOWED = {
    "unreachable": ("unreachable", "tls_invalid", "few_reviews", *DOMAIN_FINDINGS),
    "not_readable": ("listing_website_http", "listing_website_host_mismatch", *DOMAIN_FINDINGS),
    "bot_challenge": DOMAIN_FINDINGS,
}
_SILENT = {"script", "style", "noscript", "template", "svg"}
_MARK = r"(?:©|&copy;|\(c\)|copyright)"
_NOTICE = re.compile(rf"{_MARK}(?:\s*{_MARK})*(?P<gap>[^0-9]{{0,40}})(?P<year>\d{{4}})(?!\d)(?:\s*[-–—](?:\s*(?P<last>\d{{4}})(?!\d)|(?P<open>(?!\s*\d))))?", re.I)
_BESIDE = re.compile(rf"{_MARK}\s*$", re.I)
#: Characters of a copyright notice that are shown.
NOTICE = 160

CHECKS = (
    "title string, meta_description string, viewport_meta boolean, viewport_zoom_blocked string, canonical string, h1_count int, heading_skips int, section_headings int, "
    "word_count int, tel_link boolean, tel_numbers array<string>, mailto_address string, placeholder_email boolean, contact_form boolean, booking boolean, booking_label string, "
    "booking_method string, booking_evidence string, booking_target string, live_chat boolean, chat_evidence string, social_links array<string>, tech array<string>, "
    "builder string, builder_evidence string, structured_types array<string>, local_business boolean, broken_structured_data boolean, copyright_year int, copyright_open boolean, "
    "business struct<syntax: string, type: string, name: string, phone: string, street: string, locality: string, region: string, postal_code: string, country: string, address_text: string, hours: array<string>, same_as: array<string>>, "
    "businesses int, booking_flow string, booking_onward string, "
    "copyright_evidence string, placeholder_text string, images_without_alt int, unlabelled_inputs int, scripts int, links int, js_shell boolean, lang string, html_bytes int, title_markup string"
)


@dataclass
class Click:
    """What a visitor clicks: its start tag, where it leads, and what it says (its words, else its label)."""

    tag: str
    href: str | None
    is_link: bool
    label: str
    words: list[str] = field(default_factory=list)

    @property
    def says(self) -> str:
        return " ".join(" ".join(self.words).split()) or self.label


class Page(HTMLParser):
    """Collects in one pass what the checks ask for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.open: list[str] = []
        self.title: str | None = None
        #: Where the first title begins and its text ends: line, column, and length of the tag before the text.
        self.titled: list[tuple[int, int, int]] = []
        self.meta: dict[str, str] = {}
        self.levels: list[int] = []
        self.hrefs: list[str] = []
        #: Start tags as written, and with the address that they embed or link to.
        self.tags: list[str] = []
        self.leads: list[tuple[str, str]] = []
        self.clicks: list[Click] = []
        self.inside: list[tuple[str, Click | None]] = []
        self.footer, self.footers = 0, []
        self.blocks: list[str] = []
        self.scopes = structured.Scopes()
        self.labelled: set[str] = set()
        self.inputs: list[tuple[str, bool]] = []
        #: Fields that ask for something: kind, words of its attributes, start tag; and choices, with their options.
        self.fields: list[tuple[str, str, str]] = []
        self.choices: list[list] = []
        self.form = self.canonical = self.lang = None
        self.images = self.scripts = 0
        self.block: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        written, kind = self.get_starttag_text() or "", a.get("type", "").lower()
        self.tags.append(written)
        self.scopes.start(tag, a)
        if tag in _SILENT or tag in ("title", "label"):
            self.open.append(tag)
        if tag == "title" and not self.titled:
            self.titled.append((*self.getpos(), len(written)))
        if address := a.get("src" if tag in ("iframe", "script") else "href" if tag in ("a", "link") else ""):
            self.leads.append((address.strip(), written))
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "meta" and (name := (a.get("name") or a.get("property", "")).lower()):
            self.meta.setdefault(name, a.get("content", ""))
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = self.canonical or a.get("href")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.levels.append(int(tag[1]))
        elif tag == "a" and "href" in a:
            self.hrefs.append(a["href"].strip())
        elif tag == "footer":
            self.footer += 1
        elif tag == "form":
            self.form = True
        elif tag == "img" and "alt" not in a:
            self.images += 1
        elif tag == "option" and self.choices:
            self.choices[-1][2] += 1
        elif tag == "script":
            self.scripts += 1
            if kind.split(";")[0].strip() == "application/ld+json":
                self.block = []
        elif tag == "label" and "for" in a:
            self.labelled.add(a["for"])
        elif tag in ("input", "select", "textarea") and a.get("type", "text").lower() not in ("hidden", "submit", "button", "image", "reset"):
            self.inputs.append((a.get("id", ""), "label" in self.open or bool(a.get("aria-label") or a.get("aria-labelledby") or a.get("title"))))
        if tag in ("input", "select") and kind != "hidden":
            self.fields.append((kind, " ".join(a.get(k, "") for k in ("name", "id", "placeholder", "aria-label", "class")).lower(), written))
        if tag == "select":
            self.choices.append([" ".join(a.get(k, "") for k in ("name", "id", "aria-label")), written, 0])
        self._click(tag, a, written, kind)

    def _click(self, tag: str, a: dict[str, str], written: str, kind: str) -> None:
        click = None
        if tag in ("a", "button") or tag == "input" and kind in ("submit", "button") or a.get("role", "").lower() == "button":
            own = a.get("href") if tag == "a" else None
            around = next((c.href for _, c in reversed(self.inside) if c and c.is_link), None)
            click = Click(written, own or around, bool(own), next((v.strip() for k in ("aria-label", "title", "value") if (v := a.get(k))), ""))
            self.clicks.append(click)
        if tag not in structured.VOID and (click or self.inside):
            self.inside.append((tag, click))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and len(self.titled) == 1:
            self.titled.append((*self.getpos(), 0))
        self.scopes.end(tag)
        self.footer -= tag == "footer" and self.footer > 0
        if any(t == tag for t, _ in self.inside):
            while self.inside and self.inside.pop()[0] != tag:
                pass
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if tag == "script" and self.block is not None:
            self.blocks.append("".join(self.block))
            self.block = None

    def handle_data(self, data: str) -> None:
        if self.block is not None:
            self.block.append(data)
        elif "title" in self.open:
            self.title = (self.title or "") + data
        elif not any(t in _SILENT for t in self.open):
            self.text.append(data)
            self.scopes.data(data)
            for _, click in self.inside:
                if click:
                    click.words.append(data)
            if self.footer:
                self.footers.append(" ".join(data.split()))


def json_ld_types(text: str) -> tuple[list[str], bool]:
    """Types in a JSON-LD block, depth first through lists and @graph, and whether it is broken."""
    nodes, broken = structured.json_ld_nodes(text)
    return [t for node in nodes for t in structured.node_types(node)], broken


def copyright_year(text: str, year: int = 2026) -> tuple[int | None, bool, str | None]:
    """(latest year of a notice, whether a range has no end, the line): no year without a notice or with an open range.

    A year is four digits. One to come counts only right after the mark, as others are house numbers and such.
    """
    best: tuple[int | None, bool, str | None] = (None, False, None)
    for notice in _NOTICE.finditer(text):
        line = textwrap.shorten(text[notice.start() : notice.start() + NOTICE + 1], NOTICE, placeholder="")
        if notice["open"] is not None:
            return None, True, line
        beside = not notice["gap"].strip() or _BESIDE.search(notice["gap"])
        latest = year + YEARS_AHEAD if beside else year
        said = [int(y) for y in (notice["year"], notice["last"]) if y and FIRST_YEAR <= int(y) <= latest]
        if said and max(said) > (best[0] or 0):
            best = max(said), False, line
    return best


def booking(page: Page, markup: str, url: str) -> dict:
    """How the page takes bookings, surest first: a widget, a link to a booking tool, a link that says so, a path that does.

    The last two are only to be followed, so ``booking`` is null; links back to the page itself count for nothing.
    """
    out = dict.fromkeys(("booking", "booking_label", "booking_method", "booking_evidence", "booking_target"))
    if widget := signatures.hits(markup, page.tags, signatures.BOOKING):
        return out | {"booking": True, "booking_label": widget[0][1], "booking_method": "widget", "booking_evidence": widget[0][2]}
    links = [c for c in page.clicks if c.is_link]
    for link in links:
        where = signatures.target(url, link.href)
        if where and (tool := signatures.booking_host(where)):
            return out | {"booking": True, "booking_label": tool, "booking_method": "booking_host", "booking_evidence": link.tag[: signatures.QUOTE], "booking_target": where}
    back = None
    steps = [("cta", f"link text: {c.says}", c) for c in page.clicks if any(p.search(c.says.lower()) for p in signatures.BOOKING_WORDS)]
    steps += [("path", f"link href: {c.href.strip()}", c) for c in links if signatures.is_booking_path(c.href)]
    for method, label, click in steps:
        where = signatures.target(url, click.href) if click.href else None
        if where and signatures.same_page(where, url):
            back = back or f"{label} leads back to this page"
            continue
        return out | {"booking_label": label, "booking_method": method, "booking_evidence": click.tag[: signatures.QUOTE], "booking_target": where}
    return out | {"booking": False, "booking_evidence": back}


def booking_flow(page: Page, markup: str, url: str) -> str | None:
    """What shows that visitors can book on this page: a booking tool that serves it or stands in it, or a field for a day or an hour."""
    if tool := signatures.booking_host(url):
        return f"served by {tool}"
    for address, tag in page.leads:
        if (where := signatures.target(url, address)) and (tool := signatures.booking_host(where)):
            return f"leads to {tool}: {tag[: signatures.QUOTE]}"
    if widget := signatures.hits(markup, page.tags, signatures.BOOKING):
        return f"widget of {widget[0][1]}"
    return next((f"field for a day or an hour: {tag[: signatures.QUOTE]}" for kind, words, tag in page.fields if kind in signatures.DATE_TYPES or signatures.DATE_WORD.search(words)), None)


def booking_onward(page: Page, url: str) -> str | None:
    """Where a page without a booking flow leads on to one: a link that speaks of booking, or a choice of branches."""
    said = lambda text, words: not set(re.findall("[a-z]+", text.lower())).isdisjoint(words)
    branches = {}
    for click in page.clicks:
        where = signatures.target(url, click.href) if click.is_link else None
        if not where or signatures.same_page(where, url) or signatures.never_booking(where) or signatures.social_platform(where):
            continue
        if said(f"{click.says} {where}", signatures.ONWARD_WORDS):
            return f"leads on to {where}"
        if said(f"{click.says} {where}", signatures.BRANCH_WORDS):
            branches[where] = click
    if len(branches) > 1:
        return f"choice of branches: {next(iter(branches))}"
    return next((f"choice of branches: {tag[: signatures.QUOTE]}" for words, tag, options in page.choices if options > 1 and said(words, signatures.BRANCH_WORDS)), None)


def placeholder_text(page: Page, text: str) -> str | None:
    """A phrase that templates print: some anywhere, others in short pieces of the footer or after a copyright mark."""
    low = text.lower()
    if found := next((p for p in signatures.PAGE_PHRASES if p in low), None):
        return found
    lines = [f.lower() for f in page.footers if len(f) <= 60] + [low[m.end() : m.end() + 80] for m in re.finditer(_MARK, low)]
    return next((p for p in signatures.FOOTER_PHRASES if any(re.search(rf"(?<!\w){p}(?!\w)", line) for line in lines)), None)


def zoom_blocked(viewport: str | None) -> str | None:
    """The part of a viewport tag that keeps visitors from zooming."""
    for part in re.split(r"[,;]", viewport or ""):
        name, _, value = (x.strip().lower() for x in part.partition("="))
        if name == "user-scalable" and value in ("no", "0") or name == "maximum-scale" and re.fullmatch(r"\d+(\.\d*)?", value) and float(value) < 1.5:
            return part.strip()
    return None


def _place(html: str, line: int, column: int, length: int) -> int:
    """The index of what the parser found at a line and column, and ``length`` after it; lines end at line feeds alone."""
    return sum(len(x) + 1 for x in html.split("\n", line - 1)[: line - 1]) + column + length


def checks_of(html: str, url: str = "", year: int = 2026) -> dict:
    page = Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # markup that the parser gives up on: what was read so far counts
        pass
    text = " ".join(" ".join(page.text).split())
    markup = html.lower()
    viewport = page.meta.get("viewport")
    types, local, broken = structured.read(page.blocks, page.scopes.finish())
    mails = [m.strip() for h in page.hrefs if h.lower().startswith("mailto:") for m in h[7:].split("?")[0].split(",") if "@" in m]
    mail = next((m for m in mails if signatures.placeholder_email(m)), mails[0] if mails else None)
    numbers = dict.fromkeys(h[4:].split("?")[0].strip() for h in page.hrefs if h.lower().startswith("tel:"))
    chat, builder = (signatures.hits(markup, page.tags, marks) for marks in (signatures.CHAT, signatures.BUILDERS))
    noted, open_range, line = copyright_year(text, year)
    return booking(page, markup, url) | {
        "title": " ".join((page.title or "").split()) or None,
        "title_markup": html[slice(*[_place(html, *at) for at in page.titled])] if len(page.titled) == 2 else None,
        "meta_description": " ".join(page.meta.get("description", "").split()) or None,
        "viewport_meta": viewport is not None,
        "viewport_zoom_blocked": zoom_blocked(viewport),
        "canonical": signatures.target(url, page.canonical) if page.canonical else None,
        "h1_count": page.levels.count(1),
        "heading_skips": sum(b > a + 1 for a, b in zip(page.levels, page.levels[1:], strict=False)),
        "section_headings": sum(x > 1 for x in page.levels),
        "word_count": len(text.split()),
        "tel_link": bool(numbers),
        "tel_numbers": list(numbers)[:3],
        "mailto_address": mail,
        "placeholder_email": None if mail is None else signatures.placeholder_email(mail),
        "contact_form": bool(page.form and page.inputs),
        "live_chat": bool(chat),
        "chat_evidence": chat[0][2] if chat else None,
        "social_links": list(dict.fromkeys(p for h in page.hrefs if (p := signatures.social_platform(signatures.target(url, h) or h)))),
        "tech": [key for key, _, _ in signatures.hits(markup, page.tags, signatures.TECH)],
        "builder": builder[0][1] if builder else None,
        "builder_evidence": builder[0][2] if builder else None,
        "structured_types": types,
        "local_business": bool(local),
        "business": local[0] if local else None,
        "businesses": len(local),
        "booking_flow": booking_flow(page, markup, url),
        "booking_onward": booking_onward(page, url),
        "broken_structured_data": broken,
        "copyright_year": noted,
        "copyright_open": open_range,
        "copyright_evidence": line,
        "placeholder_text": placeholder_text(page, text),
        "images_without_alt": page.images,
        "unlabelled_inputs": sum(not ok and i not in page.labelled for i, ok in page.inputs),
        "scripts": page.scripts,
        "links": len(page.hrefs),
        "js_shell": len(text) < SHELL_TEXT and page.scripts >= SHELL_SCRIPTS,
        "lang": page.lang,
        "html_bytes": len(html.encode()),
    }


def audit(pages: DataFrame, year: int = 2026) -> DataFrame:
    """Adds ``checks`` to (page_id, url, html); null for a page without html.

    Pages are read where they lie. Only a table of fewer files than there are cores is dealt anew, as parsing
    a page costs far more than moving it.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = spark.createDataFrame([], CHECKS).schema
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("checks", kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)
                made = [None if h is None else checks_of(h, u or "", year) for h, u in rows]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(made, arrow)], names=["page_id", "url", "checks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    spread = spark.sparkContext.defaultParallelism
    return (rows.repartition(spread) if len(pages.inputFiles()) < spread else rows).mapInArrow(run, schema)


def follow_bookings(audited: DataFrame) -> DataFrame:
    """(page_id, url, checks) with ``booking`` judged where a link only says so, by the page that the link leads to.

    The pages that such links lead to are looked up in ``audited`` by host and path; of several pages under one the
    least page_id speaks. A flow on it makes ``booking`` true. One that only leads on, or is built by scripts, or is
    not in the table, leaves it null (``multi_hop``, ``unverified``); any other makes it false. Links that
    lead nowhere stay unverified. Pages without checks pass through.
    """
    c = F.col("checks")
    to_follow = c["booking"].isNull() & c["booking_method"].isin("cta", "path")
    asked = audited.withColumn("__target", F.when(to_follow, web.page_key(c["booking_target"])))
    wanted = asked.select(F.col("__target").alias("__key")).where("__key is not null").distinct()
    seen = F.struct(c["booking_flow"].alias("flow"), c["booking_onward"].alias("onward"), c["js_shell"].alias("shell"))
    pages = audited.where(c.isNotNull()).select(web.page_key(F.col("url")).alias("__key"), "page_id", seen.alias("seen"))
    reached = pages.join(wanted, "__key", "left_semi").groupBy("__key").agg(F.min_by("seen", F.struct(F.col("page_id").isNull(), "page_id")).alias("__seen"))
    page = F.col("__seen")
    verdict = F.when(page["flow"].isNotNull(), True).when(page.isNotNull() & page["onward"].isNull() & ~page["shell"], False)
    method = F.when(verdict, "verified_target").when(~verdict, c["booking_method"]).when(page["onward"].isNotNull(), "multi_hop").otherwise("unverified")
    proof = F.concat_ws("; ", c["booking_evidence"], F.coalesce(page["flow"], page["onward"], F.when(page["shell"], "built by scripts"), F.when(page.isNull(), "not read").otherwise("no booking flow")))
    judged = F.when(to_follow, c.withField("booking", verdict).withField("booking_method", method).withField("booking_evidence", proof)).otherwise(c)
    return asked.join(reached, asked["__target"] == reached["__key"], "left").withColumn("checks", judged).select(*audited.columns)


def fetch_checks(outcome: DataFrame) -> DataFrame:
    """Adds ``fetch`` to (url, final_url, status_code, redirect_chain, content_type, tls_valid, error, error_kind): what is known without parsing.

    Over http there is no certificate to judge, so ``tls_valid`` is null; a redirect to https can be told only
    of a page that was asked for over http and answered.
    """
    final = F.coalesce("final_url", "url")
    scheme = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    reachable, secure = F.col("status_code").isNotNull(), scheme(final) == "https"
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    html = F.lower(F.coalesce("content_type", F.lit("text/html"))).rlike("^(text/html|application/xhtml)")
    told = F.when(reachable, F.concat(F.lit("HTTP "), F.col("status_code"), F.lit(" from "), final))
    return outcome.withColumn(
        "fetch",
        F.struct(
            reachable.alias("reachable"), F.col("status_code").alias("http_status"), final.alias("final_url"), chain.alias("redirect_chain"),
            F.when(F.size(chain) > 0, F.array_join(F.concat(chain, F.array(final)), " -> ")).alias("redirects"),
            F.when(secure, F.coalesce("tls_valid", F.lit(False))).alias("tls_valid"),
            F.when(reachable | (F.col("error_kind") == "tls"), secure).alias("https"),
            F.when((scheme(F.col("url")) == "http") & reachable, secure).alias("http_redirects_to_https"),
            (reachable & html).alias("parsed"), F.coalesce(told, F.concat(F.lit("No answer from "), final, F.lit(": "), F.coalesce("error", F.lit("unknown")))).alias("evidence"),
        ),
    )


def _rules(c: Column, url: Column, year: int) -> list[tuple[str, Column, Column]]:
    """(code, condition, evidence) in the order in which findings are told."""
    text = lambda x: x.cast("string")
    none = F.lit(None)
    segments = F.filter(F.transform(F.split(F.lower(c["title"]), r"\s*[|\-–—:•·»/]\s*"), lambda s: F.trim(s)), lambda s: s != "")
    template = (F.size(segments) > 0) & F.forall(segments, lambda s: s.isin(*TEMPLATE_TITLES))
    contact = c["tel_link"] | c["mailto_address"].isNotNull() | c["contact_form"]
    built = web.builder_host(url)
    typed = F.size(c["structured_types"]) > 0
    return [
        ("no_https", url.startswith("http://"), url),
        ("builder_subdomain", built.isNotNull(), built),
        ("no_mobile_viewport", ~c["viewport_meta"], none),
        ("viewport_blocks_zoom", c["viewport_zoom_blocked"].isNotNull(), c["viewport_zoom_blocked"]),
        ("missing_title", c["title"].isNull(), none),
        ("default_title", template, c["title"]),
        ("short_title", ~template & (F.length(c["title"]) < SHORT_TITLE), c["title"]),
        ("long_title", F.length(c["title"]) > LONG_TITLE, c["title"]),
        ("missing_meta_description", c["meta_description"].isNull(), none),
        ("no_h1", c["h1_count"] == 0, none),
        ("multiple_h1", c["h1_count"] > 1, text(c["h1_count"])),
        ("invalid_structured_data", c["broken_structured_data"], none),
        ("no_structured_data", ~typed & ~c["broken_structured_data"], none),
        ("no_local_business_schema", typed & ~c["local_business"], F.array_join(c["structured_types"], ", ")),
        ("no_contact_on_homepage", ~contact, none),
        ("no_click_to_call", contact & ~c["tel_link"], none),
        ("placeholder_email", c["placeholder_email"], c["mailto_address"]),
        ("placeholder_text", c["placeholder_text"].isNotNull(), c["placeholder_text"]),
        ("no_online_booking", ~c["booking"], c["booking_evidence"]),
        ("no_live_chat", ~c["live_chat"], none),
        ("images_without_alt", c["images_without_alt"] > 0, text(c["images_without_alt"])),
        ("unlabelled_form_fields", c["unlabelled_inputs"] > 0, text(c["unlabelled_inputs"])),
        ("thin_content", (c["word_count"] < THIN_WORDS) & ~c["js_shell"], text(c["word_count"])),
        ("no_section_headings", (c["section_headings"] == 0) & (c["word_count"] >= THIN_WORDS), none),
        ("heading_level_skipped", c["heading_skips"] > 0, text(c["heading_skips"])),
        ("future_copyright", c["copyright_year"] > year, c["copyright_evidence"]),
        ("stale_copyright", c["copyright_year"] <= year - STALE_YEARS, c["copyright_evidence"]),
        ("site_builder", c["builder"].isNotNull() & built.isNull(), c["builder"]),
        ("js_shell_suspected", c["js_shell"], none),
    ]


def _told(rules: list[tuple[str, Column, Column]], url: Column, severity: dict[str, Column] | None = None) -> Column:
    """The findings whose condition holds, in order, as structs (place, code, severity, service, message, evidence_text, evidence_url)."""
    spec = {code: rest for code, *rest in CATALOGUE}

    def one(i: int, code: str, when: Column, proof: Column) -> Column:
        grade, service, wording = spec[code]
        proof = proof.cast("string")
        before, _, after = wording.partition("{}")
        message = F.concat(F.lit(before), F.coalesce(F.substring(proof, 1, 300), F.lit("unknown")), F.lit(after)) if "{}" in wording else F.lit(wording)
        graded = (severity or {}).get(code, F.lit(grade))
        columns = {"place": F.lit(i), "code": F.lit(code), "severity": graded, "service": F.lit(service).cast("string"), "message": message}
        columns |= {"evidence_text": F.substring(proof, 1, 300), "evidence_url": url}
        return F.when(when, F.struct(*[v.alias(k) for k, v in columns.items()]))

    return F.array_compact(F.array(*[one(i, *rule) for i, rule in enumerate(rules)]))


def findings(audited: DataFrame, year: int = 2026) -> DataFrame:
    """(page_id, place, code, severity, service, message, evidence_text, evidence_url): a row for each finding of a page."""
    rules = _rules(F.col("checks"), F.col("url"), year)
    return audited.where("checks is not null").select("page_id", F.inline(_told(rules, F.col("url"))))


def other_findings(businesses: DataFrame) -> DataFrame:
    """(business_id, place, code, ...): findings that no page tells.

    ``businesses``: (business_id, website_kind, website, status, robots_reason, tls_valid, error, user_rating_count,
    listing_url, performance, accessibility, best_practices). A site that did not answer is told as a bad
    certificate if that was why; unknown counts and scores tell nothing.
    """
    c = F.col
    missing, down = c("website_kind") == "none", c("status") == "unreachable"
    low = lambda name: c(name) < QUALITY_SCORE
    graded = lambda name: F.when(c(name) < QUALITY_MEDIUM, "medium").otherwise("low")
    rules = [
        ("no_website", missing, F.lit(None)),
        ("social_profile_only", c("website_kind") == "social_profile", c("website")),
        ("robots_blocked", c("status") == "robots_blocked", c("robots_reason")),
        ("tls_invalid", down & (c("tls_valid") == F.lit(False)), F.coalesce("error", "website")),
        ("unreachable", down & ~F.coalesce(c("tls_valid") == F.lit(False), F.lit(False)), F.coalesce("error", "website")),
        ("slow_mobile", c("performance") < SLOW_SCORE, c("performance")),
        ("low_accessibility_score", low("accessibility"), c("accessibility")),
        ("low_best_practices_score", low("best_practices"), c("best_practices")),
        ("few_reviews", c("user_rating_count") < FEW_REVIEWS, c("user_rating_count")),
    ]
    severity = {"low_accessibility_score": graded("accessibility"), "low_best_practices_score": graded("best_practices")}
    from_listing = F.inline(F.transform(_told(rules, c("website"), severity), lambda f: f.withField("evidence_url", F.when(f["code"] == "few_reviews", c("listing_url")).when(f["code"] != "no_website", f["evidence_url"]))))
    return businesses.select("business_id", from_listing)


def allowed_findings(rows: DataFrame) -> DataFrame:
    """Rows (code, audit_status, ...) that an audit of this status may contribute."""
    kept = F.lit(True)
    for state, codes in ALLOWED.items():
        kept = kept & ((F.col("audit_status") != state) | F.col("code").isin(*codes))
    return rows.where(F.coalesce(kept, F.lit(True)))


def status(outcome: DataFrame) -> DataFrame:
    """Adds ``status`` to fetch outcomes (website_kind, robots_allowed, error, status_code, text): the first that applies."""
    challenge = F.col("status_code").isin(403, 429, 503) & F.lower("text").rlike("captcha|cf-challenge|just a moment|access denied")
    return outcome.withColumn(
        "status", F.when(F.col("website_kind").isin("none", "social_profile"), "skipped").when(~F.coalesce(F.col("robots_allowed"), F.lit(True)), "robots_blocked").when(F.col("error").isNotNull() | F.col("status_code").isNull(), "unreachable").when(challenge, "bot_challenge").when(~F.col("status_code").between(200, 299), "not_readable").otherwise("done")
    )


def domain_findings(domains: DataFrame, now: Column) -> DataFrame:
    """(domain, code) from (domain, expires, a_records, mx, spf, dmarc): null arrays are unknown and tell nothing."""
    days = F.floor((F.unix_timestamp("expires") - F.unix_timestamp(now)) / 86400)
    spf = F.filter("spf", lambda v: v.rlike(r"(?i)^v=spf1(\s|$)"))
    dmarc = F.filter("dmarc", lambda v: v.rlike(r"(?i)^v=dmarc1\s*(;|$)"))
    rules = [
        ("domain_expired", days < 0), ("domain_expiring_soon", days.between(0, 30)), ("domain_no_a_record", F.size("a_records") == 0), ("no_domain_mx", F.size("mx") == 0), ("no_spf", F.size(spf) == 0), ("multiple_spf_records", F.size(spf) > 1),
        ("spf_allows_all", F.exists(spf, lambda v: F.lower(v).rlike(r"(^|\s)\+?all(\s|$)"))), ("no_dmarc", F.size(dmarc) == 0), ("dmarc_policy_none", F.exists(dmarc, lambda v: F.lower(v).rlike(r";\s*p\s*=\s*none(\s|;|$)"))),
    ]
    return domains.select("domain", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in rules]))).alias("code"))
