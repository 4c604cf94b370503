"""Structured data of a page: JSON-LD blocks, and the items that microdata and RDFa attributes mark as the page is parsed.

A property belongs to the innermost item that is open above it, so nested items (the address of a business) keep
their own properties. The items are told by a stack of open elements; no tree is built.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

# Types of local businesses, in lower case.
LOCAL_BUSINESS = (
    "localbusiness", "animalshelter", "archiveorganization", "automotivebusiness", "childcare", "dentist", "drycleaningorlaundry", "emergencyservice", "employmentagency",
    "entertainmentbusiness", "financialservice", "foodestablishment", "governmentoffice", "healthandbeautybusiness", "homeandconstructionbusiness", "internetcafe", "legalservice", "library",
    "lodgingbusiness", "medicalbusiness", "professionalservice", "radiostation", "realestateagent", "recyclingcenter", "selfstorage", "shoppingcenter", "sportsactivitylocation",
    "store", "televisionstation", "touristinformationcenter", "travelagency", "autobodyshop", "autodealer", "autopartsstore", "autorental", "autorepair",
    "autowash", "gasstation", "motorcycledealer", "motorcyclerepair", "firestation", "hospital", "policestation", "adultentertainment", "amusementpark",
    "artgallery", "casino", "comedyclub", "movietheater", "nightclub", "accountingservice", "automatedteller", "bankorcreditunion", "insuranceagency",
    "bakery", "barorpub", "brewery", "cafeorcoffeeshop", "distillery", "fastfoodrestaurant", "icecreamshop", "restaurant", "winery",
    "postoffice", "beautysalon", "dayspa", "hairsalon", "healthclub", "nailsalon", "tattooparlor", "electrician", "generalcontractor",
    "hvacbusiness", "housepainter", "locksmith", "movingcompany", "plumber", "roofingcontractor", "attorney", "notary", "bedandbreakfast",
    "campground", "hostel", "hotel", "motel", "resort", "vacationrental", "communityhealth", "dermatology", "dietnutrition",
    "medicalclinic", "optician", "pharmacy", "physician", "individualphysician", "physiciansoffice", "covidtestingfacility", "veterinarycare", "bowlingalley",
    "exercisegym", "golfcourse", "publicswimmingpool", "skiresort", "sportsclub", "stadiumorarena", "tenniscomplex", "bikestore", "bookstore",
    "clothingstore", "computerstore", "conveniencestore", "departmentstore", "electronicsstore", "florist", "furniturestore", "gardenstore", "grocerystore",
    "hardwarestore", "hobbyshop", "homegoodsstore", "jewelrystore", "liquorstore", "mensclothingstore", "mobilephonestore", "movierentalstore", "musicstore",
    "officeequipmentstore", "outletstore", "pawnshop", "petstore", "shoestore", "sportinggoodsstore", "tireshop", "toystore", "wholesalestore",
    "bar", "cleaningservice", "pestcontrolservice", "landscaping",
)
# Elements without an end tag, and the attribute that holds the value of a property on an element.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
VALUES = {
    "a": "href", "link": "href", "area": "href", "img": "src", "audio": "src", "video": "src", "source": "src",
    "iframe": "src", "embed": "src", "object": "data", "time": "datetime", "data": "value", "meter": "value",
}
# How a syntax says that an item begins, of what type it is, and that something is its property.
SYNTAXES = {"microdata": ("itemscope", "itemtype", "itemprop"), "rdfa": ("typeof", "typeof", "property")}
# Most characters of a value and values of a property that are kept.
MOST_CHARS, MOST_VALUES = 200, 10

_WRAPPERS = re.compile(r"^\ufeff?\s*(?:<!--|<!\[CDATA\[|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/)?|(?:-->|\]\]>|//\s*\]\]>|/\*\s*\]\]>\s*\*/)\s*$")
_DECODER = json.JSONDecoder(strict=False)


@dataclass
class Item:
    """An item of a page: its types, and the values of each property, which are texts or items."""

    syntax: str
    types: list[str]
    values: dict[str, list] = field(default_factory=dict)


@dataclass
class _Open:
    tag: str
    items: dict[str, Item]
    texts: list[tuple[Item, str, list[str]]]


def bare(name: str) -> str:
    """The name of a type or property without the vocabulary it is given with."""
    return re.split(r"[/#:]", name.strip().rstrip("/#"))[-1]


class Scopes:
    """Items of both syntaxes, from the start tags, texts and end tags of a page in order."""

    def __init__(self) -> None:
        self.items: list[Item] = []
        self.open: list[_Open] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        entry = _Open(tag, {}, [])
        for syntax, (scope, kind, prop) in SYNTAXES.items():
            item = None
            if scope in attrs:
                item = entry.items[syntax] = Item(syntax, [n for n in map(bare, attrs.get(kind, "").split()) if n])
                self.items.append(item)
            owner = next((o.items[syntax] for o in reversed(self.open) if syntax in o.items), None) if prop in attrs else None
            if owner is None:
                continue
            for name in filter(None, map(bare, attrs[prop].split())):
                value = item or attrs.get("content") or attrs.get(VALUES.get(tag, ""))
                place = owner.values.setdefault(name, [])
                place.append(value)
                if value is None and tag not in VOID:
                    entry.texts.append((owner, name, [len(place) - 1]))
        if tag not in VOID:
            self.open.append(entry)

    def data(self, text: str) -> None:
        for entry in self.open:
            for _, _, pieces in entry.texts:
                pieces.append(text)

    def end(self, tag: str) -> None:
        if any(entry.tag == tag for entry in self.open):
            while self._close() != tag:
                pass

    def finish(self) -> list[Item]:
        """All items, in the order of the page; elements that are still open end here."""
        while self.open:
            self._close()
        return self.items

    def _close(self) -> str:
        entry = self.open.pop()
        for owner, name, (place, *pieces) in entry.texts:
            owner.values[name][place] = " ".join(" ".join(pieces).split()) or None
        return entry.tag


def json_ld_nodes(text: str) -> tuple[list[dict], bool]:
    """The objects of a JSON-LD block, depth first through lists and @graph, and whether it is broken.

    Wrappers of content systems are taken off; of several values one after the other all are read; what follows
    the last one that can be read is ignored, and only a block of which nothing can be read is broken.
    """
    text = _WRAPPERS.sub("", text.strip()).strip()
    at, nodes, first = 0, [], True
    while at < len(text):
        try:
            value, at = _DECODER.raw_decode(text, at)
        except ValueError:
            return nodes, first
        first, stack = False, [value]
        while stack:
            node = stack.pop(0)
            if isinstance(node, list):
                stack = node + stack
            elif isinstance(node, dict):
                nodes.append(node)
                if isinstance(node.get("@graph"), (list, dict)):
                    stack.insert(0, node["@graph"])
        while at < len(text) and text[at] in " \t\r\n,;":
            at += 1
    return nodes, False


def node_types(node: dict) -> list[str]:
    kind = node.get("@type")
    return [bare(k) for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str) and k.strip()]


def texts(value: object) -> list[str]:
    """The texts that a value holds, in order: of an item its name, of an object its @value or name."""
    if isinstance(value, Item):
        value = value.values.get("name")
    elif isinstance(value, dict):
        value = value.get("@value") or value.get("name")
    if isinstance(value, list):
        return [t for v in value for t in texts(v)]
    if value is None or isinstance(value, (bool, dict)):
        return []
    return [t] if (t := " ".join(str(value).split())[:MOST_CHARS]) else []


def _hours(value: object) -> list[str]:
    """``Monday, Tuesday 08:00-17:00`` for each opening specification; an unknown end is a question mark."""
    lines = []
    for spec in value if isinstance(value, list) else [value]:
        own = spec.values if isinstance(spec, Item) else spec
        if isinstance(own, dict):
            named = own.get("dayOfWeek")
            days = ", ".join(bare(d) for v in (named if isinstance(named, list) else [named]) for d in texts(v))
            opens, closes = (next(iter(texts(own.get(k))), "?") for k in ("opens", "closes"))
            lines.append(f"{days} {opens}-{closes}".strip())
    return lines


def business(kind: str, syntax: str, values: dict) -> dict:
    """What a local business says of itself, as the columns of a row."""
    first = lambda own, name: next(iter(texts(own.get(name))), None)
    address = values.get("address")
    address = address[0] if isinstance(address, list) and address else address
    parts = address.values if isinstance(address, Item) else address if isinstance(address, dict) else {}
    return {
        "syntax": syntax,
        "type": kind,
        "name": first(values, "name"),
        "phone": first(values, "telephone"),
        "street": first(parts, "streetAddress"),
        "locality": first(parts, "addressLocality"),
        "region": first(parts, "addressRegion"),
        "postal_code": first(parts, "postalCode"),
        "country": first(parts, "addressCountry"),
        "address_text": None if parts else next(iter(texts(address)), None),
        "hours": (texts(values.get("openingHours")) or _hours(values.get("openingHoursSpecification")))[:MOST_VALUES],
        "same_as": texts(values.get("sameAs"))[:MOST_VALUES],
    }


def read(blocks: list[str], items: list[Item]) -> tuple[list[str], list[dict], bool]:
    """Types, local businesses and whether a JSON-LD block is broken: JSON-LD first, then microdata, then RDFa."""
    types, found, broken = [], [], False
    for block in blocks:
        nodes, bad = json_ld_nodes(block)
        broken = broken or bad
        for node in nodes:
            own = node_types(node)
            types += own
            if local := next((t for t in own if t.lower() in LOCAL_BUSINESS), None):
                found.append(business(local, "json-ld", node))
    for item in sorted(items, key=lambda i: i.syntax):
        types += item.types
        if local := next((t for t in item.types if t.lower() in LOCAL_BUSINESS), None):
            found.append(business(local, item.syntax, item.values))
    return list(dict.fromkeys(types)), found, broken
