"""Product cards of a listing page, read with a stack of open elements.

A page is taken whole or refused: its first fault becomes the only row of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa

# Element names without content, the card's class, its text fields, the field of the published total.
NO_CONTENT = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CARD_CLASS = "product-item"
FIELDS = ("price", "price-old", "promotion-text")
TOTAL_ID = "RecordCountSP"

FACTS = pa.struct([("published_total", pa.int64()), ("position", pa.int32()), ("card_id", pa.string()), ("name", pa.string()),
                   ("href", pa.string()), ("brand", pa.string()), ("price", pa.string()), ("price_old", pa.string()),
                   ("promo_text", pa.string()), ("page_error", pa.string())])
FACTS_DDL = ("struct<published_total:bigint,position:int,card_id:string,name:string,href:string,brand:string,price:string,"
             "price_old:string,promo_text:string,page_error:string>")


class Fault(Exception):
    """Why a page can't be trusted."""


class _Reader(HTMLParser):
    """Each open element is (name, role); the role of a card is its class, that of a field its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.opened: list[tuple[str, str | None]] = []
        self.open_cards = 0
        self.total: int | None = None
        self.cards: list[dict[str, str]] = []
        self.link: dict[str, str] | None = None
        self.texts: dict[str, list[str]] = {}

    def in_card(self) -> bool:
        return self.open_cards > 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = {name: value or "" for name, value in attrs} if attrs else {}
        if have.get("id") == TOTAL_ID:
            if not have.get("value", "").isdecimal():
                raise Fault("bad_total")
            self.total = int(have["value"])
        classes, role = have["class"].split() if "class" in have else (), None
        if CARD_CLASS in classes:
            if self.open_cards:
                raise Fault("nested_card")
            role, self.link, self.texts = CARD_CLASS, None, {}
        elif self.open_cards:
            role = next((f for f in FIELDS if f in classes), None) if classes else None
            if role in self.texts:
                raise Fault("repeated_field")
            if role:
                self.texts[role] = []
            if tag == "a" and have.get("data-id") and have.get("data-name"):
                link = {"card_id": have["data-id"], "name": have["data-name"].strip(), "href": have.get("href", ""),
                        "brand": have.get("data-brand", "")}
                if self.link not in (None, link):
                    raise Fault("several_products")
                self.link = link
        if tag not in NO_CONTENT:
            self.opened.append((tag, role))
            self.open_cards += role == CARD_CLASS

    def handle_data(self, data: str) -> None:
        for _, role in self.opened:
            if role in self.texts:
                self.texts[role].append(data)

    def handle_endtag(self, tag: str) -> None:
        last = next((i for i in range(len(self.opened) - 1, -1, -1) if self.opened[i][0] == tag), None)
        if last is None:
            return
        cards = sum([role == CARD_CLASS for _, role in self.opened[last:]])
        del self.opened[last:]
        self.open_cards -= cards
        if cards:
            if not self.link or not self.link["href"]:
                raise Fault("card_without_link")
            text = {f: " ".join("".join(self.texts.get(f, [])).split()) for f in FIELDS}
            self.cards.append(self.link | {"price": text["price"], "price_old": text["price-old"], "promo_text": text["promotion-text"]})
            self.link, self.texts = None, {}


# Plain markup, which a parser can only read in one way: tags with quoted attributes one blank apart, and texts without "<".  References
# in attributes end in a semicolon and are of the common ones; elements whose content is no markup are left to the parser.
_VALUE = r'"(?:[^"&]|&(?:amp|lt|gt|quot|#[0-9]{1,4});)*+"'
_TAG = rf'<(?P<open>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?: [A-Za-z][A-Za-z0-9-]*={_VALUE})*+)>|</(?P<close>[A-Za-z][A-Za-z0-9]*)>|(?P<text>[^<]+)'
_TOKEN, _ATTRIBUTE, _PLAIN = re.compile(_TAG), re.compile(r' ([A-Za-z0-9-]+)="([^"]*)"'), re.compile(f"(?:{_TAG.replace('?P<open>', '?:').replace('?P<attrs>', '?:').replace('?P<close>', '?:').replace('?P<text>', '?:')})*+")
_OTHER_CONTENT = re.compile("<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)", re.IGNORECASE)


def _read(reader: _Reader, markup: str) -> None:
    """Show the page's tags and texts to the reader: plain markup by one expression, any other by the standard parser."""
    if _OTHER_CONTENT.search(markup) or not _PLAIN.fullmatch(markup):
        reader.feed(markup)
        reader.close()
        return
    for token in _TOKEN.finditer(markup):
        kind = token.lastgroup
        if kind == "text":
            if reader.texts:
                reader.handle_data(unescape(token["text"]))
        elif kind == "close":
            reader.handle_endtag(token["close"].lower())
        else:
            attrs = [(name.lower(), unescape(value) if "&" in value else value) for name, value in _ATTRIBUTE.findall(token["attrs"])]
            reader.handle_starttag(token["open"].lower(), attrs)


def read_page(markup: str | None) -> list[dict]:
    """Facts of every card, or one row that names the page's fault; a page without cards gives no row."""
    reader = _Reader()
    try:
        _read(reader, markup or "")
        if reader.in_card():
            raise Fault("unfinished_card")
        if reader.total is None:
            raise Fault("no_total")
    except Fault as fault:
        return [{"published_total": reader.total, "page_error": str(fault)}]
    return [{"published_total": reader.total, "position": i, **card} for i, card in enumerate(reader.cards)]


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``html`` as their last column, which becomes the list of its cards' facts."""
    for batch in batches:
        pages = [read_page(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        facts = [card for page in pages for card in page]
        columns = [pa.array([card.get(f.name) for card in facts], f.type) for f in FACTS]
        ends = list(accumulate((len(page) for page in pages), initial=0))
        cards = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(FACTS)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cards], [*batch.schema.names[:-1], "_cards"])
