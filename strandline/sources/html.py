"""Web pages to rows: one pass of the standard HTML parser a page, in Arrow batches; all else is expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import units as U

BLOCKS = {"p", "div", "li", "tr", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "title", "br", "ul", "ol", "table", "section", "span", "a", "option", "button"}
SILENT = {"script", "style", "noscript", "template"}
#: Plain tags, read at once: nothing in them needs the standard parser's tolerance. All others go its way.
PLAIN_START, PLAIN_END = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z:-]+="[^"&]*")*)>'), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z:-]+)="([^"]*)"')
#: Tags whose content newer versions of the parser read in modes of their own.
OWN_MODE = {*getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"}
#: Addresses that are joined by putting one behind the other.
PLAIN_BASE, PLAIN_PATH = re.compile(r"https?://[A-Za-z0-9.:-]+(?=[/?#]|\Z)"), re.compile(r"(?:/[A-Za-z0-9_-]+)+")


def joined(base: str, href: str) -> str:
    """urljoin, shorter for plain addresses."""
    if PLAIN_PATH.fullmatch(href) and (origin := PLAIN_BASE.match(base)):
        return origin[0] + href
    return urljoin(base, href)


class Page(HTMLParser):
    """What of a page is asked for: title, heading, metas, links, table rows, term pairs, JSON-LD, text lines."""

    def __init__(self, html: str, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.heading, self.metas = base, "", "", {}
        self.links: list[tuple[str, str, str]] = []
        self.rows: list[list[str]] = []
        self.terms: list[tuple[str, str]] = []
        self.data: list[str] = []
        self.lines: list[str] = [""]
        self.open: list[tuple[str, list[str]]] = []  # gathered text of the elements that are read
        self.silent, self.href, self.term, self.json = 0, None, None, False
        self.feed(html)
        self.close()

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if not plain or (tag := plain[1].lower()) in OWN_MODE:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(a.lower(), v) for a, v in PLAIN_ATTRIBUTE.findall(plain[2])])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if not plain or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in BLOCKS:
            self.lines.append("")
        if tag == "meta":
            self.metas.setdefault(at.get("property") or at.get("name", ""), at.get("content", ""))
        elif tag == "script" and at.get("type", "").lower() == "application/ld+json":
            self.json = True
            self.data.append("")
        if tag in SILENT:
            self.silent += 1
        elif tag in ("title", "h1", "td", "th", "dt", "dd", "a"):
            if tag == "a":
                self.href = at.get("href")
            self.open.append((tag, []))
        elif tag == "tr":
            self.rows.append([])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent, self.json = max(0, self.silent - 1), False
            return
        if tag in BLOCKS:
            self.lines.append("")
        at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if at is None:
            return
        text = " ".join(" ".join(self.open.pop(at)[1]).split())
        if tag == "title":
            self.title = self.title or text
        elif tag == "h1":
            self.heading = self.heading or text
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(text)
        elif tag == "dt":
            self.term = text
        elif tag == "dd" and self.term is not None:
            self.terms.append((self.term, text))
            self.term = None
        elif tag == "a" and self.href is not None:
            self.links.append((self.href.strip(), joined(self.base, self.href.strip()), text))

    def handle_data(self, data):
        if self.json:
            self.data[-1] += data
        if self.silent:
            return
        for _, text in self.open:
            text.append(data)
        self.lines[-1] += data

    def text(self) -> str:
        return "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)


def json_values(text: str) -> Iterator[object]:
    """The JSON values of a script; where it isn't one, the objects that stand in it."""
    decoder, at = json.JSONDecoder(), 0
    while (at := min((p for p in (text.find("{", at), text.find("[", at)) if p >= 0), default=-1)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            yield value
        except ValueError:
            at += 1


def nodes(value: object) -> Iterator[dict]:
    """All objects of a JSON value, outer ones first."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def text_of(*values: object) -> str:
    return next((" ".join(str(v).split()) for v in values if v), "")


def product_offers(scripts: list[str]) -> Iterator[dict]:
    """Offers of the products in JSON-LD; prices stay text."""
    for node in (n for s in scripts for v in json_values(s) for n in nodes(v)):
        kinds = node.get("@type")
        if "product" not in {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])}:
            continue
        offers = node.get("offers")
        for offer in (o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)):
            yield {
                "price": text_of(offer.get("price"), offer.get("lowPrice")), "currency": text_of(offer.get("priceCurrency")),
                "variant": text_of(offer.get("name"), offer.get("sku")), "sku": text_of(offer.get("sku"), node.get("sku")),
                "availability": text_of(offer.get("availability")), "product_name": text_of(node.get("name")), "method": "json_ld_offer",
            }


def variant_offers(html: str) -> Iterator[dict]:
    """Offers of every "variants": [...] array in a page's scripts; equal arrays count once."""
    decoder, seen, at = json.JSONDecoder(), set(), 0
    while (at := html.find('"variants"', at)) >= 0:
        at += len('"variants"')
        rest = html[at : at + 64].lstrip()
        if not rest.startswith(":") or not rest[1:].lstrip().startswith("["):
            continue
        start = html.index("[", at)
        try:
            found, stop = decoder.raw_decode(html, start)
        except ValueError:
            continue
        if html[start:stop] in seen:
            continue
        seen.add(html[start:stop])
        for v in (v for v in found if isinstance(v, dict)):
            cents = v.get("price") is None
            try:
                price = float(v["priceInCents"] if cents else v["price"])
            except (KeyError, TypeError, ValueError):
                continue
            price = price / 100 if cents or price > 200 else price
            if 0 < price < 10000:
                out = v.get("available") is False or v.get("isOutOfStock")
                yield {
                    "price": repr(price), "currency": "", "variant": text_of(v.get("title"), v.get("name")), "sku": text_of(v.get("sku")),
                    "availability": "OutOfStock" if out else "InStock", "product_name": "", "method": "shopify_variant_json",
                }


OFFER = pa.struct([(n, pa.string()) for n in ("price", "currency", "variant", "sku", "availability", "product_name", "method")])
OFFER_SQL = "array<struct<price: string, currency: string, variant: string, sku: string, availability: string, product_name: string, method: string>>"


#: What parse_pages finds, in order, with each column's type in Arrow and in SQL.
FOUND = {
    "title": (pa.string(), "string"), "heading": (pa.string(), "string"), "metas": (pa.map_(pa.string(), pa.string()), "map<string, string>"),
    "links": (pa.list_(pa.struct([(n, pa.string()) for n in ("href", "url", "text")])), "array<struct<href: string, url: string, text: string>>"),
    "rows": (pa.list_(pa.list_(pa.string())), "array<array<string>>"), "terms": (pa.list_(pa.struct([("term", pa.string()), ("value", pa.string())])), "array<struct<term: string, value: string>>"),
    "offers": (pa.list_(OFFER), OFFER_SQL), "page_text": (pa.string(), "string"),
}


def listed(groups: list[list[tuple | dict]], kind: pa.ListType) -> pa.Array:
    """Lists of records, field by field."""
    ends, flat = [0], [x for g in groups for x in g]
    for g in groups:
        ends.append(ends[-1] + len(g))
    fields = list(kind.value_type)
    columns = ([x[f.name] for x in flat] for f in fields) if flat and isinstance(flat[0], dict) else zip(*flat) if flat else ([] for _ in fields)
    parts = [pa.array(c, f.type) for c, f in zip(columns, fields)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=fields))


def parse_pages(df: DataFrame, url: str = "url", html: str = "html", columns: Sequence[str] = ("html", *FOUND)) -> DataFrame:
    """url and `columns`: html and what Page reads, with the offers of its scripts; what isn't asked for isn't sent back."""
    wanted = [n for n in FOUND if n in columns]
    given = ["url", "html"] if "html" in columns else ["url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {
            "title": lambda p, h: p.title, "heading": lambda p, h: p.heading, "metas": lambda p, h: list(p.metas.items()), "links": lambda p, h: p.links,
            "rows": lambda p, h: [[c for c in r if c] for r in p.rows], "terms": lambda p, h: p.terms,
            "offers": lambda p, h: [*product_offers(p.data), *variant_offers(h)], "page_text": lambda p, h: p.text(),
        }
        for b in batches:
            out: dict[str, list] = {n: [] for n in wanted}
            each = [(out[n].append, of[n]) for n in wanted]
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Page(h or "", u or "")
                for add, read in each:
                    add(read(p, h or ""))
            made = [listed(v, FOUND[n][0]) if n in ("links", "terms", "offers") else pa.array(v, FOUND[n][0]) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(given)], *made], names=[*given, *wanted])

    schema = ", ".join([*[f"{n} string" for n in given], *[f"{n} {FOUND[n][1]}" for n in wanted]])
    return df.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)


def meta(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("metas", F.lit(n))), F.lit("")) for n in names])


def slug(url: Column) -> Column:
    last = F.element_at(F.split(X.url_part(url, "path"), "/"), -1)
    return F.translate(F.regexp_replace(last, r"\.[^.]*$", ""), "-", " ")


def best_title(url: Column) -> Column:
    """Of heading, share title, title and address the one that tells most: length, a mass, the word filament."""
    every = F.filter(F.array(F.col("heading"), meta("og:title", "twitter:title"), F.col("title"), slug(url)), lambda x: x.isNotNull() & (x != ""))
    low = lambda x: F.lower(x)
    score = lambda x: F.length(x) + F.when(low(x).rlike(r"\b(kg|g|lb|lbs)\b"), 100).otherwise(0) + F.when(F.contains(low(x), F.lit("filament")), 50).otherwise(0)
    return F.coalesce(F.array_max(F.transform(every, lambda x: F.struct(score(x).alias("s"), x.alias("t"))))["t"], F.lit(""))


def first_title(url: Column) -> Column:
    """Heading, else share title, else title, else address, without the shop's name at the end."""
    some = F.coalesce(F.nullif("heading", F.lit("")), meta("og:title", "twitter:title"), F.nullif("title", F.lit("")), slug(url))
    return C.page_space(F.regexp_replace(some, r"(?i)\s*[|\-]\s*(SUNLU|ELEGOO|Anycubic|HATCHBOX|Creality Store|ColorFabb|Fillamentum).*$", ""))


def page_links(pages: DataFrame, keep_query: bool = True) -> DataFrame:
    """(url, ord, link, text) of the links that lead to pages."""
    form = X.normalize_page_url if keep_query else X.normalize_price_url
    out = pages.select("url", F.posexplode("links").alias("ord", "l")).where(X.is_followed(F.col("l.href")))
    return out.select("url", "ord", form(F.col("l.url")).alias("link"), C.page_space(F.col("l.text")).alias("text"))


def spec_rows(pages: DataFrame) -> DataFrame:
    """(url, row): canonical label | value | source, from title, tables, term lists, then text lines; each once a page."""
    name = first_title(F.col("url"))
    size = F.regexp_extract(name, r"(?i)\b(1\.75|2\.85|3\.0|3\.00)\s*mm\b", 1)
    mass = F.regexp_extract(name, r"(?i)\b\d+(?:\.\d+)?\s*(?:kg|g)\b", 0)
    row = lambda label, value, source: F.struct(label.alias("label"), value.alias("value"), F.lit(source).alias("source"))
    titles = F.array(
        F.when(size != "", row(F.lit("Diameter"), F.concat(size, F.lit(" mm")), "official_html_title")),
        F.when(mass != "", row(F.lit("Net Weight"), mass, "official_html_title")),
    )
    spec = "official_html_specs"
    tables = F.transform(F.filter("rows", lambda r: F.size(r) >= 2), lambda r: row(r[0], F.array_join(F.slice(r, 2, F.size(r) - 1), " | "), spec))
    terms = F.transform("terms", lambda t: row(t["term"], t["value"], spec))
    lines = F.filter(F.split("page_text", "\n"), lambda x: (F.length(x) <= 180) & (x != ""))
    pattern = r"^(.{3,85}?)(?:[:：]\s+|\s{2,}|\s+[|]\s+)(.+)$"
    noise = r"(?i)add to cart|newsletter|cookie|shipping|tax|qty|quantity|sold out"
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(pattern) & ~x.rlike(noise)), lambda x: row(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2), spec))
    nexts = F.transform(lines, lambda x, i: F.when(~x.rlike(noise), row(x, F.coalesce(F.get(lines, i + 1), F.lit("")), spec)))
    every = pages.select("url", F.posexplode(F.array_compact(F.concat(titles, tables, terms, pairs, nexts))).alias("ord", "r")).select("url", "ord", "r.*")
    named = every.withColumn("canon", C.canonical_label(F.col("label"))).where("canon IS NOT NULL")
    named = named.where(~((F.col("canon") == "Diameter") & F.lower("label").rlike("spool|inner diameter|outer diameter")))
    valued = named.withColumn("value", C.normalize_value(F.col("label"), F.col("value"))).where(C.looks_like_value(F.col("value")))
    made = valued.select("url", "ord", C.page_space(F.concat_ws(" | ", "canon", "value", "source")).alias("row"))
    first = made.groupBy("url", F.lower("row").alias("k")).agg(F.min(F.struct("ord", "row")).alias("b"))
    return first.select("url", F.col("b.ord").alias("ord"), F.col("b.row").alias("row"))


def offers_of(visible_for: Column) -> Column:
    """A parsed page's offers as an array: scripts, then price metas; visible prices only where `visible_for` and nothing else is there."""
    empty = F.lit("")
    one = lambda price, currency, method: F.struct(
        price.alias("price"), currency.alias("currency"), empty.alias("variant"), empty.alias("sku"), empty.alias("availability"), empty.alias("product_name"), F.lit(method).alias("method")
    )
    amount = F.coalesce(*[F.when(U.number_or_none(meta(n)).isNotNull(), meta(n)) for n in ("product:price:amount", "og:price:amount", "twitter:data1")])
    metas = F.when(amount.isNotNull(), F.array(one(amount, F.coalesce(meta("product:price:currency", "og:price:currency"), empty), "meta_price")))
    seen = F.regexp_extract_all("page_text", F.lit(r"(?i)\d+(?:[.,]\d+)?\s*(?:USD|EUR|GBP)\b|[$€£]\s*\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*[€£$]"), F.lit(0))
    symbol = lambda x: F.when(F.contains(x, F.lit("$")), "USD").when(F.contains(x, F.lit("€")), "EUR").when(F.contains(x, F.lit("£")), "GBP").otherwise(F.upper(F.regexp_extract(x, r"[A-Za-z]{3}", 0)))
    visible = F.slice(F.transform(seen, lambda x: one(x, symbol(x), "visible_text_price")), 1, 3)
    priced = F.filter("offers", lambda o: U.number_once(o["price"]).isNotNull())
    told = F.concat(priced, F.coalesce(metas, F.array().cast(OFFER_SQL)))
    return F.when((F.size(told) == 0) & visible_for, visible).otherwise(told)


def page_offers(pages: DataFrame, visible_for: Column) -> DataFrame:
    """(url, ord, offer columns) of parsed pages."""
    return pages.select("url", F.posexplode(offers_of(visible_for)).alias("ord", "o")).select("url", "ord", "o.*")


def page_currency() -> Column:
    """The currency a page's scripts or metas name."""
    found = [F.nullif(F.regexp_extract("html", rf'"{k}"\s*:\s*"([A-Z]{{3}})"', 1), F.lit("")) for k in ("currency", "currencyCode", "active")]
    return F.coalesce(*found, F.upper(meta("product:price:currency", "og:price:currency")), F.lit(""))
