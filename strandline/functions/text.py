"""Text and URL expressions. Regexes are Java's; where Unicode blanks count, (?U) says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols folded to plain ones, in this order.
FOLDS = [
    ("™️", "TM"), ("™", "TM"), ("®", ""), ("µ", "u"), ("±", "+/-"), ("≤", "<="), ("≥", ">="),
    ("−", "-"), ("–", "-"), ("—", "-"), ("∼", "~"), ("～", "~"), ("，", ","), ("（", "("), ("）", ")"),
    ("℃", "°C"), ("˚", "°"), ("Â°", "°"), ("Â²", "2"), ("Â³", "3"),
]
#: Unit symbols for display.
UNIT_SYMBOLS = {
    "degC": "°C", "degF": "°F", "g/cm3": "g/cm³", "kg/m3": "kg/m³", "g/cc": "g/cc", "g/10min": "g/10 min", "cm3/10min": "cm³/10 min", "mm3/s": "mm³/s",
    "kJ/m2": "kJ/m²", "J/m2": "J/m²", "ft-lb/in": "ft-lb/in", "ohm": "Ω", "ohm/sq": "Ω/sq",
}


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_text(c: Column) -> Column:
    """Symbols folded, a tilde between digits made a range, control characters blanked."""
    c = F.regexp_replace(replaced(F.coalesce(c, F.lit("")), FOLDS), r"(?U)(?<=\d)\s*~\s*(?=\d)", "-")
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def compact_spaces(c: Column) -> Column:
    return squeeze(clean_text(c))


def normalize_unit_text(c: Column) -> Column:
    low = F.lower(clean_text(c))
    return replaced(low, [(" ", ""), ("|", ""), ("²", "2"), ("³", "3"), ("°", "deg")])


def flag_list(c: Column) -> Column:
    """The flags of a ;-joined field."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda x: x != "")


def append_flag(c: Column, flag: Column) -> Column:
    """The field with one more flag, each once, in the order of arrival."""
    return F.array_join(F.array_distinct(F.concat(flag_list(c), F.filter(F.array(flag), lambda x: x.isNotNull() & (x != "")))), ";")


def cells(c: Column) -> Column:
    """Cells of a |-joined row, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), squeeze), lambda x: x != "")


def supplier_from_path(c: Column, root: str = "") -> Column:
    rest = F.regexp_replace(c, "^" + root, "") if root else c
    first = F.get(F.split(rest, "/"), F.lit(0))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("Unknown"))


def product_from_file(name: Column, supplier: Column) -> Column:
    """A product's name from a datasheet's file name: boilerplate, supplier prefix and version marks go."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    c = F.regexp_replace(stem, r"(?i)\s*-\s*technical_datasheet.*$", "")
    prefix = F.concat(F.lower(supplier), F.lit("-"))
    head = F.regexp_replace(F.lower(F.regexp_extract(c, r"^(.*?\s*-)\s*", 1)), r"\s+", " ")
    c = F.when(F.replace(head, F.lit(" -"), F.lit("-")) == prefix, F.regexp_replace(c, r"^.*?\s*-\s*", "")).otherwise(c)
    for pattern in (
        r"(?i)^3DXTech\s*-\s*(?:3DXTech|Triton3D) Technical and Safety Data Sheets\s*-\s*",
        r"(?i)^Prusa Polymers\s*-\s*",
    ):
        c = F.regexp_replace(c, pattern, "")
    c = F.translate(c, "_", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bTDS\b.*$", ""), r"(?i)\bv\d+(?:\.\d+)?\b", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-_]+|[ \-_]+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), stem)


#: Where a product's name stands in a datasheet's text; the first that fits counts.
PRODUCT_PATTERNS = (
    r"(?i)Technical Data Sheet:\s*([^\n]+)",
    r"(?i)Trade Name\s*\n\s*([^\n]+)",
    r"(?i)TECHNICAL DATA SHEET\s*-\s*([^\n]+)",
    r"(?i)Technical datasheet\s*\n\s*([^\n]+)",
    r"(?i)Bambu Filament\s*\nTechnical Data Sheet[^\n]*\n\s*([^\n]+)",
)


def product_from_text(text: Column, fallback: Column) -> Column:
    found = []
    for pattern in PRODUCT_PATTERNS:
        name = F.regexp_replace(compact_spaces(F.regexp_extract(text, pattern, 1)), r"(?i)\s+3D Printing Filament$", "")
        found.append(F.when((F.length(name) >= 2) & ~F.contains(F.lower(name), F.lit("certificate")), name))
    return F.coalesce(*found, fallback)


#: Names of files that aren't datasheets, and endings of other languages.
AUXILIARY = ("logo", "catalog", "polityka", "privacy", "iso_9001", "cert_2026", ".ds_store")
LANGUAGES = ("PL", "JP", "IT", "FR", "ES", "DE", "CZ", "CS")


def skip_reason(name: Column) -> Column:
    """Why a file is skipped, empty if it isn't. Auxiliary names in any case; language endings as written."""
    other = F.lit(False)
    for code in LANGUAGES:
        other = other | name.endswith(f"_{code}.pdf")
    aux = F.lit(False)
    for part in AUXILIARY:
        aux = aux | F.contains(F.lower(name), F.lit(part))
    return F.when(aux, "non_material_or_auxiliary").when(other, "non_english_duplicate").otherwise("")


def record_status(error: Column, text: Column, n_rows: Column, pages: Column, supplier: Column, n_obs: Column, skip: Column) -> Column:
    """The first of: skipped, error, privacy page, image catalogue, needs_ocr, no_properties_found, parsed."""
    short = (F.length(F.trim(F.coalesce(text, F.lit("")))) < 80) & (n_rows == 0)
    own = supplier == "Fiberlogy"
    return (
        F.when(skip != "", "skipped")
        .when(F.coalesce(error, F.lit("")) != "", "error")
        .when(own & F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("privacy")), "skipped")
        .when(own & short & (pages > 5), "skipped")
        .when(short, "needs_ocr")
        .when(n_obs == 0, "no_properties_found")
        .otherwise("parsed")
    )


def url_part(url: Column, part: str) -> Column:
    """scheme, host, path, query or fragment, empty where missing; never fails on odd urls."""
    group = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def normalize_price_url(url: Column) -> Column:
    """No query, no fragment, no slash at the end; an empty path is /."""
    path = F.regexp_replace(url_part(url, "path"), "/+$", "")
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "host"), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def normalize_page_url(url: Column) -> Column:
    """No fragment; query and slash stay."""
    query = url_part(url, "query")
    return F.concat(
        url_part(url, "scheme"), F.lit("://"), url_part(url, "host"), url_part(url, "path"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def product_json_url(url: Column) -> Column:
    """The .js address of a two-step product path, else null."""
    name = F.regexp_extract(url_part(url, "path"), r"^/*products/+([^/]+)", 1)
    return F.when(name != "", F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "host"), F.lit("/products/"), name, F.lit(".js")))


def is_followed(href: Column) -> Column:
    """A link that leads to a page."""
    return (F.trim(F.coalesce(href, F.lit(""))) != "") & ~F.trim(href).rlike(r"^(#|mailto:|tel:|javascript:)")


def is_pdf(url: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", url_part(url, "path"), url_part(url, "query")))
    return F.contains(hay, F.lit(".pdf")) | F.contains(hay, F.lit("filename=tds"))


def significant(c: Column) -> Column:
    """Three significant digits without trailing zeros."""
    digits = F.regexp_replace(F.printf(F.lit("%.3g"), c), r"(\.\d*?)0+(?=$|e)", "$1")
    return F.when(c.isNotNull(), F.regexp_replace(digits, r"\.(?=$|e)", ""))


def unit_symbol(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in UNIT_SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), c)


def polynomial_hash(c: Column) -> Column:
    """31-polynomial over characters, modulo 2^32."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)) % 4294967296)
