"""The text of fetched bytes: which charset a page is in, and decoding by it."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks at the beginning of a file, the longer first, and how far a page is searched for its own word.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
META_REACH = 2048
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", re.I)
META = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", re.I)
#: Charsets that a page without a word of its own may be in, in the order in which they are tried; the last takes any bytes.
CANDIDATES = ("utf-8", "cp1252", "latin-1")


def known(name: str | None) -> str | None:
    """A charset's own name; pages say latin-1 and mean its Windows form."""
    try:
        found = codecs.lookup(name or "").name
    except (LookupError, ValueError):
        return None
    return "cp1252" if found in ("iso8859-1", "ascii") else found


def valid(body: bytes, charset: str) -> bool:
    try:
        body.decode(charset)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def charset_of(body: bytes, content_type: str | None) -> tuple[str, int]:
    """(charset, bytes of the mark): by mark, header, the page's own word, then the first candidate whose rules the bytes keep."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return name, len(mark)
    told = CHARSET.search(content_type or "")
    own = META.search(body[:META_REACH])
    for name in (known(told[1]) if told else None, known(own[1].decode("ascii")) if own else None):
        if name and valid(body, name):
            return name, 0
    return next(n for n in CANDIDATES if valid(body, n)), 0


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """(text, charset) of binary bodies with their header; null for null. Bytes that break a charset told by a mark are replaced."""
    out = []
    for b, c in zip(body, content_type):
        if b is None:
            out.append((None, None))
            continue
        name, skip = charset_of(bytes(b), c)
        out.append((bytes(b)[skip:].decode(name, "replace"), name))
    return pd.DataFrame(out, columns=["text", "charset"])


def page_text(body: Column, content_type: Column) -> Column:
    return decoded(body, content_type)
