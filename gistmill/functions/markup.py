"""Markup to text as columns: tags become line ends or nothing, entities are decoded, lines are tidied."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Elements that end a line of a page and of a reply, and those of each that are not shown.
PAGE_BLOCKS = "p div br li tr h1 h2 h3 h4 h5 h6 section article blockquote pre td th dt dd header footer".split()
PAGE_HIDDEN = "script style noscript template svg head".split()
REPLY_BLOCKS = "p div br ul ol tr table pre blockquote hr h1 h2 h3 h4 h5 h6".split()
REPLY_HIDDEN = "script style".split()
#: What an RTF file's markup becomes, in this order.
RTF_MARKUP = ((r"\\par[d]?\b", "\n"), (r"\{\\\*[^{}]*\}", ""), (r"\\'[0-9a-fA-F]{2}", ""), (r"\\[a-zA-Z]+-?\d* ?", ""), (r"[{}]", ""))

#: What follows a tag's name: attributes, whose quoted values may hold a closing bracket, and the bracket itself.
REST = r"""(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>"""
#: The same for an element that has a content, so does not close itself.
OPEN_REST = r"""(?:\s(?:[^>"'/]|"[^"]*"|'[^']*'|/[^>])*)?>"""


def markup_steps(page: bool) -> list[tuple[str, str]]:
    """(pattern, replacement) in order, in the syntax that Java and RE2 share."""
    blocks, hidden = (PAGE_BLOCKS, PAGE_HIDDEN) if page else (REPLY_BLOCKS, REPLY_HIDDEN)
    steps = [(r"(?s)<!--.*?(?:-->|\z)", ""), (r"(?s)<[!?][^>]*>", "")]
    steps += [(rf"(?is)<{x}{OPEN_REST}.*?(?:</{x}\s*>|\z)", "") for x in (*hidden, *(["title"] if page else []))]
    steps += [] if page else [(rf"(?i)<li{REST}", "\n- ")]
    return [*steps, (rf"(?i)</?(?:{'|'.join(blocks)}){REST}", "\n"), (rf"(?i)</?[a-z][^\s/>]*{REST}", ""), ("</?[A-Za-z][^>]*>", "")]


def replaced(text: Column, steps: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> Column:
    for pattern, plain in steps:
        # so that quoted values are taken whole without a way back, which would go as deep as they are long
        pattern = pattern.replace("""(?:[^>"']|"[^"]*"|'[^']*')*""", """(?:[^>"']++|"[^"]*+"|'[^']*+')*+""").replace("""(?:[^>"'/]|"[^"]*"|'[^']*'|/[^>])*""", """(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/[^>])*+""")
        text = F.regexp_replace(text, pattern, plain)
    return text


@F.pandas_udf(ArrayType(StringType()))
def decoded(texts: pd.Series) -> pd.Series:
    """Texts with their character references decoded."""
    return texts.map(lambda row: None if row is None else [t if t is None or "&" not in t else html.unescape(t) for t in row])


CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


@F.pandas_udf(ArrayType(StringType()))
def decoded_closed(texts: pd.Series) -> pd.Series:
    """The same for references that end with a semicolon; others stay, where decoded() reads the old names without one."""
    return texts.map(lambda row: None if row is None else [t if t is None or "&" not in t else CLOSED.sub(_closed, t) for t in row])


def tidy(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+", " "))


def tight_lines(text: Column) -> Column:
    """Lines with their white space collapsed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), tidy), lambda x: x != ""), "\n")


def loose_lines(text: Column) -> Column:
    """Lines with their white space collapsed, runs of blank ones as one."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\R|[\x1c-\x1e]", "\n"), "\n"), tidy)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def title_of(page: Column) -> Column:
    """What stands in a page's title element, as it is."""
    return F.regexp_extract(page, rf"(?is)<title{REST}(.*?)</title\s*>", 1)


def page_texts(pages: Column) -> Column:
    """The shown text of each page of an array."""
    return F.transform(decoded(F.transform(pages, lambda p: replaced(p, markup_steps(True)))), tight_lines)


def html_page(page: Column | str, closed: bool = False) -> Column:
    """struct(title, text) of a page; closed: decode only character references that end with a semicolon."""
    raw = F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit(""))
    both = (decoded_closed if closed else decoded)(F.array(title_of(raw), replaced(raw, markup_steps(True))))
    title = tidy(F.element_at(both, 1))
    return F.struct(F.when(title != "", title).alias("title"), tight_lines(F.element_at(both, 2)).alias("text"))


def reply_text(parts: Column) -> Column:
    """Text of an array of HTML parts, list items as bullets, parts joined by blank lines."""
    given = F.coalesce(parts, F.array().cast("array<string>"))
    texts = F.transform(decoded(F.transform(given, lambda p: replaced(p, markup_steps(False)))), loose_lines)
    return F.array_join(F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False))), "\n\n")


def rtf_text(text: Column) -> Column:
    return tight_lines(replaced(text, RTF_MARKUP))


def labelled(cells: Column) -> Column:
    """Rows of cells as `name: value | ...` by the first row's names; the names alone if there are no others. Blank rows
    are no rows, and empty cells and cells without a name are left out."""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: F.coalesce(tidy(c) != "", F.lit(False))))
    names = F.get(rows, F.lit(0))
    filled = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(F.zip_with(names, r, lambda n, c: F.when(c != "", F.concat(n, F.lit(": "), c))), " | "))
    return F.when(F.size(rows) < 1, "").when(F.size(rows) < 2, F.array_join(names, " | ")).otherwise(F.array_join(filled, "\n"))


def sheet_text(cells: Column, name: Column) -> Column:
    """A sheet's name over its rows as labelled() has them, but a cell of a column without a name stands alone; nothing
    for a sheet without cells."""
    full = lambda c: F.coalesce(c != "", F.lit(False))
    rows = F.filter(cells, lambda r: F.exists(r, full))
    heads = F.get(rows, F.lit(0))
    shown = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(F.zip_with(heads, r, lambda n, c: F.when(n.isNotNull() & full(c), F.when(n == "", c).otherwise(F.concat(n, F.lit(": "), c)))), " | "))
    body = F.when(F.size(rows) < 2, F.array_join(F.filter(heads, full), " | ")).otherwise(F.array_join(shown, "\n"))
    return F.when(F.size(rows) < 1, "").otherwise(F.concat(F.when(name != "", F.concat(name, F.lit("\n"))).otherwise(""), body))
