"""Tables and text inside HTML and Markdown documents."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ordered import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -----------------------------------------------------------
BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav "
                       "ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = ("script", "style", "head", "noscript", "template")
C1 = range(0x80, 0xA0)  # numbers in this range are read as Windows characters
# ----------------------------------------------------------------------------
# Possessive loops neither backtrack nor recurse, however long a page or a tag is.
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(HIDDEN_TAGS)})(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1\s*>|\z)"
BLOCK = rf"(?i)</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>]){_ATTRIBUTES}"
TAG = rf"<[A-Za-z/!?]{_ATTRIBUTES}"
_BLANK = r"[\s&&[^\n]]*+"
_PIPED = rf"{_BLANK}\|.*\|{_BLANK}(?=\n|\z)"
# The first pipe line of a run that has dashes below, those, and all pipe lines that follow, one at least.
MARKDOWN_TABLE = rf"(?U)(?<![^\n]){_PIPED}\n(?={_BLANK}\|?{_BLANK}:?-{{2,}}){_PIPED}(?:\n{_PIPED})++"
WINDOWS = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in C1)


class _Tables(HTMLParser):
    """Collects cell text per table; an inner table closes before its outer one goes on."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "cell": None})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = None
        elif self.open and tag in ("td", "th"):
            table = self.open[-1]
            if not table["rows"]:
                table["rows"].append([])
            table["cell"] = []
            table["rows"][-1].append(table["cell"])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.done.append(self.open.pop()["rows"])
        elif tag in ("td", "th") and self.open:
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)


def tables_in(html: str, minimum: int = 2) -> list[list[list[str]]]:
    """Cell texts of every table with a header and at least ``minimum`` further rows."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for rows in parser.done:
        texts = [["".join(c).strip() for c in r] for r in rows]
        filled = [r for r in texts if any(r)]
        if len(filled) > minimum:
            out.append(filled)
    return out


def extract_html_tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, table_no, row_no, cells); row 0 is the header."""
    key = pages.schema[page].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t, r, cells) for k, h in zip(batch[page], batch[html])
                    for t, table in enumerate(tables_in(h), 1) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[page, "table_no", "row_no", "cells"])

    return spread(pages.select(page, html)).mapInPandas(run, f"{page} {key}, table_no int, row_no int, cells array<string>")


def _character(code: Column) -> Column:
    """The character of a numeric reference; numbers that stand for none give the replacement character."""
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(known, F.translate(plain, "".join(map(chr, C1)), WINDOWS)).otherwise(F.lit("\ufffd"))


def decode_references(c: Column) -> Column:
    """Character references that end in a semicolon, named or numbered; anything else after an ampersand stays as it is."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("long")
        char = F.when(name == "amp", "&").when(name.startswith("#"), _character(number)).when(name != "", F.try_element_at(names, name))
        return F.when(i == 0, part).when(char.isNotNull(), F.concat(char, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "&"), piece), "")).otherwise(c)


def html_to_text(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, text): visible text, block elements on their own lines; comments and hidden elements go, null gives an empty text."""
    shown = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, "")
    shown = F.regexp_replace(F.regexp_replace(shown, BLOCK, "\n"), TAG, "")
    bare = spread(pages.select(page, html)).select(page, shown.alias("__t"))
    lines = F.regexp_replace(F.regexp_replace(decode_references(F.col("__t")), r"(?U)[\s&&[^\n]]+", " "), r" ?\n[ \n]*", "\n")
    return bare.select(page, F.trim(lines, F.lit(" \n")).alias("text"))


def extract_markdown_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, table_no, row_no, cells) of pipe tables; row 0 is the header, the dashed line is left out. Rows of one doc and text count as
    copies, each of whose lines has a number of its own.

    A text is one row, in which a regular expression finds the tables: only texts are shuffled, for their copies, not lines."""
    dealt = docs.select(doc, F.col(text).alias("__t")).where(F.col("__t").contains("|")).repartition(doc, "__t")
    copies = dealt.groupBy(doc, "__t").agg(F.count(F.lit(1)).alias("__n"))
    tables = copies.select(doc, "__n", F.posexplode(F.regexp_extract_all("__t", F.lit(MARKDOWN_TABLE), F.lit(0))).alias("__i", "__t"))
    rows = F.filter(F.split("__t", "\n"), lambda line, i: i != 1)
    lines = tables.select(doc, (F.col("__i") + 1).alias("table_no"), "__n", F.posexplode(rows).alias("__r", "line"))
    lines = lines.select(doc, "table_no", "line", "__r", "__n", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)).alias("__k"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.select(doc, "table_no", (F.col("__r") * F.col("__n") + F.col("__k")).cast("int").alias("row_no"), cells.alias("cells"))
