"""Text of HTML pages: the blocks of the article, without navigation."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sarit.functions.text import norm_key

# Elements without prose, elements of prose, roots in order of preference, least lengths.
DROPPED = frozenset("script style nav header footer aside form button noscript iframe svg".split())
BLOCKS = frozenset("p h1 h2 h3 li".split())
ROOTS = ("article", "main", "body")
MIN_BLOCK, MIN_DOCUMENT = 40, 200
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    """Blocks with the roots they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.dropped = 0
        self.open: list[tuple[int, list[str]]] = []
        self.done: list[tuple[int, frozenset[str], list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        self.stack.append(tag)
        self.dropped += tag in DROPPED
        if tag in BLOCKS and not self.dropped:
            pieces: list[str] = []
            self.open.append((len(self.stack), pieces))
            self.done.append((len(self.done), frozenset(self.stack) & frozenset(ROOTS), pieces))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            last = self.stack.pop()
            self.dropped -= last in DROPPED
            while self.open and self.open[-1][0] > len(self.stack):
                self.open.pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            for _, pieces in self.open:
                pieces.append(data)


def blocks_of(html: str | None) -> list[str]:
    """The blocks of the article, else of main, else of the body, else of the page, white space collapsed."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    for root in ROOTS:
        found = [p for _, roots, p in parser.done if root in roots]
        if found or root in html.lower() and f"<{root}" in html.lower():
            return [" ".join("".join(p).split()) for p in found]
    return [" ".join("".join(p).split()) for _, _, p in parser.done]


@F.pandas_udf(ArrayType(StringType()))
def blocks(html: pd.Series) -> pd.Series:
    return html.map(blocks_of)


def text_of(found: Column, letters: str = r"[ऀ-ॿ]", least: int = MIN_BLOCK) -> Column:
    """Blocks of enough characters with a letter of the script, each once, joined by line feeds."""
    return F.array_join(F.array_distinct(F.filter(found, lambda b: (F.length(b) >= least) & b.rlike(letters))), "\n")


def documents(pages: DataFrame, letters: str = r"[ऀ-ॿ]", least: int = MIN_DOCUMENT) -> DataFrame:
    """pages (url, html, and if they have them source, lang, fetched_at) as documents of enough characters: doc_id by the text's
    normal form, text, lang, source, source_type, url, fetched_at (now where the page has none) and flags with the numbers of
    characters and bytes."""
    own = lambda name, other: F.coalesce(F.col(name), other) if name in pages.columns else other
    out = pages.withColumn("text", text_of(blocks(F.col("html")), letters)).where(F.length("text") >= least)
    flags = F.struct(F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))
    none = F.lit(None).cast("string")
    return out.select(F.md5(norm_key(F.col("text"))).alias("doc_id"), "text", own("lang", none).alias("lang"), own("source", none).alias("source"), F.lit("manual").alias("source_type"), "url", own("fetched_at", F.current_timestamp()).alias("fetched_at"), flags.alias("flags"))


def wiki_text(responses: DataFrame) -> DataFrame:
    """page, title, extract of responses (json) of a wiki's plain-text interface, a row for each page with text."""
    schema = "query struct<pages: map<string, struct<title: string, extract: string>>>"
    pages = responses.select(F.explode(F.from_json("json", schema)["query"]["pages"]).alias("page", "x"))
    return pages.select("page", "x.title", "x.extract").where("extract <> ''")
