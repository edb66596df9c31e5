"""Document sources and text normalisation: SQLite stores, REST payloads, page metadata, generated-text payloads."""

from __future__ import annotations

import html
import json
import re
import sqlite3
import unicodedata
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType


@F.pandas_udf(StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """Entities decoded, compatibility forms unified, white space joined. Null stays null."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", html.unescape(t)).split()))


def stable_id(space: uuid.UUID, name: Column) -> Column:
    """Version 5 UUID of a name within a name space, as a column expression."""
    h = F.lower(F.substring(F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8"))), 1, 32))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


REST_SCHEMA = "id bigint, link string, date_gmt string, modified_gmt string, author bigint, title struct<rendered: string>, content struct<rendered: string>"


def rest_posts(payloads: DataFrame, column: str) -> DataFrame:
    """JSON posts as rows; a payload that isn't a post of this shape gives none."""
    p = payloads.select(F.from_json(column, REST_SCHEMA).alias("p")).filter("p.id is not null and p.link is not null")
    return p.select("p.id", F.col("p.link").alias("url"), F.col("p.author"), F.try_to_timestamp("p.date_gmt").alias("published_at"), F.try_to_timestamp("p.modified_gmt").alias("modified_at"), clean_text("p.title.rendered").alias("title"), clean_text(F.regexp_replace("p.content.rendered", r"(?s)<[^>]*>", " ")).alias("text"))


def page_metadata(pages: DataFrame, source: str = "html") -> DataFrame:
    """Add title, section, tags and the headline of linked data; what a page doesn't have is null."""
    one = lambda p: F.nullif(F.regexp_extract(source, p, 1), F.lit(""))
    linked = F.regexp_extract(source, r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    named = lambda kind, name: F.coalesce(one(rf'(?i)<meta[^>]*(?:property|name)="{kind}:{name}"[^>]*content="([^"]*)"'), one(rf'(?i)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)="{kind}:{name}"'))
    return pages.withColumns({
        "meta_title": F.coalesce(named("og", "title"), one(r"(?is)<title>([^<]*)</title>")),
        "meta_section": F.coalesce(named("og", "section"), named("article", "section"), F.get_json_object(linked, "$.articleSection")),
        "meta_tags": F.regexp_extract_all(source, F.lit(r'(?i)<meta[^>]*property="article:tag"[^>]*content="([^"]*)"'), F.lit(1)),
        "meta_headline": F.get_json_object(linked, "$.headline"),
        "meta_published": F.coalesce(named("article", "published_time"), F.get_json_object(linked, "$.datePublished")),
        "meta_modified": F.coalesce(named("article", "modified_time"), F.get_json_object(linked, "$.dateModified")),
        "meta_author": F.coalesce(named("article", "author"), F.get_json_object(linked, "$.author.name"), F.get_json_object(linked, "$.author[0].name")),
    })


#: Containers of a story in their order of precedence, and what is taken out of them.
CONTAINERS = [("div", "entry-content"), ("article", None), ("div", "post-content")]
DROPPED_TAGS = frozenset(["script", "style", "nav", "aside", "footer"])
DROPPED_CLASSES = ("related-posts", "social-share", "advertisement", "sidebar", "newsletter", "comments", "jp-relatedposts")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Bodies(HTMLParser):
    """The text of the first element of each container, without the dropped parts; one pass for all of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: dict[int, int] = {}
        self.texts: dict[int, list[str]] = {}
        self.skip: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        classes = (dict(attrs).get("class") or "").lower().split()
        self.stack.append(tag)
        depth = len(self.stack)
        for i, (name, wanted) in enumerate(CONTAINERS):
            if i not in self.texts and tag == name and (wanted is None or wanted in classes):
                self.texts[i], self.open[i] = [], depth
        inside = any(d < depth for d in self.open.values())
        if self.skip is None and (tag in DROPPED_TAGS or (inside and any(x in " ".join(classes) for x in DROPPED_CLASSES))):
            self.skip = depth

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack:
                depth, top = len(self.stack), self.stack.pop()
                self.open = {i: d for i, d in self.open.items() if d != depth}
                if self.skip == depth:
                    self.skip = None
                if top == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.skip is None:
            for i in self.open:
                self.texts[i].append(data)


def body_of(page: str | None) -> str:
    """The story of a page by precedence of containers: lines of text, white space joined; '' without a container or page."""
    parser = _Bodies()
    parser.feed(page or "")
    parser.close()
    for i in range(len(CONTAINERS)):
        if i in parser.texts:
            lines = (" ".join(unicodedata.normalize("NFKC", x).split()) for x in "\n".join(parser.texts[i]).split("\n"))
            return "\n".join(x for x in lines if x)
    return ""


def article_bodies(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """key, body of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "body": [body_of(x if isinstance(x, str) else None) for x in b[source]]})

    return pages.select(key, source).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, body string")


_FENCE = re.compile(r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$")
_DECODER = json.JSONDecoder()


def _article_in(found: object) -> tuple[str, str] | None:
    """Headline and text of an object, or of what it wraps: article, parameters, or arguments (an object or its JSON)."""
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except (json.JSONDecodeError, RecursionError):
            return None
    if not isinstance(found, dict):
        return None
    if isinstance(found.get("text"), str):
        return str(found.get("headline") or ""), found["text"]
    return next((got for k in ("parameters", "arguments", "article") if k in found and (got := _article_in(found[k]))), None)


def parse_generated(raw: str | None) -> tuple[str, str]:
    """Headline and text of a model's answer: fenced, wrapped in JSON anywhere in it, or plain with its first line as headline.

    Braces are tried in their order until one opens an object with a text; an object that is read is not looked into again.
    """
    body = (raw or "").strip()
    fenced = _FENCE.match(body)
    body = fenced[1].strip() if fenced else body
    at = body.find("{")
    while at >= 0:
        try:
            found, end = _DECODER.raw_decode(body, at)
        except (json.JSONDecodeError, RecursionError):
            end = at + 1
        else:
            if got := _article_in(found):
                return got
        at = body.find("{", end)
    body = body.strip('"')
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    if len(lines) < 2:
        return "", body.strip()
    head, rest = lines[0], body.split(lines[0], 1)[1].strip()
    return head.strip("# ").strip()[:200], rest


def generated_articles(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, headline, text of each raw answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_generated(r) for r in b[raw]]
            yield pd.DataFrame({key: b[key], "headline": [h for h, _ in got], "text": [t for _, t in got]})

    return df.select(key, raw).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, headline string, text string")


class SqliteSource(DataSource):
    """spark.read.format("sqlite_table") with options path, table and schema; ranges of rowid are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.columns = [f.name for f in schema.fields]
        if not all(re.fullmatch(r"\w+", x) for x in [self.table, *self.columns]):
            raise ValueError("table and column names must be plain words")

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=5)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as con:
            lo, hi = con.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        step = -(-(hi - lo + 1) // self.parts)
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._connect() as con:
            yield from con.execute(f"select {', '.join(self.columns)} from {self.table} where rowid >= ? and rowid < ?", (partition.lo, partition.hi))


def read_sqlite(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", name).option("ddl", ddl).load()
