"""Sources of statutes: Markdown, HTML, nested JSON blocks and trees, tables of contents; each to rows of articles or lines.

A source takes a table of whole files (name, content), as ``spark.read.text(wholetext=True)`` gives it; files are cut into
lines or blocks in one pass, and what must be carried from line to line is carried by windows over one file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from fondaco.operators.relational import carry_forward

# Headings of the hierarchy and of articles.
HEADING = r"^[#*\s]*(?i:({0}))\s+([IVXLC]+)\b"
LEVELS = ["Libro", "Titolo", "Capo", "Sezione"]
ARTICLE = r"^[#*\s]*Art(?:icolo|\.)\s*(\d+(?:[-\s]?(?:bis|ter|quater|quinquies|sexies))?)\.?[*]*\s*(.*?)[*]*\s*$"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of every file below a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("content"))


def markdown_articles(files: DataFrame) -> DataFrame:
    """(name, articolo, rubrica, testo, libro, titolo, capo, sezione) of files of Markdown: text under an article's heading is its text."""
    lines = files.select("name", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line"))
    head = {level.lower(): F.nullif(F.regexp_extract("line", HEADING.format(level), 2), F.lit("")) for level in LEVELS}
    is_head = F.col("line").rlike(HEADING.format("|".join(LEVELS)))
    lines = lines.select("*", *[c.alias(k) for k, c in head.items()], is_head.alias("_head"), F.nullif(F.regexp_extract("line", ARTICLE, 1), F.lit("")).alias("_art"), F.regexp_extract("line", ARTICLE, 2).alias("_rub"))
    lines = carry_forward(lines, ["name"], "n", list(head))
    by = Window.partitionBy("name").orderBy("n")
    # A heading of the hierarchy ends the article before it.
    lines = lines.withColumn("_no", F.sum(F.when(F.col("_art").isNotNull() | F.col("_head"), 1).otherwise(0)).over(by))
    first = F.min(F.when(F.col("_art").isNotNull(), F.struct("n", "_art", "_rub", *[f"at_{k}" for k in head])))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_art").isNull() & ~F.col("_head"), F.struct("n", "line")))), lambda s: s.line), "\n")
    told = lines.groupBy("name", "_no").agg(first.alias("f"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("testo")).where("f is not null")
    return told.select("name", F.col("f._art").alias("articolo"), F.nullif(F.trim("f._rub"), F.lit("")).alias("rubrica"), "testo", *[F.col(f"f.at_{k}").alias(k) for k in head])


class _Text(HTMLParser):
    """The text of a page without scripts, menus and the like; of its main part if it names one."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe"}
    BLOCK = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}
    MAIN = {"main", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.main, self.all, self.inner = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        self.main += tag in self.MAIN
        self._put("\n" if tag in self.BLOCK else "")

    def handle_endtag(self, tag):
        self._put("\n" if tag in self.BLOCK else "")
        self.skipped -= tag in self.SKIP and self.skipped > 0
        self.main -= tag in self.MAIN and self.main > 0

    def handle_data(self, data):
        self._put(data)

    def _put(self, data):
        if data and not self.skipped:
            self.all.append(data)
            if self.main:
                self.inner.append(data)

    def text(self) -> str:
        raw = "".join(self.inner if "".join(self.inner).strip() else self.all)
        lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in raw.split("\n"))
        return "\n".join(x for x in lines if x)


def html_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return parser.text()


@F.pandas_udf(StringType())
def html_clean(html):
    import pandas as pd

    return pd.Series([html_text(h) for h in html])


def html_articles(files: DataFrame) -> DataFrame:
    """Articles of HTML files: their text is read as Markdown without marks."""
    return markdown_articles(files.select("name", html_clean("content").alias("content")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def walk(block, out):
        if isinstance(block, dict):
            text = block.get("text") or re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", block.get("html") or "")).strip()
            if text:
                out.append((str(block.get("block_type") or ""), text, int(block.get("page") or 0)))
            for child in block.get("children") or []:
                walk(child, out)

    for batch in batches:
        rows = []
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
            try:
                data = json.loads(content)
            except (TypeError, ValueError):
                continue
            found: list = []
            for top in data if isinstance(data, list) else [b for k in ("children", "pages", "blocks") for b in data.get(k) or []]:
                walk(top, found)
            rows += [(name, n, *b) for n, b in enumerate(found)]
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["name", "n", "kind", "text", "page"])


def json_blocks(files: DataFrame) -> DataFrame:
    """(name, n, kind, text, page): the blocks of nested JSON files, in reading order; unreadable files have none."""
    return files.select("name", "content").mapInArrow(_blocks, "name string, n int, kind string, text string, page int")


def json_articles(files: DataFrame) -> DataFrame:
    blocks = json_blocks(files)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s.text), "\n")
    return markdown_articles(blocks.groupBy("name").agg(body.alias("content")))


def tree_articles(files: DataFrame, depth: int = 6) -> DataFrame:
    """(name, path, articolo, testo): the leaves of JSON trees {label, children, articolo, testo}, with the labels above them."""
    level = files.select("name", F.col("content").alias("node"), F.array().cast("array<string>").alias("path"))
    leaves = None
    for _ in range(depth):
        text = F.get_json_object("node", "$.testo")
        here = level.where(text.isNotNull()).select("name", "path", F.get_json_object("node", "$.articolo").alias("articolo"), text.alias("testo"))
        leaves = here if leaves is None else leaves.unionByName(here)
        label = F.get_json_object("node", "$.label")
        level = level.select("name", F.concat("path", F.array_compact(F.array(label))).alias("path"), F.explode(F.from_json(F.get_json_object("node", "$.children"), "array<string>")).alias("node"))
    return leaves


def toc_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, title, page): lines of a table of contents: a title, leaders or blanks, a page number."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    form = r"^\s*(\S.*?)\s*(?:\.{2,}|\s{2,}|\|)\s*(\d{1,4})\s*$"
    return lines.where(F.col("line").rlike(form)).select(key, "n", F.regexp_extract("line", form, 1).alias("title"), F.regexp_extract("line", form, 2).cast("int").alias("page"))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parallel by ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of binary files, for a parser of their format."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def parsed_elements(files: DataFrame, parse) -> DataFrame:
    """(name, n, kind, text, page) of files by a parser: a function from bytes to (kind, text, page) rows.

    The engine brings no PDF parser; any that runs on the executors fits. A file the parser fails on has no elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(name, n, *e) for n, e in enumerate(parse(content))]
                except Exception:
                    continue
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["name", "n", "kind", "text", "page"])

    return files.select("name", "content").mapInArrow(run, "name string, n int, kind string, text string, page int")


def landing_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that a fetcher left as lines of JSON; the schema is given, never guessed, and bad lines come out as nulls."""
    return spark.read.schema(schema).json(path)


def with_cached_vectors(texts: DataFrame, cache: DataFrame, embed=None, dims: int = 0) -> DataFrame:
    """(key, digest, vec) of (key, text): vectors by the hash of the text, from the cache or, for new texts, from ``embed``.

    ``embed`` is a Pandas function column -> array<float>; without one new texts come out with a null vector, to be fetched.
    """
    keyed = texts.select("key", F.sha2("text", 256).alias("digest"), "text")
    known = keyed.join(cache.select("digest", "vec"), "digest", "left")
    new = F.lit(None).cast("array<float>") if embed is None else F.when(F.col("vec").isNull(), embed(F.col("text")))
    vec = F.coalesce("vec", new)
    return known.select("key", "digest", (vec if not dims else F.when(F.size(vec) == dims, vec)).alias("vec"))


def paged_text(content: bytes):
    """The simplest parser for ``parsed_elements``: pages of plain text apart by form feeds, elements apart by empty lines, a first line in capitals a heading."""
    for page, text in enumerate(content.decode("utf-8").split("\f"), 1):
        for block in re.split(r"\n\s*\n", text):
            if block := block.strip():
                yield ("heading" if block.isupper() else "text"), block, page


def sparql_bindings(files: DataFrame, variables: list[str]) -> DataFrame:
    """(name, *variables) of the answers of a SPARQL endpoint in its JSON form; a variable that a row does not bind is null, an unreadable answer has no rows."""
    row = ", ".join(f"`{v}`: struct<value: string>" for v in variables)
    told = F.from_json("content", f"struct<results: struct<bindings: array<struct<{row}>>>>")
    rows = files.select("name", F.explode(told["results"]["bindings"]).alias("b"))
    return rows.select("name", *[F.col(f"b.`{v}`.value").alias(v) for v in variables])
