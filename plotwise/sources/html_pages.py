"""Property records from a table of HTML pages.

The pages stay distributed: each Arrow batch is parsed where it is read. Parsing
markup is the one step Spark has no expression for; what follows it (postcodes,
prices, dates, numbers) is done by the usual column functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotwise.functions import text

# Image endings of floorplans, elements without an end tag.
FLOORPLAN_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
CAPTURED = {"h1", "h2", "td", "th", "li", "dt", "dd", "a"}

RAW_SCHEMA = (
    "address string, table_rows array<array<string>>, features array<string>,"
    " terms array<struct<key string, value string>>, floorplan_urls array<string>"
)


class PropertyPage(HTMLParser):
    """Collects the few elements a property record is made of."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.address: str | None = None
        self.rows: list[list[str]] = []
        self.features: list[str] | None = None
        self.keys: list[str] = []
        self.values: list[str] = []
        self.image_urls: list[str] = []
        self.link_urls: list[str] = []
        self._open: list[tuple[str, list[str], dict]] = []
        self._depth = 0
        self._tables = 0
        self._table_depth = 0
        self._list_wanted_at: int | None = None
        self._list_depth: int | None = None
        self._muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self._muted += 1
        if tag == "img":
            self._image(found)
        if tag in VOID:
            return
        self._depth += 1
        if tag == "table":
            self._table_depth += 1
            self._tables += self._table_depth == 1
        elif tag == "tr" and self._table_depth and self._tables == 1:
            self.rows.append([])
        elif tag == "ul" and self._list_wanted_at == self._depth and self.features is None:
            self.features, self._list_depth = [], self._depth
        if tag in CAPTURED:
            self._open.append((tag, [], {"depth": self._depth, **found}))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._muted = max(self._muted - 1, 0)
        if tag in VOID:
            return
        if any(entry[0] == tag for entry in self._open):
            while self._open:
                name, parts, found = self._open.pop()
                self._finish(name, "".join(parts), found)
                if name == tag:
                    break
        if tag == "table":
            self._table_depth = max(self._table_depth - 1, 0)
        if tag == "ul" and self._list_depth == self._depth:
            self._list_depth = None
        self._depth = max(self._depth - 1, 0)
        wanted = self._list_wanted_at
        if wanted is not None and self.features is None and self._depth < wanted - 1:
            self._list_wanted_at = -1  # the heading's parent ended without a list

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self._muted:
            for _, parts, _ in self._open:
                parts.append(piece)

    def _image(self, found: dict) -> None:
        source = found.get("src", "")
        if not source:
            return
        marks = (found.get("alt", ""), found.get("class", ""), source)
        if any("floorplan" in m.lower() for m in marks):
            self.image_urls.append(source)
        for name, _, link in self._open:
            if name == "a" and "href" in link:
                link.setdefault("inner", source)

    def _finish(self, name: str, value: str, found: dict) -> None:
        if name == "h1" and self.address is None:
            self.address = value
        elif name == "h2" and self._list_wanted_at is None and "key features" in value.lower():
            self._list_wanted_at = found["depth"]
        elif name in ("td", "th") and self._tables == 1 and self._table_depth and self.rows:
            self.rows[-1].append(value)
        elif name == "li" and self._list_depth is not None and value:
            self.features.append(value)
        elif name == "dt":
            self.keys.append(value.lower())
        elif name == "dd":
            self.values.append(value)
        elif name == "a" and "href" in found:
            href = found["href"]
            if "floorplan" in value.lower() or "floorplan" in href.lower():
                if href.lower().endswith(FLOORPLAN_ENDINGS):
                    self.link_urls.append(href)
                if found.get("inner"):
                    self.link_urls.append(found["inner"])


def _page_record(html: str | None) -> tuple:
    page = PropertyPage()
    page.feed(html or "")
    page.close()
    terms = [{"key": k, "value": v} for k, v in zip(page.keys, page.values)]
    return (page.address, page.rows, page.features or [], terms, page.image_urls + page.link_urls)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["address", "table_rows", "features", "terms", "floorplan_urls"]
    for batch in batches:
        parsed = pd.DataFrame([_page_record(h) for h in batch["html"]], columns=names,
                              index=batch.index)
        yield pd.concat([batch[["page_id", "url"]], parsed], axis=1)


def _first_number(terms: str, word: str):
    """Number in the last matching term, as later terms overwrite earlier ones."""
    digits = F.transform(
        F.filter(terms, lambda t: F.contains(t["key"], F.lit(word))),
        lambda t: text.blank_to_null(F.regexp_extract(t["value"], r"(\d+)", 1)).try_cast("int"),
    )
    return F.coalesce(F.get(F.reverse(F.filter(digits, lambda d: d.isNotNull())), 0), F.lit(0))


def extract_pages(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Property records of pages (page_id, url, html); pages without any drop out.

    ``tasks`` spreads pages that come from few partitions over that many before they are
    parsed; without it they are parsed where they are read.

    Sales come from the first table: date, change, price, then type and tenure
    with five columns, or tenure alone with four.
    """
    read = pages.select("page_id", "url", "html")
    raw = (read.repartition(tasks, "page_id") if tasks else read).mapInPandas(
        _parse_batches, f"page_id bigint, url string, {RAW_SCHEMA}"
    )
    wide = F.size(F.get("table_rows", 0)) >= 5
    cell = lambda row, i: F.coalesce(F.get(row, i), F.lit(""))
    sales = F.transform(
        F.filter(F.slice("table_rows", 2, 1000000000), lambda r: F.size(r) >= 3),
        lambda r: F.struct(
            cell(r, 0).alias("date_sold"), cell(r, 2).alias("price"),
            cell(r, 1).alias("price_change_pct"),
            F.when(wide & (F.size(r) >= 5), cell(r, 3)).otherwise("").alias("property_type"),
            F.when(wide & (F.size(r) >= 5), cell(r, 4)).otherwise(cell(r, 3)).alias("tenure"),
        ),
    )
    kinds = F.filter("terms", lambda t: F.contains(t["key"], F.lit("property type")) | (t["key"] == "type"))
    return raw.withColumn(
        "sales", F.filter(sales, lambda s: (s["date_sold"] != "") | (s["price"] != ""))
    ).where((F.coalesce("address", F.lit("")) != "") | (F.size("sales") > 0)).select(
        "page_id", "url", F.coalesce("address", F.lit("")).alias("address"),
        text.postcode_in(F.col("address")).alias("postcode"),
        F.coalesce(F.get(F.reverse(kinds), 0)["value"], F.lit("")).alias("property_type"),
        _first_number("terms", "bedroom").alias("bedrooms"),
        _first_number("terms", "bathroom").alias("bathrooms"),
        F.col("features").alias("extra_features"),
        F.array_distinct("floorplan_urls").alias("floorplan_urls"), "sales",
    )


def page_sales(records: DataFrame) -> DataFrame:
    """One row per sale with parsed price and date."""
    rows = records.select("page_id", "address", F.explode("sales").alias("s"))
    return rows.select(
        "page_id", "address", "s.*", text.price_to_int(F.col("s.price")).alias("price_numeric"),
        text.date_to_iso(F.col("s.date_sold")).alias("date_sold_iso"),
    )
