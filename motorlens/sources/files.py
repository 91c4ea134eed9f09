"""Fixed-width, ZIP, CSV, XML-feed, JSON and HTML sources as DataFrames. Fetching is left to others."""

from __future__ import annotations

import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a ZIP member handed on at a time.
LINES = 10_000
VEHICLE = "make string, model string, year int, mileage_km int, price_eur double, fuel_type string, url string"


def fixed_width(lines: DataFrame, fields: list[tuple[str, int, int]], width: int) -> DataFrame:
    """Columns cut from ``value`` at (name, start from 1, length); a byte-order mark is dropped, short lines go to ``short``."""
    line = F.regexp_replace("value", "^(﻿|ï»¿)", "")
    out = lines.select(line.alias("line"))
    return out.select((F.length("line") < width).alias("short"), *(F.trim(F.substring("line", start, size)).alias(name) for name, start, size in fields))


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]], width: int) -> DataFrame:
    # The text source reads UTF-8 only; a CSV of one column takes an encoding and splits files just as well.
    lines = spark.read.options(encoding="ISO-8859-1", sep="\u0001", quote="").schema("value string").csv(path)
    return fixed_width(lines, fields, width)


def zip_lines(binaries: DataFrame, skip: str = "readme") -> DataFrame:
    """(member, line) of all text members of ZIP files (columns of the ``binaryFile`` source); names with ``skip`` are left out."""

    def opened(parts):
        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if skip not in name.lower():
                            with io.TextIOWrapper(archive.open(name), "iso-8859-1") as lines:
                                while rows := list(itertools.islice(lines, LINES)):
                                    yield pd.DataFrame({"member": name, "value": [x.rstrip("\r\n") for x in rows]})

    return binaries.select("content").mapInPandas(opened, "member string, value string")


ALIASES = {
    "make": ("make", "marke", "marque", "marca", "brand"), "model": ("model", "modell", "modele", "modelo"), "year": ("year", "baujahr", "annee", "ano", "erstzulassung"),
    "mileage_km": ("mileage_km", "mileage", "km", "kilometerstand", "kilometrage"), "price_eur": ("price_eur", "price", "preis", "prix", "precio"), "fuel_type": ("fuel_type", "fuel", "kraftstoff", "carburant", "combustible"), "url": ("url", "link", "href"),
}


def aliased(df: DataFrame) -> DataFrame:
    """Columns under their usual names, found by alias whatever their case; absent ones are null."""
    have = {re.sub(r"[^a-z0-9_]", "", c.lower()): c for c in df.columns}
    kinds = dict(part.split(" ") for part in VEHICLE.split(", "))
    picked = []
    for name, options in ALIASES.items():
        found = next((have[o] for o in options if o in have), None)
        picked.append((F.col(f"`{found}`").try_cast(kinds[name]) if found else F.lit(None).cast(kinds[name])).alias(name))
    return df.select(picked)


def aliased_map(m: Column) -> Column:
    """The same over a map of strings (JSON of changing keys)."""
    low = F.transform_keys(m, lambda k, _: F.lower(k))
    kinds = dict(part.split(" ") for part in VEHICLE.split(", "))
    return F.struct(*(F.coalesce(*(low[o] for o in options)).try_cast(kinds[name]).alias(name) for name, options in ALIASES.items()))


def feed_items(pages: DataFrame, column: str = "xml") -> DataFrame:
    """(title, link) of RSS items and Atom entries."""
    items = F.regexp_extract_all(column, F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), 0)
    rows = pages.select(F.explode(items).alias("i"))
    link = F.coalesce(F.nullif(F.regexp_extract("i", r"(?s)<link[^>]*href=\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.trim(F.regexp_extract("i", r"(?s)<link>(.*?)</link>", 1)), F.lit("")))
    return rows.select(F.trim(F.regexp_extract("i", r"(?s)<title[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1)).alias("title"), link.alias("link"))


def sitemap_urls(pages: DataFrame, column: str = "xml", vehicle: str = r"/(cars?|vehicles?|auto|voiture|coche|fahrzeug)") -> DataFrame:
    """Vehicle links of sitemaps."""
    return pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")).where(F.lower("url").rlike(vehicle)).distinct()


class _Scripts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "script" and dict(attrs).get("type") == "application/ld+json"
        if self.inside:
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def _text(x):
    if isinstance(x, dict):
        return _text(x.get("name") or x.get("value"))
    return _text(x[0]) if isinstance(x, list) and x else None if isinstance(x, list) else x


def _number(x):
    found = re.search(r"\d+(?:\.\d+)?", str(_text(x) or "").replace(",", ""))
    return float(found[0]) if found else None


def json_ld_vehicles(html: str | None) -> list[dict]:
    """Cars described by JSON-LD anywhere in a page (graphs, lists, nested items)."""
    parser = _Scripts()
    parser.feed(html or "")
    out, todo = [], []
    for script in parser.found:
        try:
            todo.append(json.loads(script))
        except ValueError:
            continue
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if {"Car", "Vehicle"} & set(kinds if isinstance(kinds, list) else [kinds]):
                offer = node.get("offers") or {}
                offer = offer[0] if isinstance(offer, list) and offer else offer
                year, km = _number(node.get("vehicleModelDate") or node.get("productionDate")), _number(node.get("mileageFromOdometer"))
                out.append({"make": _text(node.get("brand") or node.get("manufacturer")), "model": _text(node.get("model")), "year": int(year) if year else None, "mileage_km": int(km) if km is not None else None, "price_eur": _number(offer.get("price") if isinstance(offer, dict) else None), "fuel_type": _text(node.get("fuelType")), "url": node.get("url")})
            else:
                todo += list(node.values())
    return out


def html_vehicles(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row for each car that JSON-LD in the pages describes."""

    def walked(parts):
        for part in parts:
            rows = [v for html in part[column] for v in json_ld_vehicles(html)]
            frame = pd.DataFrame(rows, columns=list(ALIASES))
            yield frame.astype({"year": "Int32", "mileage_km": "Int32", "price_eur": "Float64"})

    return pages.select(column).mapInPandas(walked, VEHICLE)


def fenced_json(answer: Column, schema: str) -> Column:
    """JSON of a model's answer, with or without a code fence."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""), schema)


def page_fields(pages: DataFrame, column: str = "html") -> DataFrame:
    """Title, number of links and visible characters of pages, by expressions alone."""
    bare = F.regexp_replace(F.regexp_replace(column, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return pages.withColumn("title", F.trim(F.regexp_extract(column, r"(?is)<title[^>]*>(.*?)</title>", 1))).withColumn("n_links", F.regexp_count(column, F.lit(r"(?i)<a\s")).cast("long")).withColumn("text_chars", F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))).cast("long"))


# ---------------------------------------------------------------- JSON bodies: captured calls, content systems, pushes

WRAPPERS = ("vehicles", "inventory", "results", "items", "listings", "data", "records", "cars")


def json_items(body: Column) -> Column:
    """Entries of a JSON body: the array itself, or the first non-empty one under a usual key."""
    each = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in WRAPPERS]
    inner = F.coalesce(*(F.when(F.size(x) > 0, x) for x in each))
    return F.when(F.startswith(F.ltrim(body), F.lit("[")), F.from_json(body, "array<string>")).otherwise(inner)


def json_vehicles(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Vehicles in captured JSON bodies, whatever their keys' language; those without make and model are left out."""
    items = bodies.select(F.explode(json_items(F.col(column))).alias("i")).where("i is not null")
    return items.select(aliased_map(F.from_json("i", "map<string,string>")).alias("v")).select("v.*").where("make is not null or model is not null")


def posts(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Vehicles in posts of a content system's interface: title, link and its meta fields (or custom ones)."""
    items = bodies.select(F.explode(F.from_json(column, "array<string>")).alias("i"))
    meta = F.coalesce(F.from_json(F.coalesce(F.get_json_object("i", "$.meta"), F.get_json_object("i", "$.acf")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    bare = F.map_from_entries(F.transform(F.map_entries(meta), lambda e: F.struct(F.ltrim(e["key"], F.lit("_")), e["value"])))
    v = aliased_map(bare)
    return items.select(F.get_json_object("i", "$.id").try_cast("long").alias("post_id"), F.regexp_replace(F.get_json_object("i", "$.title.rendered"), r"<[^>]*>", "").alias("title"), v.alias("v"), F.get_json_object("i", "$.link").alias("link")).select("post_id", "title", "v.make", "v.model", "v.year", "v.mileage_km", "v.price_eur", "v.fuel_type", F.coalesce("v.url", "link").alias("url"))


def pushed(listings: DataFrame, now_year: int) -> DataFrame:
    """Pushed listings with what is wrong with them in ``error`` (null: nothing): VIN of 17 bytes, make, model, year."""
    bad = F.when(F.coalesce(F.length("vin"), F.lit(0)) == 0, "vin required").when(F.octet_length("vin") != 17, "vin must be 17 characters").when(F.coalesce("make", F.lit("")) == "", "make required").when(F.coalesce("model", F.lit("")) == "", "model required")
    return listings.withColumn("error", bad.when(~F.coalesce(F.col("year").between(1900, now_year + 2), F.lit(False)), "year out of range"))


def pending(queue: DataFrame, consumed: DataFrame, key: str = "id") -> DataFrame:
    """Staged rows (mail, pushes, manual entries) that no run has taken yet."""
    return queue.join(consumed.select(key), key, "left_anti")


# ---------------------------------------------------------------- tables in documents


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, as texts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ET.fromstring(book.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value = c.find("m:v", ns)
                inline = c.find("m:is/m:t", ns)
                raw = inline.text if inline is not None else value.text if value is not None else ""
                cells += [""] * (at - len(cells)) + [shared[int(raw)] if c.get("t") == "s" and raw else raw or ""]
            rows.append(cells)
    return rows


def table_vehicles(rows: list[list[str]]) -> list[dict]:
    """Vehicles of a table whose first row names its columns; a column belongs to the first field one of whose names it holds."""
    if len(rows) < 2:
        return []
    where: dict[str, int] = {}
    for i, head in enumerate(rows[0]):
        for name, options in ALIASES.items():
            if name not in where and any(o in head.strip().lower() for o in options):
                where[name] = i
                break
    out = []
    for row in rows[1:]:
        cell = {n: row[i].strip() for n, i in where.items() if i < len(row) and row[i].strip()}
        if cell:
            year, km, price = _number(cell.get("year")), re.sub(r"\D", "", cell.get("mileage_km", "")), _amount(cell.get("price_eur", ""))
            out.append({"make": cell.get("make"), "model": cell.get("model"), "year": int(year) if year and 1900 < year < 2100 else None, "mileage_km": int(km) if km else None, "price_eur": price, "fuel_type": cell.get("fuel_type"), "url": cell.get("url")})
    return out


def _amount(raw: str) -> float | None:
    kept = re.sub(r"[^0-9.,]", "", raw)
    kept = re.sub(r"[.,](?=\d{3}(?:[.,]|$))", "", kept).replace(",", ".")
    try:
        return float(kept)
    except ValueError:
        return None


def workbook_vehicles(files: DataFrame, column: str = "content") -> DataFrame:
    """Vehicles in workbooks (columns of the ``binaryFile`` source), a workbook at a time."""
    return _vehicles(files, column, lambda content: table_vehicles(sheet_rows(content)))


def page_lines(text_: str) -> list[list[str]]:
    """A document's text as rows: lines cut at tabs, bars, semicolons or runs of blanks."""
    return [[c.strip() for c in re.split(r"\t|\||;|\s{2,}", line.strip()) if c.strip()] for line in (text_ or "").splitlines() if line.strip()]


def document_vehicles(texts: DataFrame, column: str = "text") -> DataFrame:
    """Vehicles in texts taken from documents: the table below the first line that names at least three of its columns."""

    def found(text_):
        rows = page_lines(text_)
        known = lambda row: sum(any(o in cell.lower() for cell in row for o in options) for options in ALIASES.values())
        at = next((i for i, row in enumerate(rows) if known(row) >= 3), None)
        return [] if at is None else table_vehicles(rows[at:])

    return _vehicles(texts, column, found)


def _vehicles(df: DataFrame, column: str, read) -> DataFrame:
    def rows(parts):
        for part in parts:
            for value in part[column]:
                frame = pd.DataFrame(read(value), columns=list(ALIASES))
                yield frame.astype({"year": "Int32", "mileage_km": "Int32", "price_eur": "Float64"})

    return df.select(column).mapInPandas(rows, VEHICLE)


# ---------------------------------------------------------------- marked-up pages


class _Marked(HTMLParser):
    """Values of ``itemprop`` (microdata) or ``property`` (RDFa) attributes, item by item."""

    VOID = {"meta", "link", "img", "br", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self, base: str):
        super().__init__()
        self.base, self.depth = base, 0
        self.items: list[dict] = []
        self.open: list[tuple[int, dict]] = []
        self.reading: list[list] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in self.VOID:
            self.depth += 1
        kind = a.get("itemtype") or a.get("typeof") or ""
        if re.search(r"(?i)(car|vehicle|motorcycle)$", kind.strip()) and ("itemscope" in a or "typeof" in a):
            item: dict = {}
            self.items.append(item)
            self.open.append((self.depth, item))
        name = (a.get("itemprop") or a.get("property") or "").split(":")[-1].strip().lower()
        if name and self.open:
            item = self.open[-1][1]
            given = a.get("content") or (urljoin(self.base, a["href"]) if a.get("href") else urljoin(self.base, a["src"]) if a.get("src") else a.get("resource"))
            if given:
                item.setdefault(name, given.strip())
            elif tag not in self.VOID and "itemscope" not in a and "typeof" not in a:
                self.reading.append([self.depth, name, item, ""])

    def handle_data(self, data):
        for r in self.reading:
            r[3] += data

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        while self.reading and self.reading[-1][0] >= self.depth:
            _, name, item, said = self.reading.pop()
            if said.strip():
                item.setdefault(name, " ".join(said.split()))
        while self.open and self.open[-1][0] >= self.depth:
            self.open.pop()
        self.depth -= 1


def marked_vehicles(html: str | None, base: str = "") -> list[dict]:
    """Cars that a page marks up as microdata or RDFa; those without a make and a VIN are left out."""
    parser = _Marked(base or "")
    parser.feed(html or "")
    parser.close()
    out = []
    for v in parser.items:
        make = v.get("brand") or v.get("manufacturer") or v.get("make")
        if make or v.get("vehicleidentificationnumber") or v.get("vin"):
            year, km = _number(v.get("vehiclemodeldate") or v.get("productiondate") or v.get("modeldate")), _number(v.get("mileagefromodometer") or v.get("mileage"))
            out.append({"make": make, "model": v.get("model") or v.get("vehiclemodel"), "year": int(year) if year else None, "mileage_km": int(km) if km is not None else None, "price_eur": _amount(v.get("price", "")), "fuel_type": v.get("fueltype"), "url": v.get("url")})
    return out


def marked_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    return _vehicles(pages, column, marked_vehicles)


def first_json_ld(html: str | None) -> dict:
    """One car from all JSON-LD of a page together: for each field the first value that any node gives."""
    out: dict = {}
    for v in json_ld_vehicles(html):
        for k, x in v.items():
            if out.get(k) is None:
                out[k] = x
    return out


def first_json_ld_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    return _vehicles(pages, column, lambda html: [v] if (v := first_json_ld(html)) else [])


def sitemaps(pages: DataFrame, column: str = "xml") -> DataFrame:
    """(kind, url): links of sitemaps; those of an index are further sitemaps, to be read in the next round."""
    kind = F.when(F.rlike(column, F.lit(r"<sitemapindex")), "sitemap").otherwise("page")
    return pages.select(kind.alias("kind"), F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")).distinct()


def resolved(base: Column, link: Column) -> Column:
    """A link of a page as an absolute one."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?):", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    return F.when(F.rlike(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(folder, link))


TLD_COUNTRY = {"de": "DE", "fr": "FR", "es": "ES", "nl": "NL", "be": "BE", "ch": "CH", "at": "AT", "it": "IT"}


def country_of(url: Column) -> Column:
    """Country of a link's top-level domain; null if it says none."""
    tld = F.lower(F.regexp_extract(url, r"^https?://[^/:?#]*\.([a-zA-Z]+)(?:[:/?#]|$)", 1))
    return F.create_map(*(F.lit(x) for kv in TLD_COUNTRY.items() for x in kv))[tld]
