"""Readers of outside formats: delimited text, archives, JSON, XML and HTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def patched(history: DataFrame, latest: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """History with those latest rows that lie after each key's last day."""
    end = history.groupBy(*keys).agg(F.max(day).alias("_end"))
    new = latest.join(end, list(keys), "left").filter(F.col("_end").isNull() | (F.col(day) > F.col("_end"))).drop("_end")
    return history.unionByName(new)


def last_good(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of several Parquet copies that is there; fails if none is."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    raise FileNotFoundError(f"none of {len(paths)} copies is there")


def missing_days(calendar: DataFrame, known: DataFrame, day: str, per_batch: int) -> DataFrame:
    """Days still to fetch and the batch after which each is checkpointed."""
    from pyspark.sql.window import Window

    todo = calendar.select(day).distinct().join(known.select(day), day, "left_anti")
    return todo.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(day)) - 1) / per_batch))


def search_hits(responses: DataFrame, text: str = "json") -> DataFrame:
    """A row per company and form family of full-text search responses: the earliest filing."""
    hit = "struct<_id:string,_source:struct<ciks:array<string>,root_form:string,file_date:string,display_names:array<string>>>"
    found = responses.select(F.explode(F.from_json(text, f"hits struct<hits:array<{hit}>>")["hits"]["hits"]).alias("h")).select("h._id", "h._source.*")
    rows = found.select(F.regexp_replace(F.get("ciks", F.lit(0)), r"^0+(?=\d)", "").alias("cik"), F.col("root_form").alias("form"), F.to_date("file_date").alias("filed"), F.get("display_names", F.lit(0)).alias("name"), F.col("_id").alias("id"))
    first = F.min_by(F.struct("filed", "name", "id"), F.struct("filed", "id")).alias("x")
    return rows.filter("cik is not null").groupBy("cik", "form").agg(first).select("cik", "form", "x.*")


def fee_amount(text: str) -> Column:
    """Total of a fee exhibit: XML amounts of any namespace summed, else tagged numbers times their scale."""
    xml = F.regexp_extract_all(text, F.lit(r"<(?:\w+:)?(?:TtlOfferingAmt|MaxAggtOfferingPric)>\s*([0-9.,]+)\s*<"), F.lit(1))
    tagged = r'<ix:nonFraction[^>]*name="[^"]*(?:TtlOfferingAmt|MaxAggtOfferingPric)"[^>]*'
    scale = F.regexp_extract_all(text, F.lit(tagged + r'scale="(-?\d+)"[^>]*>[^<]*<'), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(tagged + r'>\s*([0-9.,]+)\s*<'), F.lit(1))
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.zip_with(value, scale, lambda v, s: number(v) * F.pow(F.lit(10.0), F.coalesce(s.try_cast("int"), F.lit(0))))
    return F.when(F.size(xml) > 0, total(F.transform(xml, number))).when(F.size(value) > 0, total(scaled))


def disclosed_trades(reports: DataFrame, text: str = "json") -> DataFrame:
    """Purchases and sales of disclosure reports; each can be followed 45 days after its own day."""
    kind = "array<struct<ticker:string,type:string,transaction_date:string,amount:string>>"
    rows = reports.select("person", F.inline(F.from_json(text, kind)))
    side = F.when(F.lower("type").startswith("purchase"), "buy").when(F.lower("type").startswith("sale"), "sell")
    least = F.regexp_replace(F.regexp_extract("amount", r"\$([0-9,]+)", 1), ",", "").try_cast("long")
    day = F.coalesce(F.try_to_timestamp("transaction_date", F.lit("MM/dd/yyyy")), F.try_to_timestamp("transaction_date", F.lit("yyyy-MM-dd"))).cast("date")
    rows = rows.select("person", F.upper(F.trim("ticker")).alias("ticker"), side.alias("side"), day.alias("day"), least.alias("least"))
    return rows.filter("side is not null and day is not null and ticker rlike '^[A-Z]{1,5}$'").withColumn("followable", F.date_add("day", 45))


def next_dates(calendar: DataFrame, universe: DataFrame, symbol: str, day: str, today: str) -> DataFrame:
    """The next date of every symbol of the universe."""
    coming = calendar.filter(F.col(day) >= F.lit(today).cast("date")).join(universe.select(symbol).distinct(), symbol, "left_semi")
    return coming.groupBy(symbol).agg(F.min(day).alias("next"))


def text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with a header, every column as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def word_list(lines: DataFrame, text: str = "json") -> DataFrame:
    """Curated names of a JSON list as arrays of upper-case words, without legal suffixes."""
    rows = lines.select(F.inline(F.from_json(text, "array<struct<name:string,why:string>>")))
    words = F.split(F.trim(F.regexp_replace(F.upper("name"), "[^A-Z0-9]+", " ")), " ")
    return rows.select("name", F.filter(words, lambda w: ~w.isin("INC", "CORP", "LTD", "CO", "PLC", "")).alias("words")).filter(F.size("words") > 0)


def made_mentions(spark: SparkSession, tickers: int, days: int, effect: float) -> DataFrame:
    """A made-up panel of mentions and next moves with a planted link, for trying out a study."""
    unit = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = spark.range(tickers * days).select((F.col("id") % tickers).alias("ticker"), F.floor(F.col("id") / tickers).alias("day"))
    mentions = F.floor(100 * unit(F.lit("m"), "ticker", "day"))
    rows = rows.withColumn("mentions", mentions.cast("long"))
    return rows.withColumn("move", unit(F.lit("r"), "ticker", "day") - 0.5 + effect * (F.col("mentions") - 50) / 50)


def series_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``date, asset, value`` of a two-column file in which '.' stands for no value."""
    raw = spark.read.schema("date string, value string").option("header", True).csv(path)
    return raw.select(F.to_date("date").alias("date"), F.lit(name).alias("asset"), F.col("value").try_cast("double").alias("value"))


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "latin-1") -> DataFrame:
    """Rows of the CSV files in zip archives, all columns as text; one archive per task at a time."""
    names = list(columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as f:
                            for part in pd.read_csv(f, dtype=str, encoding=encoding, chunksize=10_000):
                                yield part.reindex(columns=names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def net_positions(raw: DataFrame, codes: Sequence[str], code: str, day: str, long: str, short: str, interest: str) -> DataFrame:
    """Net position and its share of open interest for the contracts with given codes.

    Days come as ISO or as month/day/year with a time; a report is usable six
    days after its own day.
    """
    when = F.coalesce(F.try_to_timestamp(F.col(day), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col(day), F.lit("M/d/yyyy h:mm:ss a"))).cast("date")
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    rows = raw.filter(F.trim(F.col(code)).isin(*codes)).select(
        F.trim(F.col(code)).alias("code"), when.alias("report_date"), (number(long) - number(short)).alias("net"), number(interest).alias("open_interest")
    )
    share = 100 * F.try_divide("net", "open_interest")
    return rows.select("*", share.alias("net_share"), F.date_add("report_date", 6).alias("usable_from"))


def after_header(lines: DataFrame, header: str, columns: Sequence[str], order: str = "nr") -> DataFrame:
    """Comma-separated lines below the line that starts with ``header``, by position."""
    start = lines.filter(F.col("value").startswith(header)).agg(F.min(order).alias("_start"))
    cells = F.split("value", ",")
    rows = lines.join(start, F.col(order) > F.col("_start"))
    return rows.select(*[F.trim(F.get(cells, i)).alias(c) for i, c in enumerate(columns)])


def named_ratio(payload: str, name: str) -> Column:
    """Value of the entry with a given name in a JSON text {"ratios": [{"name", "value"}...]}."""
    parsed = F.from_json(payload, "ratios array<struct<name:string,value:string>>")["ratios"]
    return F.get(F.filter(parsed, lambda r: r["name"] == name), F.lit(0))["value"].try_cast("double")


def index_lines(lines: DataFrame, form: str) -> DataFrame:
    """``company, cik, day, path`` of fixed-width index lines for one form."""
    cells = F.split("value", r"\s{2,}")
    rows = lines.filter(F.col("value").rlike(rf"^{form}\s")).select(*[F.get(cells, i).alias(n) for i, n in enumerate(("form", "company", "cik", "day", "path"))])
    return rows.withColumn("cik", F.regexp_replace("cik", r"^0+(?=\d)", "")).drop("form")


FILING = """issuer struct<issuerTradingSymbol:string>, reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>>,
nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,
transactionAmounts:struct<transactionShares:struct<value:double>,transactionPricePerShare:struct<value:double>,transactionAcquiredDisposedCode:struct<value:string>>>>>"""


def purchases(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Open-market purchases of ownership filings, a row per transaction."""
    doc = F.from_xml(xml, FILING.replace("\n", " "))
    rows = filings.withColumn("_d", doc)
    rows = rows.select(
        F.col("_d.issuer.issuerTradingSymbol").alias("ticker"),
        F.col("_d.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"),
        F.explode("_d.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    ).filter("t.transactionCoding.transactionCode = 'P' and t.transactionAmounts.transactionAcquiredDisposedCode.value = 'A'")
    shares, price = F.col("t.transactionAmounts.transactionShares.value"), F.col("t.transactionAmounts.transactionPricePerShare.value")
    return rows.select("ticker", "owner", F.to_date("t.transactionDate.value").alias("date"), shares.alias("shares"), price.alias("price"), (shares * price).alias("value"))


FEED = "channel struct<item:array<struct<title:string,link:string,pubDate:string>>>"


def feed_items(feeds: DataFrame, relevant: str, xml: str = "xml") -> DataFrame:
    """Items of RSS texts whose title matches a pattern."""
    rows = feeds.select(F.explode(F.from_xml(xml, FEED)["channel"]["item"]).alias("i")).select("i.*")
    return rows.filter(F.col("title").rlike(relevant))


def split_name(display: str) -> list[Column]:
    """``company, ticker, cik`` of texts like 'Name (TICK) (CIK 0001)'."""
    return [
        F.trim(F.regexp_extract(display, r"^([^(]*)", 1)).alias("company"),
        F.nullif(F.regexp_extract(display, r"\(([A-Z][A-Z0-9.,\- ]*)\)\s+\(CIK", 1), F.lit("")).alias("ticker"),
        F.nullif(F.regexp_extract(display, r"\(CIK\s+0*(\d+)\)", 1), F.lit("")).alias("cik"),
    ]


def request_list(lines: DataFrame, most: int, order: str = "nr") -> DataFrame:
    """Valid symbols of a request file, once each in order of first mention, at most ``most``.

    The limit is part of the feature: a request file may ask for so many.
    """
    symbol = F.upper(F.trim(F.regexp_replace("value", "#.*", "")))
    rows = lines.select(symbol.alias("symbol"), order).filter(F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"))
    return rows.groupBy("symbol").agg(F.min(order).alias(order)).orderBy(order).limit(most)


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = ""

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(self.cell.strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``rows``: the cells of every table row of each page."""

    @F.pandas_udf("array<array<string>>")
    def cells(texts: pd.Series) -> pd.Series:
        def parsed(text):
            parser = _Cells()
            parser.feed(text or "")
            return [r for r in parser.rows if r]

        return texts.map(parsed)

    return pages.withColumn("rows", cells(html))


class SeriesSource(DataSource):
    """Daily series by symbol, a partition per symbol, with retries.

    ``fetch`` is the path of a folder with ``<symbol>.csv`` files, so the source
    also works without a network.  A symbol whose file can't be read after the
    retries fails the read, unless ``missing`` is ``skip``: then it gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_series"

    def schema(self) -> str:
        return "symbol string, date string, value double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SeriesReader(self.options)


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.symbols = options["folder"], options["symbols"].split(",")
        self.tries = int(options.get("tries", "3"))
        self.skip = options.get("missing", "fail") == "skip"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition: InputPartition):
        import csv
        import time

        for attempt in range(self.tries):
            try:
                with open(f"{self.folder}/{partition.value}.csv", newline="") as f:
                    for row in csv.DictReader(f):
                        if row["value"] not in ("", "."):
                            yield partition.value, row["date"], float(row["value"])
                return
            except OSError as error:
                if attempt + 1 < self.tries:
                    time.sleep(0.1 * 2**attempt)
                elif not self.skip:
                    raise OSError(f"no series of {partition.value} after {self.tries} tries") from error
