"""Registered queries of readers, sinks, filters and plain joins.

Readers get text made from the tables, so that SQL over the tables says what
they must give back.
"""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import functions as F

from ..operators import ledger as l
from ..operators.windows import Series
from ..sources import adapters as a
from ..sources import readers as r
from ..sources import sinks as k
from ..streaming.events import scratch
from .registry import query
from .window_queries import O, RET, _r, _returns

S = Series(("asset",), "date")
sql = a.with_views
t = a.table


# ---- sources ----------------------------------------------------------------------


def _as_csv(df, folder):
    k.write_csv(df, folder)
    return folder


@query(sql("t", "SELECT date, 'total' AS asset, CASE WHEN day(date) = 1 THEN NULL ELSE value END AS value FROM t"))
def src04_series_csv(spark, sf_dir):
    d = a.daily_total(spark, sf_dir).select("date", F.when(F.dayofmonth("date") == 1, ".").otherwise(F.col("value").cast("string")).alias("value"))
    return r.series_csv(spark, _as_csv(d, scratch(spark)), "total")


@query(sql("p", "SELECT asset, date, value FROM p"))
def src01_daily_series(spark, sf_dir):
    """The retrying source over a file per symbol, in a folder that all workers see."""
    spark.dataSource.register(r.SeriesSource)
    p = a.daily_prices(spark, sf_dir)
    names = sorted(x["asset"] for x in p.select("asset").distinct().collect())  # one per file to read
    folder = scratch(spark)
    k.write_symbol_files(p.select(F.col("asset").alias("symbol"), "date", "value"), folder)
    found = spark.read.format("daily_series").option("folder", folder.removeprefix("file://")).option("symbols", ",".join(names)).load()
    return found.select(F.col("symbol").alias("asset"), F.col("date").cast("date").alias("date"), "value")


@query(sql("p", "WITH e AS (SELECT asset, max(date) AS last FROM p WHERE date < DATE '2001-01-01' GROUP BY 1) SELECT p.asset, p.date, CASE WHEN p.date < DATE '2001-01-01' THEN value ELSE value * 2 END AS value FROM p"))
def src02_patched(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    held = p.filter(F.col("date") < F.lit("2001-01-01").cast("date"))
    return r.patched(held, p.withColumn("value", F.col("value") * 2), ["asset"], "date")


@query("SELECT n_nationkey, n_name FROM nation", dates="")
def src06_last_good(spark, sf_dir):
    kept = scratch(spark)
    t(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.parquet(kept)
    return r.last_good(spark, [scratch(spark), kept])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation", dates="")
def src08_zipped_csv(spark, sf_dir):
    rows = t(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows, zipped by hand
    text, packed = io.StringIO(), io.BytesIO()
    csv.writer(text).writerows([("key", "name"), *map(tuple, rows)])
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("report.txt", text.getvalue().encode("latin-1"))
    folder = scratch(spark)
    k.write_bytes(spark, folder, "report.zip", packed.getvalue())
    return r.zipped_csv(spark, folder + "/*.zip", ["key", "name"])


POSITIONS = "SELECT CAST(s_suppkey AS VARCHAR) AS code, DATE '2020-01-01' + CAST(s_suppkey AS INT) AS report_date, DATE '2020-01-07' + CAST(s_suppkey AS INT) AS usable_from, CAST(s_suppkey * 1000 - s_nationkey * 10 AS DOUBLE) AS net, CAST(s_suppkey * 2000 AS DOUBLE) AS open_interest, round(100 * CAST(s_suppkey * 1000 - s_nationkey * 10 AS DOUBLE) / (s_suppkey * 2000), 6) AS share FROM supplier WHERE s_suppkey IN (1, 3, 5, 7)"


def _positions(spark, sf_dir, form):
    s, key = t(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("int")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), key), form)
    raw = s.select(F.concat(F.lit(" "), key.cast("string")).alias("code"), day.alias("day"), F.format_number(key * 1000, 0).alias("l"), (F.col("s_nationkey") * 10).cast("string").alias("s"), F.format_number(key * 2000, 0).alias("oi"))
    found = r.net_positions(raw, ["1", "3", "5", "7"], "code", "day", "l", "s", "oi")
    return found.select("code", "report_date", "usable_from", "net", "open_interest", F.round("net_share", 6).alias("share"))


@query(POSITIONS, dates="report_date usable_from")
def src09_legacy_positions(spark, sf_dir):
    return _positions(spark, sf_dir, "yyyy-MM-dd")


@query(POSITIONS, dates="report_date usable_from")
def src10_dated_positions(spark, sf_dir):
    return _positions(spark, sf_dir, "M/d/yyyy '12:00:00 AM'")


@query("SELECT CAST(DATE '2020-01-01' + CAST(n_nationkey AS INT) AS VARCHAR) AS date, CAST(n_nationkey AS VARCHAR) AS calls, n_name AS name FROM nation", dates="")
def src11_after_header(spark, sf_dir):
    n, key = t(spark, sf_dir, "nation"), F.col("n_nationkey").cast("int")
    body = n.select((key + 10).alias("nr"), F.concat_ws(", ", F.date_add(F.lit("2020-01-01").cast("date"), key).cast("string"), key.cast("string"), "n_name").alias("value"))
    head = spark.createDataFrame([(1, "Some archive"), (2, "no data here, at all"), (3, "DATE,CALLS,NAME")], "nr int, value string")
    return r.after_header(head.unionByName(body), "DATE,", ["date", "calls", "name"])


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS BIGINT) // 50 AS batch FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice >= 400000)")
def src13_missing_days(spark, sf_dir):
    return r.missing_days(a.daily_total(spark, sf_dir), a.large_order_days(spark, sf_dir), "date", 50)


@query("SELECT s_name AS company, CAST(s_suppkey AS VARCHAR) AS cik, '2024-01-02' AS day, 'data/' || s_suppkey || '.txt' AS path FROM supplier WHERE s_suppkey % 2 = 0", dates="")
def src14_index_lines(spark, sf_dir):
    key = F.col("s_suppkey")
    line = F.format_string("%-12s%-40s%-12s%-12s%s", F.when(key % 2 == 0, "4").otherwise("10-K"), "s_name", F.format_string("%010d", key), F.lit("2024-01-02"), F.concat(F.lit("data/"), key.cast("string"), F.lit(".txt")))
    return r.index_lines(t(spark, sf_dir, "supplier").select(line.alias("value")), "4")


@query("SELECT 'T' || o_custkey % 100 AS ticker, 'owner ' || o_custkey AS owner, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS DOUBLE) AS shares, o_totalprice AS price, o_custkey * o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P'")
def src15_purchases(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[x if not isinstance(x, str) else F.lit(x) for x in inner], F.lit(f"</{name}>"))
    text = lambda c: F.col(c).cast("string")
    amounts = tag(
        "transactionAmounts", tag("transactionShares", tag("value", text("o_custkey"))), tag("transactionPricePerShare", tag("value", text("o_totalprice"))),
        tag("transactionAcquiredDisposedCode", tag("value", F.when(F.col("o_orderstatus") == "P", "D").otherwise("A"))),
    )
    trade = tag("nonDerivativeTransaction", tag("transactionDate", tag("value", F.date_format("o_orderdate", "yyyy-MM-dd"))), tag("transactionCoding", tag("transactionCode", F.when(F.col("o_orderkey") % 2 == 0, "P").otherwise("S"))), amounts)
    ticker = F.concat(F.lit("T"), (F.col("o_custkey") % 100).cast("string"))
    owner = tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerName", F.concat(F.lit("owner "), text("o_custkey")))))
    doc = tag("ownershipDocument", tag("issuer", tag("issuerTradingSymbol", ticker)), owner, tag("nonDerivativeTable", trade))
    return r.purchases(o.select(doc.alias("xml")))


@query("SELECT o_orderkey, 'T' || s_suppkey AS ticker FROM orders JOIN supplier ON s_suppkey = o_custkey", dates="")
def src16_symbol_map(spark, sf_dir):
    """A JSON map of ids to symbols, joined to what carries the ids."""
    lines = t(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"))).alias("value"))
    folder = scratch(spark)
    lines.write.text(folder)
    known = spark.read.schema("cik_str long, ticker string").json(folder)
    return t(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("cik_str")).select("o_orderkey", "ticker")


@query("""SELECT cik, form, filed, 'Company ' || cik AS name, id FROM (SELECT CAST(o_custkey AS VARCHAR) AS cik, CASE WHEN o_orderstatus = 'F' THEN 'S-1' ELSE '424B' END AS form, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey AS VARCHAR) AS id,
row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR)) AS k FROM orders) AS x WHERE k = 1""", dates="filed")
def src17_search_hits(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    source = F.struct(F.array(F.format_string("%010d", "o_custkey")).alias("ciks"), F.when(F.col("o_orderstatus") == "F", "S-1").otherwise("424B").alias("root_form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), F.array(F.concat(F.lit("Company "), F.col("o_custkey").cast("string"))).alias("display_names"))
    hit = F.struct(F.col("o_orderkey").cast("string").alias("_id"), source.alias("_source"))
    page = o.groupBy(F.floor(F.col("o_orderkey") / 10).alias("page")).agg(F.collect_list(hit).alias("hits"))  # ten hits on a page
    return r.search_hits(page.select(F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("json")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round((p_size + p_partkey)::DOUBLE, 4) WHEN p_partkey % 3 = 1 THEN round(p_size * 1000000::DOUBLE, 4) END AS amount FROM part", dates="")
def src19_fee_amount(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    xml = F.concat(F.lit("<ffd:Fees xmlns:ffd='x'><ffd:TtlOfferingAmt>"), size, F.lit("</ffd:TtlOfferingAmt><MaxAggtOfferingPric> "), key, F.lit(" </MaxAggtOfferingPric></ffd:Fees>"))
    tagged = F.concat(F.lit('<p><ix:nonFraction name="ffd:TtlOfferingAmt" contextRef="c" scale="6" decimals="0">'), size, F.lit("</ix:nonFraction></p>"))
    text = F.when(F.col("p_partkey") % 3 == 0, xml).when(F.col("p_partkey") % 3 == 1, tagged).otherwise("<p>none</p>")
    return t(spark, sf_dir, "part").withColumn("text", text).select("p_partkey", F.round(r.fee_amount("text"), 4).alias("amount"))


@query("SELECT 'Rate news ' || n_name AS title, 'http://n/' || n_nationkey AS link FROM nation WHERE n_nationkey % 3 = 0", dates="")
def src20_feed_items(spark, sf_dir):
    n, key = t(spark, sf_dir, "nation"), F.col("n_nationkey")
    word = F.when(key % 3 == 0, "Rate news ").otherwise("Sports ")
    item = lambda title: F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://n/"), key.cast("string"), F.lit("</link><pubDate>x</pubDate></item>"))
    feed = F.concat(F.lit("<rss><channel>"), item(F.concat(word, "n_name")), item(F.lit("Weather")), F.lit("</channel></rss>"))
    return r.feed_items(n.select(feed.alias("xml")), "(?i)rate").select("title", "link")


@query("SELECT 'p' || o_custkey AS person, 'T' || chr(CAST(65 + o_custkey % 26 AS INT)) AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'buy' ELSE 'sell' END AS side, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 45 AS followable, CAST(floor(o_totalprice) AS BIGINT) AS least FROM orders WHERE o_orderstatus <> 'P'", dates="day followable")
def src21_disclosed(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Purchase").when(F.col("o_orderstatus") == "O", "Sale (Full)").otherwise("Exchange")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" - $9,999,999"))
    one = F.struct(F.concat(F.lit("t"), F.lower(F.char((65 + F.col("o_custkey") % 26).cast("int")))).alias("ticker"), kind.alias("type"), day.alias("transaction_date"), amount.alias("amount"))
    return r.disclosed_trades(o.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("person"), F.to_json(F.array(one)).alias("json")))


@query("SELECT o_custkey AS symbol, min(CAST(o_orderdate AS DATE)) AS next FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1", dates="next")
def src22_next_dates(spark, sf_dir):
    calendar = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
    universe = t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"))
    return r.next_dates(calendar, universe, "symbol", "day", "2000-06-01")


@query(sql("t", "SELECT date, 'index' AS asset, value FROM t"))
def src25_index_history(spark, sf_dir):
    """An index file, read from its last good copy when the newest is lacking."""
    kept = scratch(spark)
    r.series_csv(spark, _as_csv(a.daily_total(spark, sf_dir).withColumn("value", F.col("value").cast("string")), scratch(spark)), "index").write.parquet(kept)
    return r.last_good(spark, [scratch(spark), kept])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier", dates="")
def src28_text_table(spark, sf_dir):
    names = ["s_suppkey", "s_name", "s_nationkey"]
    return r.text_table(spark, _as_csv(t(spark, sf_dir, "supplier").select(names), scratch(spark)), names)


@query("SELECT s_name || ', Inc.' AS name, 'SUPPLIER' AS first, 2 AS n_words FROM supplier", dates="")
def src30_word_list(spark, sf_dir):
    one = F.struct(F.concat("s_name", F.lit(", Inc.")).alias("name"), F.lit("because").alias("why"))
    found = r.word_list(t(spark, sf_dir, "supplier").select(F.to_json(F.array(one)).alias("json")))
    return found.select("name", F.col("words")[0].alias("first"), F.size("words").alias("n_words"))


@query("""WITH x AS (SELECT i % 20 AS ticker, i // 20 AS day FROM (SELECT unnest(range(2000)) AS i) AS z), m AS (SELECT *, CAST(floor(100 * (CAST('0x' || substr(md5('m:' || ticker || ':' || day), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS BIGINT) AS mentions FROM x)
SELECT ticker, day, mentions, round(CAST('0x' || substr(md5('r:' || ticker || ':' || day), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 + 0.1 * (mentions - 50) / 50, 6) AS move FROM m""", dates="")
def src31_made_mentions(spark, sf_dir):
    return r.made_mentions(spark, 20, 100, 0.1).withColumn("move", F.round("move", 6))


# ---- sinks ----------------------------------------------------------------------------


@query(sql("t", "SELECT date, value FROM t"))
def snk02_append_daily(spark, sf_dir):
    """Two overlapping runs: days that are there are not added again."""
    d, folder = a.daily_total(spark, sf_dir), scratch(spark)
    k.append_daily(d.filter(F.year("date") < 1998), folder, "date")
    k.append_daily(d.withColumn("value", F.when(F.year("date") < 1998, -1.0).otherwise(F.col("value"))), folder, "date")
    return spark.read.parquet(folder)


@query(sql("t", "SELECT date, value + 1 AS value FROM t WHERE year(date) >= 1997"))
def snk03_replace_table(spark, sf_dir):
    folder = scratch(spark)
    a.daily_total(spark, sf_dir).write.parquet(folder)
    held = spark.read.parquet(folder)
    k.replace_table(held.filter(F.year("date") >= 1997).withColumn("value", F.col("value") + 1), folder)
    return spark.read.parquet(folder)


@query(sql("p", "SELECT asset, date, CASE WHEN year(date) >= 2000 THEN value + 0.01 ELSE value END AS value FROM p"))
def snk05_upsert_checked(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    return l.upsert_checked(p, p.filter(F.year("date") >= 2000).withColumn("value", F.col("value") + 0.01), ["asset", "date"], "value", 0.05)


@query(sql("t", "SELECT CASE WHEN date < DATE '1999-01-01' THEN 'history' ELSE 'recent' END AS part, count(*) AS n, min(date) AS first, max(date) AS last FROM t GROUP BY 1"), dates="first last")
def snk08_split(spark, sf_dir):
    folder = scratch(spark)
    k.write_split(a.daily_total(spark, sf_dir), "date", "1999-01-01", folder)
    return spark.read.parquet(folder).groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("SELECT 1 AS run, count(*) AS n_rows FROM orders UNION ALL SELECT 2, count(*) FROM lineitem", dates="")
def snk09_manifest(spark, sf_dir):
    folder = scratch(spark)
    for run, name in ((1, "orders"), (2, "lineitem")):
        k.append_record(t(spark, sf_dir, name).agg(F.count("*").alias("n_rows")).select(F.lit(run).alias("run"), "n_rows"), folder)
    return spark.read.parquet(folder)


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", dates="")
def snk12_csv(spark, sf_dir):
    folder = _as_csv(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), scratch(spark))
    return spark.read.schema("c_custkey long, c_mktsegment string, c_acctbal double").option("header", True).csv(folder)


# ---- filters, joins, ledgers --------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders", dates="")
def flt01_existing_columns(spark, sf_dir):
    return k.with_existing(t(spark, sf_dir, "orders"), ["o_orderkey", "not_there", "o_totalprice"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0", dates="")
def flt02_positive(spark, sf_dir):
    return t(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def flt03_date_range(spark, sf_dir):
    """Bounds on the stored timestamp, so that they reach the scan."""
    at = lambda d: F.lit(d).cast("timestamp")
    o = t(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= at("1996-03-01")) & (F.col("o_orderdate") < at("1997-04-01")))
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


@query(sql("p t", "SELECT asset, date, p.value FROM p WHERE date IN (SELECT date FROM t WHERE isodow(date) <= 5)"))
def flt05_trading_days(spark, sf_dir):
    calendar = a.daily_total(spark, sf_dir).filter(F.weekday("date") < 5).select("date")
    return a.daily_prices(spark, sf_dir).join(calendar, "date", "left_semi")


@query(sql("p", f"{RET} SELECT asset, year(date) AS year, month(date) AS month, count(r) AS n, round(avg(r), 6) AS mean FROM r GROUP BY 1, 2, 3 HAVING count(r) >= 5"), dates="")
def flt09_enough_rows(spark, sf_dir):
    by = _returns(spark, sf_dir).groupBy("asset", F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"))
    return by.agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean")).filter("n >= 5")


@query(sql("p t", f"{RET}, m AS (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS m FROM t) SELECT r.asset, r.date, round(r.r, 6) AS r, round(m, 6) AS m FROM r JOIN m ON m.date = r.date WHERE r.r IS NOT NULL AND m IS NOT NULL"))
def joi10_complete_inner(spark, sf_dir):
    m = a.daily_total(spark, sf_dir).select("date", Series((), "date").change("value").alias("m"))
    return _returns(spark, sf_dir).join(m, "date").filter("r is not null and m is not null").select("asset", "date", *_r(r=F.col("r"), m=F.col("m")))


@query(sql("p", f"SELECT asset, date, round(value, 4) AS value, round(lag(value, 5) {O}, 4) AS before, round(lead(value, 20) {O}, 4) AS after FROM p"))
def joi17_other_day(spark, sf_dir):
    """The same series on other days: two windows in place of a self-join."""
    before, after = S.lagged("value", 5), F.lead("value", 20).over(S.ordered)
    return a.daily_prices(spark, sf_dir).select("asset", "date", *[F.round(c, 4).alias(n) for n, c in (("value", F.col("value")), ("before", before), ("after", after))])


@query("SELECT o_orderkey AS position FROM orders WHERE o_orderkey % 997 = 0", dates="")
def set04_prefix(spark, sf_dir):
    """Rows of the older ledger that the newer one changed: a legal append has none."""
    old = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), "o_totalprice")
    edited = F.when(F.col("position") % 997 == 0, -1.0).otherwise(F.col("o_totalprice"))
    new = old.withColumn("o_totalprice", edited).unionByName(old.withColumn("position", F.col("position") + 10_000_000))
    return l.is_prefix(old, new, "position")


@query("""SELECT p_partkey, sha256('' || '{"p_brand":"' || p_brand || '","p_partkey":"' || p_partkey || '","p_size":"' || p_size || '"}') AS row_hash FROM part""", dates="")
def sca17_row_hash(spark, sf_dir):
    """The hash of a chain's first row: its canonical JSON with nothing before it."""
    p = t(spark, sf_dir, "part")
    return l.seal(p.select("p_partkey", "p_brand", "p_size"), "p_partkey", "p_partkey", ["p_partkey", "p_size", "p_brand"]).select("p_partkey", "row_hash")


@query("""WITH n AS (SELECT o_orderpriority AS ledger, count(*) AS n FROM orders GROUP BY 1) SELECT ledger, n - CASE WHEN substr(ledger, 1, 1) = '1' THEN 0 WHEN substr(ledger, 1, 1) = '2' THEN 5 ELSE 0 END AS n_rows,
CASE substr(ledger, 1, 1) WHEN '1' THEN 'edited' WHEN '2' THEN 'extended' WHEN '3' THEN 'truncated' ELSE 'intact' END AS state FROM n""", dates="")
def sta04_sidecar(spark, sf_dir):
    """Ledgers sealed, then one edited, one extended and one truncated, and what the manifest says of each."""
    from pyspark.sql.window import Window

    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ledger"), "o_orderkey", "o_totalprice")
    back = F.row_number().over(Window.partitionBy("ledger").orderBy(F.desc("o_orderkey")))
    o = o.withColumn("back", back).withColumn("kind", F.substring("ledger", 1, 1))
    fields = ["o_orderkey", "o_totalprice"]
    earlier = o.filter("not (kind = '2' and back <= 5)").select("ledger", *fields)
    later = o.filter("not (kind = '3' and back = 1)").withColumn("o_totalprice", F.when((F.col("kind") == "1") & (F.col("back") == 3), 0.0).otherwise(F.col("o_totalprice"))).select("ledger", *fields)
    manifest = l.seal_manifest(l.seal(earlier, "ledger", "o_orderkey", fields), "ledger", "o_orderkey", "first seal")
    return l.verify_manifest(manifest, l.seal(later, "ledger", "o_orderkey", fields), "ledger", "o_orderkey")
