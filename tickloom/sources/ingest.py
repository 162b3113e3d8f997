"""Landed payloads to rows: JSON quotes, HTML table rows, news articles, and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom import config as cfg
from tickloom.functions.numeric import div, nan_to_null, rnd

QUOTE_SCHEMA = ("finance struct<result: array<struct<quotes: array<struct<symbol: string, regularMarketPrice: double, "
                "regularMarketChange: double, regularMarketChangePercent: double, shortName: string, longName: string>>>>>")
ARTICLE_SCHEMA = "array<struct<datetime: bigint, headline: string>>"

# Cell patterns (fixed values).
NUMBER = r"[-+]?[\d,]+(?:\.\d+)?"
PERCENT = r"\(([-+]?[\d,]*\.?\d+)%\)"


def to_day(value: Column) -> Column:
    """Any date-like text or timestamp to a date; NULL when it is none."""
    return value.try_cast("date")


def epoch_day(seconds: Column) -> Column:
    """UTC day of an epoch second, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def quotes_from_json(raw: DataFrame, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """One price row per usable quote of every payload; incomplete or non-positive quotes are left out."""
    quotes = F.get(F.from_json(payload, QUOTE_SCHEMA)["finance"]["result"], F.lit(0))["quotes"]
    q = raw.select(*keep, F.inline(quotes))
    name = F.coalesce(F.nullif("shortName", F.lit("")), F.nullif("longName", F.lit("")), F.lit(""))
    return (
        q.where((F.col("symbol") != "") & F.col("regularMarketPrice").isNotNull()
                & F.col("regularMarketChange").isNotNull() & F.col("regularMarketChangePercent").isNotNull())
        .select(*keep, "symbol", F.replace(name, F.lit(","), F.lit("")).alias("company_name"),
                rnd(F.col("regularMarketPrice"), 2).alias("price"), rnd(F.col("regularMarketChange"), 4).alias("change"),
                rnd(F.col("regularMarketChangePercent"), 4).alias("pct_change"))
        .where(F.col("price") > 0)
    )


def _cell(cells: Column, i: int, sep: str = "") -> Column:
    return F.trim(F.regexp_replace(F.get(cells, F.lit(i)), "<[^>]+>", sep))


def html_rows(pages: DataFrame, html: str = "html", keep: list[str] = ()) -> DataFrame:
    """Every table row of every page as (symbol, company_name, price, change, pct_change); numbers NULL when unreadable."""
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("_tr"))
    cells = rows.select(*keep, F.regexp_extract_all("_tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("_td"))
    symbol = _cell(F.col("_td"), 0)
    cells = cells.where((F.size("_td") >= 3) & (symbol != "") & (F.lower(symbol) != "symbol"))
    rest = F.slice("_td", 3, F.greatest(F.size("_td") - 2, F.lit(0)))
    text = F.array_join(F.transform(rest, lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", " "))), " ")
    t = cells.withColumn("_text", text).withColumn("_num", F.regexp_extract_all("_text", F.lit(NUMBER), F.lit(0)))

    def plain(x):
        return F.replace(x, F.lit(","), F.lit(""))

    enough = F.size("_num") >= 2
    price = F.when(enough, plain(F.get("_num", F.lit(0)))).otherwise(plain(_cell(F.col("_td"), 2)))
    change = F.when(enough, plain(F.get("_num", F.lit(1)))).otherwise(F.coalesce(_cell(F.col("_td"), 3), F.lit("0")))
    found = F.nullif(F.regexp_extract("_text", PERCENT, 1), F.lit(""))
    pct = F.regexp_replace(F.coalesce(found, _cell(F.col("_td"), 4), F.lit("0")), "[%()]", "")
    return t.select(*keep, symbol.alias("symbol"), F.trim(plain(_cell(F.col("_td"), 1))).alias("company_name"),
                    *[nan_to_null(F.trim(v).try_cast("double")).alias(n)
                      for n, v in (("price", price), ("change", change), ("pct_change", pct))])


def readable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("price").isNotNull() & F.col("change").isNotNull() & F.col("pct_change").isNotNull())


def pct_recompute(prices: DataFrame) -> DataFrame:
    """Percent change from price and change where the change is large enough; the stored value otherwise."""
    again = rnd(div(F.col("change"), F.col("price") - F.col("change")) * 100, 2)
    return prices.withColumn("pct_change", F.when(F.abs("change") >= cfg.MIN_CHANGE_FOR_RECOMPUTE, again)
                             .otherwise(F.col("pct_change")))


def prices_from_html(pages: DataFrame, html: str = "html", keep: list[str] = ()) -> DataFrame:
    return pct_recompute(readable(html_rows(pages, html, keep)).where(F.col("price") > 0))


def news_articles(raw: DataFrame, articles: str = "articles", keep: list[str] = ()) -> DataFrame:
    """One row per usable article: its UTC day and trimmed headline of more than three characters."""
    a = raw.select("symbol", *keep, F.inline(F.from_json(articles, ARTICLE_SCHEMA)))
    head = F.trim("headline")
    return a.where((F.length(head) > cfg.MIN_HEADLINE_LENGTH) & F.col("datetime").isNotNull()).select(
        "symbol", *keep, epoch_day(F.col("datetime")).alias("date"), head.alias("headline"))


def source_failures(log: DataFrame, order: list[str] | Column, limit: int = cfg.MAX_SOURCE_FAILURES) -> DataFrame:
    """Failures of each source since its last success, and whether to skip it.

    Aggregates only: a source's log may be huge, so it is never sorted in one task.  With one fixed-width column as ``order``, such as
    :func:`tickloom.sources.market.tick_order`, they are hash aggregates and no row is sorted at all.
    """
    pos = order if isinstance(order, Column) else F.struct(*order)
    ok = log.groupBy("symbol").agg(F.max(F.when(F.col("success"), pos)).alias("_ok"))
    failed = log.where(~F.col("success")).select("symbol", pos.alias("_pos"), "date")
    since = failed.join(ok, "symbol").where(F.col("_ok").isNull() | (F.col("_pos") > F.col("_ok")))
    return (since.groupBy("symbol").agg(F.count(F.lit(1)).alias("consecutive_failures"), F.max("date").alias("last_failure"))
            .withColumn("skip", F.col("consecutive_failures") >= limit))


def macro_series(raw: DataFrame, as_of: Column, max_age: int = 7) -> DataFrame:
    """Long macro table without missing values, plus whether each series is recent on ``as_of``."""
    good = raw.where(F.col("value").isNotNull())
    fresh = good.groupBy("series_alias").agg(F.max("date").alias("_last")).select(
        "series_alias", (F.datediff(as_of, F.col("_last")) <= max_age).alias("recent"))
    return good.join(fresh, "series_alias")
