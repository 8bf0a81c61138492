"""Vendor payloads in two dialects, symbol mapping, wide batches and the registry pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import VENDOR_A, VENDOR_B

ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def zoned_timestamp(text: Column) -> Column:
    """Instant of an ISO text; null without a zone suffix."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.try_cast("double"))


def finite_number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalise_a(payloads: DataFrame, symbols: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("payload", VENDOR_A))
    return _map(p.select(
        F.col("p.ticker").alias("vendor_symbol"), zoned_timestamp(F.col("p.time")).alias("ts"),
        F.col("p.interval").alias("timeframe"),
        *[finite_number(F.col(f"p.{k}")).alias(v) for k, v in zip("ohlcv", ("open", "high", "low", "close", "volume"))],
    ), symbols)


def normalise_b(payloads: DataFrame, symbols: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("payload", VENDOR_B))
    names = {"openPrice": "open", "highPrice": "high", "lowPrice": "low", "lastPrice": "close", "totalVolume": "volume"}
    return _map(p.select(
        F.col("p.instrument").alias("vendor_symbol"), epoch_timestamp(F.col("p.ts")).alias("ts"),
        F.col("p.tf").alias("timeframe"), *[finite_number(F.col(f"p.{k}")).alias(v) for k, v in names.items()],
    ), symbols)


def _map(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exact symbol mapping; an unmapped code keeps a null symbol and belongs in quarantine."""
    return rows.join(symbols, "vendor_symbol", "left")


def vendor_symbol(symbol: Column, suffix: str = ".IS") -> Column:
    """Canonical to vendor code; null for anything but plain letters and digits."""
    code = F.upper(F.trim(symbol))
    return F.when(code.rlike("^[A-Z0-9]+$"), F.concat(code, F.lit(suffix)))


def canonical_symbol(vendor: Column, suffix: str = ".IS") -> Column:
    """Vendor to canonical code; null without the exact suffix."""
    body = F.substring(vendor, F.lit(1), F.length(vendor) - len(suffix))
    return F.when(F.endswith(vendor, F.lit(suffix)) & body.rlike("^[A-Z0-9]+$"), body)


def flatten_batch(wide: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Columns named ``<field>_<symbol>`` next to ``ts`` become one row per symbol and time."""
    symbols = sorted({c.split("_", 1)[1] for c in wide.columns if "_" in c and c.split("_", 1)[0] in fields})
    rows = [
        F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{f}_{s}`").alias(f) for f in fields]) for s in symbols
    ]
    return wide.select("ts", F.explode(F.array(*rows)).alias("_r")).select("_r.symbol", "ts", *[f"_r.{f}" for f in fields]).filter(
        F.coalesce(*fields).isNotNull()
    )


# Market headings whose members are equities, and the type of every other heading.
EQUITY_MARKETS = (
    "YILDIZ PAZAR",
    "ANA PAZAR",
    "ALT PAZAR",
    "YAKIN İZLEME PAZARI",
    "PİYASA ÖNCESİ İŞLEM PLATFORMU",
    "GÖZALTI PAZARI",
)
OTHER_MARKETS = {
    "GİRİŞİM SERMAYESİ PAZARI": "FUND",
    "YAPILANDIRILMIŞ ÜRÜNLER VE FON PAZARI": "STRUCTURED_OR_FUND",
    "EMTİA PAZARI": "COMMODITY",
    "KESİN ALIM SATIM PAZARI": "DEBT_INSTRUMENT",
    "KESİN ALIM SATIM PAZARI-NİTELİKLİ YATIRIMCILAR ARASINDA": "DEBT_INSTRUMENT",
}
HEADING_COUNT = r"\s+\d+\s+Şirket / Fon Bulundu$"


def _market_type(heading: Column, equity: tuple[str, ...], other: dict[str, str]) -> Column:
    kind = F.when(heading.isin(*equity), "EQUITY")
    for name, label in other.items():
        kind = kind.when(heading == name, label)
    return kind


def registry_instruments(
    pages: DataFrame, html: str = "html", page: str = "page_id", row_tag: str = "tr", cell_tags: str = "th|td",
    equity: tuple[str, ...] = EQUITY_MARKETS, other: dict[str, str] | None = None,
) -> DataFrame:
    """Instruments listed on registry pages, one row per symbol (an accepted listing wins).

    A row naming a market sets the market of the rows after it on the same page.
    """
    other = OTHER_MARKETS if other is None else other
    body = F.regexp_extract_all(html, F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), 1)
    rows = pages.select(page, F.posexplode(body).alias("pos", "row"))
    raw = F.regexp_extract_all("row", F.lit(rf"(?is)<(?:{cell_tags})\b[^>]*>(.*?)</(?:{cell_tags})>"), 1)
    clean = F.transform(raw, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " ")))
    rows = rows.select(page, "pos", clean.alias("cells")).filter(F.size("cells") > 0)
    heading = F.trim(F.regexp_replace(F.col("cells")[0], HEADING_COUNT, ""))
    rows = rows.withColumn("_kind", _market_type(heading, equity, other))
    rows = rows.withColumn("_market", F.when(F.col("_kind").isNotNull(), heading))
    over = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = rows.withColumns({
        "market": F.last("_market", ignorenulls=True).over(over),
        "instrument_type": F.last("_kind", ignorenulls=True).over(over),
    }).filter(
        F.col("_kind").isNull() & F.col("market").isNotNull() & (F.size("cells") >= 3)
    ).select(
        page, "pos", F.upper(F.trim(F.get("cells", F.lit(1)))).alias("symbol"), F.get("cells", F.lit(2)).alias("name"),
        "market", "instrument_type", (F.col("instrument_type") == "EQUITY").alias("accepted"),
        F.get("cells", F.lit(0)).alias("_number"),
    ).filter(F.col("_number").rlike(r"^\d+$") & F.col("symbol").rlike("^[A-Z0-9]+$"))
    best = F.min_by(
        F.struct("name", "market", "instrument_type", "accepted"), F.struct(~F.col("accepted"), F.col(page), F.col("pos"))
    )
    one = listed.groupBy("symbol").agg(best.alias("_b"))
    return one.select("symbol", "_b.name", "_b.market", "_b.instrument_type", "_b.accepted")
