"""Column expressions that build the fields of a collection row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import zero_padded

# Shop domain of each platform, and the domain of every other platform.
DOMAINS = {
    "Mercado Livre": "mercadolivre.com.br",
    "Amazon": "amazon.com.br",
    "Shopee": "shopee.com.br",
    "Americanas": "americanas.com.br",
    "Magazine Luiza": "magazineluiza.com.br",
    "Casas Bahia": "casasbahia.com.br",
}
OTHER_DOMAIN = "loja.com.br"

# First collection day and the number of days after it that may occur.
FIRST_DAY = "2024-05-01"
DAY_SPAN = 730


def sku(platform: Column, number: Column, index: Column) -> Column:
    """First three letters of the platform, a number and a five-digit index."""
    letters = F.regexp_replace(platform, r"[^\p{L}]", "")
    return F.concat_ws(
        "-", F.upper(F.substring(letters, 1, 3)), number.cast("string"), zero_padded(index, 5)
    )


def url(platform: Column, sku_text: Column) -> Column:
    """Product page: the platform's domain and the SKU as a path."""
    domains = F.create_map(*[F.lit(v) for pair in DOMAINS.items() for v in pair])
    domain = F.coalesce(F.try_element_at(domains, platform), F.lit(OTHER_DOMAIN))
    slug = F.replace(F.lower(sku_text), F.lit("-"), F.lit("/"))
    return F.concat(F.lit("https://www."), domain, F.lit("/produto/"), slug)


def description(base: Column, brand: Column, size: Column) -> Column:
    """Base, brand and size as one text; absent parts are left out."""
    return F.concat_ws(" ", base, brand, size.cast("string"))


def promo_price(price: Column, factor: Column, on_offer: Column) -> Column:
    """Reduced price rounded to cents for rows on offer, else NULL. Exact: computed on decimals."""
    exact = price.cast("decimal(18,2)") * factor.cast("decimal(5,4)")
    return F.when(on_offer, F.round(exact, 2).cast("double"))


def product_id(number: Column) -> Column:
    return F.concat(F.lit("PROD"), zero_padded(number, 6))


def collection_id(number: Column) -> Column:
    return F.concat(F.lit("COL"), number.cast("string"))


def image_id(number: Column) -> Column:
    return F.concat(F.lit("IMG"), number.cast("string"))


def collection_date(days: Column, first_day: str = FIRST_DAY) -> Column:
    """ISO text of the day that many days after the first one."""
    return F.date_add(F.lit(first_day).cast("date"), days.cast("int")).cast("string")
