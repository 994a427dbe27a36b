"""The product list, a fixed table of two rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Product id, price id, name, mode, price.
PRODUCTS = (
    ("trial_product", "trial_price", "7-Day Free Trial", "subscription", Decimal("0.00")),
    ("pro_product", "price_pro", "Go Pro", "subscription", Decimal("45.00")),
)


def product_structs() -> Column:
    """The products as an array literal, for one row per product by explode."""
    return F.array(
        *[
            F.struct(
                F.lit(pid).alias("product_id"),
                F.lit(price_id).alias("price_id"),
                F.lit(name).alias("product_name"),
                F.lit(mode).alias("mode"),
                F.lit(price).cast("decimal(10,2)").alias("price"),
            )
            for pid, price_id, name, mode, price in PRODUCTS
        ]
    )


def products(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(product_structs()))


_FIELDS = ("product_id", "price_id", "product_name", "mode", "price")


def product_field(value: Column, by: str = "price_id", field: str = "product_name") -> Column:
    """A field of the product whose ``by`` equals the value; null if there is none."""
    key, wanted = _FIELDS.index(by), _FIELDS.index(field)
    kind = "decimal(10,2)" if field == "price" else "string"
    found = F.lit(None).cast(kind)
    for product in reversed(PRODUCTS):
        known, result = product[key], F.lit(product[wanted]).cast(kind)
        found = F.when(value == known, result).otherwise(found)
    return found


def product_name(price_id: Column) -> Column:
    """Look a price up in the fixed list; unknown and null prices give null."""
    return product_field(price_id)


def product_by_id(product_id: Column) -> Column:
    """The product of an id as a struct; unknown and null ids give null."""
    fields = [product_field(product_id, "product_id", name).alias(name) for name in _FIELDS]
    known = product_id.isin(*[product[0] for product in PRODUCTS])
    return F.when(known, F.struct(*fields))
