"""Canonical column names and column maps.

Operators work on canonical names. A caller whose tables use other names
passes ``cols={canonical: actual}``; :func:`conform` renames and prunes in one
projection, which Catalyst folds into the scan (only the needed columns are
read).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = ("order_id", "customer_id", "order_status", "purchase_ts", "approved_ts",
          "carrier_ts", "delivered_ts", "estimated_ts")
ITEMS = ("order_id", "order_item_id", "product_id", "seller_id", "price")
CUSTOMERS = ("customer_id", "customer_state")
PRODUCTS = ("product_id", "product_category_name")
TRANSLATION = ("product_category_name", "product_category_name_english")
PAYMENTS = ("order_id", "payment_sequential", "payment_type", "payment_value")
REVIEWS = ("order_id", "review_score")

# Column map for tables loaded with the e-commerce DDL names (see
# sources.schemas): canonical name -> DDL name.
ECOMMERCE_DDL_COLUMNS = {
    "purchase_ts": "order_purchase_timestamp",
    "approved_ts": "order_approved_at",
    "carrier_ts": "order_delivered_carrier_date",
    "delivered_ts": "order_delivered_customer_date",
    "estimated_ts": "order_estimated_delivery_date",
}


def conform(df: DataFrame, needed: Iterable[str], cols: Mapping[str, str] | None = None) -> DataFrame:
    """Project ``df`` to the canonical ``needed`` columns, renaming via ``cols``."""
    cols = cols or {}
    return df.select([F.col(cols.get(name, name)).alias(name) for name in needed])
