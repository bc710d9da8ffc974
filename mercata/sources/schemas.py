"""Declared schemas of the source entities (CSV files -> typed tables).

Column names follow the e-commerce DDL (English names); timestamps are
wall-clock DATETIMEs without zone, hence TIMESTAMP_NTZ; money is
DECIMAL(10,2) as declared.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


S, I, TS, MONEY = StringType(), IntegerType(), TimestampNTZType(), DecimalType(10, 2)

ECOMMERCE_SCHEMAS: dict[str, StructType] = {
    "customers": _s(("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
                    ("customer_city", S), ("customer_state", S)),
    "orders": _s(("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", TS),
                 ("order_approved_at", TS), ("order_delivered_carrier_date", TS),
                 ("order_delivered_customer_date", TS), ("order_estimated_delivery_date", TS)),
    "order_items": _s(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                      ("shipping_limit_date", TS), ("price", MONEY), ("freight_value", MONEY)),
    "order_payments": _s(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                         ("payment_installments", I), ("payment_value", MONEY)),
    "order_reviews": _s(("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
                        ("review_comment_message", S), ("review_creation_date", TS),
                        ("review_answer_timestamp", TS)),
    "products": _s(("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
                   ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", I),
                   ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I)),
    "sellers": _s(("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S)),
    "geolocation": _s(("geolocation_zip_code_prefix", S), ("geolocation_lat", DecimalType(15, 12)),
                      ("geolocation_lng", DecimalType(15, 12)), ("geolocation_city", S), ("geolocation_state", S)),
    "product_category_translation": _s(("product_category_name", S), ("product_category_name_english", S)),
}

# Credit applicants: first CSV column is a row index (not a feature).
APPLICANT_SCHEMA = _s(("row_id", LongType()), ("SeriousDlqin2yrs", I),
                      ("RevolvingUtilizationOfUnsecuredLines", DoubleType()), ("age", I),
                      ("NumberOfTime30-59DaysPastDueNotWorse", I), ("DebtRatio", DoubleType()),
                      ("MonthlyIncome", DoubleType()), ("NumberOfOpenCreditLinesAndLoans", I),
                      ("NumberOfTimes90DaysLate", I), ("NumberRealEstateLoansOrLines", I),
                      ("NumberOfTime60-89DaysPastDueNotWorse", I), ("NumberOfDependents", DoubleType()))

# A/B effects: headerless file with given names.
AB_SCHEMA = _s(("dmp_id", I), ("user_id", LongType()), ("click", I), ("flag", S))
