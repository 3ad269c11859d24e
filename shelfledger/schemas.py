"""Table schemas.  Money is whole VND in LongType; instants are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, DAY, INSTANT, FLAG = (T.StringType(), T.LongType(), T.IntegerType(), T.DateType(),
                                       T.TimestampNTZType(), T.BooleanType())


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SEED = table(chain=TEXT, category=TEXT, brand=TEXT, url=TEXT, input_sheet=TEXT, input_row=LONG)
RUN = table(run_id=TEXT, chain=TEXT, year=INT, week=INT, product_count=LONG, expected_count=LONG, issue_count=LONG,
            completed_at=INSTANT, catalog_run_id=TEXT)
COLOR_EVIDENCE = table(model=TEXT, canonical_color=TEXT, product_code=TEXT, website_color_id=TEXT, verified_at=TEXT)
OBSERVATION = table(seq=LONG, chain=TEXT, sku=TEXT, product_name=TEXT, model=TEXT, storage=TEXT, display_variant=TEXT,
                    color=TEXT, brand=TEXT, category=TEXT, variant_id=TEXT, promo_price=LONG, original_price=LONG,
                    promo_text=TEXT, source_url=TEXT, observed_at=INSTANT, business_date=DAY, week_start=DAY,
                    promotion_complete=FLAG, color_evidence=COLOR_EVIDENCE, stale_since=INSTANT, stale_reason=TEXT)
ISSUE = table(stage=TEXT, chain=TEXT, sku=TEXT, product_name=TEXT, category=TEXT, brand=TEXT, model=TEXT,
              source_url=TEXT, reason=TEXT, error_kind=TEXT)
CATALOG = table(run_id=TEXT, chain=TEXT, source_url=TEXT, status=TEXT, reason=TEXT, sku=TEXT, variant_id=TEXT,
                product_name=TEXT, category=TEXT, brand=TEXT, model=TEXT, storage=TEXT, color=TEXT, verified=FLAG,
                listing_urls=T.ArrayType(TEXT), input_row=LONG, discovered_at=INSTANT)
SUMMARY = table(chain=TEXT, stage=TEXT, status=TEXT, expected=LONG, prices=LONG, issues=LONG, blocked=LONG, message=TEXT)
RULE = table(name=TEXT, pattern=TEXT)
PREFERENCE = table(model=TEXT, color=TEXT, aliases=T.ArrayType(TEXT), urls=T.MapType(TEXT, T.ArrayType(TEXT)),
                   previous_names=T.ArrayType(TEXT))
