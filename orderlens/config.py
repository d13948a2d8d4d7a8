"""Thresholds and domain values.

Everything a business user might tune is a field of :class:`Params`; the
library never hard-codes a reason string, carrier name or product code. The
fields' defaults are for real exports; ``ADAPTER`` has the values of the test
data, whose tables are derived (see ``sources.adapter``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# --- fixed values (must equal the reference for identical results) --------
# Order statuses that count as a completed sale.
COMPLETED_STATUSES = ("confirmed", "delivered")

# Statuses of the status mix: cancelled, and the spellings of returned.
CANCELED_STATUS = "canceled"
RETURNED_STATUSES = ("returned", "Package Returned", "In Transit: Returning to seller")

# Personal columns of the marketplace export, dropped right after the scan.
PII_COLUMNS = (
    "customerName", "customerEmail", "nationalRegistrationNumber",
    "shippingName", "shippingAddress", "shippingAddress2", "shippingAddress3",
    "shippingAddress4", "shippingAddress5", "shippingPhone", "shippingPhone2",
    "shippingPostCode",
    "billingName", "billingAddr", "billingAddr2", "billingAddr3",
    "billingAddr4", "billingAddr5", "billingPhone", "billingPhone2",
    "billingPostCode",
    "taxCode", "branchNumber", "invoiceNumber",
    "trackingCode", "cdTrackingCode", "trackingUrl",
    "trackingCodeFM", "trackingUrlFM",
    "buyerFailedDeliveryUserName", "sellerNote",
)

# Headers of the marketplace export and the names they have here; other columns
# of an export are not read.
EXPORT_COLUMNS = {
    "orderNumber": "order_number", "orderItemId": "line_number", "sellerSku": "seller_sku", "itemName": "item_name",
    "status": "status_raw", "payMethod": "pay_method", "shippingProvider": "carrier", "shippingProviderType": "carrier_type",
    "buyerFailedDeliveryReason": "fail_reason", "buyerFailedDeliveryDetail": "fail_detail",
    "unitPrice": "unit_price_raw", "paidPrice": "paid_price", "shippingFee": "shipping_fee",
    "sellerDiscountTotal": "seller_discount_raw", "platformDiscountTotal": "platform_discount_raw",
    "bundleDiscount": "bundle_discount_raw", "createTime": "created_raw", "updateTime": "updated_raw",
    "deliveredDate": "delivered_raw", "promisedShippingTime": "promised_raw",
}

# Timestamp format of the export, e.g. '14 Nov 2022 10:35'.
RAW_TIMESTAMP_FORMAT = "d MMM yyyy HH:mm"

# SKU suffix patterns (searched case-insensitively at the end of the SKU) and
# the item-name label pattern (matched at the start of the trimmed name).
CAMPAIGN_SUFFIX_RE = r"FS([23])?$"
GIFT_SL_SUFFIX_RE = r"SL([23])?$"
GIFT_STICKER_SUFFIX_RE = r"(\d)?stickera?$"
PROMO_LABEL_RE = r"^\[([^\]]+)\]"

# RFM segment cut-offs on the summed 3..15 score, best first.
RFM_SEGMENTS = (("star", 13), ("potential", 10), ("attention", 7), ("dormant", 0))

# Effect-size labels for the rank-biserial correlation |r|.
EFFECT_SIZE_LABELS = (("negligible", 0.1), ("small", 0.3), ("medium_or_large", None))

# Mann-Whitney / z-test decision level.
ALPHA = 0.05

# Orders with at least this many lines are operational; columns of the export
# without a single value; failure reasons, cash on delivery and the carrier
# spelling as the export has them; the holidays of its time range.
BULK_THRESHOLD = 20
EMPTY_COLUMNS = ("wareHouse", "walletCredit", "refundAmount")
REASON_SLOW = "Thời gian giao hàng quá lâu"
REASON_DUPLICATE = "Trùng đơn hàng"
REASON_UNPAID = "Không hoàn thành thanh toán đúng thời gian"
COD_VALUE = "COD"
CARRIER_CANONICAL = (("vinacapital", "Vinacapital"),)
HOLIDAYS = (dt.date(2021, 2, 12), dt.date(2022, 2, 1))
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Analysis parameters; the defaults are those of real exports."""

    # orders with at least this many lines are internal/operational, not demand
    bulk_threshold: int = BULK_THRESHOLD
    # minimum lines per group for the campaign-vs-normal comparison
    min_sample: int = 20
    # minimum products in a cohort for the retention table
    min_cohort_size: int = 5
    # first month indices shown in the retention table
    retention_months: int = 12
    # product of the single-product margin comparison (None: no product)
    hero_product: str | None = None
    # shop of the seasonality analyses (None: all shops)
    seasonality_shop: str | None = None
    # failure reasons used by individual analyses
    reason_slow: str = REASON_SLOW
    reason_duplicate: str = REASON_DUPLICATE
    reason_unpaid: str = REASON_UNPAID
    # product key of the cohort and RFM analyses
    product_key: str = "product_code"
    # the pay method value meaning cash on delivery
    cod_value: str = COD_VALUE
    # carrier spelling fixes: lower(trim(value)) -> canonical
    carrier_canonical: tuple = CARRIER_CANONICAL
    # holidays and windows for the seasonality analysis
    holidays: tuple = HOLIDAYS
    pre_holiday_days: int = 14
    holiday_window_before: int = 30
    holiday_window_after: int = 10
    campaign_offset_span: int = 7
    # the empty columns dropped by the cleaning step
    empty_columns: tuple = EMPTY_COLUMNS
    # personal columns, dropped right after the scan
    pii_columns: tuple = PII_COLUMNS
    # lookup tables (codes, costs, parts) are broadcast up to this many bytes,
    # measured; each executor holds one copy. Larger ones are shuffle-joined
    max_broadcast_bytes: int = 64 << 20
    # optional folder written by ``materialize_model``: the model tables are
    # then read from it instead of being derived from the source tables
    model_dir: str | None = None
    # optional database of the bucketed fact and order tables written by
    # ``materialize_model(..., buckets=n, database=...)``
    model_tables: str | None = None
    # optional cost table as CSV (header; code and cost columns by name);
    # without it the adapter derives costs from the part table
    cost_csv: str | None = None
    cost_csv_code_col: str = "product_code"
    cost_csv_cost_col: str = "cost"


DEFAULT = Params()

#: The values of the test data.
ADAPTER = Params(
    bulk_threshold=6, hero_product="Brand#10", seasonality_shop="shop_a", reason_slow="too_slow", reason_duplicate="duplicate",
    reason_unpaid="unpaid", product_key="part_id", carrier_canonical=(("falcon", "Falcon"),),
    holidays=(dt.date(1999, 2, 16), dt.date(2000, 2, 5)), empty_columns=("warehouse",),
    pii_columns=(*PII_COLUMNS, "customer_name", "customer_segment"),
)
