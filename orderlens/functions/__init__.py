"""Column-expression helpers. All are built-in Spark expressions (JVM-side,
whole-stage codegen); none is a Python UDF."""

from orderlens.functions.calendar import (
    day_diff,
    minute_diff,
    parse_export_timestamp,
    weekday0,
    year_month,
)
from orderlens.functions.sku import campaign_flag, has_gift, promo_label
from orderlens.functions.stats import normal_two_sided_p, normal_upper_tail

__all__ = [
    "day_diff",
    "minute_diff",
    "parse_export_timestamp",
    "weekday0",
    "year_month",
    "campaign_flag",
    "has_gift",
    "promo_label",
    "normal_two_sided_p",
    "normal_upper_tail",
]
