"""SKU suffix and item-name label extraction (SK2-SK4) as Column expressions.

Null in -> null out (the gift flag: false), so a missing SKU never fails a job.
``regexp_extract`` returns '' when nothing matches; each extraction is guarded
by ``rlike`` so "no match" stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.config import (
    CAMPAIGN_SUFFIX_RE,
    GIFT_SL_SUFFIX_RE,
    GIFT_STICKER_SUFFIX_RE,
    PROMO_LABEL_RE,
)


#: White space before the label: Unicode's, and the four separators U+001C to U+001F.
_LABEL_RE = r"(?U)^[\s\x1c-\x1f]*" + PROMO_LABEL_RE.removeprefix("^")


def _ci(pattern: str) -> str:
    return "(?i)" + pattern


def campaign_flag(sku: Column) -> Column:
    """'FS', 'FS2' or 'FS3' from a case-insensitive FS suffix, else null."""
    pat = _ci(CAMPAIGN_SUFFIX_RE)
    return F.when(sku.rlike(pat), F.concat(F.lit("FS"), F.regexp_extract(sku, pat, 1)))


def has_gift(sku: Column) -> Column:
    """True when the SKU ends in an SL/SL2/SL3 or [digit]sticker[a] suffix."""
    return F.coalesce(
        sku.rlike(_ci(GIFT_STICKER_SUFFIX_RE)) | sku.rlike(_ci(GIFT_SL_SUFFIX_RE)), F.lit(False)
    )


def promo_label(item_name: Column) -> Column:
    """The leading '[...]' label of the trimmed item name, else null. The label
    ends in a bracket, so white space at the name's end is never part of it and
    only that before it is skipped; no trimmed name is built."""
    return F.when(item_name.rlike(_LABEL_RE), F.regexp_extract(item_name, _LABEL_RE, 1))
