"""Column-expression builders; nothing here touches rows in Python."""

from .finance import (POLICIES, LoanPolicy, clamp_value, display_money, forward_target,
                      inverse_target, rehab_ratio, size_loan, total_cost, value_ratio)
from .numeric import (nan_to_null, null_if_zero, strip_space, to_date, to_number,
                      to_number_strict, zero_if_null)
from .text import (city_bucket, day_key, iso_text, lower_strip, normalize_name,
                   normalize_names, strip_text)

__all__ = [
    "POLICIES", "LoanPolicy", "clamp_value", "display_money", "forward_target",
    "inverse_target", "rehab_ratio", "size_loan", "total_cost", "value_ratio",
    "nan_to_null", "null_if_zero", "strip_space", "to_date", "to_number", "to_number_strict",
    "zero_if_null", "city_bucket", "day_key", "iso_text", "lower_strip", "normalize_name",
    "normalize_names", "strip_text",
]
