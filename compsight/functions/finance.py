"""Valuation and loan-sizing expressions (FIN-1..9, FMT-1).

Every function returns Spark ``Column`` expressions so a whole scoring job
stays one projection inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .numeric import null_if_zero, zero_if_null


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_cost(purchase: Column | str, rehab: Column | str, nulls: str = "zero") -> Column:
    """FIN-1: purchase + rehab; ``nulls='zero'`` treats missing as 0, 'propagate' keeps NULL."""
    if nulls == "zero":
        return zero_if_null(purchase) + zero_if_null(rehab)
    if nulls == "propagate":
        return _c(purchase).cast("double") + _c(rehab).cast("double")
    raise ValueError(f"nulls must be 'zero' or 'propagate', got {nulls!r}")


REHAB_RATIO_MODES = ("train_linear", "train_forest", "audit", "score")


def rehab_ratio(purchase: Column | str, rehab: Column | str, mode: str = "train_linear") -> Column:
    """FIN-2, four definitions used by the reference:

    train_linear  rehab/purchase, purchase 0 -> NULL, clipped to [0, 5], NULL stays
    train_forest  rehab/purchase, purchase 0 -> NULL, then NULL -> 0
    audit         rehab/purchase, purchase 0 -> NULL, unclipped, NULL stays
    score         rehab/(purchase+rehab) with missing inputs as 0; 0 when cost <= 0
    """
    p, r = _c(purchase).cast("double"), _c(rehab).cast("double")
    if mode == "score":
        p0, r0 = zero_if_null(p), zero_if_null(r)
        cost = p0 + r0
        return F.when(cost > 0, r0 / cost).otherwise(F.lit(0.0))
    ratio = r / null_if_zero(p)
    if mode == "train_linear":
        # clip keeps NULL (least/greatest would skip it)
        return F.when(ratio < 0, F.lit(0.0)).when(ratio > 5, F.lit(5.0)).otherwise(ratio)
    if mode == "train_forest":
        return F.coalesce(ratio, F.lit(0.0))
    if mode == "audit":
        return ratio
    raise ValueError(f"mode must be one of {REHAB_RATIO_MODES}, got {mode!r}")


TARGET_TRANSFORMS = {
    "log1p": (F.log1p, F.expm1),
    "log": (F.log, F.exp),
    "identity": (lambda c: c, lambda c: c),
}


def forward_target(c: Column | str, transform: str) -> Column:
    """FIN-4 forward transform (``log1p`` for the linear model, ``log`` for the forest)."""
    return TARGET_TRANSFORMS[transform][0](_c(c).cast("double"))


def inverse_target(c: Column | str, transform: str) -> Column:
    """FIN-4 exact inverse of the stored transform."""
    return TARGET_TRANSFORMS[transform][1](_c(c))


def clamp_value(raw: Column | str, cost: Column | str, lo: float = C.ARV_MIN_RATIO,
                hi: float = C.ARV_MAX_RATIO, tol: float = C.CLAMP_TOLERANCE) -> dict[str, Column]:
    """FIN-5 guard-rail: value/cost ratio clamped to [lo, hi] when cost > 0.

    Returns ``arv``, ``clamped_ratio`` (NULL when cost <= 0) and ``arv_clamped``.
    """
    raw, cost = _c(raw), _c(cost)
    ratio = raw / null_if_zero(cost)  # shared subexpressions are evaluated eagerly
    bounded = F.when(ratio < lo, F.lit(lo)).when(ratio > hi, F.lit(hi)).otherwise(ratio)
    has_cost = cost > 0
    clamped_ratio = F.when(has_cost, bounded)
    return {
        "arv": F.when(has_cost, bounded * cost).otherwise(raw),
        "clamped_ratio": clamped_ratio,
        "arv_clamped": F.coalesce(has_cost & (F.abs(bounded - ratio) > tol), F.lit(False)),
    }


@dataclass(frozen=True)
class LoanPolicy:
    """D9: one loan-sizing operator, three reference policies as records."""

    ltv: float = C.LTV_LIMIT
    ltc: float | None = None
    points: float = C.PLACEMENT_POINTS
    setup_fee: float = C.ACCOUNT_SETUP_FEE
    other_fees: float = C.OTHER_FIXED_FEES
    floor_loan: bool = True
    floor_advance: bool = True
    round_cash: bool = True


POLICIES = {
    # FIN-6: LTV only, loan floored at 0, advance floored, cash rounded half-even
    "ltv": LoanPolicy(),
    # FIN-7: min(LTV, LTC), advance floored, cash rounded
    "ltv_ltc": LoanPolicy(ltc=C.LTC_LIMIT, floor_loan=False),
    # FIN-8: min(LTV, LTC), advance not floored, cash not rounded
    "ltv_ltc_raw": LoanPolicy(ltc=C.LTC_LIMIT, floor_loan=False, floor_advance=False,
                              round_cash=False),
}


def size_loan(arv: Column | str, purchase: Column | str, rehab: Column | str,
              policy: LoanPolicy | str = "ltv") -> dict[str, Column]:
    """FIN-6/7/8: total loan, initial advance, placement fee and cash to close."""
    pol = POLICIES[policy] if isinstance(policy, str) else policy
    arv = _c(arv)
    p, r = zero_if_null(purchase), zero_if_null(rehab)
    cost = p + r
    max_ltv = F.lit(pol.ltv) * arv
    out: dict[str, Column] = {"total_cost": cost}
    if pol.ltc is None:
        loan = max_ltv
    else:
        max_ltc = F.lit(pol.ltc) * cost
        loan = F.least(max_ltv, max_ltc)
        out["max_loan_ltv"] = max_ltv
        out["max_loan_ltc"] = max_ltc
    if pol.floor_loan:
        loan = F.greatest(F.lit(0.0), loan)
    advance = loan - r
    if pol.floor_advance:
        advance = F.greatest(advance, F.lit(0.0))
    fee = loan * F.lit(pol.points)
    cash = p - advance + fee + F.lit(pol.setup_fee) + F.lit(pol.other_fees)
    if pol.round_cash:
        cash = F.bround(cash, 0)  # Python round(): half to even
    cash = F.greatest(cash, F.lit(0.0))
    out.update({"total_loan": loan, "initial_advance": advance, "placement_fee": fee,
                "cash_to_close": cash})
    if pol.ltc is None:
        out["ltv_limit"] = F.lit(pol.ltv)
    return out


def value_ratio(pred: Column | str, cost: Column | str) -> Column:
    """FIN-9: predicted value / total cost, cost 0 -> NULL."""
    return _c(pred) / null_if_zero(_c(cost))


def display_money(c: Column | str, digits: int = 0) -> Column:
    """FMT-1: half-even rounding then thousands separators (text)."""
    return F.format_number(F.bround(_c(c), digits), digits)
