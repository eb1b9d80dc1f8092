"""Column functions of the loan domain: parsing, normalising, status classes, bands and month arithmetic.

All are built from Spark's own functions and stay inside generated code; none raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status classes, the delinquency bucket of each status, and columns known only after origination.
BAD_STATUSES = ["Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off"]
TERMINAL_STATUSES = ["Fully Paid", "Charged Off", "Default", "Does not meet the credit policy. Status:Fully Paid", "Does not meet the credit policy. Status:Charged Off"]
STATUS_BUCKETS = {
    "Fully Paid": "PAID",
    "Current": "CURRENT",
    "In Grace Period": "DPD_1_30",
    "Late (16-30 days)": "DPD_1_30",
    "Late (31-120 days)": "DPD_31_120",
    "Charged Off": "CHARGED_OFF",
    "Default": "CHARGED_OFF",
    "Does not meet the credit policy. Status:Fully Paid": "PAID",
    "Does not meet the credit policy. Status:Charged Off": "CHARGED_OFF",
}
GRADES = ["A", "B", "C", "D", "E", "F", "G"]
POST_ORIGINATION = [
    "loan_status", "pymnt_plan", "total_pymnt", "total_pymnt_inv", "total_rec_prncp", "total_rec_int", "total_rec_late_fee", "recoveries", "collection_recovery_fee",
    "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d", "last_credit_pull_d", "last_fico_range_high", "last_fico_range_low", "out_prncp", "out_prncp_inv",
    "total_bal_ex_prncp", "total_bal_il", "il_util", "max_bal_bc", "all_util", "hardship_flag", "hardship_type", "hardship_reason", "hardship_status", "deferral_term",
    "hardship_amount", "hardship_start_date", "hardship_end_date", "payment_plan_start_date", "hardship_length", "hardship_dpd", "hardship_loan_status",
    "orig_projected_additional_accrued_interest", "hardship_payoff_balance_amount", "hardship_last_payment_amount", "debt_settlement_flag", "debt_settlement_flag_date",
    "settlement_status", "settlement_date", "settlement_amount", "settlement_percentage", "settlement_term",
]
# The bands, as (upper bound, name).
INCOME_BANDS = [(30000, "L0_<3w"), (60000, "L1_3-6w"), (100000, "L2_6-10w"), (200000, "L3_10-20w"), (None, "L4_>=20w")]
FICO_BANDS = [(660, "F0_<660"), (700, "F1_660-699"), (740, "F2_700-739"), (780, "F3_740-779"), (None, "F4_>=780")]
RATE_BANDS = [(8, "R0_<8"), (12, "R1_8-12"), (16, "R2_12-16"), (20, "R3_16-20"), (None, "R4_>=20")]
UNKNOWN = "UNKNOWN"
NULL_KEY = "__NULL__"


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("int")


def parse_term(c: Column) -> Column:
    """``' 36 months'`` to 36."""
    return first_number(c)


def parse_rate(c: Column) -> Column:
    """``'13.56%'`` to 13.56."""
    return F.trim(F.replace(c, F.lit("%"), F.lit(""))).try_cast("decimal(8,4)")


def parse_month(c: Column) -> Column:
    """``'Dec-2018'`` to the first day of that month."""
    return F.try_to_date(c, "MMM-yyyy")


def parse_emp_length(c: Column, lt1_as_zero: bool = False) -> Column:
    """``'10+ years'`` to 10; ``'n/a'`` to null; ``'< 1 year'`` to 1, or 0 on request."""
    years = F.when(~F.lower(c).contains("n/a"), first_number(c))
    return F.when(F.trim(c).startswith("<"), F.lit(0)).otherwise(years) if lt1_as_zero else years


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def norm_purpose(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("_"), F.lit(" ")))


def band(c: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The first band whose upper bound is above the value; null is UNKNOWN."""
    out = F.when(c.isNull(), UNKNOWN)
    for upper, name in bands[:-1]:
        out = out.when(c < upper, name)
    return out.otherwise(bands[-1][1])


def income_band(c: Column) -> Column:
    return band(c, INCOME_BANDS)


def fico_band(c: Column) -> Column:
    return band(c, FICO_BANDS)


def rate_band(c: Column) -> Column:
    return band(c, RATE_BANDS)


def product_code(term: Column, grade: Column) -> Column:
    return F.concat_ws("_", term.cast("string"), grade)


def is_bad(status: Column) -> Column:
    return F.coalesce(F.trim(status).isin(BAD_STATUSES), F.lit(False))


def is_terminal(status: Column) -> Column:
    return F.coalesce(F.trim(status).isin(TERMINAL_STATUSES), F.lit(False))


def dpd_bucket(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_BUCKETS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(status)), F.lit(UNKNOWN))


def weighted_avg(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over pairs without null; no weight gives null."""
    both = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(both, weight)).cast("double")
    return F.sum(F.when(both, value * weight)).cast("double") / F.nullif(total, F.lit(0.0))


def skew_ratio(share: Column, keys: Column) -> Column:
    """How many times its fair part a key holds; unknown share or no keys give 0."""
    return F.when(share.isNull() | keys.isNull() | (keys <= 0), 0.0).otherwise(share * keys)


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def month_of_index(i: Column) -> Column:
    """``year*12 + month`` to the first day of that month."""
    return F.add_months(F.lit("2000-01-01").cast("date"), i - 24001)


def month_str(i: Column) -> Column:
    return F.date_format(month_of_index(i), "yyyy-MM")


def month_diff(later: Column, earlier: Column) -> Column:
    return F.greatest(month_index(later) - month_index(earlier), F.lit(0))


def add_months_str(month: Column, n: int | Column) -> Column:
    """'YYYY-MM' moved by n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), places)


def null_key(c: Column) -> Column:
    """Text keys with null, blank and 'nan' as one sentinel."""
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), NULL_KEY).otherwise(t)


def tie_at_4dp(x: Column) -> Column:
    y = x * 1e4
    return F.abs(y - F.floor(y) - 0.5) < 1e-6


def ts_diff_ms(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000


def salt(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


ENVELOPE = "struct<op:string,before:struct<{row}>,after:struct<{row}>>"


def unpack_envelope(value: Column, row: str) -> Column:
    """A change envelope (op, before, after) from JSON text; ``row`` is the DDL of one image."""
    inner = ",".join(f.strip().replace(" ", ":", 1) for f in row.split(","))
    return F.from_json(value, ENVELOPE.format(row=inner))
