"""Codes and limits of the product range.

Everything in this module is a fixed value: results are right only if these
equal the published product terms.
"""

# Enumerations accepted in policy documents.
GENDERS = ("Unknown", "Male", "Female", "NotApplicable")
PAY_MODES = ("Annual", "SemiAnnual", "Quarterly", "Monthly")
CHANNELS = ("CHNL001", "CHNL002", "CHNL003")
STATUSES = ("Inforce", "Lapsed", "Terminated", "Claimed")
BENEFIT_OPTIONS = ("A", "B")
RELATIONSHIPS = ("OwnerSelf", "Other")
FUNDS = (
    "F000", "F001", "F002", "F003", "F004", "F005",
    "F006", "F007", "F008", "F009", "F010",
)
BASE_PRODUCTS = ("UVL01", "UVL02", "UVL03", "ILP01", "ILP02", "ILP03")
RIDER_PRODUCTS = (
    "ADD01", "PPD01", "CIR01", "CIR02", "SUP01", "HOP02", "WOP01", "WOP02",
)

# Integer codes used as rate table keys.
GENDER_CODES = {"Unknown": 0, "Male": 1, "Female": 2, "NotApplicable": 9}
INT_RATE_CODES = {"High": 0, "Low": 1, "Guaranteed": 2}
PAY_MODE_CODES = {"Annual": 1, "SemiAnnual": 2, "Quarterly": 4, "Monthly": 12}

# Scenario labels, in the order the scenarios are numbered.
INT_RATE_SCENARIOS = ("High", "Low", "Guaranteed")
RISK_SCENARIOS = ("Standard", "Subrisk")
TERM_SCENARIOS = ("Policy", "Opted", "Must-pay")

# Outcome texts of a planned withdrawal.
NO_WITHDRAWAL = "No withdrawal."
OVER_ACCOUNT = "Withdrawal amount exceeds policy account value."
LOW_ACCOUNT = "After withdrawal, end PAV is below acceptable limit."
LOW_SI = "After withdrawal, end SI is below acceptable limit."
WITHDRAWN = "Successfully withdraw."

# Terms of the supported base products.
# product, must-pay years, bonus review years (loyalty, special), minimum sum
# insured, first withdrawal year, monthly accident rate, guarantees an interest
# rate, pays a special bonus, pays a big-case bonus
PRODUCT_TERMS = (
    ("UVL01", 4, 4, 10, 100_000_000.0, 2, 0.000075, True, False, False),
    ("UVL02", 3, 3, 10, 100_000_000.0, 2, 0.000075, True, True, False),
    ("UVL03", 3, 3, 10, 100_000_000.0, 2, 0.000075, True, True, False),
    ("ILP01", 3, 3, 10, 100_000_000.0, 2, 0.0, False, False, True),
)
PRODUCT_TERMS_SCHEMA = (
    "product string, must_pay_period int, lb_review_period int, "
    "sb_review_period int, min_si double, withdrawal_start_year int, "
    "acc_coi_rate double, has_guaranteed_rate boolean, has_special_bonus boolean, "
    "has_big_case_bonus boolean"
)

# Ages and grid size.
MATURITY_AGE = {1: 100}
MATURITY_AGE_OTHERWISE = 66
ACCIDENT_COVER_END_AGE = 66
MAX_POLICY_YEARS = 100
MAX_EXTRA_PREM_TERM = 99

# Big-case bonus, share of the annual target premium by minimum
# premium, and special bonus rates by (0-based year, minimum sum insured).
BIG_CASE_TIERS = ((100_000_000.0, 0.05), (50_000_000.0, 0.03))
SPECIAL_BONUS_LARGE_SI = 1_000_000_000.0
SPECIAL_BONUS_RATES = {10: (0.2, 0.4), 20: (0.6, 1.2)}
