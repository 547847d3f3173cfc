"""Parameters of the registered queries on the test tables; the operators' own defaults are neutral."""

from __future__ import annotations

from datetime import date

THRESHOLD = "0.2"

# Structural losses by sub-category alone are empty on the test tables (every
# brand has deeply discounted lines): registered as they are, and at a finer grain besides.
STRUCTURAL_DIMS = ("customer_name", "sub_category")

# Accounts profiled by name: the first sixteen customer names of the test
# tables, built by rule (they all have lines).
NAMED_ACCOUNTS = tuple(f"Customer#{i:09d}" for i in range(16))
NAMED_CUSTOMER = "Customer#000000001"

# Shared dashboard filters for the registered filtered views.
FILTERS = {
    "regions": ("AMERICA", "EUROPE", "ASIA"),
    "categories": ("ECONOMY", "PROMO", "STANDARD", "LARGE"),
    "segments": ("AUTOMOBILE", "BUILDING", "MACHINERY"),
    "date_range": (date(1996, 1, 1), date(1999, 12, 31)),
}

FIXTURE = {
    "threshold": THRESHOLD, "structural_dims": STRUCTURAL_DIMS, "named_accounts": NAMED_ACCOUNTS,
    "named_customer": NAMED_CUSTOMER, "filters": FILTERS,
}
