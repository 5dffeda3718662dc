"""Fixed values, declared once."""

from __future__ import annotations

# --- fixed values (must equal the reference's) ---------------------------
# The category list, in its given order.
CATEGORIES = [
    "Food & Dining",
    "Groceries",
    "Shopping",
    "Transportation",
    "Travel",
    "Entertainment",
    "Health & Medical",
    "Utilities",
    "Rent & Housing",
    "Subscriptions",
    "Income & Salary",
    "Transfers",
    "ATM & Cash",
    "Insurance",
    "Education",
    "Other",
]
DEFAULT_CATEGORY = "Other"
CATEGORY_BATCH = 20          # descriptions per categorising request
CHUNK_CHARS = 3000           # characters per extraction chunk
TOP_K = 5                    # search depth
Z_THRESHOLD = 2.5            # z-score flag threshold
Z_MIN_GROUP = 3              # minimum expenses per category for z-scores
DUPLICATE_DAYS = 3           # near-duplicate window in whole days
# --------------------------------------------------------------------------
