"""Vocabularies that must stay as they are for right results."""

# Condition vocabulary, best to worst (filter order).
CONDITIONS = (
    "Brand New - Sealed",
    "Brand New - Open Box",
    "New (Adjusted Quantity)",
    "Best Before (Grocery)",
    "Excellent",
    "Good",
    "New With Defects",
    "Fair",
    "Heavily Used",
    "For Parts Only",
    "Do Not Bid",
)

# Entries that mean "no condition was recorded".
CONDITION_PLACEHOLDERS = ("SELECT CONDITION HERE",)

# Price ladder, best to worst. A different order from CONDITIONS on purpose.
PRICE_LADDER = (
    "BRAND NEW - SEALED",
    "BRAND NEW - OPEN BOX",
    "NEW (ADJUSTED QUANTITY)",
    "EXCELLENT",
    "GOOD",
    "NEW WITH DEFECTS",
    "FAIR",
    "HEAVILY USED",
    "FOR PARTS ONLY",
)

CONFIDENCES = ("low", "medium", "high")
OUTLOOKS = ("good", "fair", "poor")

# "Label: value" lines of a description and the column each one fills.
TEXT_FIELDS = {
    "Model": "model",
    "Verified Size": "size",
    "Notes": "notes",
    "Damage Desct": "damage",
    "Missing Parts Desc": "missing_parts",
}

# "Question? answer" lines, the column, and the answers worth keeping.
FLAG_FIELDS = {
    "Is Item Damaged?": ("damaged", ("Yes", "Unknown")),
    "Missing Major Parts?": ("missing_major_parts", ("Yes", "Unknown")),
    "Is Item Functional?": ("functional", ("No", "Unable to Test")),
}

# Columns that, with the title, decide whether two lots are one product.
VALUE_FIELDS = (
    "model",
    "size",
    "condition",
    "notes",
    "damage",
    "missing_parts",
    "damaged",
    "missing_major_parts",
    "functional",
)

# Columns a label answer carries from the representative to every copy.
LABEL_FIELDS = (
    "is_flagged",
    "buckets",
    "subtype",
    "personal_match",
    "personal_tags",
    "match_strength",
    "match_types",
    "personal_reasoning",
)

VALUATION_FIELDS = ("est_low", "est_high", "confidence", "outlook", "reasoning")

# Columns where the listing itself wins over a label row.
LISTING_FIELDS = (
    "title",
    "description",
    "thumb_url",
    "image_url",
    "lot_url",
    "url",
    "condition",
    "close_at",
    "first_seen",
)
LABEL_CATEGORY_FIELDS = ("category", "subcategory", "category_path")

UNGROUPED = "Other"
TIME_ZONE = "America/New_York"
CRUMB = " - "

# Title openers that are never a brand.
FILLER_WORDS = (
    "AND", "FOR", "WITH", "THE", "OF", "IN", "TO", "PACK", "SET", "PC", "PCS",
    "PK", "KIT", "NEW", "BOX", "CASE", "LOT", "ASSORTED", "PIECE", "PIECES",
    "SIZE", "COLOR", "COLOUR", "BLACK", "WHITE", "GREY", "GRAY", "BLUE", "RED",
    "GREEN", "PINK", "LARGE", "SMALL", "MEDIUM", "MENS", "WOMENS", "KIDS",
    "INCH", "IN", "FT", "CM", "MM", "OZ", "LB", "LBS", "GAL", "ML", "PRO",
    "PLUS", "MAX", "ULTRA", "MINI", "ORIGINAL", "STYLE", "TYPE", "DUAL",
)

# Thresholds.
MAX_WEEKS = 8                # periods kept per product
CLUSTER_SECONDS = 3 * 3600   # runs this close to a cluster's start belong to it
MAX_BUCKET_SHARE = 0.08
MAX_SHORTLIST_ROWS = 14000
SWEEP_ROWS = 500
SWEEP_SEED = "20260815"
DOMINANCE = 0.60
MIN_CATEGORY_LOTS = 15
MIN_SEED_LEN = 4
NOISY_RATIO = 2.0
NOISY_MIN = 5
CHUNK_ROWS = 2750
CHUNK_DRIFT = 0.10
SUBTYPE_MIN_PCT = 90
REASONING_MIN_PCT = 95
