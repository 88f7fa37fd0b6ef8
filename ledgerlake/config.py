"""Fixed values and limits of the transaction model.

Everything here is plain data. Values marked as fixed must keep these exact
texts and numbers so that results agree with the service this engine
replaces; the rest are engine defaults.
"""

from __future__ import annotations

# --- fixed values (must equal the original service) -------------------------
ALLOWED_CHANNELS = ("web", "mobile", "pos", "api", "import")
CURRENCY_PATTERN = "^[A-Z]{3}$"
CUSTOMER_ID_MAX_LEN = 100
TRANSACTION_ID_MAX_LEN = 255
CURRENCY_LEN = 3
CHANNEL_MAX_LEN = 100
AMOUNT_UPPER_EXCLUSIVE = 1_000_000_000
MAX_AGE_YEARS = 10
DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
DEFAULT_LOOKBACK_MONTHS = 3
DEFAULT_CHUNK_ROWS = 500
MAX_UPLOAD_BYTES = 104_857_600
AMOUNT_PRECISION = 18
AMOUNT_SCALE = 4

MSG_DATE_INVALID = "Transaction date must be a valid timestamp."
MSG_DATE_FUTURE = "Transaction date cannot be in the future."
MSG_DATE_TOO_OLD = "Transaction date cannot be older than 10 years."
MSG_DATE_REQUIRED = "Transaction date is required."
MSG_AMOUNT_INVALID = "Amount must be a valid decimal value."
MSG_AMOUNT_POSITIVE = "Amount must be greater than 0."
MSG_AMOUNT_MAX = "Amount must be less than 1000000000."
MSG_CHANNEL_SET = "Source channel must be one of: web, mobile, pos, api, import."
MSG_DUPLICATE = "Duplicate transaction identifier."
MSG_CUSTOMER_UNRESOLVED = "Customer '{customer}' could not be resolved."
# --- end of fixed values -----------------------------------------------------

# Input field names as they appear in CSV headers and JSON records.
INPUT_FIELDS = (
    "customerId",
    "transactionId",
    "transactionDate",
    "amount",
    "currency",
    "sourceChannel",
)

# Wide decimal used to validate amounts before rounding to the stored scale.
PARSE_DECIMAL = "decimal(38,10)"
STORED_DECIMAL = f"decimal({AMOUNT_PRECISION},{AMOUNT_SCALE})"
# Sums are reported at this type so that engines with different widening rules agree.
SUM_DECIMAL = "decimal(38,4)"

# Outcome classes of an ingested row.
STATUS_ACCEPTED = "accepted"
STATUS_DUPLICATE = "duplicate"
STATUS_INVALID = "invalid"
STATUS_UNRESOLVED = "unresolved"

# Error codes of rule failures and rejects, in report order.
ERR_CUST_EMPTY = "cust_empty"
ERR_CUST_LEN = "cust_len"
ERR_TXN_EMPTY = "txn_empty"
ERR_TXN_LEN = "txn_len"
ERR_DATE_EMPTY = "date_empty"
ERR_DATE_BAD = "date_bad"
ERR_DATE_FUTURE = "date_future"
ERR_DATE_OLD = "date_old"
ERR_AMT_EMPTY = "amt_empty"
ERR_AMT_BAD = "amt_bad"
ERR_AMT_POS = "amt_pos"
ERR_AMT_MAX = "amt_max"
ERR_CUR_EMPTY = "cur_empty"
ERR_CUR_LEN = "cur_len"
ERR_CUR_FMT = "cur_fmt"
ERR_CHAN_EMPTY = "chan_empty"
ERR_CHAN_SET = "chan_set"
ERR_RECORD_CORRUPT = "record_corrupt"
ERR_DUP_STORED = "dup_stored"
ERR_DUP_BATCH = "dup_batch"
ERR_CUST_UNRESOLVED = "cust_unresolved"
