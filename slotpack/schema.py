"""Constants, vocabularies and table schemas of the storage-layout model.

All tables are plain DataFrames; nesting appears only at the JSON sink.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
SLOT_SIZE = 32            # bytes per EVM storage slot
MAX_EXACT_ITEMS = 20      # exact packer limit; more packable items -> first-fit decreasing
GAS_PER_SLOT = 20000      # deployment gas estimate per saved slot
WEB_TOP_N = 30            # dataset report top list
CLI_TOP_N = 10            # bulk CLI top list
LEADERBOARD_PAGE = 15     # leaderboard page size
ERROR_TEXT_MAX = 240      # short error: at most 240 chars, 237 + "..."

STRATEGY_EXACT = "DP-bitmask (exact optimum)"
STRATEGY_FFD = "First-Fit Decreasing (heuristic, fallback for n > 20)"
STRATEGY_TAG_EXACT = "DP-bitmask"
STRATEGY_TAG_FFD = "FFD"

ISSUE_PARTIAL = "PARTIAL_SLOT_WASTE"
ISSUE_ORDER = "SUBOPTIMAL_ORDER"
SEVERITY_MEDIUM = "MEDIUM"
SEVERITY_LOW = "LOW"
PARTIAL_RECOMMENDATION = "Check whether the small variables can be packed more efficiently."

STATUS_OK, STATUS_ERROR, STATUS_EMPTY = "OK", "ERROR", "EMPTY"
KIND_REAL, KIND_SYNTHETIC, KIND_OTHER = "real", "synthetic", "other"

# Solidity names that are never external types (value types, keywords).
SOLIDITY_BASE_TYPES = ["bool", "address", "string", "bytes", "byte", "fixed", "ufixed",
                       "uint", "int", "mapping"]
NON_TYPE_KEYWORDS = ["function", "constructor", "modifier", "event", "error", "struct", "enum",
                     "using", "contract", "interface", "library", "abstract", "pragma", "import",
                     "return", "if", "for", "while", "do", "break", "continue", "throw",
                     "emit", "new", "delete", "try", "catch", "revert", "require", "assert"]


def solidity_value_types() -> list[str]:
    """Base types plus the sized families uint8..uint256, int8..int256, bytes1..bytes32."""
    sized = [f"{p}{n}" for n in range(8, 257, 8) for p in ("uint", "int")]
    fixed_bytes = [f"bytes{n}" for n in range(1, 33)]
    return SOLIDITY_BASE_TYPES + sized + fixed_bytes


# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Compiler standard-JSON output, read with an explicit schema (never inferred). Scalars are read as text
# and converted leniently; ``errors`` is parsed on its own, as its shape varies.
LAYOUT_MEMBER = _texts("label", "offset", "slot", "type")
LAYOUT_TYPE = T.StructType([*_texts("encoding", "label", "numberOfBytes").fields,
                            T.StructField("members", T.ArrayType(LAYOUT_MEMBER))])
LAYOUT_ITEM = _texts("astId", "contract", "label", "offset", "slot", "type")
STORAGE_LAYOUT = T.StructType([
    T.StructField("storage", T.ArrayType(LAYOUT_ITEM)),
    T.StructField("types", T.MapType(T.StringType(), LAYOUT_TYPE)),
])
CONTRACT_OUTPUT = T.StructType([T.StructField("storageLayout", STORAGE_LAYOUT)])
LAYOUT_DOCUMENT = T.StructType([
    T.StructField("contracts", T.MapType(T.StringType(), T.MapType(T.StringType(), CONTRACT_OUTPUT))),
    T.StructField("errors", T.StringType()),
])

BULK_COLUMNS = ["file", "contract", "status", "error", "current_slots", "recommended_slots",
                "saved_slots", "current_wasted", "recommended_wasted", "saved_wasted", "strategy",
                "imports_removed", "functions_removed", "modifiers_removed", "types_replaced",
                "structs_total", "structs_improved", "struct_saved_slots"]
BULK_INT_COLUMNS = [c for c in BULK_COLUMNS if c not in ("file", "contract", "status", "error", "strategy")]
