"""Company-name and postal-address normalisation columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, one of which is dropped from the end of a name.
LEGAL_SUFFIX = (
    r"\b(LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Ltd\.?|Limited|Co\.?|Company|LP|LLP)"
    r"\s*[,.]?\s*$"
)

# Address abbreviations, applied in this order.
ADDRESS_WORDS = {
    "St": "Street", "Ave": "Avenue", "Blvd": "Boulevard", "Dr": "Drive", "Ln": "Lane",
    "Ct": "Court", "Rd": "Road", "Ste": "Suite", "Apt": "Apartment",
}

# Every character that can begin a legal form in any case; a word boundary is costly, so it is
# looked for only there.
_LEGAL_START = "(?=[CcIiLl\u0130\u0131])"

_WORD = r"[\p{L}\p{N}_]"

# Leading articles ignored when names are put into blocks.
LEADING_ARTICLE = r"^(the|a|an)\s+"


def normalize_company_name(col: Column) -> Column:
    """Lower-case name without its trailing legal form; NULL for a missing name."""
    base = F.trim(F.lower(col))
    bare = F.trim(F.regexp_replace(base, _LEGAL_START + "(?iU)" + LEGAL_SUFFIX, ""))
    return F.when(col != "", bare)


def standardize_address(col: Column) -> Column:
    """Whole-word street abbreviations spelled out; NULL for a missing address."""
    out = col
    for short, full in ADDRESS_WORDS.items():
        # the literal comes first, so that the search skips quickly; then both word ends
        whole = rf"(?iu){short}(?!{_WORD})(?<!{_WORD}{'.' * len(short)})"
        out = F.regexp_replace(out, whole, full)
    return F.when(col != "", out)


def block_key(col: Column) -> Column:
    """First character of a normalised name after a leading article; ``_`` when nothing is
    left; NULL (no block) for a missing name."""
    bare = F.trim(F.regexp_replace(col, "(?iU)" + LEADING_ARTICLE, ""))
    return F.when(col != "", F.when(bare == "", F.lit("_")).otherwise(F.substring(bare, 1, 1)))
