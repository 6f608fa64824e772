"""Text cleaning columns: entity decode, invisible characters, whitespace, slugs."""

import html
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters removed from, or replaced by a blank in, every text field.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
SOFT_HYPHEN = "\u00ad"
NO_BREAK_SPACE = "\u00a0"

# Entities decoded inside the JVM. "&amp;" comes last so that "&amp;lt;" ends as "&lt;":
# one decoding pass, not two.
NATIVE_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'",
    "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&middot;": "\u00b7", "&amp;": "&",
}

# What else the full HTML5 table decodes: numeric forms, names with a semicolon, and the few names
# that count without one, whatever follows ("&copy=1"). The "&" of a query string is none of these.
_BARE_NAMES = "|".join(sorted(name for name in html5 if not name.endswith(";")))
_NEEDS_FULL_TABLE = (
    "&(?!" + "|".join(name[1:] for name in NATIVE_ENTITIES)
    + rf")(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]*+;|{_BARE_NAMES})"
)

# Whitespace as Python sees it: Unicode spaces and line ends plus the four ASCII separators.
# Visible ASCII is ruled out first, so that most characters never reach the list.
_WHITESPACE = (
    r"[[^!-~]&&[ \t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]+"
)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _html5_unescape(*columns: pa.Array) -> pa.Array:
    rows = len(columns[0])
    if all(c.null_count == rows for c in columns):
        return pa.nulls(rows, pa.list_(pa.string()))
    decoded = [[v and html.unescape(v) for v in c.to_pylist()] if c.null_count < rows else [None] * rows for c in columns]
    return pa.array([None if row.count(None) == len(row) else row for row in zip(*decoded)], pa.list_(pa.string()))


def unescape_all(*cols: Column) -> list[Column]:
    """Decode HTML entities of each column once.

    Common entities are decoded by JVM ``replace``; only values holding any other entity
    reach Python, all others travel as NULL. One call takes all columns of a row and gives
    one array, NULL for most rows, so that a batch without such values costs Python nothing.
    """
    decoded = _html5_unescape(*[F.when(c.contains("&") & c.rlike(_NEEDS_FULL_TABLE), c) for c in cols])
    out = []
    for n, col in enumerate(cols):
        native = col
        for entity, char in NATIVE_ENTITIES.items():
            native = F.replace(native, F.lit(entity), F.lit(char))
        native = F.when(col.contains("&"), native).otherwise(col)
        out.append(F.coalesce(decoded[n], native))
    return out


def unescape_html(col: Column) -> Column:
    """``unescape_all`` of one column."""
    return unescape_all(col)[0]


def strip_invisible(col: Column) -> Column:
    """Drop zero-width characters and soft hyphens; no-break space becomes a blank."""
    return F.translate(col, NO_BREAK_SPACE + ZERO_WIDTH + SOFT_HYPHEN, " ")


def squash_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _WHITESPACE, " "))


# One range, so that a character costs one comparison; "&" and double blanks are sought as bytes.
_PRINTABLE_ASCII = r"\A[ -~]*\z"


def needs_cleaning(col: Column) -> Column:
    """Whether a value holds anything but printable ASCII, an "&", or two blanks in a row."""
    return col.contains("&") | col.contains("  ") | ~col.rlike(_PRINTABLE_ASCII)


def clean_texts(*cols: Column) -> list[Column]:
    """Decode entities, drop invisible characters, squash whitespace. Most values hold
    nothing to change; ``needs_cleaning`` finds that out and they are only trimmed."""
    return [
        F.when(needs_cleaning(col), squash_whitespace(strip_invisible(plain))).otherwise(F.trim(col))
        for col, plain in zip(cols, unescape_all(*cols), strict=True)
    ]


def clean_text(col: Column) -> Column:
    """``clean_texts`` of one column."""
    return clean_texts(col)[0]


def slug(col: Column) -> Column:
    """Lower-case key part: runs of other characters become one hyphen, ends stripped. Never
    cut, so that long texts stay apart as keys."""
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9-]", "-")
    squeezed = F.regexp_replace(dashed, "-+", "-")
    return F.regexp_replace(squeezed, "^-+|-+$", "")
