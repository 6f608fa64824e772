"""E-mail and telephone columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top-level domains reserved for special use; no mail can be sent there.
SPECIAL_USE_TLDS = ["arpa", "invalid", "local", "localhost", "onion", "test"]

# One dot-separated atom of a local part: ASCII atom characters or anything non-ASCII that
# is not a space or control character.
_ATOM = r"[a-zA-Z0-9_!#$%&'*+\-/=?^`{|}~[^\x00-\x7f\p{Z}\p{C}]]++"
# A domain label: letters, digits, inner hyphens, at most 63 long; "ab--" only as "xn--".
_LABEL = r"(?!(?!xn)..--)[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?"
# The last label is looked at once, where it begins.
_ADDRESS = (
    rf"^{_ATOM}(?:\.{_ATOM})*+@(?:{_LABEL}\.)+"
    rf"(?!(?i:{'|'.join(SPECIAL_USE_TLDS)})$){_LABEL}(?<=\p{{L}})$"
)


def email_domain(col: Column) -> Column:
    return F.lower(F.substring_index(col, "@", -1))


def normalized_email(col: Column) -> Column:
    """The address with its domain in lower case, or NULL when the syntax is not valid.
    Syntax only: whether the domain takes mail is a join (``operators.validation``)."""
    local = F.substring_index(col, "@", 1)
    valid = col.rlike(_ADDRESS) & (F.octet_length(local) <= 64) & (F.octet_length(col) <= 254)
    return F.when(valid, F.concat(local, F.lit("@"), email_domain(col)))


_EXTENSION = r"(?i)(?:[\s,;]*(?:;ext=|ext(?:ension|n)?\.?|x|#)[:.\s]*\d{1,20}#?)\s*$"
_KEYPAD_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEYPAD_DIGITS = "22233344455566677778889999" * 2
_PHONE_CHARACTERS = r"^\+?[0-9A-Za-z\s\-.()/\[\]~*\u2010-\u2015]+$"

# International digits that make a number. North American plan (calling code 1): area code
# N-0..8-X, never N11, no 37X / 96X blocks (held back), not 555 (reserved), exchange N-X-X.
# Other countries: an assigned calling code and total length only.
# Assigned three-digit country calling codes.
LONG_CALLING_CODES = (
    "21[12368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0179]|35[0-9]|37[0-8]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|"
    "67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0-358]|88[0-368]|96[0-8]|97[0-79]|99[2-68]"
)
# One- and two-digit country calling codes.
SHORT_CALLING_CODES = (
    "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|"
    "60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
)
_VALID_DIGITS = (
    r"^(?:1(?!.11|37|96|555)[2-9][0-8][0-9][2-9][0-9]{6}"
    rf"|(?=[0-9]{{7,15}}$)(?:(?!1){SHORT_CALLING_CODES.join(('(?:', ')'))}|{LONG_CALLING_CODES})[0-9]+)$"
)


def phone_start(col: Column) -> Column:
    """The dialled part: from the first digit, plus or bracket, without an extension. Every
    extension holds an "x" or "#"; without them none is sought."""
    marked = col.contains("x") | col.contains("X") | col.contains("#")
    bare = F.when(marked, F.regexp_replace(col, _EXTENSION, "")).otherwise(col)
    return F.regexp_extract(bare, r"[+0-9(\[].*$", 0)


def international_digits(start: Column) -> Column:
    """Digits with calling code, US assumed; three or more letters are read as keypad keys."""
    letters = start.rlike("(?:[A-Za-z].*){3}")
    keyed = F.when(letters, F.translate(start, _KEYPAD_LETTERS, _KEYPAD_DIGITS)).otherwise(start)
    dialled = F.regexp_replace(keyed, "[^0-9+]+", "")
    return (
        F.when(dialled.startswith("+"), F.replace(dialled, F.lit("+"), F.lit("")))
        .when(dialled.startswith("011"), F.regexp_replace(dialled, "^011", ""))
        .otherwise(F.concat(F.lit("1"), F.regexp_replace(dialled, "^1(?=[0-9]{10}$)", "")))
    )


def e164(start: Column, digits: Column) -> Column:
    """E.164 form of a number split by the two functions above, or NULL.

    North American numbers follow the numbering plan (see ``operators.validation`` for the
    check against a table of area codes in service). Numbers of other countries are checked
    by assigned calling code and total length only, which is approximate.
    """
    usable = start.rlike(_PHONE_CHARACTERS) & digits.rlike(_VALID_DIGITS)
    return F.when(usable, F.concat(F.lit("+"), digits))


def area_code(e164: Column) -> Column:
    """Three-digit area code of a North American number, NULL for any other."""
    return F.when(e164.rlike(r"^\+1\d{10}$"), F.substring(e164, 3, 3))


def phone_display(e164: Column) -> Column:
    """International spelling: ``+1 212-555-1234``, ``+44 2079460958``."""
    home = F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", "+1 $1-$2-$3")
    abroad = F.regexp_replace(e164, rf"^\+({SHORT_CALLING_CODES}|\d{{3}})(\d+)$", "+$1 $2")
    return F.when(e164.startswith("+1"), home).otherwise(abroad)
