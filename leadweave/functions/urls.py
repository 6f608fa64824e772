"""URL columns: cleaning, safety, form encoding. Addresses are split by regular expression
because ``parse_url`` rejects hosts a browser would still show."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track the visitor.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "mkt_tok", "mc_cid", "mc_eid",
]

# scheme, authority, path, query (fragment ignored)
_URL_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"

# IPv4 networks that are not reachable from the public internet: 0/8, 10/8,
# 100.64/10, 127/8, 169.254/16, 172.16/12, 192.0.0/24 (but for .9 and .10), 192.0.2/24,
# 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 240/4.
_CLOSED_V4 = (
    r"^(?:0|10|127|24\d|25[0-5])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\."
    r"|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.0\.(?!(?:9|10)$)|^192\.0\.2\.|^192\.168\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
# IPv6 networks that are not global, in any spelling of their groups
# (unspecified and loopback, mapped, 64:ff9b:1, discard, protocol assignments, documentation,
# 6to4, unique local, link local).
_CLOSED_V6 = (
    r"(?i)^(?:[0:]*:0{0,3}[01]?$|(?:[0:]*::(?:0{1,4}:)*|(?:0{1,4}:){5})ffff:(?:[0-9a-f]{1,4}:[0-9a-f]{1,4}|[0-9.]+)$|0{0,2}64:ff9b:0{0,3}1:|0?100:(?::(?!(?:[0-9a-f]+:){4}[0-9a-f])|(?:0{1,4}:){3})"
    r"|2001:(?:0{0,3}[0-9a-f]?|0{0,2}[0-9a-f]{2}|0?[01][0-9a-f]{2}):|2001:0?db8:|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# eight groups, or fewer around one "::"; the last two may be a dotted quad; a zone may follow
_GROUP = "[0-9a-f]{1,4}"
_TAIL = rf"(?:{_GROUP}:{_GROUP}|{_OCTET}(?:\.{_OCTET}){{3}})"
_IPV6 = (
    rf"(?i)^(?:(?:{_GROUP}:){{6}}{_TAIL}"
    rf"|(?!(?!::)(?:[^:]*:){{8}}[^:]|::(?:[^:]*:){{7}}[^:])(?!.*::.*::)(?:{_GROUP}(?::{_GROUP})*)?::(?:(?:{_GROUP}:)*(?:{_GROUP}|{_TAIL}))?)(?:%.*)?$"
)


def form_encode(col: Column) -> Column:
    """Form encoding with a blank as ``+``; ``~`` stays, ``*`` is escaped."""
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form_decode(col: Column) -> Column:
    """Inverse of ``form_encode`` that leaves a stray ``%`` as it is."""
    return F.url_decode(F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(query: Column) -> Column:
    """Decoded parameters without blank and tracking ones, as array<struct<name, value>>."""
    pairs = F.transform(
        F.split(query, "&"),
        lambda item: F.struct(
            form_decode(F.substring_index(item, "=", 1)).alias("name"),
            form_decode(F.regexp_replace(item, "^[^=]*=?", "")).alias("value"),
        ),
    )
    return F.filter(
        pairs, lambda p: (p["value"] != "") & ~F.lower(p["name"]).isin(TRACKING_PARAMS)
    )


def encode_pairs(pairs: Column) -> Column:
    """Query text of ``query_pairs``; a repeated name moves next to its first use."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: p["name"] == n)))
    return F.array_join(
        F.transform(
            grouped,
            lambda p: F.concat(form_encode(p["name"]), F.lit("="), form_encode(p["value"])),
        ),
        "&",
    )


def with_scheme(col: Column) -> Column:
    given = col.startswith("http://") | col.startswith("https://")
    return F.when(given, col).otherwise(F.concat(F.lit("https://"), col))


def clean_website(df: DataFrame, name: str = "website") -> DataFrame:
    """Canonical address in column ``name``: scheme added, host in lower case, tracking
    parameters, fragment and trailing slashes dropped (a lone ``/`` stays). NULL without a
    host; NULL or empty input comes back unchanged.

    The parts are columns of their own because each is used more than once: the optimizer
    then computes them once instead of copying the expressions into each other.
    """
    given = F.coalesce(F.col(name) != "", F.lit(False))
    whole = F.regexp_extract("_url", _URL_PARTS, 3)
    parts = df.withColumn("_url", F.when(given, with_scheme(F.col(name)))).withColumns({
        "_host": F.lower(F.regexp_extract("_url", _URL_PARTS, 2)),
        # an empty ";params" goes, like an empty query
        "_path": F.when(F.col("_url").contains(";"), F.regexp_replace(whole, "(^|/)([^/;]*);$", "$1$2")).otherwise(whole),
        "_pairs": query_pairs(F.when(
            F.col("_url").contains("?"), F.nullif(F.regexp_extract("_url", _URL_PARTS, 4), F.lit("")))),
    }).withColumn("_query", encode_pairs(F.col("_pairs")))
    # ";params" after the last slash stay, but the slash rule sees the path before them
    path = F.regexp_replace("_path", "^(.*?)/+(;[^/]*)?$", "$1$2")
    path = F.when(F.col("_path").rlike("^/(;|$)"), F.col("_path")).otherwise(path)
    path = F.regexp_replace(path, "^;", "/;")
    query = F.when(F.col("_query") != "", F.concat(F.lit("?"), F.col("_query"))).otherwise("")
    cleaned = F.when(F.col("_host") != "", F.concat(
        F.lower(F.substring_index("_url", ":", 1)), F.lit("://"), "_host", path, query))
    return parts.withColumn(
        name, F.when(F.col("_url").isNull(), F.col(name)).otherwise(cleaned)
    ).select(df.columns)


def url_host(col: Column) -> Column:
    """Lower-case host without user info, brackets or port."""
    authority = F.regexp_extract(col, _URL_PARTS, 2)
    host = F.regexp_replace(authority, "^.*@", "")
    return F.lower(
        F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(
            F.substring_index(host, ":", 1)
        )
    )


def is_safe_url(col: Column) -> Column:
    """True for http(s) addresses whose host is a name or a public IP literal."""
    scheme = F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = url_host(col)
    reachable = (
        F.when(host == "localhost", False)
        .when(host.rlike(_IPV4), ~host.rlike(_CLOSED_V4))
        .when(host.contains(":"), host.rlike(_IPV6) & ~host.rlike(_CLOSED_V6))
        .otherwise(True)
    )
    return scheme.isin("http", "https") & reachable


def fill_template(template: Column, **values: Column) -> Column:
    """Replace each ``{name}`` in a template column by a value column."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
