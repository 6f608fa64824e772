"""The registered queries once more as SQL for DuckDB, written independently of the operators:
plain string functions and windows over the same source rows."""

from leadweave.plans import views
from leadweave.sources.configs import BUILT_IN

ORACLES: dict[str, str] = {}


def _v(name: str) -> str:
    return views.for_engine(getattr(views, name), "duckdb")


RAW = f"raw_leads AS ({_v('RAW_LEADS')}), admitted AS (SELECT * FROM raw_leads WHERE company_name <> '')"


def _clean(col: str) -> str:
    out = col
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"replace(replace({out}, chr(8203), ''), chr(160), ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


TEXT_COLUMNS = ("company_name", "phone", "email", "website", "address", "city", "state", "category",
                "rating", "source", "source_url", "scraped_at")
CLEANED = ("cleaned AS (SELECT lead_id, review_count, "
           + ", ".join(f"{_clean(c)} AS {c}" for c in TEXT_COLUMNS) + " FROM admitted)")

_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ATOM = "[a-zA-Z0-9_!#$%&''*+/=?^`{|}~-]+"
GOOD_EMAIL = (f"(regexp_full_match(email, '{_ATOM}(\\.{_ATOM})*@({_LABEL}\\.)+([A-Za-z0-9-]*[A-Za-z])') "
              "AND lower(regexp_extract(email, '[^.@]*$')) NOT IN ('arpa','invalid','local','localhost','onion','test') "
              "AND length(split_part(email, '@', 1)) <= 64 AND length(email) <= 254)")
EMAIL = (f"CASE WHEN email <> '' THEN CASE WHEN {GOOD_EMAIL} THEN split_part(email, '@', 1) || '@' || lower(split_part(email, '@', 2)) END ELSE email END")
EMAIL_FLAG = f"CASE WHEN email <> '' THEN {GOOD_EMAIL} END"

_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_TEN = f"CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS}[1] = '1' THEN {_DIGITS}[2:] ELSE {_DIGITS} END"
PHONE = (f"CASE WHEN phone <> '' AND regexp_full_match({_TEN}, '[2-9][0-8][0-9][2-9][0-9]{{6}}') AND substr({_TEN}, 2, 2) <> '11' "
         f"AND substr({_TEN}, 1, 2) NOT IN ('37', '96') AND substr({_TEN}, 1, 3) <> '555' THEN '+1' || {_TEN} END")
PHONE_DISPLAY = (f"CASE WHEN ({PHONE}) IS NOT NULL THEN '+1 ' || substr({PHONE}, 3, 3) || '-' || substr({PHONE}, 6, 3) || '-' || substr({PHONE}, 9) END")

_TRACKING = "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mkt_tok','mc_cid','mc_eid']"


def _website(col: str) -> str:
    url = f"CASE WHEN starts_with({col}, 'http://') OR starts_with({col}, 'https://') THEN {col} ELSE 'https://' || {col} END"
    host = f"lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1))"
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '^[^=]*=.') "
            f"AND NOT list_contains({_TRACKING}, lower(split_part(p, '=', 1)))), '&')")
    return (f"CASE WHEN {col} <> '' THEN CASE WHEN {host} <> '' THEN regexp_extract({url}, '^([a-z]+)://', 1) || '://' || {host} "
            f"|| CASE WHEN {path} = '/' THEN '/' ELSE rtrim({path}, '/') END "
            f"|| CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END ELSE {col} END")


NAME = ("trim(regexp_replace(trim(lower(company_name)), '(?i)\\b(llc|l\\.l\\.c\\.|inc\\.?|incorporated|corp\\.?|corporation|ltd\\.?|limited|co\\.?|company|lp|llp)"
        "\\s*[,.]?\\s*$', ''))")
ADDRESS = "address"
for _short, _full in (("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Dr", "Drive"), ("Ln", "Lane"),
                      ("Ct", "Court"), ("Rd", "Road"), ("Ste", "Suite"), ("Apt", "Apartment")):
    ADDRESS = f"regexp_replace({ADDRESS}, '(?i)\\b{_short}\\b', '{_full}', 'g')"

PREPARED_COLUMNS = [c for c in TEXT_COLUMNS] + [
    "review_count", "ord", "pipeline_id", "email_validated", "phone_normalized", "phone_display",
    "company_name_normalized", "address_normalized"]
PREPARED = f"""prepared AS (SELECT company_name, phone, {EMAIL} AS email, {_website('website')} AS website, address, city, state,
  category, rating, source, source_url, scraped_at, review_count, lead_id AS ord, CAST(lead_id AS VARCHAR) AS pipeline_id,
  {EMAIL_FLAG} AS email_validated, {PHONE} AS phone_normalized, {PHONE_DISPLAY} AS phone_display,
  {NAME} AS company_name_normalized, {ADDRESS} AS address_normalized FROM cleaned)"""
LEADS = f"WITH {RAW}, {CLEANED}, {PREPARED}"


def _exact(source: str, key: str, out: str, size: str, columns: list[str], own: tuple[str, ...]) -> str:
    """CTEs for one exact pass: rank rows per key, then fill and rename."""
    filled = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns if not c.startswith("_"))
    group = f"CASE WHEN {key} <> '' THEN 'k' || {key} ELSE 'o' || ord END"
    picks = []
    for c in columns:
        first = f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL)"
        mine = f"arg_min({c}, rn) FILTER (WHERE rn = 1)"
        if c in own:
            picks.append(f"{mine} AS {c}")
        elif c == "company_name":
            longest = "arg_max(company_name, length(company_name) * 1000000000::BIGINT - ord)"
            picks.append(f"CASE WHEN length({longest}) > length({mine}) THEN {longest} ELSE {mine} END AS {c}")
        else:
            picks.append(f"coalesce({mine}, {first}) AS {c}")
    return f"""{out}_r AS (SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {filled} DESC, ord) AS rn FROM {source}),
      {out} AS (SELECT {', '.join(picks)}, CAST(count(*) - 1 AS BIGINT) AS {size} FROM {out}_r GROUP BY g)"""


_OWN = ("ord", "pipeline_id")
_SHOW = "pipeline_id, company_name, phone_normalized, email, email_validated, website, address, rating, review_count"
BY_PHONE = _exact("prepared", "phone_normalized", "by_phone", "phone_absorbed", PREPARED_COLUMNS, _OWN)
BY_BOTH = _exact("by_phone", "email", "by_both", "email_absorbed",
                 PREPARED_COLUMNS + ["phone_absorbed"], _OWN + ("phone_absorbed",)).replace(
    "CASE WHEN phone_absorbed IS NOT NULL THEN 1 ELSE 0 END", "0")

ORACLES["raw_admit"] = f"""WITH {RAW} SELECT lead_id, sha256(source || chr(1) || source_url) AS pipeline_id, company_name, phone, source FROM admitted"""
ORACLES["valid_raw_leads"] = f"""WITH {RAW} SELECT source, count(*) AS n FROM raw_leads WHERE company_name IS NOT NULL AND source IS NOT NULL AND source_url IS NOT NULL AND scraped_at IS NOT NULL GROUP BY source"""
ORACLES["clean_strings_leads"] = f"""WITH {RAW}, {CLEANED} SELECT lead_id, company_name, address, email, city, review_count FROM cleaned"""
ORACLES["clean_page_text"] = f"""SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM (SELECT page_id, {_clean('html')} AS t FROM pages)"""
ORACLES["validate_email"] = f"""WITH {RAW} SELECT lead_id, {EMAIL} AS email, {EMAIL_FLAG} AS email_validated FROM admitted"""
ORACLES["document_emails"] = f"""SELECT doc_id, pos, given, {EMAIL} AS email, {EMAIL_FLAG} AS email_validated FROM (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, all_found[pos] AS email, all_found[pos] AS given FROM (
    SELECT doc_id, all_found, unnest(range(1, len(all_found) + 1)) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') AS all_found FROM documents)))"""
ORACLES["check_domain"] = f"""WITH {RAW}, v AS (SELECT lead_id, {EMAIL} AS email, {EMAIL_FLAG} AS email_validated FROM admitted),
  d AS (SELECT DISTINCT 'mail' || (c_custkey % 7) || '.example.com' AS domain FROM customer WHERE c_custkey % 7 < 5)
  SELECT lead_id, CASE WHEN email <> '' AND split_part(email, '@', 2) NOT IN (SELECT domain FROM d) THEN NULL ELSE email END AS email,
    CASE WHEN email <> '' AND split_part(email, '@', 2) NOT IN (SELECT domain FROM d) THEN false ELSE email_validated END AS email_validated FROM v"""
ORACLES["mailbox_verdicts"] = f"""WITH {RAW}, v AS (SELECT lead_id, {EMAIL} AS email, {EMAIL_FLAG} AS email_validated FROM admitted),
  a AS (SELECT DISTINCT 'Contact' || (c_custkey % 1200) || '@mail' || (c_custkey % 7) || '.example.com' AS email FROM customer WHERE c_custkey % 3 = 0)
  SELECT lead_id, email, CASE WHEN email_validated AND email NOT IN (SELECT email FROM a) THEN false ELSE email_validated END AS email_validated FROM v"""
ORACLES["normalize_phone"] = f"""WITH {RAW} SELECT lead_id, phone, {PHONE} AS phone_normalized FROM admitted"""
ORACLES["normalize_phone_in_service"] = f"""WITH {RAW}, p AS (SELECT lead_id, {PHONE} AS n FROM admitted)
  SELECT lead_id, CASE WHEN substr(n, 3, 3) IN (SELECT CAST(c_custkey % 700 + 201 AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0) THEN n END AS phone_normalized FROM p"""
ORACLES["phone_display"] = f"""WITH {RAW} SELECT lead_id, {PHONE_DISPLAY} AS phone_display FROM admitted"""
ORACLES["document_phones"] = f"""SELECT doc_id, pos, phone, {PHONE} AS phone_normalized, {PHONE_DISPLAY} AS phone_display FROM (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, all_found[pos] AS phone FROM (
    SELECT doc_id, all_found, unnest(range(1, len(all_found) + 1)) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}}') AS all_found FROM documents)))"""
ORACLES["clean_website"] = f"""WITH {RAW} SELECT lead_id, {_website('website')} AS website FROM admitted"""
ORACLES["clean_page_urls"] = f"""SELECT page_id, {_website('url')} AS url FROM pages"""
ORACLES["normalize_name"] = f"""WITH {RAW}, {CLEANED} SELECT lead_id, company_name, {NAME} AS company_name_normalized FROM cleaned"""
ORACLES["standardize_address"] = f"""WITH {RAW}, {CLEANED} SELECT lead_id, {ADDRESS} AS address_normalized FROM cleaned"""
ORACLES["prepare_leads_stream"] = f"""{LEADS}, d AS (SELECT DISTINCT 'mail' || (c_custkey % 7) || '.example.com' AS domain FROM customer WHERE c_custkey % 7 < 5),
  a AS (SELECT DISTINCT 'Contact' || (c_custkey % 1200) || '@mail' || (c_custkey % 7) || '.example.com' AS email FROM customer WHERE c_custkey % 3 = 0),
  v AS (SELECT * REPLACE (CASE WHEN lost THEN NULL ELSE email END AS email, CASE WHEN lost THEN false ELSE email_validated END AS email_validated)
    FROM (SELECT *, coalesce(email <> '' AND split_part(email, '@', 2) NOT IN (SELECT domain FROM d), false) AS lost FROM prepared))
  SELECT pipeline_id, company_name, company_name_normalized, phone_normalized, phone_display, email,
    CASE WHEN email_validated AND email NOT IN (SELECT email FROM a) THEN false ELSE email_validated END AS email_validated,
    website, address_normalized, city, rating, review_count FROM v"""
ORACLES["validator_stats"] = f"""WITH {RAW} SELECT count(*) FILTER (WHERE email <> '' AND {GOOD_EMAIL}) AS emails_validated,
  count(*) FILTER (WHERE email <> '' AND NOT {GOOD_EMAIL}) AS emails_invalid, CAST(0 AS BIGINT) AS emails_smtp_failed,
  count(*) FILTER (WHERE phone <> '' AND ({PHONE}) IS NOT NULL) AS phones_normalized, count(*) FILTER (WHERE phone <> '' AND ({PHONE}) IS NULL) AS phones_invalid,
  count(*) FILTER (WHERE website <> '') AS urls_cleaned, CAST(0 AS BIGINT) AS urls_invalid FROM admitted"""
ORACLES["block_key"] = f"""WITH {RAW}, {CLEANED}, n AS (SELECT {NAME} AS name FROM cleaned)
  SELECT substr(trim(regexp_replace(name, '^(the|a|an)\\s+', '')), 1, 1) AS block, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY 1"""
ORACLES["dedup_phone"] = f"""{LEADS}, {BY_PHONE} SELECT {_SHOW}, phone_absorbed AS absorbed FROM by_phone"""
ORACLES["dedup_email"] = f"""{LEADS}, {_exact('prepared', 'email', 'by_mail', 'absorbed', PREPARED_COLUMNS, _OWN)} SELECT {_SHOW}, absorbed FROM by_mail"""
ORACLES["dedup_exact_passes"] = f"""{LEADS}, {BY_PHONE}, {BY_BOTH} SELECT {_SHOW}, phone_absorbed, email_absorbed FROM by_both"""
ORACLES["dedup_counters"] = f"""{LEADS}, {BY_PHONE}, {BY_BOTH} SELECT (SELECT CAST(sum(phone_absorbed) AS BIGINT) FROM by_phone) AS exact_phone_matches,
  (SELECT CAST(sum(email_absorbed) AS BIGINT) FROM by_both) AS exact_email_matches"""
ORACLES["duplicate_map"] = f"""{LEADS}, {BY_PHONE} SELECT a.pipeline_id AS removed_id, b.pipeline_id AS survivor_id FROM by_phone_r a JOIN by_phone_r b
  ON a.g = b.g AND a.rn > 1 AND b.rn = 1"""
_FILLED = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in PREPARED_COLUMNS)
ORACLES["completeness"] = f"""{LEADS} SELECT pipeline_id, CAST({_FILLED} AS INTEGER) AS filled FROM prepared"""


def _similarity(pairs: str, cutoff: float) -> str:
    """Token-set score of a CTE ``pairs(i, j, a, b)`` of sorted token lists. The common
    subsequence is counted with one bit per character; the edit distance, which is never above
    the distance counted here, sorts out most pairs first."""
    return f"""parts AS (SELECT i, j, array_to_string(list_filter(a, lambda t: list_contains(b, t)), ' ') AS s,
        array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), ' ') AS l,
        array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), ' ') AS r FROM {pairs}),
      sized AS (SELECT *, length(s) AS sl, CASE WHEN s <> '' THEN 1 ELSE 0 END AS gap, length(l) AS ll, length(r) AS rl FROM parts),
      near AS (SELECT * FROM sized WHERE {cutoff} = 0 OR (sl > 0 AND (1 + least(ll, rl)) * {cutoff} <= (100 - {cutoff}) * 2 * sl + 1)
        OR (sl > 0 AND least(ll, rl) = 0) OR levenshtein(l, r) <= ceil((2 * (sl + gap) + ll + rl) * (100 - {cutoff}) / 100.0)),
      lcs AS (SELECT *, CASE WHEN ll = 0 OR rl = 0 THEN 0 ELSE ll - bit_count(list_reduce(
          string_split(r, ''),
          lambda acc, ch: ((acc + (acc & m[ch])) | (acc - (acc & m[ch]))) & ((1::HUGEINT << ll) - 1),
          (1::HUGEINT << ll) - 1)) END AS common
        FROM (SELECT *, map_from_entries(list_transform(list_distinct(string_split(l || r, '')), lambda c: {{'k': c,
          'v': CAST(list_sum(list_transform(range(1, ll + 1), lambda p: CASE WHEN l[p] = c THEN 1::HUGEINT << (p - 1) ELSE 0::HUGEINT END)) AS HUGEINT)}})) AS m FROM near)),
      best AS (SELECT i, j, CASE WHEN sl > 0 AND (ll = 0 OR rl = 0) THEN 100.0::DOUBLE ELSE greatest(
          100.0::DOUBLE - 100.0::DOUBLE * (ll + rl - 2 * common) / (2 * (sl + gap) + ll + rl),
          CASE WHEN sl > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (1 + ll) / (2 * sl + 1 + ll) ELSE 0.0::DOUBLE END,
          CASE WHEN sl > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (1 + rl) / (2 * sl + 1 + rl) ELSE 0.0::DOUBLE END) END AS score FROM lcs)
      SELECT i, j, CAST(floor(score + 0.5) AS INTEGER) AS score FROM best WHERE score >= {cutoff}"""


_TOKENS = "list_sort(list_distinct(string_split(company_name_normalized, ' ')))"
ORACLES["token_set_ratio"] = f"""{LEADS}, t AS (SELECT ord, {_TOKENS} AS tokens FROM prepared),
  pairs AS (SELECT x.ord AS i, y.ord AS j, x.tokens AS a, y.tokens AS b FROM t x JOIN t y ON y.ord = x.ord + 1), {_similarity('pairs', 0)}"""
ORACLES["candidate_pairs"] = f"""WITH n AS (SELECT p_partkey AS ord, lower(p_name || ' ' || p_type) AS company_name_normalized FROM part),
  c AS (SELECT company_name_normalized[1] AS block, {_TOKENS} AS tokens, CAST(min(ord) AS BIGINT) AS rep FROM n GROUP BY ALL),
  pairs AS (SELECT x.rep AS i, y.rep AS j, x.tokens AS a, y.tokens AS b FROM c x JOIN c y ON x.block = y.block AND x.rep < y.rep), {_similarity('pairs', 85)}"""



def _greedy(names: str) -> str:
    """Greedy leaders over a CTE ``names(ord, company_name_normalized)``: all pairs of a block
    are scored, then blocks are walked name by name in step."""
    scored = _similarity("pairs", 85)
    parts, final = scored.rsplit("\n      SELECT", 1)
    return f"""cls AS (SELECT substr(trim(regexp_replace(company_name_normalized, '^(the|a|an)\\s+', '')), 1, 1) AS block, {_TOKENS} AS tokens,
        min(ord) AS rep, count(*) AS members FROM {names} GROUP BY ALL),
      pairs AS (SELECT x.rep AS i, y.rep AS j, x.tokens AS a, y.tokens AS b FROM cls x JOIN cls y ON x.block = y.block AND x.rep < y.rep), {parts},
      edges AS MATERIALIZED (SELECT {final}),
      nodes AS MATERIALIZED (SELECT block, rep, row_number() OVER (PARTITION BY block ORDER BY rep) AS k, coalesce(nb, []) AS nb
        FROM cls LEFT JOIN (SELECT j, list(i) AS nb FROM edges WHERE score >= 90 GROUP BY j) e ON e.j = rep),
      walk AS (SELECT block, 0::BIGINT AS k, []::BIGINT[] AS leaders FROM (SELECT DISTINCT block FROM cls)
        UNION ALL SELECT w.block, n.k, CASE WHEN list_has_any(n.nb, w.leaders) THEN w.leaders ELSE list_append(w.leaders, n.rep) END
        FROM walk w JOIN nodes n ON n.block = w.block AND n.k = w.k + 1),
      leaders AS MATERIALIZED (SELECT unnest(l) AS rep FROM (SELECT arg_max(leaders, k) AS l FROM walk GROUP BY block)),
      owner AS MATERIALIZED (SELECT j, min(i) AS i FROM edges WHERE score >= 90 AND i IN (SELECT rep FROM leaders) GROUP BY j),
      review AS MATERIALIZED (SELECT e.i, e.j FROM edges e LEFT JOIN owner o ON o.j = e.j
        WHERE e.score < 90 AND e.i IN (SELECT rep FROM leaders) AND (o.i IS NULL OR o.i > e.i))"""


_OWNED = """SELECT n.ord, coalesce(o.i, c.rep) AS owner_ord FROM {names} n JOIN cls c ON c.tokens = {tokens}
  AND c.block = substr(trim(regexp_replace(company_name_normalized, '^(the|a|an)\\s+', '')), 1, 1)
  LEFT JOIN owner o ON o.j = c.rep WHERE coalesce(o.i, c.rep) <> n.ord"""
_FLAGGED = "SELECT j AS ord, max(i) AS flagged_by FROM review WHERE j IN (SELECT rep FROM leaders) GROUP BY j"
_PART_NAMES = "WITH RECURSIVE n AS (SELECT CAST(p_partkey AS BIGINT) AS ord, lower(p_name || ' ' || p_type) AS company_name_normalized FROM part)"
_LEAD_NAMES = LEADS.replace("WITH", "WITH RECURSIVE", 1) + ", n AS (SELECT ord, company_name_normalized FROM prepared)"
ORACLES["fuzzy_counters"] = f"""{_PART_NAMES}, {_greedy('n')} SELECT CAST((SELECT sum(members) FROM cls) - (SELECT count(*) FROM leaders) AS BIGINT) AS fuzzy_auto_merged,
  CAST((SELECT coalesce(sum(members), 0) FROM review JOIN cls ON rep = j) AS BIGINT) AS fuzzy_flagged_review"""
ORACLES["resolve_leaders"] = f"{_LEAD_NAMES}, {_greedy('n')} " + _OWNED.format(names="n", tokens=_TOKENS)
ORACLES["flag_reviews"] = f"{_LEAD_NAMES}, {_greedy('n')} {_FLAGGED}"

# --- enrichment
_LEADS_SITES = f"WITH {RAW}, lead AS (SELECT lead_id, email, {_website('website')} AS website FROM admitted), sites AS ({_v('SITE_PAGES')})"
_ALIVE = "(CASE WHEN status_head = 405 THEN status_get ELSE status_head END BETWEEN 200 AND 299)"
_MAIL = """list_filter(regexp_extract_all(html, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), lambda e:
  NOT regexp_matches(lower(e), '^(info|support|sales|webmaster|admin|noreply|no-reply|donotreply|example)@')
  AND NOT regexp_matches(lower(e), '(googleapis\\.com|cloudflare\\.com|sentry\\.io|example\\.com)$'))[1]"""
_SOCIAL = {
    "linkedin": """https?://(?:www\\.)?linkedin\\.com/company/[^\\s"''<>]+""",
    "facebook": """https?://(?:www\\.)?facebook\\.com/[^\\s"''<>]+""",
    "twitter": """https?://(?:www\\.)?(?:twitter\\.com|x\\.com)/[^\\s"''<>]+""",
}
_FACTS = f"""facts AS (SELECT url, bool_or(path = '' AND {_ALIVE}) AS alive,
    arg_min({_MAIL}, CASE path WHEN '/contact' THEN 1 WHEN '/about' THEN 2 ELSE 3 END) FILTER (WHERE path <> '' AND status_get = 200 AND {_MAIL} IS NOT NULL) AS found,
    {', '.join(f"max(regexp_extract(html, '{p}')) FILTER (WHERE path = '' AND status_get = 200) AS {n}" for n, p in _SOCIAL.items())}
    FROM sites GROUP BY url)"""
_JOINED = f"{_LEADS_SITES}, {_FACTS}, j AS (SELECT lead_id, website, email, CASE WHEN website <> '' THEN coalesce(alive, false) END AS website_alive, found, linkedin, facebook, twitter FROM lead LEFT JOIN facts ON rtrim(website, '/') = url)"
ORACLES["website_alive"] = f"{_JOINED} SELECT lead_id, website, website_alive FROM j"
ORACLES["contact_email"] = f"{_JOINED} SELECT lead_id, CASE WHEN website_alive AND coalesce(email, '') = '' AND found IS NOT NULL THEN found ELSE email END AS email FROM j"
ORACLES["social_links"] = f"{_JOINED} SELECT lead_id, " + ", ".join(
    f"CASE WHEN website_alive AND {n} <> '' THEN {n} END AS {n}" for n in _SOCIAL) + " FROM j"
ORACLES["enrich_stats"] = f"""{_JOINED} SELECT count(website_alive) AS websites_checked, count(*) FILTER (WHERE website_alive) AS websites_alive,
  count(*) FILTER (WHERE website_alive AND coalesce(email, '') = '' AND found IS NOT NULL) AS emails_found,
  count(*) FILTER (WHERE website_alive AND (linkedin <> '' OR facebook <> '' OR twitter <> '')) AS social_links_found FROM j"""
_V6 = """CASE page_id % 5 WHEN 1 THEN 'http://[0:0:0:0:0:0:0:1]/' WHEN 2 THEN 'http://[::0001]:80/'
        WHEN 3 THEN concat('https://[2001:db', page_id % 10, '::', page_id % 97, ']/') WHEN 4 THEN 'http://[::ffff:1.2.3.4]/' ELSE url END"""
ORACLES["safe_urls"] = """SELECT page_id, site, CASE page_id % 6 WHEN 0 THEN CASE page_id % 5 WHEN 0 THEN true WHEN 3 THEN page_id % 10 <> 8 ELSE false END
    WHEN 1 THEN NOT (a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)))
    WHEN 5 THEN NOT (a BETWEEN 16 AND 31) ELSE false END AS safe
  FROM (SELECT page_id, page_id % 256 AS a, page_id * 7 % 256 AS b, CASE page_id % 6 WHEN 0 THEN {v6}
      WHEN 1 THEN concat('http://', page_id % 256, '.', page_id * 7 % 256, '.1.', page_id % 250)
      WHEN 2 THEN concat('http://192.168.', page_id % 256, '.1/x') WHEN 3 THEN 'http://localhost:8080/'
      WHEN 4 THEN concat('ftp://', page_id, '.example.com') ELSE concat('https://172.', page_id % 256, '.0.1:443/a') END AS site FROM pages)""".replace("{v6}", _V6)

# --- pipeline counters
_CHANGED = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in TEXT_COLUMNS)
ORACLES["stage_stats_cleaner"] = f"""WITH {RAW}, {CLEANED} SELECT count(*) AS count_in, count(*) AS count_out, CAST(0 AS BIGINT) AS count_removed,
  count(*) FILTER (WHERE {_CHANGED}) AS count_modified FROM admitted a JOIN cleaned b ON a.lead_id = b.lead_id"""
_TASKS = f"tasks AS ({_v('TASKS')})"
_STATS = f"{_TASKS}, stats AS ({_v('STAGE_STATS')})"
ORACLES["task_totals"] = f"""WITH {_STATS} SELECT task_id, max(count_in) FILTER (WHERE step = 1) AS total_scraped,
  max(count_out) FILTER (WHERE stage = 'field_validator') AS total_cleaned, max(count_out) FILTER (WHERE stage = 'deduplicator') AS total_deduped FROM stats GROUP BY task_id"""
ORACLES["stage_history"] = f"""WITH {_STATS} SELECT task_id, step, stage, count_in, count_out, CAST(created_at AS VARCHAR) AS created_at FROM stats WHERE task_id = 'task-7'"""

# --- companies
COMPANIES = f"""{LEADS}, companies AS (SELECT 'c' || lpad(pipeline_id, 12, '0') AS id, company_name, phone, phone_normalized, phone_display, email,
    coalesce(email_validated, false) AS email_validated, website, city, state, category, TRY_CAST(rating AS DOUBLE) AS rating, review_count, source,
    TRY_CAST(scraped_at AS TIMESTAMP) AS scraped_at, ord % 7 = 0 AS needs_review, CASE WHEN ord % 9 = 0 THEN 'c000000000001' END AS is_duplicate_of,
    'task-' || source AS task_id, DATE '2026-01-01' + CAST(ord % 365 AS INTEGER) AS created_at, address, CAST(NULL AS VARCHAR) AS zip FROM prepared)"""
_SHOWN = "id, company_name, email, city, rating, source"
ORACLES["typed_companies"] = f"{COMPANIES} SELECT id, company_name, rating, review_count, CAST(scraped_at AS VARCHAR) AS scraped_at, email_validated, needs_review FROM companies"
ORACLES["search_companies"] = f"""{COMPANIES} SELECT {_SHOWN} FROM companies WHERE is_duplicate_of IS NULL AND source = 'yelp' AND email IS NOT NULL AND NOT needs_review
  AND (company_name ILIKE '%WIDGET%NATION_1%' OR email ILIKE '%WIDGET%NATION_1%' OR phone ILIKE '%WIDGET%NATION_1%')"""
ORACLES["company_filters"] = f"""{COMPANIES} SELECT {_SHOWN} FROM companies WHERE is_duplicate_of IS NULL AND task_id = 'task-bbb' AND state = 'ASIA' AND category = 'FURNITURE' AND phone_normalized IS NULL"""
ORACLES["company_count"] = f"{COMPANIES} SELECT count(*) AS total FROM companies WHERE is_duplicate_of IS NULL AND city = 'NATION_3'"
ORACLES["company_page"] = f"{COMPANIES} SELECT {_SHOWN} FROM companies WHERE is_duplicate_of IS NULL ORDER BY rating DESC NULLS FIRST, id LIMIT 200 OFFSET 400"
ORACLES["company_last_page"] = f"""{COMPANIES} SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (ORDER BY rating DESC NULLS FIRST, id) AS rn, count(*) OVER () AS n
  FROM companies WHERE is_duplicate_of IS NULL) WHERE rn > (n - 1) // 200 * 200"""
ORACLES["company_page_ascending"] = f"{COMPANIES} SELECT {_SHOWN} FROM companies WHERE is_duplicate_of IS NULL AND phone_normalized IS NOT NULL ORDER BY city ASC NULLS LAST, id LIMIT 100 OFFSET 100"
ORACLES["company_by_id"] = f"{COMPANIES} SELECT {_SHOWN} FROM companies WHERE id = 'c000000000012'"
ORACLES["public_view"] = f"{COMPANIES} SELECT source, state, count(*) AS n, CAST(sum(review_count) AS BIGINT) AS reviews, count(phone_display) AS with_phone FROM companies GROUP BY source, state"
_GRID = "lower(concat_ws(chr(10), company_name, phone_display, email, website, city, state, category, CAST(rating AS VARCHAR), source, CAST(needs_review AS VARCHAR)))"
ORACLES["quick_filter"] = f"{COMPANIES} SELECT {_SHOWN} FROM companies WHERE contains({_GRID}, 'red') AND contains({_GRID}, 'asia') AND contains({_GRID}, '4')"
ORACLES["grid_view"] = f"{COMPANIES} SELECT {_SHOWN} FROM companies WHERE contains(lower(company_name), 'gizmo') AND contains(lower(state), 'eur')"
ORACLES["apply_edits"] = f"""{COMPANIES}, e AS (SELECT 'c' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 12, '0') AS id, s_suppkey AS k, s_nationkey AS n FROM supplier)
  SELECT c.id, CASE WHEN k % 7 = 0 THEN NULL WHEN e.id IS NOT NULL THEN concat('City ', n) ELSE city END AS city, CASE WHEN k % 2 = 0 THEN NULL ELSE email END AS email,
    CASE WHEN k % 5 = 0 THEN true ELSE needs_review END AS needs_review, CASE WHEN e.id IS NOT NULL THEN '2026-12-01 00:00:00' END AS updated_at
  FROM companies c LEFT JOIN e ON c.id = e.id"""
ORACLES["unknown_edit_ids"] = f"""{COMPANIES} SELECT 'c' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 12, '0') AS id FROM supplier
  WHERE 'c' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 12, '0') NOT IN (SELECT id FROM companies)"""
ORACLES["company_page_after"] = ORACLES["company_page"]
ORACLES["export_rows"] = f"""{COMPANIES} SELECT company_name, phone, email, website, address, city, state, zip, category, rating, review_count, source
  FROM companies WHERE task_id = 'task-yelp' AND is_duplicate_of IS NULL"""
ORACLES["export_csv"] = ORACLES["export_json"] = ORACLES["export_rows"].replace("task-yelp", "task-bbb")
ORACLES["export_log"] = f"{COMPANIES} SELECT task_id, 'csv' AS format, count(*) AS rows_exported FROM companies WHERE task_id = 'task-yellowpages' AND is_duplicate_of IS NULL GROUP BY task_id"
ORACLES["read_raw_leads"] = f"WITH {RAW} SELECT company_name, phone, email, website, address, city, state, category, rating, review_count, source, source_url, scraped_at FROM raw_leads"
def _raw_without(*missing: str) -> str:
    head, _, shown = ORACLES["read_raw_leads"].rpartition(" SELECT ")
    for c in missing:
        shown = shown.replace(f" {c},", f" CAST(NULL AS VARCHAR) AS {c},").replace(f" {c} FROM", f" CAST(NULL AS VARCHAR) AS {c} FROM")
    return f"{head} SELECT {shown}"


ORACLES["read_raw_leads_csv"] = _raw_without("rating", "scraped_at")
ORACLES["read_raw_leads_parquet"] = _raw_without("city")
ORACLES["task_count"] = f"WITH {_TASKS} SELECT count(*) AS total FROM tasks"
ORACLES["task_by_id"] = f"WITH {_TASKS} SELECT id, source, status, total_scraped FROM tasks WHERE id = 'task-7'"
ORACLES["list_tasks"] = f"WITH {_TASKS} SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at) FROM tasks ORDER BY tasks.created_at DESC, id LIMIT 20 OFFSET 20"
ORACLES["cancel_tasks"] = f"WITH {_TASKS} SELECT id, CASE WHEN source = 'yelp' AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS status FROM tasks"
ORACLES["reset_mode"] = f"""WITH {_TASKS} SELECT (SELECT count(*) FROM tasks WHERE mode = 'demo') AS deleted_tasks, (SELECT count(*) FROM tasks WHERE mode <> 'demo') AS tasks_left,
  (SELECT count(*) FROM orders WHERE 'task-' || o_custkey NOT IN (SELECT id FROM tasks WHERE mode = 'demo')) AS companies_left"""

# --- dashboards
_PCT = "CASE WHEN total_scraped > 0 THEN CAST(floor(total_deduped / total_scraped * 100 + 0.5) AS BIGINT) ELSE 0 END"
ORACLES["dashboard_kpis"] = f"""WITH {_TASKS}, t AS (SELECT count(*) AS total_tasks, count(*) FILTER (WHERE status IN ('running', 'pending')) AS active_tasks,
    count(*) FILTER (WHERE status = 'completed') AS completed_tasks, CAST(sum(total_scraped) AS BIGINT) AS total_scraped,
    CAST(sum(total_cleaned) AS BIGINT) AS total_cleaned, CAST(sum(total_deduped) AS BIGINT) AS total_deduped FROM tasks)
  SELECT *, total_scraped - total_deduped AS duplicates_removed, {_PCT} AS yield_pct FROM t"""
ORACLES["recent_tasks"] = f"WITH {_TASKS} SELECT id, source, status, total_scraped, total_deduped, {_PCT} AS yield_pct, {_PCT} >= 50 AS good_yield FROM tasks ORDER BY created_at DESC, id LIMIT 5"
ORACLES["last_completed"] = f"WITH {_TASKS} SELECT id, source, total_deduped FROM tasks WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 1"
ORACLES["stage_funnel"] = f"""WITH {_STATS}, d AS (SELECT *, lag(count_out) OVER (PARTITION BY task_id ORDER BY step) AS prev FROM stats)
  SELECT task_id, stage, count_out, count_out - prev AS diff, CASE WHEN prev IS NULL THEN NULL WHEN prev = 0 OR prev = count_out THEN 'green'
    WHEN abs(count_out - prev) * 10 >= prev THEN 'red' ELSE 'yellow' END AS colour FROM d"""

# --- progress
_EVENTS = f"""msgs AS ({_v('PROGRESS_MESSAGES')}), ev AS (SELECT channel, event_seq, json_extract_string(value, '$.type') AS type, json_extract_string(value, '$.stage') AS stage,
  CAST(json_extract_string(value, '$.pages_processed') AS INTEGER) AS pages_processed, CAST(json_extract_string(value, '$.pages_total') AS INTEGER) AS pages_total,
  CAST(json_extract_string(value, '$.items_found') AS INTEGER) AS items_found, CAST(json_extract_string(value, '$.errors') AS INTEGER) AS errors
  FROM (SELECT * FROM msgs WHERE json_valid(value)))"""
ORACLES["progress_pct"] = f"""WITH {_EVENTS} SELECT event_seq, coalesce(pages_total, 0) = 0 AS indeterminate,
  CASE WHEN coalesce(pages_total, 0) = 0 THEN 0 ELSE CAST(floor(pages_processed / pages_total * 100 + 0.5) AS BIGINT) END AS percent FROM ev"""
ORACLES["parse_progress"] = f"WITH {_EVENTS} SELECT * FROM ev"
ORACLES["latest_progress"] = f"WITH {_EVENTS} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY channel ORDER BY event_seq DESC) = 1"
ORACLES["until_terminal"] = f"""WITH {_EVENTS} SELECT * FROM ev QUALIFY coalesce(sum(CASE WHEN type IN ('task_completed', 'task_failed') THEN 1 ELSE 0 END)
  OVER (PARTITION BY channel ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0"""
ORACLES["stage_changes"] = f"WITH {_EVENTS} SELECT * FROM ev QUALIFY lag(stage) OVER (PARTITION BY channel ORDER BY event_seq) IS DISTINCT FROM stage"
for _name in ("latest_progress", "until_terminal", "stage_changes"):
    ORACLES[f"{_name}_stream"] = ORACLES[_name]
ORACLES["clean_leads_stream"] = """SELECT c_custkey, c_name || ' & Sons LLC' AS company_name, c_mktsegment || '@mail.example.com' AS email, true AS email_validated,
  lower(c_name) || ' & sons' AS company_name_normalized FROM customer"""

# --- the whole chain: both exact passes, the fuzzy pass merged by owner, enrichment

_SITES = f"sites AS ({_v('SITE_PAGES')})"
_FIRST = {c: f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("email", "phone_normalized", "website")}
_LONGEST = "arg_max(company_name, length(company_name) * 1000000000::BIGINT - ord)"
_OWN_NAME = "arg_min(company_name, ord)"
ORACLES["process_leads"] = f"""{LEADS.replace("WITH", "WITH RECURSIVE", 1)}, {BY_PHONE}, {BY_BOTH},
n AS (SELECT ord, company_name_normalized FROM by_both WHERE company_name_normalized <> ''), {_greedy('n')},
owned AS ({_OWNED.format(names="n", tokens=_TOKENS)}), flagged AS ({_FLAGGED}),
grouped AS (SELECT b.*, coalesce(owner_ord, b.ord) AS g FROM by_both b LEFT JOIN owned o ON o.ord = b.ord),
merged AS (SELECT min(ord) AS ord, {", ".join(_FIRST.values())},
  CASE WHEN length({_LONGEST}) > length({_OWN_NAME}) THEN {_LONGEST} ELSE {_OWN_NAME} END AS company_name FROM grouped GROUP BY g),
{_SITES}, {_FACTS},
j AS (SELECT merged.*, found, CASE WHEN website <> '' THEN coalesce(alive, false) END AS website_alive,
  flagged_by IS NOT NULL AS needs_review FROM merged LEFT JOIN facts ON rtrim(website, '/') = url LEFT JOIN flagged USING (ord))
SELECT company_name, CASE WHEN website_alive AND coalesce(email, '') = '' AND found IS NOT NULL THEN found ELSE email END AS email,
  phone_normalized, website, website_alive, needs_review FROM j"""

_BY_NAME = f"""{LEADS.replace("WITH", "WITH RECURSIVE", 1)}, {BY_PHONE}, {BY_BOTH},
n AS (SELECT ord, company_name_normalized FROM by_both WHERE company_name_normalized <> ''), {_greedy('n')},
owned AS ({_OWNED.format(names="n", tokens=_TOKENS)}), flagged AS ({_FLAGGED})"""
ORACLES["chain_duplicate_map"] = f"""{_BY_NAME},
phone AS (SELECT a.ord AS x, b.ord AS y FROM by_phone_r a JOIN by_phone_r b ON a.g = b.g AND b.rn = 1 WHERE a.rn > 1),
mail AS (SELECT a.ord AS x, b.ord AS y FROM by_both_r a JOIN by_both_r b ON a.g = b.g AND b.rn = 1 WHERE a.rn > 1),
gone AS (SELECT x, y FROM phone UNION ALL SELECT x, y FROM mail UNION ALL SELECT ord, owner_ord FROM owned),
trail AS (SELECT x, y FROM gone UNION ALL SELECT trail.x, gone.y FROM trail JOIN gone ON trail.y = gone.x)
SELECT CAST(x AS VARCHAR) AS removed_id, CAST(y AS VARCHAR) AS survivor_id FROM trail WHERE y NOT IN (SELECT x FROM gone)"""
ORACLES["saved_run"] = f"""{_BY_NAME},
left_over AS (SELECT ord FROM by_both WHERE ord NOT IN (SELECT ord FROM owned)),
c AS (SELECT count(*) AS n, count(flagged_by) AS f FROM left_over LEFT JOIN flagged USING (ord))
SELECT 'task-1' AS task_id, (SELECT count(*) FROM admitted) AS total_scraped, (SELECT count(*) FROM admitted) AS total_cleaned, n AS total_deduped,
  n AS companies, n AS ids, f AS for_review FROM c"""

# --- the chain's own stage table

_CHAIN = f"""{LEADS}, {_SITES}, s AS (
  SELECT 1 AS step, 'html_cleaner' AS stage UNION ALL SELECT 2, 'field_validator' UNION ALL SELECT 3, 'enricher'),
n AS (SELECT count(*) AS n FROM admitted)"""
ORACLES["chain_stage_table"] = f"""{_CHAIN}, {_FACTS},
j AS (SELECT p.*, found, CASE WHEN website <> '' THEN coalesce(alive, false) END AS website_alive FROM prepared p LEFT JOIN facts ON rtrim(website, '/') = url),
v AS (SELECT count(*) FILTER (WHERE c.email <> '' AND p.email IS NOT NULL) AS good, count(*) FILTER (WHERE c.email <> '' AND p.email IS NULL) AS bad,
  count(*) FILTER (WHERE c.phone <> '' AND phone_normalized IS NOT NULL) AS phones FROM cleaned c JOIN prepared p ON p.ord = c.lead_id),
e AS (SELECT count(*) FILTER (WHERE website_alive) AS alive, count(*) FILTER (WHERE website_alive AND coalesce(email, '') = '' AND found IS NOT NULL) AS mails FROM j)
SELECT 'task-1' AS task_id, CAST(step AS INTEGER) AS step, stage, n AS count_in, n AS count_out, CAST(0 AS BIGINT) AS count_removed, true AS timed,
  CAST(NULL AS VARCHAR) AS error, CASE step WHEN 2 THEN good END AS emails_validated, CASE step WHEN 2 THEN bad END AS emails_invalid,
  CASE step WHEN 2 THEN phones END AS phones_normalized, CASE step WHEN 3 THEN alive END AS websites_alive, CASE step WHEN 3 THEN mails END AS emails_found
FROM s, n, v, e"""
ORACLES["chain_totals"] = f"{_CHAIN} SELECT 'task-1' AS task_id, n AS total_scraped, n AS total_cleaned, n AS total_deduped FROM n"
ORACLES["chain_history"] = f"{_CHAIN} SELECT CAST(step AS INTEGER) AS step, stage, n AS count_out FROM s, n"
ORACLES["chain_funnel"] = f"""{_CHAIN} SELECT stage, n AS count_out, CASE WHEN step > 1 THEN CAST(0 AS BIGINT) END AS diff,
  CASE WHEN step > 1 THEN 'green' END AS colour FROM s, n"""
ORACLES["chain_failure"] = f"""{_CHAIN} SELECT CAST(3 AS INTEGER) AS step, 'halver' AS stage, n AS count_in, n AS count_out,
  CAST(0 AS BIGINT) AS count_removed, CAST(0 AS BIGINT) AS count_modified, 'no counters today' AS error, n AS rows_left FROM n"""

# --- pages and crawls


def _slug(col: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({col}), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


ORACLES["slug"] = f"SELECT page_id, {_slug('url')} AS slug FROM pages"
_REQ = f"req AS ({_v('PAGE_REQUESTS')})"
_Q, _L = (f"replace(url_encode({c}), '%20', '+')" for c in ("query", "location"))
_CASES = []
for _c in BUILT_IN:
    if _c["renderer"] != "static":
        continue
    _p = _c["pagination"]
    _n = f"CAST({_p['start']} + page * {_p.get('step', 1)} AS VARCHAR)"
    if _c.get("url_template"):
        _parts = f"'{_c['base_url']}/' || {_Q} || '?page=' || {_n}"
    else:
        _keys = list(_c["search_params"])
        _parts = f"'{_c['base_url']}?{_keys[0]}=' || {_Q} || '&{_keys[1]}=' || {_L} || '&{_p['param']}=' || {_n}"
    _CASES.append(f"SELECT source, query, location, CAST(page AS INTEGER) AS page, {_parts} AS url FROM (SELECT *, unnest(range({_p['max_pages']})) AS page FROM r WHERE source = '{_c['name']}')")
ORACLES["frontier"] = f"WITH {_REQ}, r AS (SELECT DISTINCT source, query, location FROM req) " + " UNION ALL ".join(_CASES)
_KEYED = f"{_REQ}, keyed AS (SELECT *, {_slug('query')} AS slug_query, {_slug('location')} AS slug_location FROM req)"
ORACLES["page_lookup"] = f"WITH {_KEYED} SELECT source, query, location, page, CASE WHEN page < 2 THEN '<p>' || query || '</p>' END AS html FROM keyed"
ORACLES["page_exists"] = f"WITH {_KEYED} SELECT source, query, location, page FROM keyed WHERE page < 2"
ORACLES["page_upsert"] = f"WITH {_KEYED} SELECT source, slug_query, slug_location, page, CASE WHEN page > 0 THEN '<b>' || slug_query || '</b>' ELSE '<p>' || query || '</p>' END AS html FROM keyed"
ORACLES["page_purge"] = f"WITH {_REQ} SELECT count(*) FILTER (WHERE source = 'yelp') AS purged, count(*) FILTER (WHERE source <> 'yelp') AS kept FROM req"


def _plain(col: str) -> str:
    return f"trim(replace(replace(replace(replace({col}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'))"


ORACLES["listings"] = f"""SELECT page_id, CAST(0 AS INTEGER) AS idx, {_plain("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)")} AS company_name,
  {_plain("regexp_extract(html, '<nav><ul><li><a href=\"[^\"]*\">([^<]*)</a>', 1)")} AS category, regexp_extract(html, '<nav><ul><li><a href="([^"]*)">', 1) AS website,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS state, {_plain("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS address, url AS source_url FROM pages"""
_LD = f"""pg AS ({_v('JSON_LD_PAGES')}), txt AS (SELECT page_id, regexp_extract(html, 'ld\\+json">(.*?)</script>', 1) AS t FROM pg),
  objs AS (SELECT page_id, CASE WHEN t[1] = '[' THEN from_json(t, '["JSON"]') ELSE [CAST(t AS JSON)] END AS o FROM (SELECT * FROM txt WHERE json_valid(t))),
  ld AS (SELECT page_id, CAST(k - 1 AS INTEGER) AS idx, json_extract_string(o[k], '$.name') AS company_name, json_extract_string(o[k], '$.telephone') AS phone,
    json_extract_string(o[k], '$.address.streetAddress') AS address, json_extract_string(o[k], '$.aggregateRating.ratingValue') AS rating
    FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM objs))"""
ORACLES["json_ld"] = f"WITH {_LD} SELECT * FROM ld"
ORACLES["merge_by_position"] = f"""WITH {_LD}, cards AS (SELECT page_id, CAST(0 AS INTEGER) AS idx, 'Card A' || page_id AS company_name, '555-0001' AS phone FROM pg
    UNION ALL SELECT page_id, 1, 'Card B' || page_id, '555-0002' FROM pg)
  SELECT c.page_id, c.idx, coalesce(nullif(ld.company_name, ''), c.company_name) AS company_name, coalesce(nullif(ld.phone, ''), c.phone) AS phone, ld.address, ld.rating
  FROM cards c LEFT JOIN ld ON c.page_id = ld.page_id AND c.idx = ld.idx"""
ORACLES["app_state"] = """SELECT CAST(s_suppkey AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS idx, s_name || ' &amp; Co' AS company_name, 'https://s' || s_suppkey || '.example.org' AS website,
    'Tech, B' || s_nationkey AS category, '' AS address FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT s_suppkey, 1, s_name || ' Two', 'https://two.example.org', NULL, 'Town ' || s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0"""
ORACLES["extract_pages"] = f"""WITH {_LD}, apps AS ({ORACLES['app_state']}), cards AS (SELECT page_id, url, 0 AS idx, 'Card A' || page_id AS company_name, '555-0001' AS phone FROM pg
    UNION ALL SELECT page_id, url, 1, 'Card B' || page_id, '555-0002' FROM pg)
  SELECT 'yelp' AS source, c.page_id, CAST(c.idx AS INTEGER) AS idx, coalesce(nullif(ld.company_name, ''), c.company_name) AS company_name, coalesce(nullif(ld.phone, ''), c.phone) AS phone,
    CAST(NULL AS VARCHAR) AS website, c.url AS source_url FROM cards c LEFT JOIN ld ON c.page_id = ld.page_id AND c.idx = ld.idx
  UNION ALL SELECT 'crunchbase', page_id, idx, company_name, NULL, website, 'https://discover.example.org/' || page_id FROM apps
  UNION ALL SELECT 'crunchbase', s_suppkey, 0, 'Grid ' || s_name, NULL, '/o/' || s_suppkey, 'https://discover.example.org/' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0"""
ORACLES["pages_to_companies"] = f"""WITH RECURSIVE x AS ({ORACLES["extract_pages"]}),
  page AS (SELECT kind AS source, kind || '-' || s_nationkey AS crawl, CAST(s_suppkey AS BIGINT) AS page_id, s_suppkey % 9 <> 4 AS fetched
    FROM supplier, (SELECT unnest(['yelp', 'crunchbase']) AS kind)),
  item AS (SELECT source, crawl, page_id, company_name, source_url, row_number() OVER (PARTITION BY source, page_id ORDER BY idx) - 1 AS k
    FROM x JOIN page USING (source, page_id) WHERE fetched AND page_id % 17 <> 16 AND company_name <> ''),
  cp AS (SELECT page.source, page.crawl, page.page_id, fetched, count(k) AS n FROM page LEFT JOIN item USING (source, page_id) GROUP BY ALL),
  seen AS (SELECT *, coalesce(sum(n) OVER w, 0) AS items_before, coalesce(sum(CASE WHEN fetched AND n = 0 THEN 1 ELSE 0 END) OVER w, 0) AS stops FROM cp
    WINDOW w AS (PARTITION BY crawl ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  visited AS (SELECT * FROM seen WHERE stops = 0 AND items_before < 12),
  taken AS (SELECT i.source, page_id * 10 + k * 2 + CASE WHEN i.source = 'yelp' THEN 1 ELSE 0 END AS ord, {_clean('company_name')} AS company_name
    FROM item i JOIN visited USING (source, page_id) WHERE items_before + k < 12),
  n AS (SELECT ord, source, {NAME} AS company_name_normalized FROM taken), {_greedy('n')},
  owned AS ({_OWNED.format(names="n", tokens=_TOKENS)}), flagged AS ({_FLAGGED}),
  s AS (SELECT source, count(*) AS companies, count(flagged_by) AS for_review FROM n LEFT JOIN flagged USING (ord) WHERE ord NOT IN (SELECT ord FROM owned) GROUP BY source),
  c AS (SELECT crawl, source, count(*) FILTER (WHERE fetched) AS done, count(*) FILTER (WHERE NOT fetched) AS skipped, least(sum(n), 12) AS items FROM visited GROUP BY ALL)
  SELECT source, count(*) AS crawls, CAST(sum(done) AS BIGINT) AS pages_scraped, CAST(sum(skipped) AS BIGINT) AS pages_skipped, CAST(sum(items) AS BIGINT) AS items,
    max(companies) AS companies, max(for_review) AS for_review FROM c LEFT JOIN s USING (source) GROUP BY source"""
_CRAWL = f"""cp AS ({_v('CRAWL_PAGES')}), seen AS (SELECT *, CAST(coalesce(sum(n_items) OVER (PARTITION BY crawl ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS items_before,
    coalesce(sum(CASE WHEN fetched AND n_items = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY crawl ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM cp),
  visited AS (SELECT crawl, page, fetched, n_items, items_before FROM seen WHERE stops = 0 AND items_before < 60)"""
ORACLES["stop_rule"] = f"WITH {_CRAWL} SELECT * FROM visited"
ORACLES["crawl_items"] = f"WITH {_CRAWL} SELECT crawl, page, idx FROM (SELECT *, unnest(range(n_items)) AS idx FROM visited WHERE fetched) WHERE items_before + idx < 60"
ORACLES["crawl_summary"] = f"""WITH {_CRAWL} SELECT crawl, count(*) FILTER (WHERE fetched) AS pages_scraped, count(*) FILTER (WHERE NOT fetched) AS pages_skipped,
  CAST(least(sum(n_items), 60) AS BIGINT) AS items FROM visited GROUP BY crawl"""
ORACLES["sample_listings"] = f"""WITH {_LD}, cards AS (SELECT source, page_id, unnest([0, 1]) AS idx FROM pg)
  SELECT source, CAST(rank AS INTEGER) AS rank, page_id, CAST(idx AS INTEGER) AS idx FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id, idx) AS rank FROM cards) WHERE rank <= 3"""
_MARKS = {
    ("(listing)", "html"): "<html lang=",
    ("company_name", "article > h1::text"): "<article><h1>[^<]",
    ("category", "nav li a::text"): '<li><a href="[^"]*">[^<]',
    ("website", "nav li a::attr(href)"): '<li><a href="',
    ("state", "html::attr(lang)"): "<html lang=",
    ("address", "div.ad::text"): '<div class="ad">[^<]',
}
ORACLES["selector_coverage"] = " UNION ALL ".join(
    f"""SELECT 'web' AS source, '{field}' AS field, '{css}' AS selector, count(*) AS pages,
  CAST(sum(len(regexp_extract_all(html, '{mark}'))) AS BIGINT) AS matches, sum(len(regexp_extract_all(html, '{mark}'))) = 0 AS missing FROM pages"""
    for (field, css), mark in _MARKS.items())
