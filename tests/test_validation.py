from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadweave.functions import names, urls
from leadweave.operators import validation


def emails(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, email string")
    return [(r.email, r.email_validated) for r in validation.validate_email(df).orderBy("n").collect()]


def test_email(spark):
    good = ["user@example.com", "User@Example.COM", "a.b+c@x-y.co.uk", "用户@例子.中国"]
    bad = ["userexample.com", "user@.com", "a@b", "a..b@x.com", ".a@x.com", "a@x.com.", "a b@x.com", "a@@x.com",
           "a@-x.com", "a@x.123", "a@host.localhost", "a@ab--c.com", "x" * 65 + "@x.com", "a@" + "x" * 64 + ".com"]
    assert emails(spark, good) == [("user@example.com", True), ("User@example.com", True),
                                   ("a.b+c@x-y.co.uk", True), ("用户@例子.中国", True)]
    assert emails(spark, bad) == [(None, False)] * len(bad)
    assert emails(spark, [None, ""]) == [(None, None), ("", None)]


def phones(spark, values, codes=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, phone string")
    if codes:
        codes = spark.createDataFrame([(c,) for c in codes], "area_code string")
    return [(r.phone_normalized, r.phone_display) for r in validation.normalize_phone(df, codes).orderBy("n").collect()]


def test_phone(spark):
    same = ["(212) 555-1234", "212-555-1234", "+12125551234", "2125551234", "1 212 555 1234",
            "212.555.1234 ext. 9", "212-555-1234 x55", "tel:+1-212-555-1234"]
    assert phones(spark, same) == [("+12125551234", "+1 212-555-1234")] * len(same)
    bad = ["12345", "5551234567", "211-555-1234", "212-155-1234", "abc", "442079460958", "1-212-555"]
    assert phones(spark, bad) == [(None, None)] * len(bad)
    assert phones(spark, ["1-800-FLOWERS", "+44 20 7946 0958", "011 44 20 7946 0958", "+353 1 679 1234"]) == [
        ("+18003569377", "+1 800-356-9377"), ("+442079460958", "+44 2079460958"),
        ("+442079460958", "+44 2079460958"), ("+35316791234", "+353 16791234")]
    assert phones(spark, [None, ""]) == [(None, None)] * 2
    assert phones(spark, ["2125551234", "3125551234"], ["312"]) == [(None, None), ("+13125551234", "+1 312-555-1234")]


def sites(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, website string")
    return [r.website for r in urls.clean_website(df).orderBy("n").collect()]


TRACKING = set(urls.TRACKING_PARAMS)


def site_model(url):
    if not url:
        return url
    if not url.startswith(("http://", "https://")):
        url = "https://" + url
    p = urlparse(url)
    if not p.netloc:
        return None
    kept = {k: v for k, v in parse_qs(p.query).items() if k.lower() not in TRACKING}
    path = p.path if p.path == "/" else p.path.rstrip("/")
    return urlunparse((p.scheme, p.netloc.lower(), path, p.params, urlencode(kept, doseq=True), ""))


def test_website(spark):
    values = ["example.com", "https://example.com/page?utm_source=google&id=123", "https://EXAMPLE.COM/Path",
              "https://example.com/path/", "https://example.com/", "not-a-url", "HTTP://x", "http://", None, "",
              "http://x.com/?a=1&b=2&a=3", "http://x.com?a=&b&c=%7e*+%zz", "http://x.com/a//;p=1?UTM_Medium=1#f",
              "http://x.com/;p", "http://u@Host:80/é ü/?q=é ü"]
    assert sites(spark, values) == [site_model(v) for v in values]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/?#&=;:.%2+AZ~*é", max_size=18), min_size=20, max_size=60))
def test_website_equals_model(spark, tails):
    values = ["http://h.com" + t for t in tails]
    assert sites(spark, values) == [site_model(v) for v in values]


def test_names(column):
    cases = {"Acme Corp.": "acme", "Smith & Johnson LLC": "smith & johnson", "acme, inc.": "acme,", "A Co Ltd": "a co",
             "Incorporated": "", "Cobalt": "cobalt", "L.L.C. x": "l.l.c. x", "Acme LLP ,": "acme", "  Big Limited  ": "big"}
    assert column(names.normalize_company_name, list(cases)) == list(cases.values())
    assert column(names.normalize_company_name, [None, ""]) == [None, None]


def test_address(column):
    cases = {"123 Main St": "123 Main Street", "1 st ave, STE 4": "1 Street Avenue, Suite 4", "St. Louis": "Street. Louis",
             "éSt x": "éSt x", "Stone Rd Apt 2": "Stone Road Apartment 2"}
    assert column(names.standardize_address, list(cases)) == list(cases.values())


def test_block_key(column):
    cases = {"the acme": "a", "an  owl": "o", "a": "a", "theory": "t", "The X": "X", "": None, "1st": "1"}
    assert column(names.block_key, list(cases)) == list(cases.values())


def test_domain_and_mailbox_tables(spark):
    lead = spark.createDataFrame([("a@x.com", True), ("b@y.com", True), (None, False)], "email string, email_validated boolean")
    mx = spark.createDataFrame([("X.com",)], "domain string")
    assert {tuple(r) for r in validation.check_domain(lead, mx).collect()} == {("a@x.com", True), (None, False)}
    verdicts = spark.createDataFrame([("a@x.com", True), ("b@y.com", False)], "email string, accepted boolean")
    got = {tuple(r) for r in validation.apply_mailbox_verdicts(lead, verdicts).collect()}
    assert got == {("a@x.com", True), ("b@y.com", False), (None, False)}


def test_counters(spark):
    df = spark.createDataFrame([("A", "bad", "12345", "https://ok.com", None)],
                               "company_name string, email string, phone string, website string, address string")
    row = validation.validator_stats(df).first().asDict()
    assert row == {"emails_validated": 0, "emails_invalid": 1, "emails_smtp_failed": 0, "phones_normalized": 0,
                   "phones_invalid": 1, "urls_cleaned": 1, "urls_invalid": 0}


def test_validation_without_tables_has_no_shuffle(spark):
    df = spark.createDataFrame([("A", "bad", "12345", "x.com", "1 St")],
                               "company_name string, email string, phone string, website string, address string")
    plan = validation.validate_fields(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_safe_url(column):
    cases = {"http://192.168.1.1/page": False, "http://localhost/page": False, "ftp://example.com": False,
             "https://example.com": True, "http://8.8.8.8": True, "http://10.0.0.1:80": False, "http://172.32.0.1": True,
             "http://[::1]/": False, "http://[2606:4700::1111]/": True, "http://u@127.0.0.1/": False,
             "http://010.0.0.1/": True, "HTTPS://x": True, "http://100.64.1.1": False, "http://192.0.0.9": True,
             "http://[fe80::1]": False, "http://224.0.0.1": True, "http://255.255.255.255": False}
    assert column(urls.is_safe_url, list(cases)) == list(cases.values())
