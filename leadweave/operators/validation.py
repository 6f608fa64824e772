"""Stage ``field_validator``: per-row column work, plus joins with small reference tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.contact import (
    area_code,
    e164,
    email_domain,
    international_digits,
    normalized_email,
    phone_display,
    phone_start,
)
from leadweave.functions.names import normalize_company_name, standardize_address
from leadweave.functions.urls import clean_website
from leadweave.session import salted_join


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def validate_email(df: DataFrame) -> DataFrame:
    """``email`` normalised or NULL, ``email_validated`` NULL where no address was given."""
    checked = df.withColumn("_good", normalized_email(F.col("email")))
    return checked.withColumns({
        "email": F.when(_given("email"), F.col("_good")).otherwise(F.col("email")),
        "email_validated": F.when(_given("email"), F.col("_good").isNotNull()),
    }).drop("_good")


def check_domain(df: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """Treat addresses whose domain is not in ``mail_domains(domain)`` as invalid."""
    known = mail_domains.select(F.lower("domain").alias("_domain")).distinct() \
        .withColumn("_takes_mail", F.lit(True))
    joined = salted_join(df.withColumn("_domain", email_domain(F.col("email"))), known, "_domain")
    failed = _given("email") & F.col("_takes_mail").isNull()
    return joined.withColumns({
        "email_validated": F.when(failed, F.lit(False)).otherwise(F.col("email_validated")),
        "email": F.when(~failed, F.col("email")),
    }).select(df.columns)


def apply_mailbox_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Addresses not accepted in ``verdicts(email, accepted)`` keep the address but lose the
    flag; an address without a verdict counts as rejected."""
    accepted = verdicts.filter("accepted").select("email").distinct() \
        .withColumn("_accepted", F.lit(True))
    rejected = F.col("email_validated") & F.col("_accepted").isNull()
    return salted_join(df, accepted, "email").withColumn(
        "email_validated", F.when(rejected, F.lit(False)).otherwise(F.col("email_validated"))
    ).select(df.columns)


def normalize_phone(df: DataFrame, area_codes: DataFrame | None = None) -> DataFrame:
    """Add ``phone_normalized`` and ``phone_display``; the raw phone stays.

    ``area_codes(area_code)`` narrows North American numbers to the codes in service. Only
    texts that can be such a code are kept, at most 800, so that side is always small.
    """
    out = (
        df.withColumn("_start", F.when(_given("phone"), phone_start(F.col("phone"))))
        .withColumn("_digits", international_digits(F.col("_start")))
        .withColumn("phone_normalized", e164(F.col("_start"), F.col("_digits")))
        .drop("_start", "_digits")
    )
    if area_codes is not None:
        in_service = area_codes.filter(F.col("area_code").rlike("^[2-9][0-9]{2}$")) \
            .select(F.col("area_code").alias("_area")).distinct() \
            .withColumn("_in_service", F.lit(True))
        out = out.withColumn("_area", area_code(F.col("phone_normalized"))) \
            .join(F.broadcast(in_service), "_area", "left") \
            .withColumn("phone_normalized", F.when(
                F.col("_area").isNull() | F.col("_in_service"), F.col("phone_normalized"))) \
            .select(*df.columns, "phone_normalized")
    return out.withColumn("phone_display", phone_display(F.col("phone_normalized")))


def normalize_name(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "company_name_normalized", normalize_company_name(F.col("company_name"))
    )


def add_standard_address(df: DataFrame) -> DataFrame:
    return df.withColumn("address_normalized", standardize_address(F.col("address")))


def validate_fields(
    df: DataFrame,
    area_codes: DataFrame | None = None,
    mail_domains: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """All field rules. Without reference tables this is one projection: no shuffle."""
    out = validate_email(df)
    if mail_domains is not None:
        out = check_domain(out, mail_domains)
    if verdicts is not None:
        out = apply_mailbox_verdicts(out, verdicts)
    return (
        out.transform(normalize_phone, area_codes)
        .transform(clean_website)
        .transform(normalize_name)
        .transform(add_standard_address)
    )


def validator_counters(before: str = "_before") -> list[Column]:
    """Counters over validated rows that carry their input row in the struct ``before``."""
    def given(name):
        return F.coalesce(F.col(f"{before}.{name}") != "", F.lit(False))

    def count(condition, name):
        return F.count_if(condition).cast("bigint").alias(name)

    return [
        count(given("email") & F.col("email").isNotNull(), "emails_validated"),
        count(given("email") & F.col("email").isNull(), "emails_invalid"),
        count(F.col("email").isNotNull() & ~F.col("email_validated"), "emails_smtp_failed"),
        count(given("phone") & F.col("phone_normalized").isNotNull(), "phones_normalized"),
        count(given("phone") & F.col("phone_normalized").isNull(), "phones_invalid"),
        count(given("website") & F.col("website").isNotNull(), "urls_cleaned"),
        count(given("website") & F.col("website").isNull(), "urls_invalid"),
    ]


def validator_stats(before: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row of validator counters for the rows of ``before``, in a single pass."""
    snapshot = before.withColumn("_before", F.struct("email", "phone", "website"))
    return validate_fields(snapshot, **tables).agg(*validator_counters())
