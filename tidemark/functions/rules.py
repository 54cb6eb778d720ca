"""Row rules for controller registries and upload schedules: a message, or null when valid."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.names import is_blank
from tidemark.functions.values import number_text

# Accepted policies and providers, schedule modes, messages.
SECURITY_POLICIES = ["None", "Basic256Sha256", "Basic128Rsa15", "Aes128_Sha256_RsaOaep", "Aes256_Sha256_RsaPss"]
PROVIDERS = ["None", "GoogleDrive"]
INTERVAL, DAILY, WEEKLY, MONTHLY = "Interval", "Daily", "Weekly", "Monthly"
NAME_REQUIRED = "Name is required."
ENDPOINT_REQUIRED = "Endpoint URL is required."
ENDPOINT_INVALID = "Endpoint must be a valid opc.tcp:// URL (got '%s')."
POLICY_UNKNOWN = "Unknown security policy '%s'."
PARTITION_TOO_SMALL = "Partition size must be at least 1 hour."
PARTITION_TOO_LARGE = "Partition size (%s h) must be ≤ the upload period (%s h)."
INTERVAL_TOO_SMALL = "Interval must be at least 1 minute."
DAY_OF_WEEK_RANGE = "Day of week must be 0 (Sunday) to 6 (Saturday)."
DAY_OF_MONTH_RANGE = "Day of month must be 1 to 28."
SITE_NAME_EMPTY = "Site name is empty: export files will carry the default name."
NO_PLCS = "No PLCs are configured — nothing will be logged until one is added."
PLC_ERROR = "PLC '%s': %s"
DUPLICATE_NAME = "Duplicate PLC name '%s' — names must be unique."
PROVIDER_UNKNOWN = "Unknown upload provider '%s' (expected None or GoogleDrive)."
CREDENTIALS_REQUIRED = "Upload.GoogleDrive.CredentialsPath is required when the provider is GoogleDrive."
ENDPOINT_PATTERN = r"(?i)^opc\.tcp://([^\s/?#@]*@)?(\[[0-9a-f:.]+\]|[^\s/?#:@\[\]]+)(:\d{1,5})?([/?#]\S*)?$"
PORT_PATTERN = r"(?i)^opc\.tcp://(?:[^\s/?#@]*@)?(?:\[[^\]]*\]|[^\s/?#:]*):(\d{1,5})"
HIGHEST_PORT = 65535


def _any_of(column: Column, accepted: list[str]) -> Column:
    return F.lower(column).isin([name.lower() for name in accepted])


def plc_error(name: Column, endpoint: Column, policy: Column) -> Column:
    """The first rule a controller entry breaks."""
    port = F.coalesce(F.regexp_extract(endpoint, PORT_PATTERN, 1).try_cast("int"), F.lit(0))
    return (
        F.when(is_blank(name), F.lit(NAME_REQUIRED))
        .when(is_blank(endpoint), F.lit(ENDPOINT_REQUIRED))
        .when(~endpoint.rlike(ENDPOINT_PATTERN) | (port > HIGHEST_PORT), F.format_string(ENDPOINT_INVALID, endpoint))
        .when(
            ~F.coalesce(_any_of(policy, SECURITY_POLICIES), F.lit(False)),
            F.format_string(POLICY_UNKNOWN, F.coalesce(policy, F.lit(""))),
        )
    )


def upload_period_hours(mode: Column, interval_minutes: Column) -> Column:
    return (
        F.when(mode == INTERVAL, F.greatest(interval_minutes, F.lit(1)) / F.lit(60.0))
        .when(mode == WEEKLY, F.lit(168.0))
        .when(mode == MONTHLY, F.lit(672.0))
        .otherwise(F.lit(24.0))
    )


def schedule_error(
    mode: Column, interval_minutes: Column, day_of_week: Column, day_of_month: Column, partition_hours: Column
) -> Column:
    """The first rule a schedule breaks."""
    period = upload_period_hours(mode, interval_minutes)
    return (
        F.when(partition_hours < 1, F.lit(PARTITION_TOO_SMALL))
        .when(
            partition_hours > period,
            F.format_string(PARTITION_TOO_LARGE, partition_hours.cast("string"), number_text(F.round(period, 1))),
        )
        .when((mode == INTERVAL) & (interval_minutes < 1), F.lit(INTERVAL_TOO_SMALL))
        .when((mode == WEEKLY) & ~day_of_week.between(0, 6), F.lit(DAY_OF_WEEK_RANGE))
        .when((mode == MONTHLY) & ~day_of_month.between(1, 28), F.lit(DAY_OF_MONTH_RANGE))
    )


def provider_error(provider: Column, credentials_path: Column) -> Column:
    drive = F.lower(provider) == "googledrive"
    return F.when(
        ~F.coalesce(_any_of(provider, PROVIDERS), F.lit(False)),
        F.format_string(PROVIDER_UNKNOWN, F.coalesce(provider, F.lit(""))),
    ).when(drive & is_blank(credentials_path), F.lit(CREDENTIALS_REQUIRED))
