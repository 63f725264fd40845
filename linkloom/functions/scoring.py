"""Numbers, vectors and enumerations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SEVERITY_WEIGHT = {"critical": 3, "warning": 2, "info": 1}
EXPORT_WEIGHT = {"critical": 0, "warning": 1, "info": 2}
CRITICAL_FROM = 0.85
WARNING_FROM = 0.6
DUAL_MATCH_BONUS = 0.15
STORED_DIMENSIONS = 1536
TOKENS_PER_ARTICLE = 300
USD_PER_TOKEN = 0.00002 / 1000
MAX_RETRIES = 2
BACKOFF_SECONDS = 30
STALE_MINUTES = 10
STUCK_MINUTES = 15
TRANSIENT_STATUSES = (429, 502, 503, 504)
TRANSIENT_ERRORS = (
    "AbortError",
    "ECONNRESET",
    "ECONNREFUSED",
    "ETIMEDOUT",
    "fetch failed",
    "network",
)
# ----------------------------------------------------------------------------


def severity_of(confidence: Column) -> Column:
    return (
        F.when(confidence >= CRITICAL_FROM, "critical")
        .when(confidence >= WARNING_FROM, "warning")
        .otherwise("info")
    )


def severity_weight(severity: Column) -> Column:
    """3, 2, 1 for the known severities, 0 for anything else."""
    return (
        F.when(severity == "critical", 3)
        .when(severity == "warning", 2)
        .when(severity == "info", 1)
        .otherwise(0)
    )


def export_weight(severity: Column) -> Column:
    """Ascending report order; an unknown severity sorts with info."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 - cosine distance; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def zero_pad(v: Column, dims: int = STORED_DIMENSIONS) -> Column:
    """Right-pad with zeros; a longer vector is left alone."""
    missing = F.greatest(F.lit(dims) - F.size(v), F.lit(0))
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), missing))


def embedding_cost(needs: Column) -> Column:
    """Estimated USD, to four decimals."""
    return F.round(needs * F.lit(TOKENS_PER_ARTICLE) * F.lit(USD_PER_TOKEN) * 10000) / 10000


def backoff(now: Column, retry: Column) -> Column:
    """``now`` plus thirty seconds for each retry so far."""
    return now + F.make_dt_interval(secs=(retry * BACKOFF_SECONDS).cast("decimal(18,6)"))


def http_failure_class(status: Column, error: Column | None = None) -> Column:
    """transient or permanent, from the HTTP status or the network error."""
    network = F.lit(False)
    if error is not None:
        for text in TRANSIENT_ERRORS:
            network = network | F.coalesce(F.contains(error, F.lit(text)), F.lit(False))
    return F.when(status.isin(*TRANSIENT_STATUSES) | network, "transient").otherwise("permanent")


def is_private_ip(ip: Column) -> Column:
    """True for private, loopback, link-local and 0/8 addresses and for non-IPv4."""
    parts = F.split(ip, r"\.")
    octets = F.transform(
        parts, lambda p: F.when(F.trim(p) == "", F.lit(0.0)).otherwise(F.trim(p).try_cast("double"))
    )
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    malformed = (F.size(parts) != 4) | F.exists(octets, lambda o: o.isNull() | F.isnan(o))
    inside = (
        a.isin(0.0, 10.0, 127.0)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
    )
    return F.coalesce(F.when(malformed, F.lit(True)).otherwise(inside), F.lit(True))
