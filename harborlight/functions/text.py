"""Text normalisation, validation and the shapes of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CVE_PATTERN = r"^CVE-\d+-\d+$"
MAX_VALUE_CHARS = 200

# Fixed patterns: what credentials and personal data look like, by name.
SECRET_SHAPES = {
    "private-key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "certificate-body": r"-----BEGIN CERTIFICATE-----",
    "credential-assignment": r"(?i)\b(?:password|passwd|pwd|secret|api[_\-]?key|apikey|access[_\-]?token|auth[_\-]?token|bearer|client[_\-]?secret|private[_\-]?key|session[_\-]?id)\b\s*[:=]",
    "bearer-token": r"(?i)\b(?:authorization\s*[:=]|bearer\s+)\S{6,}",
    "aws-access-key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "slack-token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "basic-auth-url": r"\b[a-z][a-z0-9+.\-]{1,20}://[^/\s:@]{1,64}:[^/\s@]{1,64}@",
    "email-address": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
}


def secret_shapes(text: Column) -> Column:
    """Names of the shapes found, in the order of :data:`SECRET_SHAPES`."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_SHAPES.items()]), lambda x: x.isNotNull())


def looks_secret(text: Column) -> Column:
    """Whether any shape is found: one pass over the text. Each shape keeps its own case rule."""
    parts = [f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in SECRET_SHAPES.values()]
    return F.coalesce(text.rlike("|".join(parts)), F.lit(False))


def printable(text: Column) -> Column:
    """Without control, format, surrogate, private and unassigned characters, and without separators other than the space."""
    return F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}&&[^ ]]|[\p{Zs}&&[^ ]]", "")


def bounded_scalar(text: Column, limit: int = MAX_VALUE_CHARS) -> Column:
    """A short printable value; null where it is empty or too long."""
    t = F.btrim(printable(text))
    return F.when((F.length(t) > 0) & (F.length(t) <= limit), t)


def passive_mac(raw: Column) -> Column:
    """Lower-case colon form of an address written with ``:``, ``-`` or ``.``; single digits are padded. Null if it is none."""
    parts = F.split(F.translate(F.lower(F.btrim(raw)), "-.", "::"), ":")
    joined = F.array_join(F.transform(parts, lambda p: F.lpad(p, 2, "0")), ":")
    fits = (F.size(parts) == 6) & F.forall(parts, lambda p: p.rlike("^[0-9a-f]{1,2}$"))
    return F.when(fits, joined)


def ipv4(raw: Column) -> Column:
    """A dotted quad without leading zeros, each part at most 255; null otherwise."""
    t = F.btrim(raw)
    return F.when(t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"), t)


def short_hostname(raw: Column) -> Column:
    """The first label, lower-cased: what names of one machine share."""
    return F.split_part(F.rtrim(F.lower(F.btrim(raw)), F.lit(".")), F.lit("."), F.lit(1))


def squashed_hostname(raw: Column) -> Column:
    return F.regexp_replace(short_hostname(raw), "[^a-z0-9]+", "")


def clean_hostname(raw: Column) -> Column:
    name = F.btrim(F.btrim(raw), F.lit('"'))
    return F.when(name.rlike(r"^[A-Za-z0-9._-]{1,253}$"), name)


def defanged(cell: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, made text."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def cve_id(raw: Column) -> Column:
    t = F.upper(F.btrim(raw))
    return F.when(t.rlike(CVE_PATTERN), t)


def cve_ids_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bCVE-\d{4}-\d{4,}\b"), F.lit(0)), F.upper)))


def percent(x: Column, digits: int) -> Column:
    """A share as per cent, ties to even, as in ``12.5%``."""
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def capitalized(text: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def quotes(haystack: Column, needle: Column) -> Column:
    """Whether ``needle`` occurs, whatever its case and white space."""
    flat = lambda t: F.btrim(F.regexp_replace(F.lower(t), r"\s+", " "))
    return (flat(needle) != "") & flat(haystack).contains(flat(needle))
