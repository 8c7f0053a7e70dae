"""Personal data: detection, false positives, confidence, policies and redaction as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One pattern by type, in the order they are redacted.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}


@dataclass(frozen=True)
class PiiPolicy:
    """mode: detect (report), block (withhold texts with matches) or redact, see `applied`; types looked for (addresses of hosts are off by default)."""

    mode: str = "detect"
    types: tuple[str, ...] = ("email", "ssn", "credit_card", "phone")


#: Matches of a type that are no personal data, as patterns over lower case.
DUMMIES = {
    "email": r"example\.com|test\.com|localhost",
    "ip_address": r"^127\.|^0\.|^255\.255\.255\.255$",
    "credit_card": r"^0000|^1111|^9999",
}
#: Confidence of a type's matches, and a pattern of those with more, with theirs.
CONFIDENCE = {
    "email": (0.6, r"^(?=[^@]*@[^@]*$).*\.", 0.9),
    "ssn": (0.95, None, None),
    "credit_card": (0.75, None, None),
    "phone": (0.7, r"[-(]", 0.85),
    "ip_address": (0.6, None, None),
}


def false_positive(kind: str, value: Column) -> Column:
    return F.rlike(F.lower(value), F.lit(DUMMIES[kind])) if kind in DUMMIES else F.lit(False)


def confidence(kind: str, value: Column) -> Column:
    base, sure, more = CONFIDENCE[kind]
    return F.when(F.rlike(value, F.lit(sure)), more).otherwise(base) if sure else F.lit(base)


def found(text: Column, kind: str) -> Column:
    """Values of a type without false positives."""
    return F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), lambda v: ~false_positive(kind, v))


def detections(text: Column, policy: PiiPolicy = PiiPolicy()) -> Column:
    """array<struct<type, value, confidence>> of the policy's types."""
    parts = [F.transform(found(text, k), _detected(k)) for k in policy.types]
    return F.concat(*parts)


def _detected(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), confidence(kind, v).alias("confidence"))


def redact(text: Column, policy: PiiPolicy = PiiPolicy("redact")) -> Column:
    """text with every match of the policy's types replaced, in a fixed order of types."""
    for kind in PATTERNS:
        if kind in policy.types:
            text = F.regexp_replace(text, PATTERNS[kind], f"[REDACTED_{kind.upper()}]")
    return text


def applied(text: Column, policy: PiiPolicy = PiiPolicy()) -> Column:
    """struct<text, blocked, detections>: what the policy lets through of a text; a blocked text is null."""
    if policy.mode not in ("detect", "block", "redact"):
        raise ValueError(f"unknown mode {policy.mode}")
    matches = detections(text, policy)
    blocked = (F.size(matches) > 0) if policy.mode == "block" else F.lit(False)
    shown = redact(text, policy) if policy.mode == "redact" else F.when(~blocked, text)
    return F.struct(shown.alias("text"), F.coalesce(blocked, F.lit(False)).alias("blocked"), matches.alias("detections"))
