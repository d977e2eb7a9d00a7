"""Risk labels. The five normalisers differ on purpose; each keeps its own rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardlake.functions.text import strip

# Label vocabulary in two languages.
HIGH = ("high", "yüksek")
MEDIUM = ("medium", "orta")
LOW = ("low", "düşük")
HIGH_LABELS = ("High", "Yüksek")

# Severity order and the risk each severity stands for.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER_RANK = 99
SEVERITY_RISK = {"critical": "High", "high": "High", "medium": "Medium", "low": "Low"}


def _has(text: Column, words: tuple[str, str]) -> Column:
    return text.contains(words[0]) | text.contains(words[1])


def is_high(label: Column) -> Column:
    """Exactly one of the two spellings of "High" (case-sensitive); NULL is not high."""
    return F.coalesce(label.isin(*HIGH_LABELS), F.lit(False))


def severity_rank(severity: Column) -> Column:
    out = F.lit(OTHER_RANK)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_to_risk(severity: Column) -> Column:
    """critical/high → High, medium → Medium, low → Low, anything else → Medium."""
    return (
        F.when(severity.isin("critical", "high"), "High")
        .when(severity == "low", "Low")
        .otherwise("Medium")
    )


def answer_risk(label: Column) -> Column:
    """Label of an analysis answer: a contained word decides, default medium.

    A label that is exactly one of the words contains only that word, so it
    needs no test of its own.

    Gives the vocabulary of the answers themselves; ``canonical_risk`` turns it
    into English.
    """
    low = F.lower(label)
    return (
        F.when(_has(low, HIGH), "Yüksek")
        .when(_has(low, MEDIUM), "Orta")
        .when(_has(low, LOW), "Düşük")
        .otherwise("Orta")
    )


def display_risk(label: Column) -> Column:
    """English label for tables: NULL → Unspecified, unknown words stay as they are."""
    low = F.lower(label)
    return (
        F.when(label.isNull(), "Unspecified")
        .when(_has(low, HIGH), "High")
        .when(_has(low, MEDIUM), "Medium")
        .when(_has(low, LOW), "Low")
        .when(low.contains("critical"), "Critical")
        .otherwise(strip(label))
    )


def canonical_risk(label: Column) -> Column:
    """English label kept in the log table; NULL stays NULL."""
    return F.when(label.isNotNull(), display_risk(label))


def risk_bucket(label: Column) -> Column:
    """High / Medium / Low / Unspecified for the distribution ("critical" is Unspecified)."""
    low = F.lower(label)
    return (
        F.when(_has(low, HIGH), "High")
        .when(_has(low, MEDIUM), "Medium")
        .when(_has(low, LOW), "Low")
        .otherwise("Unspecified")
    )


def severity_label(label: Column) -> Column:
    """Severity column of the log view: a high risk is shown as Critical."""
    low = F.lower(label)
    return (
        F.when(_has(low, HIGH), "Critical")
        .when(_has(low, MEDIUM), "Medium")
        .when(_has(low, LOW), "Low")
        .otherwise("Unspecified")
    )
