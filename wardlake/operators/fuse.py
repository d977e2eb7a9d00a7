"""One risk and one text from feed, rules and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlake.functions.risk import HIGH_LABELS, canonical_risk, is_high

# Texts put in front of an analysis.
THREAT_HEADER = "🚨 [THREAT INTEL MATCH] IP %s zararlı listede bulundu! Kategori: %s, Güven: %d%%\n\n"
RULE_SEPARATOR = "\n\n---\n\n"
BLOCK_NOTICE = "🛡️ [ACTION TAKEN]: IP adres(ler)i engellendi: "


def fused_risk(threat: Column, rule_risk: Column, analysis_risk: Column) -> Column:
    """Feed hit → High; else a rule of high risk → High; else the analysis label."""
    high_rule = F.coalesce(rule_risk.isin(*HIGH_LABELS), F.lit(False))
    return F.when(threat.isNotNull() | high_rule, "High").otherwise(analysis_risk)


def fused_text(threat: Column, rule_message: Column, analysis: Column) -> Column:
    """Feed header before the analysis; without a feed hit the rule message; else nothing."""
    header = F.format_string(
        THREAT_HEADER, threat["ip"], threat["category"], threat["confidence"]
    )
    return (
        F.when(threat.isNotNull(), F.concat(header, analysis))
        .when(rule_message != "", F.concat(rule_message, F.lit(RULE_SEPARATOR), analysis))
        .otherwise(analysis)
    )


def block_notice(risk: Column, public_ips: Column) -> Column:
    """Notice naming every public address of a high-risk event, '' for others."""
    named = F.concat(F.lit(BLOCK_NOTICE), F.array_join(public_ips, ", "), F.lit("\n\n"))
    return F.when(is_high(risk) & (F.size(public_ips) > 0), named).otherwise("")


def fuse(events: DataFrame) -> DataFrame:
    """Add ``final_risk_raw``, ``final_risk`` (English) and ``final_analysis``.

    Needs ``threat, detection, analysis, analysis_risk, public_ips``.
    """
    raw = fused_risk(F.col("threat"), F.col("detection.risk_level"), F.col("analysis_risk"))
    text = fused_text(F.col("threat"), F.col("detection.match_message"), F.col("analysis"))
    return (
        events.withColumn("final_risk_raw", raw)
        .withColumn("final_risk", canonical_risk(F.col("final_risk_raw")))
        .withColumn(
            "final_analysis",
            F.concat(block_notice(F.col("final_risk_raw"), F.col("public_ips")), text),
        )
    )
