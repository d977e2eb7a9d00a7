"""Detection rules: loading, checking, and the predicates they stand for."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake import schemas
from wardlake.functions.risk import OTHER_RANK, SEVERITY_RANK, SEVERITY_RISK
from wardlake.functions.text import user_from_message

try:
    import yaml
except ImportError:  # rule files may still be written as JSON
    yaml = None

log = logging.getLogger(__name__)

# Defaults of a rule.
DEFAULT_WINDOW = 60
DEFAULT_MESSAGE = "🔴 Detection Rule Match: "
UNKNOWN = "UNKNOWN"

SHIPPED_RULES = Path(__file__).resolve().parent.parent / "data" / "rules"

REGEX_FIELDS = ("message_regex", "image_regex", "command_line_regex", "parent_image_regex")
DETAIL_OF = {
    "image_regex": "Image",
    "command_line_regex": "CommandLine",
    "parent_image_regex": "ParentImage",
}


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = "Unknown Rule"
    description: str = ""
    enabled: bool = True
    severity: str = "medium"
    mitre: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    event_id: str | None = None
    provider: str | None = None
    message_regex: str | None = None
    command_line_regex: str | None = None
    image_regex: str | None = None
    parent_image_regex: str | None = None
    time_window: int = DEFAULT_WINDOW
    threshold: int = 0
    match_message: str = ""
    exclude_users: tuple[str, ...] = ()
    include_users: tuple[str, ...] = ()
    rule_file: str = ""
    idx: int = 0
    #: Regex fields whose pattern cannot be used; such a test never passes.
    broken: frozenset[str] = field(default_factory=frozenset)

    @property
    def rank(self) -> int:
        return SEVERITY_RANK.get(self.severity, OTHER_RANK)

    @property
    def counted(self) -> bool:
        return self.threshold > 0


def rule_from_dict(data: dict, rule_file: str = "", idx: int = 0) -> Rule:
    """A rule from the mapping a rule file holds."""
    name = data.get("name", "Unknown Rule")
    mitre = data.get("mitre", [])
    if isinstance(mitre, str):
        mitre = [mitre]
    tags = data.get("tags", [])
    severity = data.get("severity", "medium").lower()
    if not data.get("severity") and "risk_level" in data:
        severity = _severity_of_old_label(data["risk_level"].lower(), severity)
    where = data.get("conditions", {})
    users = data.get("filters") or {}
    event_id = where.get("event_id")
    return Rule(
        id=data.get("id", f"rule_{rule_file}"),
        name=name,
        description=data.get("description", ""),
        enabled=bool(data.get("enabled", True)),
        severity=severity,
        mitre=tuple(mitre) if isinstance(mitre, list) else (),
        tags=tuple(tags) if isinstance(tags, list) else (),
        event_id=str(event_id) if event_id else None,
        provider=where.get("provider") or None,
        message_regex=where.get("message_regex") or None,
        command_line_regex=where.get("command_line_regex") or None,
        image_regex=where.get("image_regex") or None,
        parent_image_regex=where.get("parent_image_regex") or None,
        time_window=int(where.get("time_window", DEFAULT_WINDOW)),
        threshold=int(where.get("threshold", 0)),
        match_message=data.get("match_message", DEFAULT_MESSAGE + name),
        exclude_users=tuple(users.get("exclude_users") or ()),
        include_users=tuple(users.get("include_users") or ()),
        rule_file=rule_file,
        idx=idx,
    )


def _severity_of_old_label(label: str, default: str) -> str:
    # Words of the older risk_level key.
    for word, english in (("yüksek", "high"), ("orta", "medium"), ("düşük", "low")):
        if word in label or label == english:
            return english
    return default


def _parse(text: str):
    if yaml is not None:
        return yaml.safe_load(text)
    return json.loads(text)


def load_rules(directory: str | Path = SHIPPED_RULES) -> list[Rule]:
    """All rules of the ``*.yaml`` and then the ``*.yml`` files of a folder.

    A file holds one rule or a list. A file that cannot be read is reported and
    skipped; the others still load. A missing folder gives no rules.
    """
    folder = Path(directory)
    rules: list[Rule] = []
    for path in sorted(folder.glob("*.yaml")) + sorted(folder.glob("*.yml")):
        try:
            content = _parse(path.read_text(encoding="utf-8"))
            items = content if isinstance(content, list) else [content] if content else []
            for idx, item in enumerate(items):
                rules.append(rule_from_dict(item, path.name, idx))
        except Exception as error:
            log.error("rule file %s skipped: %s", path, error)
    enabled = sum(r.enabled for r in rules)
    log.info("%d rules loaded (%d enabled)", len(rules), enabled)
    return rules


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The catalogue as a table, for reporting."""
    names = schemas.RULE.fieldNames()
    rows = [
        tuple(list(v) if isinstance(v, tuple) else v for v in (asdict(r)[n] for n in names))
        for r in rules
    ]
    return spark.createDataFrame(rows, schemas.RULE)


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    """Loaded and enabled rules."""
    return catalogue.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.coalesce(F.count_if("enabled"), F.lit(0)).alias("enabled"),
    )


def spark_pattern(pattern: str) -> str:
    """Rewrite the named-group and end-of-text forms that Java spells differently."""
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


_known: dict[str, bool] = {}


def check_patterns(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """Mark patterns that cannot be used, instead of letting one fail the whole job."""
    patterns = sorted({getattr(r, f) for r in rules for f in REGEX_FIELDS if getattr(r, f)})
    new = [p for p in patterns if p not in _known]
    if new:  # each pattern is tried once per process
        good = _compiles(spark, new)
        _known.update({p: good or _compiles(spark, [p]) for p in new})
    known = _known

    checked = []
    for rule in rules:
        bad = frozenset(f for f in REGEX_FIELDS if not known.get(getattr(rule, f), True))
        for name in bad:
            log.warning("rule %s: %s is not a valid pattern, it never matches", rule.id, name)
        checked.append(replace(rule, broken=bad) if bad else rule)
    return checked


def _compiles(spark: SparkSession, patterns: list[str]) -> bool:
    """Whether all patterns can be used; one small query for all of them."""
    try:
        for pattern in patterns:
            re.compile(pattern)
        tests = [F.lit("").rlike("(?iUd)" + spark_pattern(p)) for p in patterns]
        if tests:
            spark.range(1).select(F.array(*tests)).collect()
        return True
    except (re.error, PySparkException):
        return False


def by_severity(rules: list[Rule]) -> list[Rule]:
    """Enabled rules in the order they are tried: severity, then file, then place in the file."""
    return sorted((r for r in rules if r.enabled), key=lambda r: (r.rank, r.rule_file, r.idx))


def by_file(rules: list[Rule]) -> list[Rule]:
    """Enabled rules in load order."""
    return [r for r in rules if r.enabled]


def predicate(rule: Rule, strict_fields: bool = False) -> Column:
    """Everything a rule asks of one event except its count; never NULL.

    Tests are ordered from cheap to expensive. Process-field tests are skipped
    when the event has no details or lacks the field; ``strict_fields`` makes
    them fail instead.
    """
    tests: list[Column] = []
    if rule.provider:
        tests.append(F.lower("log_source") == rule.provider.lower())
    if rule.event_id:
        tests.append(F.col("event_id") == rule.event_id)
    if rule.message_regex:
        if "message_regex" in rule.broken:
            tests.append(F.lit(False))
        else:
            pattern = "(?imUd)" + spark_pattern(rule.message_regex)
            tests.append(F.coalesce("message", F.lit("")).rlike(pattern))
    for name, detail in DETAIL_OF.items():
        pattern = getattr(rule, name)
        if not pattern:
            continue
        value = F.col("details")[detail]
        if name in rule.broken:
            hit = F.lit(False)
        else:
            hit = value.rlike("(?iUd)" + spark_pattern(pattern))
        tests.append(value.isNotNull() & hit if strict_fields else value.isNull() | hit)
    if rule.exclude_users or rule.include_users:
        user = F.upper(user_from_message(F.col("message")))
        if rule.exclude_users:
            tests.append(user.isNull() | ~user.isin(*[u.upper() for u in rule.exclude_users]))
        if rule.include_users:
            tests.append(user.isNull() | user.isin(*[u.upper() for u in rule.include_users]))
    result = F.lit(True)
    for i, test in enumerate(tests):
        result = test if i == 0 else result & test
    return F.coalesce(result, F.lit(False))


def threshold_key(rule: Rule) -> Column:
    """What a threshold rule counts together: event id, refined by process names."""
    event_id = F.coalesce("event_id", F.lit("None"))
    image = F.coalesce(F.col("details")["Image"], F.lit(UNKNOWN))
    parent = F.coalesce(F.col("details")["ParentImage"], F.lit(UNKNOWN))
    if rule.parent_image_regex:
        fine = F.concat(event_id, F.lit(":"), parent, F.lit("->"), image)
    elif rule.image_regex:
        fine = F.concat(event_id, F.lit(":"), image)
    else:
        return event_id
    return F.when(F.col("details").isNotNull(), fine).otherwise(event_id)


def disjoint(a: Rule, b: Rule) -> bool:
    """True when no event can pass both rules, seen from their equality tests."""
    if a.event_id and b.event_id and a.event_id != b.event_id:
        return True
    return bool(a.provider and b.provider and a.provider.lower() != b.provider.lower())


RESULT_DDL = (
    "struct<rule_id:string,rule_name:string,risk_level:string,severity:string,"
    "mitre_technique:string,mitre_techniques:array<string>,tags:array<string>,"
    "match_message:string,description:string>"
)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def result_struct(rule: Rule) -> Column:
    """What a match reports."""
    return F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.lit(SEVERITY_RISK.get(rule.severity, "Medium")).alias("risk_level"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.mitre[0] if rule.mitre else None).cast("string").alias("mitre_technique"),
        _strings(rule.mitre).alias("mitre_techniques"),
        _strings(rule.tags).alias("tags"),
        F.lit(rule.match_message).alias("match_message"),
        F.lit(rule.description).alias("description"),
    ).cast(RESULT_DDL)
