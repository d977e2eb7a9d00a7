"""Large rule catalogues: which rules an event can match at all, found by the text pieces they require.

A pattern that can only match where a certain piece of text stands ("-enc", "failed
to log on") is worth trying only on texts with that piece. One trigram of each
such piece goes into a table of (field, trigram, rule); the trigrams of a text are
looked up in it once, for all rules together, and only the rules found are tested,
with their patterns as columns. A rule without a required piece is found by its
event id, and tested on all events only when it has none.

So the plan has the same size for 5 and for 5,000 rules, and the outcome is that of
``predicate`` for each rule.
"""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as op, _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlake.functions.risk import SEVERITY_RISK
from wardlake.functions.text import user_from_message
from wardlake.operators.rules import DETAIL_OF, RESULT_DDL, Rule, spark_pattern
from wardlake.schemas import RECORD

#: Letters of an indexed piece of text.
GRAM = 3
#: Catalogues of more rules go through the index.
INDEX_ABOVE = 200


def _pieces(tokens) -> list[list[str]]:
    """Sets of texts, of each of which one must stand in whatever the pattern matches."""
    out: list[list[str]] = []
    run = ""
    for kind, value in [*tokens, (None, None)]:
        if kind is op.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if len(run) >= GRAM:
            out.append([run])
        run = ""
        if kind is op.SUBPATTERN:
            out += _pieces(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _pieces(value[2])
        elif kind is op.ATOMIC_GROUP:
            out += _pieces(value)
        elif kind is op.BRANCH:
            each = [_pieces(branch) for branch in value[1]]
            if all(each):
                out.append([piece for sets in each for piece in _best(sets)])
    return out


def _best(sets: list[list[str]]) -> list[str]:
    """The set that rules out most by itself: few texts, long ones."""
    return min(sets, key=lambda texts: (len(texts), -min(map(len, texts)), texts))


def required_texts(pattern: str) -> list[list[str]]:
    """Sets of lower-case texts; a match (case ignored) holds at least one of each set."""
    try:
        return [sorted(set(texts)) for texts in _pieces(parser.parse(pattern, re.IGNORECASE))]
    except (re.error, OverflowError, RecursionError):
        return []


def _trigrams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


# --- the catalogue as tables -------------------------------------------------------

#: Where a pattern is searched, in the order in which the index prefers them.
FIELDS = {"message_regex": None, **DETAIL_OF}
_TABLE = (
    "number int, event_id string, provider string, message_regex string, command_line_regex string, image_regex string, "
    "parent_image_regex string, exclude_users array<string>, include_users array<string>, kind int, window_us long, threshold int"
)
_ENTRY = "field int, gram string, piece string, number int"
#: Letters beyond ASCII that patterns take for ASCII ones when case is ignored.
FOLDED = ("\u017f\u0130\u0131\u212a", "siik")


def _index(numbered: list[tuple[int, Rule]], strict: bool) -> dict[int, list[tuple[int, str, str]]]:
    """(field, gram, piece) of each rule that some field can rule out.

    Of all required pieces a rule is filed under those, and of a piece under that
    trigram, that the fewest rules share.
    """
    sets: dict[int, list[tuple[int, list[str]]]] = {}
    for number, rule in numbered:
        for place, field in enumerate(FIELDS):
            if getattr(rule, field) and field not in rule.broken:
                sets.setdefault(number, []).extend((place, texts) for texts in required_texts(getattr(rule, field)))
    shared = Counter(x for own in sets.values() for x in {(p, g) for p, texts in own for t in texts for g in _trigrams(t)})
    out = {}
    for number, own in sets.items():
        filed = []
        for place, texts in own:
            grams = [min(_trigrams(t), key=lambda g, place=place: (shared[place, g], g)) for t in texts]
            filed.append((sum(shared[place, g] for g in grams), place, list(zip(grams, texts, strict=True))))
        if filed:
            _, place, best = min(filed)
            out[number] = [(place, g, t) for g, t in best]
            if place and not strict:  # a process pattern passes where the event has no such field
                out[number].append((place, "", ""))
    return out


def catalogue(spark: SparkSession, numbered: list[tuple[int, Rule]], strict: bool = False) -> tuple[DataFrame, DataFrame, list[int], dict[int, set[str]]]:
    """(rules, their index entries, numbers of those that have neither an entry nor an event id, trigrams per field).

    Rules and entries are as many as somebody has written; both are broadcast.
    """
    rows, entries, anywhere = [], [], []
    index = _index(numbered, strict)
    for number, rule in numbered:
        if "message_regex" in rule.broken:
            continue  # never matches
        patterns = []
        for field in ("message_regex", "command_line_regex", "image_regex", "parent_image_regex"):
            flags = "(?imUd)" if field == "message_regex" else "(?iUd)"
            text = getattr(rule, field)
            patterns.append(None if not text else "" if field in rule.broken else flags + spark_pattern(text))
        users = [[u.upper() for u in x] or None for x in (rule.exclude_users, rule.include_users)]
        kind = 3 if rule.parent_image_regex else 2 if rule.image_regex else 1
        provider = rule.provider.lower() if rule.provider else None
        rows.append((number, rule.event_id, provider, *patterns, *users, kind, rule.time_window * 1_000_000, rule.threshold))
        found = index.get(number, [])
        entries += [(*e, number) for e in found]
        if not found and rule.event_id:
            entries.append((-1, rule.event_id, "", number))
        elif not found:
            anywhere.append(number)
    indexed: dict[int, set[str]] = {}
    for place, gram, _, _ in entries:
        if place >= 0 and gram:
            indexed.setdefault(place, set()).add(gram)
    return spark.createDataFrame(rows, _TABLE), spark.createDataFrame(entries, _ENTRY), anywhere, indexed


def _test(strict: bool) -> Column:
    """``predicate`` with the rule's values as columns; the rule's columns bear the prefix ``r_``."""
    always = F.lit(True)
    ok = F.col("r_provider").isNull() | (F.lower("log_source") == F.col("r_provider"))
    ok = ok & (F.col("r_event_id").isNull() | (F.col("event_id") == F.col("r_event_id")))
    ok = ok & F.when(F.col("r_message_regex").isNull(), always).otherwise(F.rlike(F.coalesce("message", F.lit("")), F.col("r_message_regex")))
    for field, detail in DETAIL_OF.items():
        value, pattern = F.col("details")[detail], F.col(f"r_{field}")
        hit = F.when(pattern == "", F.lit(False)).otherwise(F.rlike(value, pattern))  # '' stands for a broken one
        passed = value.isNotNull() & hit if strict else value.isNull() | hit
        ok = ok & F.when(pattern.isNull(), always).otherwise(passed)
    user = F.col("_user")
    ok = ok & (F.col("r_exclude_users").isNull() | user.isNull() | ~F.array_contains("r_exclude_users", user))
    ok = ok & (F.col("r_include_users").isNull() | user.isNull() | F.array_contains("r_include_users", user))
    return F.coalesce(ok, F.lit(False))


def _letters(grams: set[str]) -> str:
    """A pattern that finds, overlapping, the trigrams with letters that some indexed one has at the same place."""
    places = [sorted({g[i] for g in grams}) for i in range(GRAM)]
    return "(?=(" + "".join("[" + "".join(f"\\x{ord(c):02x}" for c in letters) + "]" for letters in places) + "))"


def _grams_of(place: int, text: Column, grams: set[str]) -> Column:
    """Distinct keys (field, gram) of one text: its trigrams that may be indexed, or '' where there is no text."""
    none = F.array(F.lit(f"{place}:"))
    if grams:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_letters(grams)), F.lit(1)))
        every = F.transform(found, lambda g: F.concat(F.lit(f"{place}:"), g))
    else:
        every = F.slice(none, 1, 0)
    return F.when(text.isNull(), none).otherwise(every)


def matching_rules(events: DataFrame, numbered: list[tuple[int, Rule]], strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Record key, ``keep``, and ``number, kind, window_us, threshold`` of the rules whose predicate holds.

    Events need what ``predicate`` reads. Nothing is shuffled; a rule found by
    several pieces comes several times.
    """
    spark = events.sparkSession
    rules, entries, anywhere, indexed = catalogue(spark, numbered, strict)
    needed = dict.fromkeys([*RECORD, "event_id", "message", "details", *keep])
    fold = lambda c: F.lower(F.translate(c, *FOLDED))
    texts = F.array(fold(F.coalesce("message", F.lit(""))), *[fold(F.col("details")[d]) for d in DETAIL_OF.values()])
    rows = events.select(*needed, F.upper(user_from_message(F.col("message"))).alias("_user"), texts.alias("_texts"))
    grams = [_grams_of(i, F.col("_texts")[i], indexed.get(i, set())) for i in range(len(FIELDS))]
    code = F.array(F.concat(F.lit("-1:"), F.coalesce("event_id", F.lit(""))))
    met = rows.withColumn("_g", F.explode(F.concat(code, *grams)))
    met = met.join(F.broadcast(entries.withColumn("_g", F.concat_ws(":", "field", "gram")).drop("gram")), "_g")
    text = F.get("_texts", F.greatest(F.col("field"), F.lit(0)))
    met = met.filter((F.col("piece") == "") | text.contains(F.col("piece"))).drop("_g", "field", "piece")
    if anywhere:
        met = met.unionByName(rows.withColumn("number", F.explode(F.lit(anywhere))))
    named = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    found = met.join(F.broadcast(named), F.col("number") == F.col("r_number")).filter(_test(strict))
    return found.select(*RECORD, *keep, "number", *[F.col(f"r_{c}").alias(c) for c in ("kind", "window_us", "threshold")])


def results(spark: SparkSession, numbered: list[tuple[int, Rule]]) -> DataFrame:
    """``number`` and ``result`` of the rules, for a broadcast."""
    rows = [
        (n, (r.id, r.name, SEVERITY_RISK.get(r.severity, "Medium"), r.severity, r.mitre[0] if r.mitre else None,
             list(r.mitre), list(r.tags), r.match_message, r.description))
        for n, r in numbered
    ]
    return spark.createDataFrame(rows, f"number int, result {RESULT_DDL}")
