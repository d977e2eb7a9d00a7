"""Text columns: message choice, user and event-id extraction, process details, context text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# User name patterns in priority order.
USER_PATTERNS = (
    r"Account Name:\s*([^\s\n]+)",
    r"User Name:\s*([^\s\n]+)",
    r"Account Name\s+([^\s\n]+)",
    r"User\s+([^\s\n]+)",
)
# Fixed value: event id inside free text.
EVENT_ID_PATTERN = r"Event ID\s*[:#]?\s*(\d+)"
# Placeholders and separators.
NO_MESSAGE = "Message could not be retrieved"
MISSING = "N/A"
INSERT_SEPARATOR = " | "
STORED_MESSAGE_CHARS = 500
DIGEST_CHARS = 200

# Zero-based insert positions of process fields.
CREATE_POSITIONS = {"Image": 4, "CommandLine": 10, "User": 12, "ParentImage": 19}
TERMINATE_POSITIONS = {"ProcessId": 3, "Image": 4}
DETAIL_FIELDS = ("Image", "CommandLine", "User", "ParentImage", "ProcessId")

# Fixed value: the only part of an event's XML that is read.
EVENT_XML = "EventData struct<Data array<struct<_Name:string,_VALUE:string>>>"

CONTEXT_NOTE = (
    "Hint: account, workstation, source address and logon type in the message matter most."
)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), text)


def user_from_message(message: Column) -> Column:
    """First hit of the user patterns, NULL when none matches."""
    hits = [F.nullif(F.regexp_extract(message, "(?iUd)" + p, 1), F.lit("")) for p in USER_PATTERNS]
    return F.coalesce(*hits)


def event_id_from_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iUd)" + EVENT_ID_PATTERN, 1), F.lit(""))


def non_empty(inserts: Column) -> Column:
    return F.filter(inserts, lambda x: x.isNotNull() & (x != ""))


def event_message(message: Column, inserts: Column) -> Column:
    """Formatted text; else all inserts joined; else a fixed text."""
    fallback = F.when(F.size(inserts) > 0, F.array_join(inserts, INSERT_SEPARATOR, "None"))
    return F.coalesce(blank_to_null(message), fallback, F.lit(NO_MESSAGE))


def _at(values: Column, position: int) -> Column:
    return F.try_element_at(values, F.lit(position + 1))


def _xml_value(data: Column, name: str) -> Column:
    """Last value of ``Data`` elements with this name; an empty element gives ''."""
    hits = F.filter(data, lambda d: d["_Name"] == name)
    return F.when(
        F.size(hits) > 0, F.coalesce(F.try_element_at(hits, F.lit(-1))["_VALUE"], F.lit(""))
    )


def is_process_event(log_source: Column, event_id: Column) -> Column:
    """Creation ('1') and termination ('5') events of the process channel."""
    return (log_source == "Sysmon") & event_id.isin("1", "5")


def xml_data(log_source: Column, event_id: Column, inserts: Column, xml: Column) -> Column:
    """``Data`` elements of a process event's XML; NULL for broken XML.

    XML is read for process events only, and only when there are inserts. Names
    are taken as written: with a default namespace the elements have other names,
    nothing is found, and the positions stand. ``EventData`` is looked for
    directly below the root.
    """
    plain = ~F.coalesce(xml.rlike(r"\sxmlns\s*="), F.lit(False))
    wanted = is_process_event(log_source, event_id) & (F.size(inserts) > 0) & plain
    parsed = F.from_xml(F.when(wanted, xml), EVENT_XML, {"mode": "PERMISSIVE"})
    return parsed["EventData"]["Data"]


def process_details(
    log_source: Column, event_id: Column, values: Column, data: Column | None = None
) -> Column:
    """Process fields of creation ('1') and termination ('5') events; NULL for all others.

    ``values`` are the inserts positions are counted in, ``data`` the XML
    elements, which override positions. Fields an event kind does not have are
    NULL; fields it should have but lacks are ``'N/A'``.
    """

    def fields(positions: dict[str, int]) -> Column:
        columns = []
        for name in DETAIL_FIELDS:
            if name not in positions:
                columns.append(F.lit(None).cast("string").alias(name))
                continue
            sources = [] if data is None else [_xml_value(data, name)]
            sources += [_at(values, positions[name]), F.lit(MISSING)]
            columns.append(F.coalesce(*sources).alias(name))
        return F.struct(*columns)

    sysmon = log_source == "Sysmon"
    return F.when(sysmon & (event_id == "1"), fields(CREATE_POSITIONS)).when(
        sysmon & (event_id == "5"), fields(TERMINATE_POSITIONS)
    )


def detail_block(event_id: Column, details: Column) -> Column:
    """Readable block of the process fields, '' when there are no details."""
    # Titles and labels of the block.
    created = F.concat(
        F.lit("\nSysmon Process Creation Details:\n  Image: "),
        details["Image"],
        F.lit("\n  CommandLine: "),
        details["CommandLine"],
        F.lit("\n  User: "),
        details["User"],
        F.lit("\n  ParentImage: "),
        details["ParentImage"],
        F.lit("\n"),
    )
    ended = F.concat(
        F.lit("\nSysmon Process Terminated Details:\n  Image: "),
        details["Image"],
        F.lit("\n  ProcessId: "),
        details["ProcessId"],
        F.lit("\n"),
    )
    return F.when(details.isNull(), "").when(event_id == "1", created).otherwise(ended)


def inserts_block(values: Column) -> Column:
    """The non-empty inserts as a line, '' when there are none."""
    line = F.concat(
        F.lit("\nAdditional Details (StringInserts): "), F.array_join(values, INSERT_SEPARATOR)
    )
    return F.when(F.size(values) > 0, line).otherwise("")


def combined_text(message: Column, event_id: Column, details: Column, values: Column) -> Column:
    """Message, details and inserts: the text searched for IP addresses, never shortened."""
    return F.concat(message, detail_block(event_id, details), inserts_block(values))


def context_text(log_source: Column, event_id: Column, event_time: Column, combined: Column) -> Column:
    """Full event text for analysis."""
    return F.concat(
        F.lit("Log Source: "),
        log_source,
        F.lit("\nEvent ID: "),
        event_id,
        F.lit("\nTime: "),
        F.date_format(event_time, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\nMessage: "),
        combined,
        F.lit("\n\n" + CONTEXT_NOTE),
    )
