"""IPv4 columns: extraction from text, validity, private ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Candidate pattern, and octets 0-255 without leading zeros.
CANDIDATE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID = rf"^(?:{OCTET}\.){{3}}{OCTET}$"

# Ranges that are private, loopback, link-local or reserved for
# private use, and the two addresses inside them that are not.
PRIVATE_RANGES = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
PUBLIC_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
# The same ranges as leading octets of a valid address.
PRIVATE = (
    r"^(?:0|10|127|24[0-9]|25[0-5])\."
    r"|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)


def is_valid_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(VALID), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Address as a number, NULL for anything that is not a valid IPv4."""
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + octets[i].cast("long")
    return F.when(is_valid_ipv4(ip), number)


def _in_private_range(valid_ip: Column) -> Column:
    return valid_ip.rlike(PRIVATE) & ~valid_ip.isin(*PUBLIC_EXCEPTIONS)


def is_private_ip(ip: Column) -> Column:
    """Private, loopback or link-local; an invalid address is not private."""
    return F.coalesce(ip.rlike(VALID) & _in_private_range(ip), F.lit(False))


def extract_ips(text: Column) -> Column:
    """All valid IPv4 addresses of a text, in order, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + CANDIDATE), F.lit(0))
    return F.filter(found, is_valid_ipv4)


def public_ips(ips: Column) -> Column:
    """Those of a list of valid addresses that are public."""
    return F.filter(ips, lambda x: ~_in_private_range(x))


def block_rule_name(ip: Column, prefix: str = "wardlake") -> Column:
    """Name of the block rule of an address."""
    return F.concat(F.lit(f"{prefix}_Block_"), F.translate(ip, ".", "_"))
