"""Author lines: name <email> seconds ±HHMM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_author(author: Column) -> Column:
    return F.concat(author["name"], F.lit(" <"), author["email"], F.lit("> "), author["timestamp"].cast("string"), F.lit(" "), author["timezone"])


def parse_author(text: Column) -> Column:
    """struct(name, email, timestamp, timezone); null where the line has another form: the time and zone stand after the last
    closing bracket, the name before the first opening one, and neither the name nor the email is empty."""
    tail = F.substring_index(text, "> ", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 2)
    bracket = F.locate(" <", head, 2)
    email = F.substring(head, bracket + 2, F.length(head))
    good = text.contains("> ") & (bracket > 0) & (email != "") & ~text.contains("\n") & tail.rlike("^[0-9]+ [+-][0-9][0-9][0-9][0-9]$")
    seconds = F.substring_index(tail, " ", 1).try_cast("bigint")
    return F.when(good, F.struct(F.substring(head, F.lit(1), bracket - 1).alias("name"), email.alias("email"), seconds.alias("timestamp"), F.substring_index(tail, " ", -1).alias("timezone")))


def parse_author_text(text: str) -> dict | None:
    """parse_author() for one line."""
    head, bracket, tail = text.rpartition("> ")
    seconds, _, zone = tail.partition(" ")
    at = head.find(" <", 1)
    digits = seconds.isascii() and seconds.isdigit() and len(zone) == 5 and zone[0] in "+-" and zone[1:].isascii() and zone[1:].isdigit()
    if not bracket or at < 0 or at + 2 == len(head) or "\n" in text or not digits:
        return None
    return {"name": head[:at], "email": head[at + 2 :], "timestamp": int(seconds), "timezone": zone}


def when(author: Column) -> Column:
    """The moment as a timestamp."""
    return F.timestamp_seconds(author["timestamp"])
