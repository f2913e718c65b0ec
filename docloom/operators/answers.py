"""Generated command answers: prompts, cleaning, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import LINE_ENDS, strip_u

# First words of an accepted command line.
COMMANDS = (
    "interface", "router", "line", "ip", "ipv6", "vlan", "spanning-tree", "hostname", "username", "aaa", "snmp", "logging", "clock", "ntp", "crypto",
    "banner", "mls", "lldp", "cdp", "switchport", "control-plane", "access-list", r"ip\s+access-list", r"ipv6\s+access-list", "class-map", "policy-map",
    "service-policy", "route-map", "object-group", "track", r"ip\s+sla", "permit", "deny", "remark", "match", "set", "neighbor", "network", "area",
    "redistribute", "address-family", "passive-interface", "shutdown", r"no\s+shutdown",
)
# Any other word is accepted before an argument with a digit, a colon or a slash.
ARGUMENT = r"[a-z][\w-]*\s+(?:[\w./:-]*\d[\w./:-]*|[\w./:-]*:[\w./:-]+|[\w./:-]+/\d+\S*)"
# Lines that stand alone, accepted by the variant that drops repeats.
ALONE = ("enable", "end", "exit", "do", r"configure\s+terminal", r"config\s+t", r"conf\s+t")
# What ends, begins or voids an extracted configuration.
STARTS = ("enable", "configure terminal", "config t", "conf t")
OPENERS = ("interface", "ip", "ipv6", "router", "access-list", "line", "hostname", "username", "service", "no ")
FOREIGN = ("bash", "shell", "python", "javascript", "html", "css")
STOPS = ("end", "exit")

INSTRUCTIONS = "You configure network devices. Reply with one fenced block of commands and nothing else."


def command_pattern(alone: bool) -> str:
    """The accepting pattern of a line, in a form that Java and RE2 read alike."""
    body = rf"(?:(?:no|default)\s+)?(?:(?:{'|'.join(COMMANDS)})\b|{ARGUMENT})(?:\s+\S+)*"
    return rf"(?i)^\s*(?:{'(?:' + '|'.join(ALONE) + ')|' if alone else ''}{body})\s*$"


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, LINE_ENDS, "\n"), "\n"), strip_u), lambda x: x != "")


def _bare(line: Column) -> Column:
    """A command line without its comment."""
    return strip_u(F.regexp_replace(line, r"\s[!#].*$", ""))


def _framed(kept: Column) -> Column:
    """Entered, configured and ended, in a fence."""
    lower = lambda a, i: F.lower(F.coalesce(F.try_element_at(a, F.lit(i)), F.lit("")))
    one = F.when(lower(kept, 1) == "enable", kept).otherwise(F.concat(F.array(F.lit("enable")), kept))
    two = F.when(lower(one, 2) == "configure terminal", one).otherwise(F.concat(F.slice(one, 1, 1), F.array(F.lit("configure terminal")), F.slice(one, 2, 1_000_000_000)))
    three = F.when(lower(two, -1) == "end", two).otherwise(F.concat(two, F.array(F.lit("end"))))
    return F.concat(F.lit("```ios\n"), F.array_join(three, "\n"), F.lit("\n```"))


def sanitise(c: Column, variant: str = "dedup") -> Column:
    """Only accepted command lines, framed.

    ``dedup`` reads up to the first fence after an optional language line and
    keeps the first of equal lines, as long as they are equal without case;
    ``plain`` reads the first closed fence, else everything, and keeps repeats.
    """
    if variant == "dedup":
        raw = F.regexp_replace(F.regexp_replace(c, r"(?i)\A[ \t]*ios[\w ]*[ \t]*(?:\n|\z)", ""), r"(?s)```.*\z", "")
        pattern = command_pattern(alone=True)
    else:
        closed = r"(?s)```(?:[a-zA-Z]+)?\n(.*?)```"
        raw = F.when(c.rlike(closed), F.regexp_extract(c, closed, 1)).otherwise(c)
        pattern = command_pattern(alone=False)
    kept = F.filter(F.transform(_lines(raw), _bare), lambda x: x.rlike(pattern))
    if variant == "dedup":
        kept = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
    return _framed(kept)


def extract_config(c: Column) -> Column:
    """From the first line that begins a configuration to the first that ends it, foreign lines left out."""
    lines = F.filter(_lines(F.replace(c, F.lit("```"), F.lit(""))), lambda x: ~_any(F.lower(x), FOREIGN))
    begins = F.transform(lines, lambda x: _any(F.lower(x), STARTS + OPENERS))
    at = F.array_position(begins, True)
    rest = F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(rest, lambda x: F.lower(x).isin(*STOPS)), True)
    return F.when(c.isNull(), F.lit("")).otherwise(F.array_join(F.when(stop > 0, F.slice(rest, 1, stop.cast("int"))).otherwise(rest), "\n"))


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def unfence_answer(c: Column) -> Column:
    """A raw answer without the fence around it."""
    s = strip_u(c)
    opened = F.when(s.startswith("```"), F.regexp_replace(s, r"\A```[a-zA-Z]*\n?", "")).otherwise(s)
    return strip_u(F.regexp_replace(opened, r"```\z", ""))


def prompt(context: Column, question: Column, instructions: str = INSTRUCTIONS) -> Column:
    """Context and question in the chat layout that the generator continues inside an open fence."""
    return F.concat(F.lit(instructions + "\n\nContext (from docs):\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion:\n"), question, F.lit("\n\n```"))


def bare_prompt(question: Column, instructions: str = INSTRUCTIONS) -> Column:
    return F.concat(F.lit(instructions + "\n\nQuestion:\n"), question, F.lit("\n\n```"))

