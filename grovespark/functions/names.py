"""Reference names, globs and refspecs: predicates and mappings as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovespark.errors import InvalidRefNameError, RefSpecError
from grovespark.schema import HEADS, TAGS_PREFIX

# Fixed values of the naming rules: what a name may not contain, and how no part of it may be.
_FORBIDDEN = r"[\x00-\x20\x7f~^:?*\[\\]|\.\.|@\{|//"
_BAD_PART = r"(^|/)(\.|\.\.)(/|$)|\.lock(/|$)"


def is_ref_name(name: Column) -> Column:
    """HEAD, or refs/ and two parts more, without forbidden characters; null is no name."""
    good = name.rlike(r"^refs/[^/]+/.") & ~name.rlike(_FORBIDDEN) & ~name.rlike(_BAD_PART) & ~name.rlike(r"[/.]$")
    return F.coalesce((name == "HEAD") | good, F.lit(False))


def valid_ref_name(name: str) -> bool:
    """is_ref_name() for one name, on the driver."""
    if name == "HEAD":
        return True
    return bool(re.search(r"^refs/[^/]+/.", name, re.S)) and not re.search(f"{_FORBIDDEN}|{_BAD_PART}|[/.]\\Z", name)


def is_ref_prefix(prefix: Column) -> Column:
    return prefix.startswith("refs/") & prefix.endswith("/") & is_ref_name(F.concat(prefix, F.lit("x")))


def is_short_name(name: Column) -> Column:
    """A branch's or tag's name without its prefix."""
    return (F.length(name) > 0) & is_ref_name(F.concat(F.lit("refs/x/"), name))


def branch_ref(name: Column) -> Column:
    return F.when(is_short_name(name), F.concat(F.lit(HEADS), name)).otherwise(F.raise_error(F.concat(F.lit("bad branch name: "), F.coalesce(name, F.lit("null")))))


def tag_ref(name: Column) -> Column:
    return F.when(is_short_name(name), F.concat(F.lit(TAGS_PREFIX), name)).otherwise(F.raise_error(F.concat(F.lit("bad tag name: "), F.coalesce(name, F.lit("null")))))


def require_ref_name(name: str) -> str:
    if not valid_ref_name(name):
        raise InvalidRefNameError(name)
    return name


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: * matches any text, slashes too; every other character, ? among them, is itself."""
    return "^" + ".*".join(re.sub(r"([^\w/ -])", r"\\\1", part) for part in pattern.split("*")) + "$"


def matches_glob(name: Column, pattern: str) -> Column:
    if "*" not in pattern:
        return name == pattern
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return name.startswith(pattern[:-1])  # pushed down to the scan
    return name.rlike(glob_regex(pattern))


@dataclass(frozen=True)
class RefSpec:
    """[+]source:target, with or without a * at the end of both. source and target are without it."""

    force: bool
    source: str
    target: str
    wildcard: bool

    @staticmethod
    def parse(text: str) -> RefSpec:
        force, body = text.startswith("+"), text.removeprefix("+")
        source, colon, target = body.partition(":")
        if not colon:
            raise RefSpecError(f"{text}: no colon")
        for side in (source, target):
            if "*" in side[:-1]:
                raise RefSpecError(f"{text}: a * stands at the end of a side, once")
        if source.endswith("*") != target.endswith("*"):
            raise RefSpecError(f"{text}: a * stands on both sides or none")
        return RefSpec(force, source.removesuffix("*"), target.removesuffix("*"), source.endswith("*"))

    @staticmethod
    def of_rule(source: str, target: str, force: bool | None = None) -> RefSpec:
        """From a mapping rule, whose source may begin with + and whose force comes before that."""
        spec = RefSpec.parse(f"{source}:{target}")
        return spec if force is None else RefSpec(force, spec.source, spec.target, spec.wildcard)

    def rule(self) -> tuple[str, str, bool]:
        star = "*" if self.wildcard else ""
        return self.source + star, self.target + star, self.force

    def matches(self, name: Column) -> Column:
        return name.startswith(self.source) if self.wildcard else name == self.source

    def maps(self, name: Column) -> Column:
        return F.concat(F.lit(self.target), F.substring(name, F.lit(len(self.source) + 1), F.length(name))) if self.wildcard else F.lit(self.target)


def pattern_prefix(pattern: Column) -> Column:
    """What stands before the first *; null without one."""
    return F.when(F.instr(pattern, "*") > 0, F.substring_index(pattern, "*", 1))


def needs_fast_forward(name: Column) -> Column:
    return name.startswith(HEADS)
