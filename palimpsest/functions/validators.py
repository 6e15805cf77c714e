"""Validators: what a span must satisfy besides its pattern, as a Column and as a Python function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.plans.policy import FILE_ENDINGS


def luhn(span: str) -> bool:
    digits = [ord(c) - 48 for c in span if "0" <= c <= "9"]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def not_file_name(span: str) -> bool:
    return span.rpartition(".")[2].lower() not in FILE_ENDINGS


def looks_like_hostname(span: str) -> bool:
    return any(c == "-" or "0" <= c <= "9" for c in span)


def luhn_column(span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


PYTHON: dict[str, Callable[[str], bool]] = {"luhn": luhn, "not_file_name": not_file_name, "looks_like_hostname": looks_like_hostname}

COLUMN: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn_column,
    "not_file_name": lambda s: ~F.lower(F.substring_index(s, ".", -1)).isin(FILE_ENDINGS),
    "looks_like_hostname": lambda s: s.rlike("[-0-9]"),
}


def register(name: str, python: Callable[[str], bool], column: Callable[[Column], Column]) -> None:
    """A validator of one's own, under a name that rules can use; both forms must agree."""
    PYTHON[name], COLUMN[name] = python, column
