"""Pieces of ANSI SQL shared by the check queries."""

from __future__ import annotations

from threadloom.functions.columns import BLANKS

MARKS = "('[deleted]', '[removed]')"


def strip(x: str) -> str:
    return f"trim({x}, '{BLANKS}')"


def name(x: str) -> str:
    return f"nullif(regexp_replace(lower({strip(x)}), '^r/', ''), '')"


def post(x: str) -> str:
    return f"nullif(regexp_replace(lower({strip(x)}), '^t3_', ''), '')"


def author(x: str) -> str:
    return f"case when lower({strip(x)}) not in {MARKS} then nullif({strip(x)}, '') end"


def day(x: str) -> str:
    return f"cast(to_timestamp({x}) at time zone 'UTC' as date)"


def month(x: str) -> str:
    return f"strftime(to_timestamp({x}) at time zone 'UTC', '%Y-%m')"
