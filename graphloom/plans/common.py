"""SQL fragments that several oracle statements share (DuckDB dialect)."""

from __future__ import annotations

TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}﻿]+|[\s\p{{Z}}﻿]+$', '', 'g')"


def sql_trim(x: str) -> str:
    return TRIM.format(x)


def sql_clean_id(x: str) -> str:
    return f"regexp_replace({sql_trim(x)}, '^file:[./]+', 'file:')"
