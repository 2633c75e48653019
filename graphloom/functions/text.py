"""Line, token and pattern functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
TOKEN = r"[A-Za-z_][A-Za-z0-9_.]*"
SYMBOL = r"^[A-Z][a-zA-Z0-9_]+$"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"
CITATION = r"\[(E\d+)\]"

# The patterns below must be as they are for equal results.
#: Secrets in the added lines of a diff; the first pattern that matches counts.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"-----BEGIN\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY",
    r"xox[baprs]-[0-9a-zA-Z]{10,48}",
    r"(?i)EYJ[0-9A-ZA-Z_-]+\.[0-9A-ZA-Z_-]+\.[0-9A-ZA-Z_-]+",
    r"(?i)(?:api_key|access_token|secret_key|password)\s*[:=]\s*['\"](?![A-Za-z0-9_]*TEST[A-Za-z0-9_]*)[A-Za-z0-9_/-]{16,}['\"]",
)
#: What is put in place of secrets in logs and traces.
REDACTIONS = (
    (r"AKIA[0-9A-Z]{16}", "AKIA[REDACTED_AWS_KEY]"),
    (r"ghp_[a-zA-Z0-9]{36}", "ghp_[REDACTED_GITHUB_TOKEN]"),
    (r"gho_[a-zA-Z0-9]{36}", "gho_[REDACTED_OAUTH_TOKEN]"),
    (r"nvapi-[a-zA-Z0-9_-]{40,64}", "nvapi-[REDACTED_NIM_KEY]"),
    (r"-----BEGIN\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY[\s\S]+?-----END\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)Bearer\s+[a-zA-Z0-9._-]+", "Bearer [REDACTED_TOKEN]"),
    (r"(?i)(?:password|secret|api_key|access_token)\s*[:=]\s*['\"](?![A-Za-z0-9_]*TEST[A-Za-z0-9_]*)[A-Za-z0-9_/-]{16,}['\"]", "secret='[REDACTED]'"),
)
LOG_REDACTIONS = (
    (r"ghp_[a-zA-Z0-9]{36}", "ghp_REDACTED"),
    (r"gho_[a-zA-Z0-9]{36}", "gho_REDACTED"),
    (r"(?i)Bearer\s+[a-zA-Z0-9._-]+", "Bearer REDACTED"),
)
#: Prompt injection; the first pattern that matches counts.
INJECTIONS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|system)\s+instructions",
    r"(?i)run\s+git\s+push\s+--force",
    r"(?i)upload\s+(?:token|secret|credentials|repository)\s+to",
    r"(?i)delete\s+(?:repository|existing\s+branch|main)",
    r"(?i)exec\s*\(\s*['\"]",
    r"(?i)os\.system\s*\(",
)
# End of the fixed values.


def lines(text: Column) -> Column:
    """Lines without their ends; text that ends with a line end has no empty last line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, both from 0 and inclusive, clamped to the text; '' outside of it."""
    ls = lines(text)
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.size(ls) - 1)
    return F.when(hi >= lo, F.array_join(F.slice(ls, lo + 1, F.greatest(hi - lo + 1, F.lit(0))), "\n")).otherwise("")


def ordered_tokens(text: Column) -> Column:
    """Identifier-like tokens of at least two characters, each once, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2))


def embedding_tokens(text: Column) -> Column:
    got = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)), lambda t: F.length(t) >= 2))
    return F.when(F.size(got) > 0, got).when(F.trim(text) != "", F.array(F.lower(text))).otherwise(F.array(F.lit("<empty>")))


def looks_like_code(token: Column) -> Column:
    return token.rlike(r"_|\.|^[A-Z]|.[A-Z]")


def citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def symbols(text: Column) -> Column:
    """Capitalised words of a line, repeats kept."""
    return F.filter(F.split(text, NOT_WORD), lambda t: t.rlike(SYMBOL))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The number, from 1, of the first pattern that matches, or null."""
    out = F.lit(None).cast("int")
    for i in range(len(patterns), 0, -1):
        out = F.when(text.rlike(patterns[i - 1]), F.lit(i)).otherwise(out)
    return out


def first_hit(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches finds, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rx, 0), F.lit("")) for rx in patterns])


def secret_in_diff(diff: Column) -> Column:
    """The first twelve characters of the first secret in the added lines of a diff, or null."""
    added = F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    hits = F.filter(F.transform(added, lambda x: first_hit(F.substring(x, 2, 1 << 30), SECRETS)), lambda h: h.isNotNull())
    return F.substring(F.get(hits, F.lit(0)), 1, 12)


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    for rx, mark in rules:
        text = F.regexp_replace(text, rx, mark.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def words_but(text: Column, stop: tuple[str, ...], token: str = TOKEN, least: int = 2) -> Column:
    """Ordered distinct tokens of at least ``least`` characters that are no stop words."""
    stop_ = F.array(*[F.lit(w) for w in stop])
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda t: (F.length(t) >= least) & ~F.array_contains(stop_, F.lower(t))))


def keywords(text: Column) -> Column:
    """Search words: lower case, dots stripped, longer than two; a dotted path gives its parts, then itself."""
    low = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"^\.+|\.+$", ""))
    low = F.filter(low, lambda t: F.length(t) > 2)
    parts = lambda t: F.when(t.contains("."), F.array_append(F.filter(F.split(t, r"\."), lambda p: F.length(p) > 2), t)).otherwise(F.array(t))
    return F.array_distinct(F.flatten(F.transform(low, parts)))


#: ``file::test - Error: message``, with or without FAILED before it.
FAILURE = r"(?:FAILED\s+)?([^\s:]+(?:\.py)?)::([^\s\-]+)\s*-\s*([A-Za-z0-9_]+):\s*(.*)"


def failure_record(line: Column) -> Column:
    """struct(test_file, test_name, error_type, message) of a failure line; other lines split at their first colon."""
    part = lambda i: F.trim(F.regexp_extract(line, FAILURE, i))
    hit, at = line.rlike(FAILURE), F.instr(line, ":")
    return F.struct(
        F.when(hit, part(1)).otherwise("test").alias("test_file"), F.when(hit, part(2)).otherwise("test_execution").alias("test_name"),
        F.when(hit, part(3)).when(at > 0, F.trim(F.substring_index(line, ":", 1))).otherwise("UNKNOWN").alias("error_type"),
        F.when(hit, part(4)).when(at > 0, F.trim(F.substr(line, at + 1))).otherwise(line).alias("message"),
    )
