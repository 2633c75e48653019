"""Ordered classification rules as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels, words and patterns below must be as they are for equal results.
#: (label, words) in order; the first label with a word in the text wins, else symbol_lookup.
INTENTS = (
    ("call_flow", ("call", "caller", "callee")),
    ("inheritance", ("inherit", "extends", "subclass")),
    ("dependency", ("import", "depend", "use")),
    ("implementation", ("how", "implement")),
    ("explanation", ("explain", "overview", "architecture")),
    ("debugging", ("bug", "fix", "error")),
)
RELATIONSHIPS = (("call_flow", "CALLS"), ("inheritance", "INHERITS"), ("dependency", "IMPORTS"))
INTENT_STOP_WORDS = (
    "who", "what", "where", "how", "why", "does", "is", "a", "an", "the", "in", "from", "and", "or", "to", "for", "with", "call", "calls", "calling", "inherit", "inherits", "import", "imports",
)
#: Query types: words, and for the second one the pair of words and the words that forbid it.
IMPACT_WORDS = ("if i change", "what breaks", "impact", "affected", "modifying", "change to", "if we modify")
PATH_WORDS = ("path from", "path between", "connect", "reach", "travel from")
DEPENDENCY_WORDS = ("depend", "dependency", "dependencies", "imports of")
REVERSE_WORDS = ("who calls", "what calls", "callers of", "called by", "which components call")
TRACE_WORDS = ("call trace", "trace call", "call chain", "calls from", "callees of")
ARCHITECTURE_WORDS = ("architecture", "architectural", "flow from", "endpoint to database", "travel through the system", "layer")
FEATURE_WORDS = ("feature", "implemented", "where is", "how is feature", "system flow")
QUERY_STOP_WORDS = (
    "who", "what", "where", "how", "why", "does", "is", "a", "an", "the", "in", "from", "and", "or", "to", "for", "with", "call", "calls", "calling", "inherit", "inherits",
    "import", "imports", "show", "find", "locate", "defined", "definition", "implemented", "function", "class", "method", "module", "file", "code", "if", "i", "change", "could",
    "be", "affected", "trace", "path", "between", "reach", "eventually", "components", "system",
)
QUESTION_STOP_WORDS = (
    "what", "where", "show", "find", "locate", "how", "why", "trace", "display", "investigate", "identify", "causes", "components", "depend", "dependencies",
    "data", "flow", "details", "system", "method", "class", "file", "module", "script", "entry", "point", "storage", "does", "when", "with", "from", "into",
    "after", "before", "fails", "failing", "fail", "returns", "raises", "error", "issue", "problem", "reason", "impact", "radius", "blast", "change", "modifying",
    "modified", "delete", "deleted", "remove", "removed", "all", "which", "that", "this", "there", "their", "authenticate", "access", "profile", "lookup", "creation",
    "journey", "handled", "points", "managed", "check", "implementation", "records", "database", "invalid", "parameters", "direct", "directly", "instantiation",
)
CHANGE_SKIP_WORDS = (
    "the", "and", "for", "not", "add", "reject", "invalid", "values", "value", "arguments", "argument", "input", "with", "negative", "validation", "age", "table", "users", "drop", "run", "database",
)
ANSWER_COMMON_WORDS = (
    "where", "what", "how", "who", "show", "find", "locate", "explain", "describe", "implemented", "defined", "definition", "function", "class", "method", "module",
    "file", "code", "system", "usage", "call", "calls", "caller", "callee", "issue", "flush", "search", "retrieved", "object", "objects", "stored", "persisted", "formatted", "initialized",
)
LAYERS = (
    ("entry", ("api", "route", "controller", "main", "cli", "endpoint", "handler", "server", "app")),
    ("persistence", ("repo", "repository", "db", "database", "store", "model", "dao", "entity", "sql", "orm")),
    ("boundary", ("client", "adapter", "gateway", "external", "remote", "sdk", "http")),
)
#: Asset types by words of the path, after the endings .md and .txt (MARKDOWN) and before the endings of images.
ASSETS = (
    ("ARCHITECTURE_DIAGRAM", ("arch", "overview", "diagram")),
    ("ER_DIAGRAM", ("er", "schema", "database")),
    ("UML_DIAGRAM", ("uml", "class")),
    ("UI_SCREENSHOT", ("ui", "screenshot", "mockup")),
)
IMAGES = (".png", ".jpg", ".jpeg", ".svg")
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".svg": "image/svg+xml", ".md": "text/markdown", ".txt": "text/plain", ".py": "text/x-python"}
FAILURES = (
    ("SYNTAX_ERROR", ("syntaxerror", "indentationerror", "invalid syntax")),
    ("IMPORT_ERROR", ("importerror", "modulenotfounderror", "no module named")),
    ("TYPE_ERROR", ("typeerror",)),
    ("ASSERTION_FAILURE", ("assertionerror", "assert")),
    ("TEST_TIMEOUT", ("timeout", "timed out")),
    ("MISSING_SYMBOL", ("attributeerror", "nameerror", "has no attribute", "is not defined")),
    ("PATCH_APPLICATION_FAILURE", ("patch application", "patch failed", "patch file")),
    ("REGRESSION", ("regression", "baseline")),
    ("ENVIRONMENT_FAILURE", ("environment", "no pytest")),
    ("RUNTIME_ERROR", ("keyerror", "valueerror", "indexerror", "runtimeerror")),
)
DANGEROUS = (
    r"\bdrop\s+(table|database|schema|view|index)\b",
    r"\btruncate\s+(table|\w+)\b",
    r"\balter\s+(table|database)\b",
    r"\bdelete\s+from\b",
    r"\bdatabase\s+migration\b",
    r"\bdrop\s+table\b",
)
BLOCKED_WORDS = ("migration", "schema", "database", "sql", "table")
GATE_WORDS = ("migration", "schema", "database", "table")
UNKNOWN_WORDS = ("non-existent", "unknown", "cloudformation", "swift ios", "machinelearning", "ambiguous", "redis", "graphql")
SENSITIVE = (".env", "id_rsa", "credentials", "secret", ".pem")
FORBIDDEN_GIT = ("reset", "clean", "rebase", "cherry-pick", "branch -d", "branch -D", "push --force", "push -f", "checkout .", "restore .")
FORBIDDEN_REPAIR = ("git commit", "git push", "rm -rf", "drop table", "delete from", "subprocess", "os.system", "eval(", "exec(", "chmod", "chown")
#: What a drawing of each kind shows: (asset type, word of its name, source, relation, target).
DRAWINGS = (
    ("ARCHITECTURE_DIAGRAM", "arch", "AuthService", "USES", "PostgreSQL"),
    ("ARCHITECTURE_DIAGRAM", "arch", "AuthService", "USES", "Redis"),
    ("ER_DIAGRAM", "er", "Order", "REFERENCES", "User"),
    ("UML_DIAGRAM", "uml", "AdminUser", "INHERITS", "User"),
)
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".cache", "coverage", ".htmlcov", ".idea",
    ".vscode", ".venv", "venv", "env", "node_modules", ".next", ".nuxt", "dist", "build", "target", "out", "site-packages", ".eggs",
)
MAX_FILE_BYTES = 5 * 1024 * 1024
# End of the fixed values.


def has_any(text: Column, words) -> Column:
    """Whether lower-case ``text`` holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def query_type(text: Column) -> Column:
    """The kind of analysis a question asks for; the first that fits."""
    q = F.lower(text)
    path = (has_any(q, PATH_WORDS) | q.contains(" to ") & q.contains("how does")) & ~q.contains("architecture") & ~q.contains("endpoint")
    return (
        F.when(has_any(q, IMPACT_WORDS), "IMPACT_ANALYSIS").when(path, "PATH_FINDING").when(has_any(q, DEPENDENCY_WORDS) & ~q.contains("who calls"), "DEPENDENCY_ANALYSIS")
        .when(has_any(q, REVERSE_WORDS), "REVERSE_DEPENDENCY").when(has_any(q, TRACE_WORDS), "CALL_TRACE").when(has_any(q, ARCHITECTURE_WORDS), "ARCHITECTURE_FLOW")
        .when(has_any(q, FEATURE_WORDS), "FEATURE_TRACE").otherwise("CALL_TRACE")
    )


def asset_type(path: Column) -> Column:
    low = F.lower(path)
    image = F.lit(False)
    for e in IMAGES:
        image = image | low.endswith(e)
    return F.when(low.endswith(".md") | low.endswith(".txt"), "MARKDOWN").otherwise(F.coalesce(F.nullif(by_words(path, ASSETS, ""), F.lit("")), F.when(image, "IMAGE").otherwise("SOURCE")))


def by_words(text: Column, rules, default: str) -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def mime_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(kinds[F.lower(F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1)))], F.lit("application/octet-stream"))


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe, or null."""
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.contains("../") | path.contains("..\\") | path.startswith(".."), "traversal")
        .when(path.startswith("/") | (F.substring(path, 2, 1) == ":"), "absolute")
        .when(path.contains("\0"), "null byte")
    )


def dangerous(text: Column) -> Column:
    """Whether a text asks for a change of database structure."""
    low = F.lower(text)
    out = F.lit(False)
    for rx in DANGEROUS:
        out = out | low.rlike(rx)
    return out


def risk_level(text: Column, n_files: Column, n_entities: Column) -> Column:
    """The risk of a change by all it says (objective, paths, targets, descriptions) and by its size."""
    return (
        F.when(F.coalesce(dangerous(text) | has_any(F.lower(text), BLOCKED_WORDS), F.lit(False)), "BLOCKED")
        .when((n_files > 3) | (n_entities > 5), "HIGH")
        .when((n_files >= 2) | (n_entities > 2), "MEDIUM")
        .otherwise("LOW")
    )


def request_gate(text: Column) -> Column:
    """What a request is stopped for before anything is planned."""
    low = F.lower(text)
    return F.when(dangerous(text) | has_any(low, GATE_WORDS), "BLOCKED").when(has_any(low, UNKNOWN_WORDS), "ABSTAIN").otherwise("OPEN")


def confidence(n_nodes: Column, n_citations: Column) -> Column:
    return F.when((n_nodes >= 2) & (n_citations >= 1), "high").when(n_nodes >= 1, "medium").otherwise("low")


def branch_problem(name: Column) -> Column:
    return (
        F.when(name.isNull() | (name == ""), "empty").when(F.length(name) > 100, "too long").when(name.startswith("-") | name.startswith("/"), "bad start")
        .when(name.contains("..") | name.contains("@{") | name.contains("\\"), "forbidden sequence").when(~name.rlike("^[a-zA-Z0-9_/-]+$"), "forbidden character")
    )


#: Endings of names that documents speak of as parts of a system (fixed values).
KNOWN_SUFFIXES = ("Service", "Controller", "Manager", "Repository", "Model", "View", "Handler", "Middleware", "User", "Auth", "Token", "Order")
#: Namespace of name-based ids, in hexadecimal (fixed value of the standard for URLs).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def asset_id(repository_id: Column, path: Column) -> Column:
    """``ast_`` and ten digits of the name-based id of ``repository:path``; they lie before the digit that tells the version."""
    name = F.encode(F.concat_ws(":", repository_id, path), "UTF-8")
    return F.concat(F.lit("ast_"), F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name)), 1, 10))
