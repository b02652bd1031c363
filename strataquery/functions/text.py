"""Column functions over source text and paths. All stay inside whole-stage code generation or built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]+"


def identifier_terms(token: Column) -> Column:
    """The lower-cased identifier and its snake_case, CamelCase and digit parts of two characters or more."""
    parted = F.regexp_replace(token, r"([A-Z])([A-Z][a-z])", "$1_$2")
    parts = F.regexp_extract_all(parted, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lower(token)), F.filter(F.transform(parts, F.lower), lambda x: F.length(x) >= 2)))


def line_terms(line: Column) -> Column:
    """Distinct identifier terms of a line, or of a whole text. Only tokens with capitals, digits or underscores are taken
    apart: the others are their own and only part."""
    tokens = F.array_distinct(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[a-z]+$"), F.array(t)).otherwise(identifier_terms(t)))))


def token_estimate(text: Column) -> Column:
    size = F.octet_length(text)
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((size + 3) / 4))).cast("long")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """Posix-relative form; null for absolute paths and those with a parent step."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1"), r"/{2,}", "/")
    return F.when(p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"), F.lit(None)).otherwise(F.regexp_replace(p, r"/$|^\.$", ""))


#: File suffix to language.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "sql": "sql", "sh": "shell", "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("text"))


def module_name(path: Column, roots: tuple[str, ...] = ("src/", "lib/")) -> Column:
    """Dotted module of a Python file: the longest import root and a trailing __init__ are dropped."""
    stripped = path
    for r in sorted(roots, key=len, reverse=True):
        stripped = F.when(path.startswith(r), F.substring(path, len(r) + 1, 10_000)).otherwise(stripped)
    dotted = F.regexp_replace(F.replace(F.regexp_replace(stripped, r"\.pyi?$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    return F.when(path.rlike(r"\.pyi?$"), dotted)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)(tests?|spec|__tests__)/") | low.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.[a-z]+$") | low.rlike(r"\.(test|spec)\.[a-z]+$")


def path_roles(path: Column) -> Column:
    """Labels of a path; one path may serve several roles."""
    low = F.lower(path)
    labels = {
        "test": is_test_path(path),
        "documentation": low.rlike(r"(^|/)docs?/") | low.rlike(r"\.(md|rst|adoc)$"),
        "build_config": low.rlike(r"(^|/)(makefile|dockerfile|pyproject\.toml|package\.json|build\.gradle(\.kts)?|pom\.xml|cargo\.toml|go\.mod)$"),
        "ci": low.rlike(r"(^|/)\.github/workflows/"),
        "contract": low.rlike(r"(^|/)(schemas?|contracts?|proto)/") | low.rlike(r"\.(proto|avsc|graphql)$"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in labels.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("implementation"))).otherwise(found)


def impact_role(path: Column) -> Column:
    roles = path_roles(path)
    has = lambda *names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
    return F.when(has("test"), "verification").when(has("contract"), "contract").when(has("build_config", "ci"), "build_config").when(has("documentation"), "orientation").when(has("implementation"), "implementation").otherwise("other")


def is_secret_path(path: Column) -> Column:
    """Paths that are never shown: environment files, private keys and registry credentials."""
    name = F.lower(basename(path))
    return name.rlike(r"^\.env(\..*)?$") | name.rlike(r"\.(pem|key|p12|pfx)$") | name.isin(".npmrc", ".pypirc", "id_rsa", "id_ed25519")


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** crosses directories, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/" else c), i + 1
    return f"^{out}$"


def digest(*parts: Column, domain: str = "") -> Column:
    """SHA-256 of a domain and length-prefixed fields; a null field is a mark of its own, unlike any text."""
    fields = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(F.lit(domain), *fields), 256)


def short_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def dotted_prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def folder_prefixes(path: Column) -> Column:
    """All proper folder prefixes of a path, '' first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
