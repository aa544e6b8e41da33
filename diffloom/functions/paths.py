"""Predicates and projections over file paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "typescript": [".ts", ".mts", ".cts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "json": [".json"],
    "python": [".py", ".pyi"],
    "css": [".css"],
    "go": [".go"],
    "rust": [".rs"],
    "ruby": [".rb", ".rake", ".gemspec", ".ru", ".podspec"],
    "bash": [".sh", ".bash", ".command"],
    "dockerfile": [".dockerfile"],
    "hcl": [".tf", ".tfvars", ".hcl"],
    "toml": [".toml"],
    "ini": [".ini", ".cfg", ".properties", ".env"],
    "diff": [".patch", ".diff"],
    "xml": [
        ".xml", ".plist", ".storyboard", ".xib", ".xcscheme", ".entitlements", ".xcprivacy",
        ".xcworkspacedata",
    ],
    "sql": [".sql"],
    "kotlin": [".kt", ".kts"],
    "html": [".html", ".htm"],
    "swift": [".swift"],
    "yaml": [".yml", ".yaml"],
    "graphql": [".graphql", ".gql", ".graphqls"],
    "markdown": [".md", ".markdown", ".mdx"],
    "svg": [".svg"],
}

# Languages by exact file name.
FILENAMES = {
    "ruby": [
        "Gemfile", "Rakefile", "Podfile", "Fastfile", "Appfile", "Pluginfile", "Matchfile", "Gymfile",
        "Scanfile", "Snapfile", "Deliverfile", "Precheckfile", "Dangerfile",
    ],
    "bash": [
        ".bashrc", ".bash_profile", ".bash_login", ".bash_logout", ".profile", "gradlew", "pre-commit",
        "pre-push", "commit-msg",
    ],
    "dockerfile": ["Dockerfile", "Containerfile"],
    "markdown": ["README"],
    "toml": ["Cargo.lock", "uv.lock", "poetry.lock", "pdm.lock", "Pipfile"],
    "ini": [".npmrc", ".editorconfig", ".gitconfig", ".gitmodules"],
}

# Names of code fences that are neither a language nor an extension.
FENCE_ALIASES = {
    "shell": "bash",
    "shellscript": "bash",
    "zsh": "bash",
    "jsonc": "json",
    "json5": "json",
    "docker": "dockerfile",
    "terraform": "hcl",
}

# Lockfile names.
LOCKFILES = [
    "pnpm-lock.yaml", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "bun.lock", "bun.lockb",
    "deno.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "composer.lock",
    "go.sum", "flake.lock", "mix.lock", "pubspec.lock", "Podfile.lock", "Package.resolved",
    "packages.lock.json", "gradle.lockfile",
]

# Patterns of generated files and of generator markers.
GENERATED_NAME = (
    r"\.min\.(?:js|css)$|\.(?:js|css)\.map$|\.generated\.\w+$|\.g\.dart$|\.pb\.go$|_pb2\.pyi?$"
)
GENERATED_META = r"(?:^|/)meta/(?:_journal|\d{4}_snapshot)\.json$"
GENERATED_MARKER = r"(?i)@generated\b|\bDO NOT EDIT\b|\bauto-?generated\b"
MARKER_CHARS = 1024

# Patterns of test and fixture paths.
TEST_FOLDER = (
    r"(?:^|/)(?:test|tests|__tests__|__test__|spec|specs|__mocks__|fixtures|fixture|__fixtures__|testdata"
    r"|test-data|test_data|test-utils|test_utils|e2e|cypress|playwright|integration-tests"
    r"|integration_tests|Tests|androidTest|testFixtures|__snapshots__)(?:/|$)"
)
TEST_FILE = (
    r"(?:^|/)(?:[^/]*\.snap|[^/]*\.test\.[^/]*|[^/]*_test\.[^/]*|test_[^/]*\.py|[^/]*_test\.py"
    r"|(?:[^/]*\.spec|[^/]*_spec|[^/]*-spec)\.(?:[^/]*\.)*(?:js|jsx|ts|tsx|mjs|cjs|mts|cts|py|rb|go|rs"
    r"|java|kt|kts|scala|groovy|php|cs|swift|dart|ex|exs)|[^/]*(?:Test|Tests)\.(?:java|kt|kts|scala"
    r"|groovy|php|cs|swift|dart)|[^/]*Spec\.(?:java|kt|kts|scala|groovy|js|ts)|[^/]*IT\.java"
    r"|[^/]*\.bats|[^/]*\.feature|[^/]*\.e2e\.[^/]*|[^/]*\.cy\.[^/]*|setupTests\.[^/]*"
    r"|test-setup\.[^/]*|test_setup\.[^/]*|conftest\.py)$"
)


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty when the file name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language_for_path(path: Column) -> Column:
    name = base_name(path)
    by_name = _lookup((n, lang) for lang, names in FILENAMES.items() for n in names)
    by_ext = _lookup((e, lang) for lang, exts in EXTENSIONS.items() for e in exts)
    return F.coalesce(
        F.try_element_at(by_name, name),
        F.when(name.startswith("Dockerfile."), F.lit("dockerfile")),
        F.when(name.startswith(".env."), F.lit("ini")),
        F.when(F.lower(name).rlike(r"\.ya?ml\.liquid$"), F.lit("yaml")),
        F.try_element_at(by_ext, extension(path)),
    )


def fence_language(name: Column) -> Column:
    """The language a code fence names; Markdown itself stays plain."""
    lower = F.lower(name)
    known = F.when(lower.isin(list(EXTENSIONS)), lower)
    aliases = _lookup(FENCE_ALIASES.items())
    found = F.coalesce(
        known, F.try_element_at(aliases, lower), language_for_path(F.concat(F.lit("fence."), lower))
    )
    return F.when(found != "markdown", found)


def produced_by(path: Column, text: Column) -> Column:
    """``lockfile``, ``generated`` or null: what made the file rather than a person."""
    name = base_name(path)
    return (
        F.when(name.isin(LOCKFILES), "lockfile")
        .when(name.rlike(GENERATED_NAME) | path.rlike(GENERATED_META), "generated")
        .when(F.substring(text, 1, MARKER_CHARS).rlike(GENERATED_MARKER), "generated")
    )


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_FOLDER) | path.rlike(TEST_FILE)


def change_status(before: Column, after: Column, old_path: Column, path: Column) -> Column:
    return (
        F.when(before.isNull(), "added")
        .when(after.isNull(), "deleted")
        .when(old_path.isNotNull() & (old_path != path), "renamed")
        .otherwise("modified")
    )


def collapse_reason(
    produced: Column,
    deleted: Column,
    fallback: Column,
    changed_lines: Column,
    only_moves: Column,
    no_edits: Column,
) -> Column:
    """Why a file may be shown folded, the first reason that holds, or null."""
    lines = F.coalesce(changed_lines, F.lit(2**31 - 1))
    return F.coalesce(
        F.when(~((produced == "lockfile") & (lines <= 10)), produced),
        F.when(deleted, "deleted"),
        F.when((fallback == "too-large") & (lines > 400), fallback),
        F.when(only_moves, "moved"),
        F.when(no_edits, "format-only"),
    )


def fallback_class(chars: Column, nodes: Column, error_chars: Column) -> Column:
    """``too-large`` or ``parse-error`` for a side that takes the line path, else null."""
    return F.when((chars > 500_000) | (nodes > 50_000), "too-large").when(
        error_chars > 0.1 * chars, "parse-error"
    )


def is_inflated(display_changed: Column, source_changed: Column) -> Column:
    return (source_changed > 0) & (
        display_changed > F.greatest(F.lit(100).cast("bigint"), source_changed.cast("bigint") * 10)
    )


def path_contains(path: Column, query: Column) -> Column:
    return F.contains(F.lower(path), F.lower(query))
