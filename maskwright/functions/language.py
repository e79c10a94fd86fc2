"""Which language a text is in: by extension, then by its first line, then by what it looks like."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language by file extension.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".java": "java", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".md": "markdown", ".markdown": "markdown",
}
# C++ in a header, interpreters in a first line, and the looks of languages, in order. (?Ud) makes Java match as Python does.
_CPP_HEADER = r"(?Udm)^\s*(class|namespace|template\s*<)\b|^\s*(public|private|protected)\s*:"
_SHEBANGS = ((r"python", "python"), (r"\b(bash|sh|zsh)\b", "shell"), (r"\bnode\b", "javascript"))
_LOOKS = (
    (r"(?Udm)^\s*def\s+\w+\s*\(.*\)\s*:", "python"),
    (r"(?Udm)^\s*(import|class)\s+[\w.]+.*;\s*$", "java"),
    (r"(?Udm)^\s*package\s+\w+", "go"),
    (r"(?Ud)\bfn\s+\w+\s*\(", "rust"),
    (r"(?Ud)\bfunction\s+\w+\s*\(|=>\s*\{", "javascript"),
    (r"(?Uidm)^\s*SELECT\s+.+\s+FROM\s+", "sql"),
    (r"(?Udm)^\s*[\w.-]+:\s+\S", "yaml"),
    (r"(?Udm)^#{1,6}\s+\S", "markdown"),
)


def _cases(column: Column, cases, otherwise: Column) -> Column:
    out = None
    for pattern, language in cases:
        out = (F if out is None else out).when(column.rlike(pattern), F.lit(language))
    return out.otherwise(otherwise)


def by_extension(path: Column, text: Column) -> Column:
    """Language of the lower-cased extension of the last path segment, null if unknown; a C header with C++ in it is C++."""
    suffix = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s)[^.].*(\.[^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when((suffix == ".h") & text.rlike(_CPP_HEADER), F.lit("cpp")).otherwise(F.try_element_at(table, suffix))


def by_shebang(text: Column) -> Column:
    """Language of the interpreter in a first line that begins ``#!``, else null."""
    first = F.regexp_extract(text, r"^#![^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]*", 0)
    return F.when(first != "", _cases(first, [(f"(?Ud){p}", n) for p, n in _SHEBANGS], F.lit(None).cast("string")))


def by_looks(text: Column) -> Column:
    """Language by the looks of a text; ``text`` if nothing fits."""
    bare = F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    first, last = F.substring(bare, 1, 1), F.substring(bare, -1, 1)
    return F.when(bare == "", F.lit("text")).when(first.isin("{", "[") & last.isin("}", "]"), F.lit("json")).when(first == "<", F.lit("xml")).otherwise(_cases(text, _LOOKS, F.lit("text")))


def language_of(path: Column, text: Column) -> Column:
    return F.coalesce(by_extension(path, text), by_shebang(text), by_looks(text))
