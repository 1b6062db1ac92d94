"""Text expressions: reply clean-up, import lines and path resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder marks, and the text patterns ---------------------------
PAGE_FOLDERS = ("/pages/", "/app/", "/views/", "/routes/")
PRIVATE_MARK = "/_"
DEFAULT_SUFFIX = ".tsx"
IMPORT_LINE = r"""import\s+(?:\{[^}]+\}|\w+)\s+from\s+['"]([^'"]+)['"]"""
REPLY_FENCE = r"```json\s*|\s*```"
REPLY_OBJECT = r"^[^{]*(\{[\s\S]*\})[^}]*$"
CODE_START = (
    r"(?i)((?:import|export|class|function|const|let|var|/\*|//|<!DOCTYPE|<\?|<html)[\s\S]*)"
)
CODE_FENCE = r"```[\w]*\n?|\n?```"
OUTER_SPACE = r"^\s+|\s+$"
# --------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def is_page_path(path: Column) -> Column:
    hit = F.lit(False)
    for folder in PAGE_FOLDERS:
        hit = hit | path.contains(folder)
    return hit & ~path.contains(PRIVATE_MARK)


def relative_imports(content: Column) -> Column:
    """Array of the relative import targets in order of appearance."""
    found = F.regexp_extract_all(content, F.lit(IMPORT_LINE), F.lit(1))
    return F.filter(found, lambda t: t.startswith("."))


def resolve_import(path: Column, target: Column) -> Column:
    """Path of an imported file relative to the importing file; NULL where nothing is left of it."""
    parts = F.split(path, "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    stack = F.aggregate(
        F.split(target, "/"),
        folder,
        lambda acc, part: F.when(
            part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(part == ".", acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    joined = F.array_join(stack, "/")
    has_dot = F.try_element_at(stack, F.lit(-1)).contains(".")
    named = F.when(has_dot, joined).otherwise(F.concat(joined, F.lit(DEFAULT_SUFFIX)))
    return F.when(F.size(stack) > 0, named)


def clean_reply(raw: Column) -> Column:
    """Trim, drop code fences, keep the outermost ``{...}``."""
    bare = F.regexp_replace(strip(raw), REPLY_FENCE, "")
    return F.regexp_replace(bare, REPLY_OBJECT, "$1")


def clean_code(text: Column) -> Column:
    """Drop what precedes the first code token and the fences; NULL if nothing is left."""
    body = F.regexp_extract(text, CODE_START, 1)
    body = F.when(body == "", text).otherwise(body)
    return F.nullif(strip(F.regexp_replace(body, CODE_FENCE, "")), F.lit(""))
