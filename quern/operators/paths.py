"""Operators over file paths: selection and classification by ending and directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: file endings and directories, and what they stand for ----------------------------------------------
LOADABLE = ["pdf", "docx", "md", "txt", "png", "jpg", "jpeg"]
BINARY = ["exe", "dll", "so", "dylib", "bin", "obj", "o", "a", "lib", "jar", "war", "ear", "class", "pyc", "pyo", "zip", "tar", "gz", "bz2", "rar", "7z", "jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "mp3", "mp4", "avi", "mov", "wmv", "flv", "pdf", "doc", "docx"]
SKIPPED_DIRS = ["node_modules", "venv", "env", "__pycache__", "dist", "build", "target"]
KEPT_HIDDEN = [".github", ".gitlab"]
CONTENT_TYPES = {
    "markdown": ["md", "markdown", "mdown", "mkd"],
    "wiki": ["wiki", "mediawiki", "rst", "adoc", "asciidoc"],
    "code": ["py", "js", "ts", "java", "cpp", "c", "h", "cs", "go", "rs", "rb", "php", "swift", "kt", "scala", "r", "m", "sh", "bash", "ps1", "sql"],
    "json": ["json"],
    "yaml": ["yaml", "yml", "toml", "ini", "conf", "config"],
    "text": ["txt", "text", "log"],
}
LANGUAGES = {
    "python": ["py"], "javascript": ["js"], "typescript": ["ts"], "java": ["java"], "cpp": ["cpp"], "c": ["c"], "csharp": ["cs"], "go": ["go"], "rust": ["rs"],
    "ruby": ["rb"], "php": ["php"], "swift": ["swift"], "kotlin": ["kt"], "scala": ["scala"], "r": ["r"], "shell": ["sh"], "bash": ["bash"], "powershell": ["ps1"],
    "sql": ["sql"], "markdown": ["md"], "restructuredtext": ["rst"], "latex": ["tex"],
}
MIMES = {
    "text/markdown": ["md", "markdown"], "text/plain": ["txt", "log"], "text/html": ["html", "htm"], "text/css": ["css"], "application/javascript": ["js"],
    "application/json": ["json"], "application/xml": ["xml"], "application/x-yaml": ["yml", "yaml"], "text/x-python": ["py"], "text/x-java": ["java"],
    "text/x-c": ["c", "h"], "text/x-c++": ["cpp"], "application/pdf": ["pdf"], "image/png": ["png"], "application/sql": ["sql"],
}
#: Endings that the analysis of documents takes for code.
ANALYSED_AS_CODE = ["py", "js", "ts", "java", "cpp", "c", "cs", "go", "rs", "rb", "php", "swift", "kt", "scala", "r", "sh", "ps1", "sql", "tex", "html", "css", "xml", "json", "yaml", "yml"]


def ending(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _by_ending(path, groups: dict[str, list[str]], default: str | None) -> Column:
    """A map of constants: no join is needed for a few dozen values."""
    pairs = [F.lit(x) for value, ends in groups.items() for e in ends for x in (e, value)]
    return F.coalesce(F.create_map(*pairs)[ending(path)], F.lit(default))


def content_type(path) -> Column:
    return _by_ending(path, CONTENT_TYPES, "other")


def language(path) -> Column:
    return _by_ending(path, LANGUAGES, None)


def mime(path) -> Column:
    return _by_ending(path, MIMES, "text/plain")


def list_files(files: DataFrame, allowed: list[str] = LOADABLE) -> DataFrame:
    """Files whose ending is allowed."""
    return files.where(ending("path").isin(*allowed))


def indexable(files: DataFrame) -> DataFrame:
    """Files that are not binary and not in a hidden or generated directory."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(*KEPT_HIDDEN))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRS)))
    return files.where(~ending("path").isin(*BINARY) & ~hidden & ~skipped)
