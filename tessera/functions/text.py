"""Column functions over paths, texts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File policy.
MAX_FILE_BYTES = 5 * 1024 * 1024
IGNORED_DIRECTORIES = [".git", ".svn", ".hg", "node_modules", "bin", "obj", ".vs", ".idea", "dist", "build", "coverage"]
TEXT_EXTENSIONS = [".cs", ".csproj", ".sln", ".props", ".targets", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".md", ".txt", ".json", ".yml", ".yaml", ".toml", ".xml", ".config", ".sql", ".ps1", ".sh", ".bat", ".cmd"]
DOCUMENT_EXTENSIONS = [".docx", ".pdf"]
# Language labels.
LANGUAGES = {
    "csharp": [".cs"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx"], "python": [".py"], "go": [".go"], "rust": [".rs"],
    "java": [".java"], "json": [".json"], "yaml": [".yml", ".yaml"], "toml": [".toml"], "xml": [".xml", ".csproj", ".props", ".targets"],
    "markdown": [".md"], "sql": [".sql"], "shell": [".ps1", ".sh"], "word": [".docx"], "pdf": [".pdf"],
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normalise_path(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(TEXT_EXTENSIONS + DOCUMENT_EXTENSIONS) | (F.lower(file_name(path)) == "dockerfile")


def is_eligible(path: Column, size: Column, most_bytes: int = MAX_FILE_BYTES) -> Column:
    """Small enough, outside ignored directories, no key material, and of a supported kind."""
    ignored = F.arrays_overlap(F.split(F.lower(normalise_path(path)), "/"), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    private = F.lower(file_name(path)).rlike(r"(^\.env$)|(\.pem$)|(\.key$)")
    return (size <= most_bytes) & ~ignored & ~private & is_supported(path)


def language_of(path: Column) -> Column:
    ext, out = extension(path), F.lit("text")
    for name, ends in LANGUAGES.items():
        out = F.when(ext.isin(ends), name).otherwise(out)
    return out


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def file_id(source: Column, path: Column, known: Column | None = None) -> Column:
    """A file keeps the id it has once been given."""
    fresh = F.sha2(F.concat_ws("\n", source, path).cast("binary"), 256)
    return fresh if known is None else F.coalesce(known, fresh)


def chunk_id(source: Column, path: Column, locator: Column, content: Column, chunker: Column, version: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("\n", source, path, locator, content, chunker, version, fingerprint).cast("binary"), 256)


def object_uuid(identity: Column) -> Column:
    """UUID from the first 16 bytes of SHA-256 with version 5 and variant bits; the first three groups are little-endian."""
    h = F.sha2(identity.cast("binary"), 256)

    def byte(i: int) -> Column:
        return F.substring(h, 2 * i + 1, 2)

    def forced(i: int, keep: int, bits: int) -> Column:
        return F.lower(F.lpad(F.hex(F.conv(byte(i), 16, 10).cast("int").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(bits))), 2, "0"))

    seventh, ninth = forced(7, 0x0F, 0x50), forced(8, 0x3F, 0x80)
    return F.concat(byte(3), byte(2), byte(1), byte(0), F.lit("-"), byte(5), byte(4), F.lit("-"), seventh, byte(6), F.lit("-"), ninth, byte(9), F.lit("-"), *(byte(i) for i in range(10, 16)))


def root_hash(path: Column) -> Column:
    """Opaque identity of a root folder: upper-cased, closing slashes off."""
    return F.sha2(F.upper(F.regexp_replace(path, r"(.)[/\\]+$", "$1")).cast("binary"), 256)


def token_upper_bound(text: Column) -> Column:
    return F.lit(2) + F.length(F.regexp_replace(text, r"(?U)\s", ""))


def lines(text: Column) -> Column:
    return F.split(normalise_newlines(text), "\n", -1)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, numbered from 1, both included."""
    return F.array_join(F.slice(lines(text), first, last - first + 1), "\n")


def context_text(path: Column, first: Column, last: Column, content: Column, identity: Column, expected: Column, most: int = 12_000) -> Column:
    """path:first-last, a blank line, and the content cut to ``most`` characters with a notice; null unless the identities agree."""
    cut = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n\n[truncated]"))).otherwise(content)
    return F.when(identity == expected, F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n\n"), cut))


def prefixed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)


def pre_tokens(text: Column) -> Column:
    """What WordPiece starts from: lower-cased runs of a-z, 0-9 and _, and every other character that isn't blank."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([a-z0-9_]+|[^\s])"), 1)


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
