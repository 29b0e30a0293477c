"""Which files of a corpus are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which files count, so they must be these.
IGNORED_DIRS = ("node_modules", ".git", "vendor", "dist", "build", ".next", ".nuxt", "__pycache__", ".cache", "target", ".idea", ".vscode", ".DS_Store", "coverage", ".pytest_cache")
EXTENSIONS = (
    ".go .ts .tsx .js .jsx .py .rs .java .kt .swift .c .cpp .h .hpp .cs .rb .php .vue .svelte .sql .sh .bash .zsh "
    ".yml .yaml .toml .json .xml .html .css .scss .md .txt .cfg .ini .conf .dockerfile .proto .graphql .gql"
).split()
BARE_NAMES = ("dockerfile", "makefile", "license", ".gitignore")
SENSITIVE_NAMES = (".env", ".npmrc", ".pypirc", ".netrc", ".htpasswd", ".pgpass", "credentials", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
SENSITIVE_PARTS = ("secret", "credential", "password")
SENSITIVE_EXTENSIONS = (".key", ".pem", ".pfx", ".p12", ".ppk", ".keystore", ".jks", ".asc", ".gpg")
MOST_BYTES = 500 * 1024


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"(\.[^.]*)$", 1)


def is_indexable(name: Column) -> Column:
    return _extension(name).isin(*EXTENSIONS) | F.lower(name).isin(*BARE_NAMES)


def is_sensitive(name: Column) -> Column:
    """Files that commonly hold secrets, whatever their extension."""
    n = F.lower(name)
    out = n.isin(*SENSITIVE_NAMES) | n.startswith(".env.") | n.endswith(".env") | _extension(n).isin(*SENSITIVE_EXTENSIONS)
    for part in SENSITIVE_PARTS:
        out = out | n.contains(part)
    return out


def is_pruned(rel_path: Column) -> Column:
    """Below an ignored directory; the root's own name does not count."""
    dirs = F.split(rel_path, "/")
    return F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def in_size(length: Column, most: int = MOST_BYTES) -> Column:
    return length.between(1, most)


def source_dir(root: Column) -> Column:
    return F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)


def rel_path(root: Column, path: Column) -> Column:
    return F.substr(path, F.char_length(F.rtrim(root, F.lit("/"))) + 2)
