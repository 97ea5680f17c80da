"""Name normalizers, character classes and the exclusion predicate.

All are Column expressions (JVM side, codegen). Java regex needs ``(?U)`` so
that ``\\s`` covers Unicode whitespace (NBSP, ...) the way Python's ``re`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_compare(x: Column | str, case_sensitive: bool = False) -> Column:
    """Last dot segment, drop space ``_`` ``-`` ``.``, lower-case."""
    seg = F.element_at(F.split(_c(x), r"\."), -1)
    out = F.translate(seg, " _-", "")
    return out if case_sensitive else F.lower(out)


def norm_array(x: Column | str) -> Column:
    """Drop space ``_`` ``-`` ``.`` (no segment split), lower-case."""
    return F.lower(F.translate(_c(x), " _-.", ""))


def norm_exclusion(x: Column | str) -> Column:
    """Drop space ``_`` ``-`` ``.`` ``:``, lower-case."""
    return F.lower(F.translate(_c(x), " _-.:", ""))


def norm_category(x: Column | str, case_sensitive: bool = False) -> Column:
    """Drop space ``_`` ``-`` (dots kept), lower-case."""
    out = F.translate(_c(x), " _-", "")
    return out if case_sensitive else F.lower(out)


# Allowed characters in values and in names.
VALUE_ALLOWED = r"a-zA-Z0-9\s_\-.(),:;\"'"
NAME_ALLOWED = r"a-zA-Z0-9\s_\-.()"
# Python's \s also matches the information separators U+001C..U+001F.
_PY_EXTRA_SPACE = r"\x{1C}-\x{1F}"


def special_chars(x: Column | str, allowed: str = VALUE_ALLOWED) -> Column:
    """Distinct characters outside ``allowed``, first-seen order."""
    pat = f"(?U)([^{allowed}{_PY_EXTRA_SPACE}])"
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(pat), 1))


def has_special_name(x: Column | str) -> Column:
    """P17 boolean form: an empty name counts as special."""
    return ~_c(x).rlike(f"(?U)^[{NAME_ALLOWED}{_PY_EXTRA_SPACE}]+$")


# Names expected to carry special characters (chemistry
# notations), compared against the P14-normalized path. Tokens holding "_"
# can never be contained in a normalized name; only the reverse test can hit.
DEFAULT_EXCLUDED = (
    "helm", "helms", "helmnotation", "helm_notation",
    "molstructure", "molstructure_smiles", "molstructuresmiles",
    "smiles", "smile", "smiles_notation", "smilesnotation",
    "fragment_similarity", "fragmentsimilarity",
    "fragment_similarity_smiles", "fragmentsimilaritysmiles",
    "pbm_smiles", "ubm_smiles", "pd_smiles", "photolabile_smiles",
    "modification_in_smiles", "modificationinsmiles", "parameters", "parameter",
)
# Substrings that always exclude (fixed values).
ALWAYS_EXCLUDED_SUBSTRINGS = ("molstructure", "helm", "smiles", "smile")


def excluded(path: Column | str, keywords: Column | None = None, reverse: bool = True) -> Column:
    """Is a field path exempt from special-character profiling?

    ``keywords``: ARRAY<STRING> column of catalog keywords (any case/separators).
    ``reverse``: also exclude when the name is contained in a built-in token.
    """
    n = norm_exclusion(path)
    # one search for all tokens; a name has no space left, so it lies within one of the joined tokens
    hit = n.rlike("|".join((*DEFAULT_EXCLUDED, *ALWAYS_EXCLUDED_SUBSTRINGS)))
    if reverse:
        hit = hit | F.lit(" ".join(DEFAULT_EXCLUDED)).contains(n)
    if keywords is not None:
        hit = hit | F.coalesce(F.exists(keywords, lambda k: n.contains(norm_exclusion(k))), F.lit(False))
    return hit
