"""Text as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters that Python counts as white space, as a Java class
SPACE = r"(?U)[\s\x1C-\x1F]"
# line ends besides CR LF
TERMINATOR = "[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
MAX_QUERY, MAX_PROJECT = 2_000, 512
SNIPPET = 1_500
TRUNCATED = "\n…(truncated)"

# fixed values: query shapes that call for lexical search as well
CODE_SHAPES = (
    "[a-z0-9]_[a-z0-9]",  # snake case
    "[a-z][A-Z]",  # camel case
    r"[\p{L}\p{N}_]+\(",  # a call
    r"[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+",  # a member
    "/",  # a path
    "[\"'][^\\n]+[\"']",  # a quoted phrase
)


def _diacritics() -> tuple[str, str]:
    """Lower-case Latin letters with one diacritic, and their base letters."""
    marked, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c == c.lower() and base != c and base.isascii():
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _diacritics()


def normalise_newlines(text: Column) -> Column:
    """CR LF and CR become LF, as when a file is read as text."""
    return F.regexp_replace(text, "\r\n?", "\n")


def content_sha(text: Column) -> Column:
    return F.sha1(normalise_newlines(text))


def lines(text: Column) -> Column:
    """Array of lines without their ends; none for an empty text."""
    body = F.regexp_replace(text, f"(?:\r\n|{TERMINATOR})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, f"\r\n|{TERMINATOR}", -1))


def dense_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def is_blank(text: Column) -> Column:
    return dense_length(text) == 0


def tokens(text: Column) -> Column:
    """Lower-cased, accent-free runs of letters and digits; ``_`` separates."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.array_remove(F.split(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "), " "), "")


def query_terms(query: Column) -> Column:
    """Sorted distinct terms of a query: identifiers of two characters or more, and their snake and camel parts."""
    words = F.regexp_extract_all(query, F.lit("[A-Za-z_][A-Za-z0-9_]{1,}"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "_|(?<=[a-z0-9])(?=[A-Z])")))
    kept = F.filter(parts, lambda p: F.length(p) > 1)
    return F.array_sort(F.array_distinct(F.transform(F.concat(words, kept), F.lower)))


def select_mode(query: Column) -> Column:
    """hybrid for code-shaped or short queries, semantic for sentences of five words or more."""
    stripped = F.regexp_replace(query, f"^(?:{SPACE})+|(?:{SPACE})+$", "")
    words = F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, f"(?:{SPACE})+")))
    return F.when(query.rlike("|".join(CODE_SHAPES)), "hybrid").when(words >= 5, "semantic").otherwise("hybrid")


def query_problem(query: Column) -> Column:
    """Why a query is refused, or NULL."""
    return (
        F.when(F.coalesce(is_blank(query), F.lit(True)), "empty")
        .when(F.length(query) > MAX_QUERY, "too long")
        .when(query.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control characters")
    )


def project_problem(project_id: Column) -> Column:
    """Why a project id is refused, or NULL."""
    return (
        F.when(F.coalesce(is_blank(project_id), F.lit(True)), "empty")
        .when(F.length(project_id) > MAX_PROJECT, "too long")
        .when(project_id.rlike(r"[\x00-\x1F\x7F]"), "control characters")
    )


def snippet(text: Column) -> Column:
    """The text, cut after 1,500 characters with a mark."""
    return F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET), F.lit(TRUNCATED))).otherwise(text)


def fence(text: Column) -> Column:
    """A backtick fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def remote_host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL or of ``git@host:path``; NULL for anything else."""
    web = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scp = F.lower(F.regexp_extract(url, "^git@([^:]*)", 1))
    return F.nullif(F.when(url.rlike("^https?://"), web).when(url.startswith("git@"), scp), F.lit(""))


def clone_url(project_id: Column, base_url: str) -> Column:
    """The URL that a project id stands for."""
    remote = project_id.rlike("^(?:https?://|git@)")
    return F.when(remote, project_id).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), project_id, F.lit(".git")))


def suffix(path: Column) -> Column:
    """File suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def at_path_boundary(path: Column, key: Column) -> Column:
    return (path == key) | F.endswith(path, F.concat(F.lit("/"), key))
