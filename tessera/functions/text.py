"""String expressions, all evaluated in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for a character class; a plain list is matched much faster than with the flag for Unicode classes.
SPACE = r"\s\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_BLANKS = " \t\n\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z folded, everything else as it is; the faster lower does the same where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Words of a query column: runs of letters, digits and underscores of at least two bytes, in lower case."""
    parts = F.split(c, r"[^\p{IsAlphabetic}\p{N}_]+")
    return F.transform(F.filter(parts, lambda w: F.octet_length(w) >= 2), F.lower)


def term_pattern(term: str) -> str:
    """Matches a lower-case term with no ASCII letter, digit or underscore on either side, ignoring ASCII case."""
    quoted = "".join("\\" + ch if not (ch.isalnum() or ch == "_") and ch.isascii() else ch for ch in term)
    if re.fullmatch(r"[A-Za-z0-9_]+", term):  # the first letter is sought first, then what stands before it
        return rf"(?i:{term[0]})(?<![A-Za-z0-9_].)(?i:{term[1:]})(?![A-Za-z0-9_])"
    return rf"(?<![A-Za-z0-9_])(?=(?i:{quoted})(?![A-Za-z0-9_]))"  # without width, as it may overlap itself


def term_frequency(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(term_pattern(term)))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs."""
    return text.rlike("|".join(f"(?:{term_pattern(t)})" for t in terms)) if terms else F.lit(False)


def word_count(text: Column) -> Column:
    """Words separated by Unicode white space; beyond ASCII its characters become blanks first, as one small class is
    matched faster than a long one."""
    wide = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, wide, " " * len(wide)))
    return F.regexp_count(plain, F.lit(r"\S++"))


def trim_space(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++$", "")


def slugify(title: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-")), 1, 50)


def escape_yaml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def shorten_path(path: Column) -> Column:
    """Paths of synced items become github:owner/repo#item (PR#item for pull requests); others stay."""
    at = lambda i: F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?s:.*?)sources/github/([^/]*)/([^/]*)/([^/]*)/((?s:.*))$", i)
    short = F.concat(F.lit("github:"), at(1), F.lit("/"), at(2), F.when(at(3) == "prs", " PR#").otherwise("#"), F.regexp_replace(at(4), r"\.md$", ""))
    return F.when(F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"sources/github/[^/]*/[^/]*/[^/]*/"), short).otherwise(path)


def preview(text: Column, context: int = 2, width: int = 120) -> Column:
    """The first lines of a chunk (context + 1, or 3 for 0), long ones cut, and how many follow."""
    show = 3 if context == 0 else context + 1
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n", -1)
    cut = F.transform(F.slice(lines, 1, show), lambda x: F.when(F.octet_length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x))
    more = F.size(lines) - show
    return F.array_join(F.when(more > 0, F.concat(cut, F.array(F.concat(F.lit("... ("), more.cast("string"), F.lit(" more lines)"))))).otherwise(cut), "\n")


def format_score(score: Column) -> Column:
    return F.format_string("%.4f", score.cast("double"))


def repo_argument(c: Column) -> Column:
    """owner/repo split at the first slash into a struct, null unless both parts are there."""
    ok = c.rlike(r"^[^/]+/(?s:.+)$")
    return F.when(ok, F.struct(F.regexp_extract(c, r"^([^/]+)/", 1).alias("owner"), F.regexp_extract(c, r"^[^/]+/((?s:.+))$", 1).alias("repo")))


def remote_repo(url: Column) -> Column:
    """Owner and repo of a remote address on the forge, null for other hosts."""
    rest = F.regexp_extract(url, r"^(?:git@github\.com:|https://github\.com/|http://github\.com/|ssh://git@github\.com/)(.*)$", 1)
    return repo_argument(F.rtrim(F.regexp_replace(rest, r"(?:\.git)+$", ""), F.lit("/")))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def extension(path: Column) -> Column:
    """Behind the last point of the base name; empty if there is none or the name only begins with it."""
    return F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1)


def truncate(c: Column, n: int = 50) -> Column:
    return F.substring(c, 1, n)


def line_of_offset(text: Column, prefix_bytes: Column) -> Column:
    """1-based line of a byte offset."""
    return F.regexp_count(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), prefix_bytes), "UTF-8"), F.lit("\n")) + 1


def line_count(text: Column) -> Column:
    """Lines as editors count them: a final line feed adds none, an empty text has none."""
    return F.regexp_count(text, F.lit("\n")) + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
