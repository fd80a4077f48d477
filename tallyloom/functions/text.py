"""Column builders for byte strings, paths and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_lower(x) -> Column:
    """ASCII capitals as small letters; nothing else changes (pattern search)."""
    return F.translate(_c(x), UPPER, LOWER)


def fold_upper(x) -> Column:
    """ASCII small letters as capitals (ordering); so [ \\ ] ^ _ ` sort after letters."""
    return F.translate(_c(x), LOWER, UPPER)


def bytes_to_text(x) -> Column:
    """A string whose code points are the bytes; its order is the bytes' order."""
    return F.decode(_c(x), "ISO-8859-1")


def text_to_bytes(x) -> Column:
    return F.encode(_c(x), "ISO-8859-1")


def records(x, separator: str = "\n") -> Column:
    """The records of a text; what follows the last separator counts unless it is empty."""
    parts = F.split(_c(x), "\x00" if separator == "\x00" else separator, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fixed_match(line, pattern: str | bytes, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs in the line; the empty pattern occurs in all."""
    if isinstance(pattern, bytes):
        return F.contains(_c(line), F.lit(bytearray(pattern)))
    if ignore_case:
        return F.contains(fold_lower(line), fold_lower(F.lit(pattern)))
    return F.contains(_c(line), F.lit(pattern))


def join_path(parent, name) -> Column:
    return F.concat(F.regexp_replace(_c(parent), "/+$", ""), F.lit("/"), _c(name))


def normal_path(x) -> Column:
    """Without trailing slashes, but / stays."""
    cut = F.regexp_replace(_c(x), "/+$", "")
    return F.when((cut == "") & (F.length(_c(x)) > 0), F.lit("/")).otherwise(cut)


def cwe_ids(x) -> Column:
    """The distinct CWE-<digits> of a text, by number."""
    found = F.regexp_extract_all(_c(x), F.lit("CWE-([0-9]+)"), F.lit(1))
    numbers = F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("long"))))
    return F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


# repeats are unrolled, so long literals and comments don't exhaust the matcher's stack
LITERALS = r""""[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"""
COMMENTS = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|//[^\n]*"


def code_only(x) -> Column:
    """Source with each literal and comment as a space."""
    return F.regexp_replace(_c(x), f"{LITERALS}|{COMMENTS}", " ")


def normal_source(x) -> Column:
    """C source without comments (string and character literals respected), white space collapsed."""
    bare = F.regexp_replace(_c(x), f"({LITERALS})|{COMMENTS}", "$1")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def lexical_distance(a, b) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(_c(a), _c(b)) / longest)


def physical_lines(x) -> Column:
    """How many lines, splitting at every line boundary of Unicode text."""
    parts = F.split(_c(x), LINE_ENDS, -1)
    return F.when(F.length(_c(x)) == 0, 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def human_duration(ms) -> Column:
    """Milliseconds as text: 950ms, 12.3s, 4m05s, 2h03m."""
    ms = _c(ms)
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def duration_seconds(x) -> Column:
    """Seconds of 10, 10s, 5m, 1h or 1d; null for what is none of these."""
    x = _c(x)
    unit = F.regexp_extract(x, r"^\d+(?:\.\d+)?([smhd]?)$", 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(x.rlike(r"^\d+(\.\d+)?[smhd]?$"), F.regexp_extract(x, r"^(\d+(?:\.\d+)?)", 1).cast("double") * factor)


def permission_rejected(x) -> Column:
    """Whether a log tells of a permission that was asked for and denied."""
    return F.coalesce(_c(x).rlike(r"(?i)permission[^\n]{0,80}(reject|den(y|ied))|user rejected permission"), F.lit(False))


def demote_headings(x, by: int = 1) -> Column:
    """Markdown headings, so many levels deeper."""
    return F.regexp_replace(_c(x), r"(?m)^(#+ )", "#" * by + "$1")


def indent_block(x, prefix: str = "    ") -> Column:
    return F.regexp_replace(_c(x), r"(?m)^(?=[^\n])", prefix)


def collapse(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def tail(x, n: int) -> Column:
    """The last n characters."""
    return F.right(_c(x), F.lit(n))


def without_comments(x) -> Column:
    """Markdown without HTML comments."""
    return F.regexp_replace(_c(x), r"(?s)<!--.*?-->\n?", "")


def filled(template, name: str, value) -> Column:
    """The template with its one placeholder {{name}} filled; an error unless it occurs exactly once."""
    mark = "{{" + name + "}}"
    count = F.regexp_count(_c(template), F.lit(r"\{\{" + name + r"\}\}"))
    return F.when(count == 1, F.replace(_c(template), F.lit(mark), _c(value))).otherwise(F.raise_error(F.concat(F.lit(f"{mark} occurs "), count.cast("string"), F.lit(" times"))))


def flag_list(x) -> Column:
    """The flags of a recorded command's option --implemented=a,b."""
    found = F.regexp_extract(_c(x), r"--implemented[= ]([^\s]+)", 1)
    return F.filter(F.split(found, ","), lambda f: f != "")


def utility_of(x) -> Column:
    """The utility that a source path new_<utility>.c is of."""
    return F.nullif(F.regexp_extract(_c(x), r"new_([a-z]+)\.c$", 1), F.lit(""))


def output_binary(x) -> Column:
    """The file after -o of a build command."""
    return F.nullif(F.regexp_extract(_c(x), r"(?:^|\s)-o\s+(\S+)", 1), F.lit(""))
