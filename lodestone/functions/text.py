"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns, words and marks decide results, so they equal what users' data were made with.
TOKEN = r"[A-Za-z_][A-Za-z0-9_.:/-]*|[0-9]+"
EMAIL = r"(?U)(?<![\w.-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
SECRET = r"(?i)(?:sk-or-v1-[A-Za-z0-9_-]{20,}|(?:api[_-]?key|token|secret|password)\s*[:=]\s*[\"']?[^\s\"']{8,})"
ABSOLUTE_PATH = r"(?U)(?<![\w])(?:/Users|/home|/workspace|[A-Za-z]:\\\\)[^\s\"'`]+"
EMAIL_MARK, SECRET_MARK, PATH_MARK = "[REDACTED_EMAIL]", "[REDACTED_SECRET]", "[REDACTED_ABSOLUTE_PATH]"
META_PHRASE = r"(?i)\b(?:provided|supplied|above)\s+(?:context|evidence|packet)\b"
UUID_LIKE = r"(?i)\b[0-9a-f]{8}-[0-9a-f-]{27,}\b"
SHA_LIKE = r"(?i)\b[0-9a-f]{40}\b"
TOPIC_ROOTS = ("cmd", "internal", "pkg")


def tokens(text: Column) -> Column:
    """Identifier-like words and runs of digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def token_line(text: Column) -> Column:
    """The ``tokens``, which have no spaces and are ASCII, with a space between."""
    return F.lower(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), " "))


def redact(text: Column) -> Column:
    """Marks in place of e-mail addresses, secrets and absolute paths, in this order."""
    for pattern, mark in ((EMAIL, EMAIL_MARK), (SECRET, SECRET_MARK), (ABSOLUTE_PATH, PATH_MARK)):
        text = F.regexp_replace(text, pattern, mark)
    return text


def is_sensitive(text: Column) -> Column:
    return text.rlike(EMAIL) | text.rlike(SECRET) | text.rlike(ABSOLUTE_PATH)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space collapsed, ends trimmed, lower case."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def windows(text: Column, size: int, overlap: int) -> Column:
    """A text in windows of at most ``size`` characters, as an array; none of an empty text.

    A window that isn't the last ends before the last line end of its second half, if there is one, and the next one
    begins ``overlap`` characters before that end. The fold's state is what is left of the text and the windows so far.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    half = max(1, size // 2)
    most = F.ceil(F.length(text) / max(1, half - overlap)).cast("int") + 1  # each fold but the last goes ahead that far

    def cut(rest: Column) -> Column:
        back = F.instr(F.reverse(F.substring(rest, half + 1, size - half)), "\n")
        return F.when(F.length(rest) <= size, F.length(rest)).when(back > 0, size - back).otherwise(size)

    def fold(state: Column, _: Column) -> Column:
        rest, n = state["rest"], F.length(state["rest"])
        ahead = F.when(n > size, F.substring(rest, F.greatest(F.lit(1), cut(rest) - overlap) + 1, n))
        own = F.array_append(state["done"], strip(F.substring(rest, F.lit(1), cut(rest))))
        return F.struct(ahead.alias("rest"), F.when(n > 0, own).otherwise(state["done"]).alias("done"))

    none = F.array().cast("array<string>")
    cutting = F.aggregate(F.sequence(F.lit(1), most), F.struct(text.alias("rest"), none.alias("done")), fold, lambda state: state["done"])
    return F.when(F.length(text) > size, cutting).when(F.length(text) > 0, F.array(text)).otherwise(none)


def word_count(text: Column) -> Column:
    s = strip(text)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def first_line(text: Column) -> Column:
    return F.split(text, "\n")[0]


def topic_key(path: Column) -> Column:
    """The part of a file path that names its topic; null where it has none."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    deep = (n >= 3) & F.get(parts, F.lit(0)).isin(*TOPIC_ROOTS)
    return F.when(n > 0, F.array_join(F.slice(parts, 1, F.when(deep, 3).otherwise(2)), "/"))


def topic_keys(paths: Column) -> Column:
    """The first five topics, in order, of a list of paths."""
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.transform(paths, topic_key)))), 1, 5)


def diff_sections(patch: Column) -> Column:
    return F.filter(F.split(patch, r"(?m)(?=^diff --git )"), lambda s: s != "")


def changed_files(listing: Column) -> Column:
    """What follows the last tab of each line that has one."""
    return F.transform(F.filter(F.split(listing, "\n"), lambda x: x.contains("\t")), lambda x: F.regexp_extract(x, r"[^\t]*$", 0))


def title(turn_type: Column, tool: Column) -> Column:
    """The kind of turn before its tool; without a tool, in plain words."""
    return F.when(tool.isNotNull() & (tool != ""), F.concat_ws(": ", turn_type, tool)).otherwise(F.translate(turn_type, "_", " "))


def ngrams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours, in lower case."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


# These words, in this order, decide the mode.
TEMPORAL_RULES = [
    ("as_of", ("as of", "before ")),
    ("evolution", ("evolve", "history", "over time", "changed over")),
    ("introduced", ("introduced", "first added", "originally")),
    ("latest", ("latest", "most recent", "newest")),
    ("current", ("current", "now", "currently", "how does")),
]


def temporal_mode(query: Column) -> Column:
    """How a question relates to time, by the first rule with a word in it."""
    q, out = F.lower(query), F
    for mode, terms in TEMPORAL_RULES:
        hit = F.lit(False)
        for t in terms:
            hit = hit | q.contains(t)
        out = out.when(hit, F.lit(mode))
    return out.otherwise(F.lit("neutral"))
