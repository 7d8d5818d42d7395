"""Column functions over identifiers and source text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that don't count as terms of a task.
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "handle", "handling", "in", "into", "of", "on", "or", "the", "to", "with", "add", "change", "update", "support", "implement")
#: Where an identifier breaks: at other characters, before an upper-case letter after a lower-case one or before a lower-case one, and between digits and letters.
_BREAK = r"[^\p{L}\p{Nd}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})"


def split_identifier(text: Column) -> Column:
    """The parts of an identifier or a phrase, in order: breaks at other characters, at changes of case, between letters and digits. Letters without case never break."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK, -1), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Lower-cased parts, each once, in order."""
    return F.array_distinct(F.transform(split_identifier(text), F.lower))


def significant_terms(text: Column) -> Column:
    """Tokens without stop words; if all are stop words, all tokens."""
    tokens = tokenize(text)
    kept = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def normalized_identifier(text: Column) -> Column:
    return F.array_join(tokenize(text), "")


def strip_type_arguments(text: Column) -> Column:
    """The text without what stands in brackets, however deep they are nested, and without the brackets; one that closes nothing goes too."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "[", s["depth"] + 1).when(c == "]", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        plain = (s["depth"] == 0) & ~c.isin("[", "]")
        return F.struct(depth.alias("depth"), F.when(plain, F.concat(s["kept"], c)).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.split(text, ""), state, step, lambda s: s["kept"])


def span_digest(text: Column, first: Column, last: Column) -> Column:
    """SHA-256 of the lines first .. last (from 1), both clamped to the text."""
    lines = F.split(text, "\n", -1)
    lo = F.greatest(F.lit(1), F.least(first.cast("int"), F.size(lines)))
    hi = F.greatest(lo, F.least(last.cast("int"), F.size(lines)))
    return F.sha2(F.array_join(F.slice(lines, lo, hi - lo + 1), "\n"), 256)


def bounded(text: Column, most_bytes: int) -> Column:
    """The text cut after ``most_bytes`` bytes of UTF-8 at most, between characters."""
    raw = text.cast("binary")
    cut = [F.try_validate_utf8(F.substring(raw, 1, max(0, most_bytes - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(raw) <= most_bytes, text).otherwise(F.coalesce(*cut))


def excerpt(text: Column, first: Column, last: Column, most_lines: int = 60, most_bytes: int = 12_288) -> Column:
    """The lines first .. last, at most ``most_lines``, cut after ``most_bytes`` bytes (so no character is ever split)."""
    lines = F.split(text, "\n", -1)
    lo = F.greatest(F.lit(1), F.least(first.cast("int"), F.size(lines)))
    hi = F.greatest(lo, F.least(last.cast("int"), F.size(lines), lo + most_lines - 1))
    return bounded(F.array_join(F.slice(lines, lo, hi - lo + 1), "\n"), most_bytes)


def fingerprint(parts: Column) -> Column:
    """SHA-256 over the parts of an array, each followed by NUL."""
    return F.sha2(F.concat(F.array_join(parts, "\x00"), F.lit("\x00")), 256)


def migration_version(name: Column) -> Column:
    """The positive number before the first underscore of a file name without its extension; null if there is none."""
    base = F.regexp_replace(name, r"\.[^./]*$", "")
    number = F.regexp_extract(base, r"^[+]?([0-9]+)_", 1).try_cast("int")
    return F.when(number > 0, number)


#: What a message of a missing module has in it, and what is said before it.
MISSING_MODULE = ("could not import", "cannot find module", "no required module provides package", "module lookup disabled")
MISSING_SAID = "missing module dependency: "


def package_message(message: Column) -> Column:
    """The trimmed message, with what is wrong before it if a module is missing."""
    plain = F.regexp_replace(message, r"^\s+|\s+$", "")
    missing = F.lit(False)
    for part in MISSING_MODULE:
        missing = missing | F.contains(F.lower(plain), F.lit(part))
    return F.when(missing, F.concat(F.lit(MISSING_SAID), plain)).otherwise(plain)
