"""String rules as Column expressions.

Blanks are Python's: Java's Unicode white space and U+001C to U+001F. ``\\z`` stands for the end of text, as Java's
``$`` also matches before a last line break.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_B = r"[\s\x1c-\x1f]"
#: Answers that count as none, by grader.
EMPTY_NAME = ("NONE", "N/A", "NA", "NULL", "[]", "['']", '[""]')
EMPTY_WORD = ("NONE",)
#: What a CSV reader with default settings takes for missing in answer columns.
MISSING = ("None", "N/A", "NA", "nan", "null", "NULL", "")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, rule) -> Column:
    """rule(x) with x worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(x), rule), 0)


def strip(x: Column | str) -> Column:
    """Without blanks at both ends."""
    return F.btrim(col(x), F.lit(BLANKS))


@cache
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that case folding changes further, to one character and to several, as Python's Unicode tables say."""
    changed = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.lower() == c != c.casefold()}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def ranges(chars: str) -> str:
    """A regular expression's class of some characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def folded(x: Column) -> Column:
    """Unicode's full case folding: lower case, then the characters that it leaves.

    ß aside, those are rare: a test for one range, then for all of them, spares most texts the work.
    """
    one, several = folds()
    left = "".join({**one, **several}.keys() - {"ß"})
    latin = "".join(c for c in left if ord(c) < 0x100)
    beyond = min(ord(c) for c in left if ord(c) >= 0x100)
    table = F.create_map(*(F.lit(v) for kv in several.items() for v in kv))

    def each(t: Column) -> Column:
        letters = F.regexp_extract_all(F.translate(t, "".join(one), "".join(one.values())), F.lit(r"(?s)."), F.lit(0))
        return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")

    low = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return let(low, lambda t: F.when(F.rlike(t, F.lit(f"[{latin}\\x{{{beyond:x}}}-\\x{{10ffff}}]")) & F.rlike(t, F.lit(ranges(left))), each(t)).otherwise(t))


def casefold(x: Column | str) -> Column:
    """Case folded, only letters, numbers, underscores and blanks, stripped (marks go)."""
    return strip(F.regexp_replace(folded(col(x)), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""))


def is_empty(x: Column | str, words: tuple[str, ...] = EMPTY_NAME) -> Column:
    """Null, blank or one of the words in any case."""
    up = F.upper(strip(F.coalesce(col(x), F.lit(""))))
    return (up == "") | up.isin(*words)


def candidates(x: Column | str) -> Column:
    """The answers that a text holds: list brackets, quotes, remarks in parentheses and alternatives after ``/`` cut, split at commas."""
    t = F.regexp_replace(strip(x), rf"(?U)^\[?{_B}*['\"]?", "")
    t = strip(F.regexp_replace(t, rf"(?U)['\"]?{_B}*\]?\z", ""))
    t = strip(F.regexp_replace(t, rf"(?U){_B}*\([^)]*\){_B}*\z", ""))
    halves = F.transform(F.split(t, " - ", 2), strip)
    right = F.try_element_at(halves, F.lit(2))
    kept = F.when(F.length(halves[0]) > F.length(right), right).otherwise(t)
    t = F.when(right.isNotNull(), strip(F.regexp_replace(kept, rf"(?U){_B}*\[.*?\]{_B}*\z", ""))).otherwise(t)

    def piece(p: Column) -> Column:
        p = F.regexp_replace(strip(p), r"['\"\[\]()]", "")
        p = strip(F.regexp_replace(p, rf"(?U){_B}*\([^)]*\){_B}*\z", ""))
        return strip(F.split(p, "/")[0])

    return F.filter(F.transform(F.split(t, ","), piece), lambda p: p != "")


def clean_place(x: Column | str) -> Column:
    """First line up to the first comma, without quotes, brackets, a last remark in parentheses, and dots at the end."""
    t = F.split(strip(x), "\n")[0]
    t = strip(F.regexp_replace(t, r"['\"\[\]]+", ""))
    t = strip(F.regexp_replace(t, rf"(?U){_B}*\([^)]*\){_B}*\z", ""))
    t = strip(F.split(t, ",")[0])
    return strip(F.regexp_replace(t, r"\.+\z", ""))


def parse_list(x: Column | str) -> Column:
    """A Python list literal of strings as an array; else the text without its outer brackets and quotes; blank gives none."""
    raw = strip(F.coalesce(col(x), F.lit("")))
    ready = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\x([0-9a-f]{2})", r"$1\\u00$2")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    read = F.from_json(F.when(F.startswith(ready, F.lit("[")), ready), "array<string>", options)
    plain = F.regexp_replace(raw, r"^[\[\]'\"]+|[\[\]'\"]+\z", "")
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.coalesce(read, F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(plain))))


def split_list(x: Column | str) -> Column:
    """Items of a bracketed list, without blanks and quotes; null unless bracketed."""
    t = strip(x)
    inner = F.regexp_replace(t, r"(?s)^\[(.*)\]\z", "$1")
    bare = lambda p: F.regexp_replace(strip(p), r"^['\"]+|['\"]+\z", "")
    return F.when(F.rlike(t, F.lit(r"(?s)^\[.*\]\z")), F.filter(F.transform(F.split(inner, ","), bare), lambda p: p != ""))


def json_list(items: Column) -> Column:
    """An array of texts as JSON, a blank after each comma."""
    quoted = F.transform(items, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]\z", "$1"))
    return F.concat(F.lit("["), F.array_join(quoted, ", ", "null"), F.lit("]"))


def unwrap_one(x: Column | str) -> Column:
    """A JSON list of one text becomes that text, all else stays."""
    read = F.from_json(F.when(F.startswith(strip(x), F.lit("[")), strip(x)), "array<string>")
    return F.when(F.size(read) == 1, read[0]).otherwise(col(x))


def similar(a: Column, b: Column, least: int = 4) -> Column:
    """One contains the other, both of ``least`` characters or more."""
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a))


def fill(template: Column | str, name: Column | str) -> Column:
    return F.replace(col(template), F.lit("{}"), col(name))


def split_prompt(x: Column | str) -> Column:
    """A struct of instruction and question: the parts of a prompt that ``##`` begins, a worked example with the question; double blanks go."""
    parts = F.split(F.replace(col(x), F.lit("  "), F.lit("")), "##")
    part = lambda i: F.concat(F.lit("## "), F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    question = F.when(F.size(parts) > 3, F.concat(part(3), part(4))).otherwise(part(3))
    return F.struct(part(2).alias("instruction"), question.alias("question"))


def one_line(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("\n"), F.lit(" "))


def without_thoughts(x: Column | str) -> Column:
    """What follows the first ``</think>``, up to another; without one the last line."""
    parts = F.split(col(x), "</think>")
    return strip(F.when(F.size(parts) > 1, parts[1]).otherwise(F.element_at(F.split(strip(x), "\n"), -1)))


def without_echo(whole: Column | str, prompt: Column | str) -> Column:
    return F.substr(col(whole), F.length(col(prompt)) + 1)


def id_of(uri: Column | str) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(col(uri), "/"), -1)


def model_of(file: Column | str, prefix: str) -> Column:
    """The model's name in a file's name: prefix, name, an optional mark of provenance."""
    return F.regexp_extract(col(file), rf"{prefix}_?(.*?)(?:_prov)?\.csv\z", 1)


def label(labels: Column | str, lang: Column | str, fallback: str = "en") -> Column:
    """A map's text in a language, else in the fallback."""
    return F.coalesce(F.try_element_at(col(labels), col(lang)), F.try_element_at(col(labels), F.lit(fallback)))


def ascii_only(x: Column | str) -> Column:
    """For consoles that can't print more: every other character becomes a question mark."""
    return F.regexp_replace(col(x), r"[^\x00-\x7F]", "?")
