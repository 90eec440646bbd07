"""Text column functions. All are built-ins, so they run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Lower case, only ``a-z 0-9 . ,`` and single spaces; NULL gives an empty text."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s.,]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def words(c: Column) -> Column:
    """Lower-case words and numbers in order; NULL and blank give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for NULL and blank."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def without_stopwords(c: Column, stopwords: list[str], least: int = 3) -> Column:
    """Words that are no stopwords and have at least ``least`` letters, joined by a space."""
    keep = F.filter(words(c), lambda w: ~w.isin(stopwords) & (F.length(w) >= least))
    return F.array_join(keep, " ")


def snippet(c: Column, length: int = 150) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def emails(c: Column) -> Column:
    """Distinct e-mail addresses in order of appearance, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"), F.lit(0)))


def phones(c: Column) -> Column:
    """Distinct North American telephone numbers as written."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"), F.lit(0)))


def urls(c: Column) -> Column:
    """Distinct http addresses without trailing punctuation."""
    found = F.regexp_extract_all(c, F.lit(r"""https?://[^\s"'<>)\]]+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def json_object(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` (fences and chatter around it dropped); NULL without one."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def sentences(c: Column) -> Column:
    """Sentences in order: text between ends of sentences or line ends, without blanks."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def plain(c: Column) -> Column:
    """Lower case with single spaces: texts that differ in nothing else become equal."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def truth(c: Column) -> Column:
    """Yes and no in free text as boolean; NULL if neither or both."""
    t = F.lower(F.coalesce(c, F.lit("")))
    yes, no = t.rlike(r"\b(yes|true|y)\b"), t.rlike(r"\b(no|false|n|not)\b")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def first_int(c: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(c, r"(-?\d+)", 1).try_cast("int")


def metadata_line(c: Column, name: str) -> Column:
    """Value of a ``Name: value`` line of a document; NULL if absent or blank."""
    found = F.trim(F.regexp_extract(c, rf"(?mi)^[ \t]*\**{name}\**[ \t]*:[ \t]*(.*)$", 1))
    return F.when(found != "", found)


def link_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def relaxed_json(c: Column, schema: str) -> Column:
    """JSON written with single quotes."""
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})


def lemmas(c: Column, table: dict[str, str]) -> Column:
    """Words separated by spaces, each replaced by its base form if the table has one."""
    forms = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")


def duration(c: Column) -> tuple[Column, Column]:
    """Amount and unit (minute, day, week, month) of the first duration in a text; NULL without one."""
    pattern = r"([0-9]+) (minute|day|week|month)s?\b"
    unit = F.regexp_extract(c, pattern, 2)
    return F.regexp_extract(c, pattern, 1).try_cast("int"), F.when(unit != "", unit)


def term_score(c: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that a text contains; case is ignored."""
    low = F.lower(c)
    return sum((F.when(F.contains(low, F.lit(t.lower())), F.lit(w)).otherwise(0) for t, w in weights.items()), F.lit(0))


def without_metadata(c: Column, names: list[str]) -> Column:
    """A text without lines that begin with one of the names, and without rules of dashes and the like."""
    lines = F.regexp_replace(c, rf"(?m)^({'|'.join(names)})\b.*$", "")
    return F.trim(F.regexp_replace(lines, r"(?m)^[-=*_]{3,}\s*$", ""))


def link_label(c: Column) -> Column:
    """A readable label from the last part of an address; empty if it has no path."""
    last = F.regexp_extract(c, r"^https?://[^/?#]*(?:/[^?#]*)?/([^/?#]+)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), "[-_]+", " "))


def one_of(c: Column, patterns: dict[str, str]) -> Column:
    """The first value whose pattern is found in free text (case ignored); NULL if none is."""
    out = None
    for value, pattern in patterns.items():
        hit = F.coalesce(c, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def answer_and_sources(c: Column, marker: str = "Sources:") -> tuple[Column, Column]:
    """The text before the last marker, and the distinct addresses after it (an empty array without a marker)."""
    at = F.length(c) - F.instr(F.reverse(c), marker[::-1]) - len(marker) + 1
    has = F.contains(c, F.lit(marker))
    before = F.when(has, F.rtrim(F.substring(c, F.lit(1), at.cast("int")))).otherwise(c)
    after = F.when(has, urls(F.substring(c, (at + 1).cast("int"), F.length(c)))).otherwise(F.array().cast("array<string>"))
    return before, after


def preferred(addresses: Column, host: str) -> Column:
    """The first address of a host (or below it), else the first address; NULL without any."""
    own = F.filter(addresses, lambda u: (link_host(u) == host) | link_host(u).endswith(f".{host}"))
    return F.coalesce(F.get(own, F.lit(0)), F.get(addresses, F.lit(0)))
