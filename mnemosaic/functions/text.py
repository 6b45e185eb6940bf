"""Text expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of ASCII word characters of at least so many characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\w{{{least},}}"), F.lit(0))


def token_count(text: Column, least: int = 2) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"\w{{{least},}}"))


def found_terms(text: Column, terms: list[str]) -> Column:
    """The tokens that are one of the terms, repeats included, in one pass and without a list of all tokens."""
    any_ = "|".join(sorted(terms, key=len, reverse=True))  # terms are made of word characters alone
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\w)(?:{any_})(?!\w)"), F.lit(0))


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries between ASCII words alone, as the word class already is."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def wiki_links(text: Column, longest: int = 60) -> Column:
    """Distinct targets of [[label]]."""
    found = F.regexp_extract_all(text, F.lit(rf"\[\[([^\[\]\n]{{1,{longest}}})\]\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def label_refs(text: Column, kinds: tuple[str, ...] = ("bug", "decision", "lesson", "knowledge", "rule", "fact", "plan", "task")) -> Column:
    """Distinct typed references such as bug:name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\w)(?:{'|'.join(kinds)}):[A-Za-z0-9][A-Za-z0-9_.-]{{0,59}}"), F.lit(0)))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; the text itself if it is shorter."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(F.when(n >= 3, grams).otherwise(F.array(text)))


def jaccard(a: Column, b: Column) -> Column:
    met = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(met / all_)


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def ochiai(a: Column, b: Column) -> Column:
    n = F.sqrt(F.size(F.array_distinct(a)) * F.size(F.array_distinct(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def auto_summary(text: Column, shortest: int = 20, cut: int = 220) -> Column:
    """The first sentence or line with more than so many characters, cut."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda p: F.trim(p)), lambda p: F.length(p) > shortest)
    return F.substring(F.get(parts, F.lit(0)), 1, cut)


def valid_label(label: Column) -> Column:
    return F.trim(label).rlike(r"^[A-Za-z0-9][A-Za-z0-9\-_:.]{1,60}$")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def word_token_estimate(text: Column) -> Column:
    """Tokens a model would count, from words."""
    return F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 1.5)


def char_token_estimate(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / per_token)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-9;?]*[A-Za-z]", "")


def token_estimate(text: Column) -> Column:
    """Tokens a model would count, from characters: more for text with marks or line ends, as code has; one at least, none for no text."""
    per = F.when(text.rlike(r"""[{}()\[\];=<>+*&|!?:,.\\/"'\-\t\r\n]"""), 3.2).otherwise(4.5)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / per))).cast("long")


#: Long words and what they are cut to; a table of one's own may be given instead.
ABBREVIATIONS = {
    "initializing": "init", "management": "mgmt", "application": "app", "applications": "apps", "documentation": "docs", "repository": "repo",
    "repositories": "repos", "utility": "util", "utilities": "utils", "communication": "comm", "notification": "notif", "notifications": "notifs",
}


def abbreviated(text: Column, words: dict[str, str] | None = None) -> Column:
    """Long words cut short, each with a capital if it had one. Words of paths, names of files and addresses stay."""
    out = text
    for long, short in sorted((words or ABBREVIATIONS).items(), key=lambda x: -len(x[0])):
        for w, a in ((long, short), (long.capitalize(), short.capitalize())):
            # a run of characters that aren't blanks and has / . : is left alone
            out = F.regexp_replace(out, rf"(?<=^|\s)([^\s/.:]*?)\b{w}\b(?=[^\s/.:]*(?:\s|$))", f"$1{a}")
    return out


def intent_line(text: Column, pattern: str = r"(?im)^\s*intent\s*:\s*(.+)$", most: int = 30) -> Column:
    """The first declared intent, thirty words of it; null without one."""
    found = F.trim(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", F.array_join(F.slice(F.split(found, r"\s+"), 1, most), " "))


def command_prefix(command: Column) -> Column:
    """A command before its first pipe, without changes of folder and environment in front."""
    first = F.substring_index(F.trim(command), "|", 1)
    return F.trim(F.regexp_replace(first, r"^(?:(?:source|cd)\s+\S+\s+(?:&&|;)\s*)*", ""))


def command_terms(command: Column) -> Column:
    """Lower-cased arguments of three characters or more that aren't options, without quotes and brackets."""
    parts = F.filter(F.slice(F.split(command, r"\s+"), F.lit(2), F.greatest(F.size(F.split(command, r"\s+")), F.lit(1))), lambda t: ~t.startswith("-"))
    return F.filter(F.transform(parts, lambda t: F.lower(F.regexp_replace(t, r"[\"'`()]", ""))), lambda t: F.length(t) >= 3)


def call_signature(tool: Column, args: Column) -> Column:
    """tool::JSON of the arguments (a map of strings) in order of their names, nulls left out."""
    pairs = F.array_sort(F.filter(F.map_entries(args), lambda e: e["value"].isNotNull()))
    return F.concat(tool, F.lit("::"), F.coalesce(F.to_json(F.map_from_entries(pairs)), F.lit("{}")))


#: What an answer says that gives none.
REFUSALS = ("cannot determine", "cannot answer", "not mentioned", "not provided", "no information", "does not contain", "does not provide", "i cannot", "unable to", "not enough", "not specified", "not available")


def refuses(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(low.rlike("|".join(REFUSALS)), F.lit(1.0)).otherwise(0.0)


def resolved_dates(text: Column, day: Column) -> Column:
    """Words such as yesterday or last month as dates, by the day on which they were said. The first kind that stands in the text is replaced."""
    named = lambda d, form: F.lower(F.date_format(d, form))
    low, full = F.lower(text), "d MMMM yyyy"
    kinds = [
        ("yesterday", named(F.date_sub(day, 1), full)),
        ("last week", F.concat(F.lit("week of "), named(F.date_sub(day, 7), full))),
        ("last month", named(F.add_months(day, -1), "MMMM yyyy")),
        ("last year", (F.year(day) - 1).cast("string")),
        ("next week", F.concat(F.lit("week of "), named(F.date_add(day, 7), full))),
        ("next month", named(F.add_months(day, 1), "MMMM yyyy")),
    ]
    out = F.when(day.isNull(), text)
    for word, date in kinds:
        out = out.when(low.contains(word), F.regexp_replace(text, F.lit(rf"(?i)\b{word}\b"), date))
    return out.otherwise(text)
