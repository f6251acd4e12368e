"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a title that are no keywords.
STOP_WORDS = (
    "a", "an", "the", "of", "for", "in", "on", "with", "and", "or", "to", "is", "by", "from", "at", "its", "via", "are", "we", "our", "can", "be", "has", "have", "this", "that", "it", "not", "but", "as",
    "do", "how", "what", "which", "into", "over", "new", "more", "than",
)
#: Words that are no terms of a topic.
TERM_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "via", "with", "we", "our", "using", "based", "towards", "toward",
    "across", "new", "study", "paper", "method", "methods", "results",
)


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; accented letters part words."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(x: Column) -> Column:
    return F.array_distinct(tokens(x))


def hashed_set(x: Column) -> Column:
    """The set's 64-bit hashes: sets of numbers are compared several times as fast as sets of strings."""
    return F.array_distinct(F.transform(x, lambda w: F.xxhash64(w)))


def blank_split(x: Column, longer_than: int = 0) -> Column:
    """Distinct lower-case words between blanks, of more than so many characters."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(x)), r"\s+"), lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two sets as arrays; 0 if one is empty, ``both_empty`` if both are."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / F.when(union > 0, union))


def may_exceed(a: Column, b: Column, least: float) -> Column:
    """False only if the Jaccard similarity is below ``least``; as a filter it intersects the sets once, where the similarity itself would do so
    several times."""
    return F.size(F.array_intersect(a, b)) * (1 + least) >= least * (F.size(a) + F.size(b)) - 1e-6


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(least > 0, least))


def without_control(x: Column) -> Column:
    """The text without control characters other than line feed and tab."""
    return F.regexp_replace(x, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")


def shortened(x: Column, n: int) -> Column:
    """At most n characters; a longer text ends in three dots."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 3)), F.lit("..."))).otherwise(x)


def phrase(x: Column) -> Column:
    """The tokens joined by single blanks."""
    return F.array_join(tokens(x), " ")


def title_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def short_hash(x: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, digits)


def keyword_list(keywords: Column, title: Column) -> Column:
    """Sorted distinct lower-case keywords; without any, the title's runs of letters and digits that begin with a letter, of
    three or more, that aren't stop words, in order."""
    clean = F.sort_array(F.array_distinct(F.filter(F.transform(keywords, lambda k: F.trim(F.lower(k))), lambda k: k != "")))
    runs = F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit("[A-Za-z][A-Za-z0-9]+"), F.lit(0)), F.lower))
    words = F.filter(runs, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.when(F.size(F.coalesce(clean, F.array().cast("array<string>"))) > 0, clean).otherwise(F.coalesce(words, F.array().cast("array<string>")))


def coerced_score(x: Column) -> Column:
    """A score on another scale (above 1) divided by ten, kept between 0 and 1, rounded to 4 places; unreadable is null."""
    v = x.try_cast("double")
    return F.when(v.isNotNull(), F.round(F.least(F.greatest(F.when(v > 1, v / 10).otherwise(v), F.lit(0.0)), F.lit(1.0)), 4))


def h1_title(markdown: Column) -> Column:
    """The first level-one heading; null if there is none."""
    found = F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(found != "", found)


def section(markdown: Column, name: str) -> Column:
    """The text under a heading of this name, up to the next heading; null if missing or blank."""
    found = F.trim(F.regexp_extract(markdown, rf"(?ims)^#+[ \t]*{name}[ \t]*:?[ \t]*$\n(.*?)(?=^#{{1,6}}[ \t]+\S|\z)", 1))
    return F.when(found != "", found)


def preamble(markdown: Column) -> Column:
    """The lines "Key: value" between the title and the first other line, as a map with keys in lower case and underscores.

    A fold over the lines with a state: 0 before the first pair, 1 within, 2 after.
    """
    lines = F.split(markdown, "\n")
    empty = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<key:string,value:string>>").alias("kv"))

    def step(acc: Column, line: Column) -> Column:
        is_pair = line.rlike(r"^[A-Za-z][A-Za-z ]{1,30}:[ \t]*\S")
        skip = (F.trim(line) == "") | (line.rlike("^# ") & (acc["s"] == 0))
        key = F.regexp_replace(F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))), " +", "_")
        value = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        known = F.exists(acc["kv"], lambda e: e["key"] == key)
        added = F.when(known, acc["kv"]).otherwise(F.concat(acc["kv"], F.array(F.struct(key.alias("key"), value.alias("value")))))
        return (
            F.when(acc["s"] == 2, acc)
            .when(skip, acc)
            .when(is_pair, F.struct(F.lit(1).alias("s"), added.alias("kv")))
            .otherwise(F.struct(F.lit(2).alias("s"), acc["kv"].alias("kv")))
        )

    return F.map_from_entries(F.aggregate(lines, empty, step)["kv"])


def bibliography(markdown: Column) -> Column:
    """The entries of the References section: a numbered or bulleted line or one after a blank line begins an entry, other lines go on with it."""
    body = F.coalesce(section(markdown, "(?:References|Bibliography)"), F.lit(""))
    marked = F.regexp_replace(body, r"(?m)^[ \t]*(?:\[\d+\]|\d+[.)]|[-*])[ \t]+", "\u0001")
    entries = F.split(F.regexp_replace(marked, r"\n[ \t]*\n", "\u0001"), "\u0001")
    return F.filter(F.transform(entries, lambda e: F.trim(F.regexp_replace(e, r"\s+", " "))), lambda e: e != "")


def summary(markdown: Column, most: int = 1500) -> Column:
    """The Summary section, else the Abstract, else the text before the first heading (from its paragraph "Abstract: ..." on, if there is one),
    else all text before the references; title and preamble don't count. Runs of blanks become one, line breaks stay; at most so many characters."""
    body = F.regexp_replace(markdown, r"\A\s*(?:#[ \t][^\n]*(?:\n|\z))?(?:[ \t]*\n|[A-Za-z][A-Za-z ]{1,30}:[ \t]*\S[^\n]*(?:\n|\z))*+", "")
    preface = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?ms)\A(.*?)(?=^#{1,6}\s+\S|\z)", 1), r"^\s+|\s+$", ""))
    abstract = F.regexp_replace(F.regexp_extract(preface, r"(?is)(?:\A|\n[ \t]*\n)\s*abstract\s*[-—–:]\s*(.*)\z", 1), r"\s*\n[ \t]*\n\s*", "\n\n")
    rest = F.regexp_replace(body, r"(?ims)^(?:#+[ \t]*)?references[ \t]*$.*\z", "")
    chosen = F.coalesce(section(markdown, "Summary"), section(markdown, "Abstract"), F.when(abstract != "", abstract), F.when(preface != "", preface), rest)
    clean = F.regexp_replace(F.regexp_replace(chosen, "[ \t]+", " "), r"^\s+|\s+$", "")
    return F.when(clean != "", F.regexp_replace(F.substring(clean, 1, most), r"\s+$", ""))


def without_thinking(x: Column) -> Column:
    """The text after a closed think block; an unclosed block is cut off."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*\z", ""))


def judged(reply: Column, dimension: str, lenient: bool = False) -> Column:
    """The score 0 to 3 that a line of a judge's reply gives a dimension.

    Strict: only a lone digit 0 to 3 counts, else null. Lenient: any number, kept within 0 to 3; 0 if there is none.
    """
    if lenient:
        number = F.regexp_extract(reply, rf"(?i){dimension}\s*:\s*(\d+)", 1).try_cast("int")
        return F.when(number > 3, 3).otherwise(F.coalesce(number, F.lit(0)))
    return F.regexp_extract(without_thinking(reply), rf"(?im)^\s*{dimension}\s*:\s*([0-3])(?![0-9/.])", 1).try_cast("int")


def free_score(reply: Column) -> Column:
    """The number after "Score:", between 0 and 1; 0 if there is none."""
    v = F.regexp_extract(reply, r"(?i)score\s*:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


#: What looks like a citation, in the order in which they are collected.
CITATIONS = (r"(?i)\barxiv[:\s\-]*([0-9]{4}\.[0-9]{4,6})\b", r"\b([0-9]{4}\.[0-9]{4,6})\b", r"\[([A-Za-z0-9_]{4,40})\]", r"\b(10\.\d{4,9}/[\w.\-]+)\b")


def citations(x: Column, digits: int = 6) -> Column:
    """Distinct citation-like strings, pattern by pattern, each in order; digits: the most that a paper's number has after the point."""
    patterns = [p.replace("{4,6}", f"{{4,{digits}}}") for p in CITATIONS]
    return F.array_distinct(F.concat(*(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(1)) for p in patterns)))


def json_payload(x: Column) -> Column:
    """The JSON of a reply: the whole text if it is JSON, else the outermost brackets or braces if they hold some, else null."""
    whole = F.trim(without_thinking(x))
    arr, obj = F.regexp_extract(whole, r"(?s)(\[.*\])", 1), F.regexp_extract(whole, r"(?s)(\{.*\})", 1)

    def valid(c: Column) -> Column:
        return F.when((c != "") & F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(valid(whole), F.when(F.instr(whole, "[") < F.instr(whole, "{"), valid(arr)), valid(obj), valid(arr))


_PREDICTION = "struct<rank:int,title:string,rationale:string,approach:string,score:double>"


def predictions(reply: Column) -> Column:
    """The predictions of a reply in any of its shapes: a list, {"ideas": [...]}, {"predictions": [...]} or one object."""
    j = json_payload(reply)
    listed = F.from_json(F.when(j.startswith("["), j), f"array<{_PREDICTION}>")
    nested = F.from_json(F.when(j.startswith("{"), j), f"struct<ideas:array<{_PREDICTION}>,predictions:array<{_PREDICTION}>>")
    single = F.from_json(F.when(j.startswith("{"), j), _PREDICTION)
    alone = F.when(single["title"].isNotNull(), F.array(single))
    return F.filter(F.coalesce(listed, nested["ideas"], nested["predictions"], alone, F.array().cast(f"array<{_PREDICTION}>")), lambda p: F.trim(p["title"]) != "")


def prediction_text(title: Column, rationale: Column, approach: Column) -> Column:
    return F.concat_ws(" ", title, rationale, approach)


def idea_text(title: Column, rationale: Column, approach: Column, key_terms: Column) -> Column:
    """The prediction's text and its key terms."""
    terms = F.filter(F.transform(key_terms, F.trim), lambda t: t != "")
    return F.trim(F.concat_ws(" ", prediction_text(title, rationale, approach), F.array_join(terms, " ")))


def paper_text(title: Column, keywords: Column, summary: Column) -> Column:
    """Title, keywords and summary, parted by blank lines."""
    none = F.lit("")
    text = F.concat(F.coalesce(title, none), F.lit("\n\nKeywords: "), F.coalesce(F.array_join(keywords, ", "), none), F.lit("\n\n"), F.coalesce(summary, none))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_hint(text: Column, hints: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The name of the first entry one of whose hints the lower-cased text holds."""
    low, out = F.lower(text), None
    for name, words in hints:
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        out = F.when(any_of, name) if out is None else out.when(any_of, name)
    return F.lit(default) if out is None else out.otherwise(default)
