"""Column functions over text, ids and keyphrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def long_tokens(text: Column) -> Column:
    """Tokens of two characters or more, for TF-IDF."""
    return F.filter(tokens(text), lambda t: F.length(t) >= 2)


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def canonical_id(raw: Column) -> Column:
    """The one form of an id: CWE- and digits, whatever case, separator or prefix it came with."""
    digits = F.regexp_extract(raw.cast("string"), r"(?i)^\s*(?:CWE[- ]?)?([0-9]+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


#: The dialects of ids in text: strict; dash optional; dash or blank.
ID_PATTERNS = {"strict": r"CWE-([0-9]+)", "dash": r"(?i)CWE-?([0-9]+)", "loose": r"(?i)CWE[- ]?([0-9]+)"}


def ids_in(text: Column, dialect: str = "loose") -> Column:
    """Distinct canonical ids in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ID_PATTERNS[dialect]), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.concat(F.lit("CWE-"), d)))


def record_id_in(path: Column) -> Column:
    """The first record id in a path or file name."""
    found = F.regexp_extract(path, r"CVE-[0-9]{4}-[0-9]+", 0)
    return F.when(found != "", found)


def shard(number: Column) -> Column:
    """The folder of a number: its thousands and xxx."""
    return F.concat(F.floor(number / 1000).cast("string"), F.lit("xxx"))


def record_path(record_id: Column) -> Column:
    """year/Nxxx/id of a record id."""
    parts = F.split(record_id, "-")
    return F.concat_ws("/", F.get(parts, F.lit(1)), shard(F.get(parts, F.lit(2)).cast("long")), record_id)


def clean_phrases(phrases: Column) -> Column:
    """An array of phrases, trimmed, without blanks."""
    return F.filter(F.transform(phrases, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))


def search_phrases(phrases: Column, kinds: tuple[str, ...] = ("rootcause", "weakness")) -> Column:
    """Of a map of phrase arrays the kinds that drive retrieval, where any phrase is left."""
    cleaned = F.transform_values(phrases, lambda _, v: clean_phrases(v))
    return F.map_filter(cleaned, lambda k, v: k.isin(*kinds) & (F.size(v) > 0))


def joined_phrase(phrases: Column) -> Column:
    return F.array_join(clean_phrases(phrases), " and ")


def phrase_in(text: Column, kind: str) -> Column:
    """The first ``kind: phrase`` of a query text; null if there is none."""
    found = F.trim(F.regexp_extract(text, rf"(?i){kind}:\s*([^,\n]+)", 1))
    return F.when(found != "", found)


def pairs_map(text: Column) -> Column:
    """k:v,k:v as a map."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))


def highlighted(text: Column, phrase: Column) -> Column:
    return F.when(F.coalesce(phrase, F.lit("")) == "", text).otherwise(F.replace(text, phrase, F.concat(F.lit("**"), phrase, F.lit("**"))))


def shortened(text: Column, most: int, kept: int) -> Column:
    """Cut to ``kept`` characters and dots where longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def without_fences(text: Column) -> Column:
    """Text whose outer code fences are taken off, content kept."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```[a-zA-Z]*\n(.*?)```", "$1"), r"^\s+|\s+$", "")


def confidence(text: Column) -> Column:
    """The first number of a text as a share; above one it is a percentage."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"[0-9]+\.?[0-9]*", 0)
    value = F.when(n != "", n).cast("double")
    return F.when(value > 1, value / 100).otherwise(value)


# Headings of an entry's searchable text, in their order
SECTIONS = {
    "extended": "Extended Details:",
    "terms": "Alternative Terms:",
    "observed": "Real-World Examples:",
    "top": "Top 25 CWE Examples:",
    "related": "Related Weaknesses:",
}


def searchable_text(entry: dict[str, Column]) -> Column:
    """Paragraphs of an entry with an empty line between; a heading is a paragraph of its own, and stands only before what there is.

    entry: id, name, type, status, description, extended, and arrays of structs
    terms (Term, Description), observed and top (Reference, Description),
    related (CweID, Nature); any may be missing. Alternative terms are one
    paragraph, each on a line; examples and relations are a paragraph each.
    """
    e = entry.get

    def under(title: str, value: Column | None):
        return F.lit(None) if value is None else F.when(F.coalesce(value, F.lit("")) != "", F.concat_ws("\n\n", F.lit(title), value))

    def listed(name: str, one, between: str = "\n\n"):
        return under(SECTIONS[name], None if e(name) is None else F.array_join(F.transform(e(name), one), between))

    empty = lambda c: F.coalesce(c, F.lit(""))
    term = lambda x: F.when(empty(x["Description"]) != "", F.concat(x["Term"], F.lit(" - "), x["Description"])).otherwise(x["Term"])
    example = lambda x: F.concat(F.lit("- "), empty(x["Reference"]), F.lit(": "), empty(x["Description"]))
    line = lambda title, c: F.lit(None) if c is None else F.concat(F.lit(title), c)
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("CWE-"), e("id"), F.lit(": "), e("name")),
        line("Type: ", e("type")),
        line("Status: ", e("status")),
        under("Description:", e("description")),
        under(SECTIONS["extended"], e("extended")),
        listed("terms", term, "\n"),
        listed("observed", example),
        listed("top", example),
        listed("related", lambda x: F.concat(F.lit("- CWE-"), x["CweID"], F.lit(" ("), empty(x["Nature"]), F.lit(")"))),
    )


def embedding_document(entry: Column) -> Column:
    """The nested document of an entry that is embedded; missing lists are empty."""
    listed = lambda name, kind: F.coalesce(entry[name], F.array().cast(kind)).alias(name)
    return F.struct(
        entry["entry_id"].alias("id"),
        entry["Name"].alias("name"),
        entry["Abstraction"].alias("type"),
        entry["Description"].alias("description"),
        listed("AlternateTerms", "array<struct<Term:string,Description:string>>"),
        listed("RelatedWeaknesses", "array<struct<Nature:string,CweID:string,ViewID:string,Ordinal:string>>"),
    )


def validity(text: Column, most: int = 100_000) -> Column:
    """Why an input text can't be used; null if it can."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.length(text) > most, "too long")
