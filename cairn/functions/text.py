"""Names, markers, sentences and word counts as column functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _strip_accents(names: pd.Series) -> pd.Series:
    """NFKD without combining marks, case folded: Spark has no normal forms."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks whose plain form is one ASCII letter, and those, in lower case."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, x.lower()) for c, x in pairs if len(x) == 1 and x.isascii() and x.isalpha()]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


MARKED, PLAIN = _plain_letters()


def _bare_name(name: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(name.cast("string"), F.lit(""))), r"(?U)^\s*[QA]\s*[-–:]\s*", "")
    bare = F.regexp_replace(bare, r"(?Us)\s+[-–—]\s+.*$", "")
    bare = F.regexp_replace(bare, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def clean_name(name: Column, exact: bool = False) -> Column:
    """Speaker names in one spelling: no Q/A prefix, no title after " - ", glued words parted, one space, no accents, folded case.

    By a fixed map of composed Latin letters, inside the JVM; combining marks go, other letters fold case as Java does. With
    exact, all goes through Python's NFKD and case folding; clean_names() does that for distinct names only."""
    bare = _bare_name(name)
    if exact:
        return _strip_accents(bare)
    return F.lower(F.regexp_replace(F.translate(bare, MARKED, PLAIN), r"\p{M}", ""))


def clean_names(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds clean_name(exact): Python sees each distinct name that is neither ASCII nor plain marked Latin once."""
    plain = F.col(column).isNull() | F.translate(F.col(column), MARKED, "a" * len(MARKED)).rlike(r"^[\x00-\x7F]*$")
    odd = df.filter(~plain).select(F.col(column).alias("_odd")).distinct()
    odd = odd.select("_odd", clean_name(F.col("_odd"), exact=True).alias("_clean"))
    return df.join(odd, F.col(column) == F.col("_odd"), "left").withColumn(name, F.coalesce("_clean", clean_name(F.col(column)))).drop("_odd", "_clean")


def match_key_of(clean: Column) -> Column:
    """surname|first initial of a clean name; one-letter words don't count; the name itself where nothing else is left."""
    words = F.filter(F.split(F.translate(clean, ".", " "), "(?U)\\s+"), lambda w: F.length(w) > 1)
    return F.when(F.size(words) == 0, clean).otherwise(F.concat_ws("|", F.element_at(words, -1), F.substring(F.element_at(words, 1), 1, 1)))


def match_key(name: Column) -> Column:
    return match_key_of(clean_name(name))


def any_marker(text: Column, markers: list[str]) -> Column:
    """Whether the text holds one of the literal markers, whatever its case."""
    if not markers:
        return F.lit(False)
    return F.coalesce(text.rlike("(?i)" + "|".join(r"\Q" + m + r"\E" for m in markers)), F.lit(False))


def announced(text: Column, pattern: str) -> Column:
    """All first groups of a pattern, as names."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def prefix_role(speaker: Column) -> Column:
    """Role by the prefixes of older transcripts: analyst for Q, management for A, else null."""
    return F.when(speaker.rlike(r"(?U)^\s*Q\s*[-–:]"), "analyst").when(speaker.rlike(r"(?U)^\s*A\s*[-–:]"), "management")


def sentences(text: Column) -> Column:
    """Split after . ! ? at white space before a capital, digit or quote; trimmed, none empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim gets the index as what to trim


def rough_sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+(?:\s|$)"), F.lit(0))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def letters_words(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("[A-Z]+"), F.lit(0))


def lexicon_count(text: Column, words: list[str]) -> Column:
    """How many of the text's words are of a list."""
    listed = F.array(*(F.lit(w.upper()) for w in sorted(set(words)))) if words else F.array().cast("array<string>")
    return F.size(F.filter(letters_words(text), lambda w: F.array_contains(listed, w)))


def pack_chunks(text: Column, limit: int) -> Column:
    """Sentences packed greedily into chunks of at most `limit` words; a longer sentence is cut at words."""

    def cut(sentence: Column) -> Column:
        words = F.split(sentence, r"\s+")
        starts = F.sequence(F.lit(0), F.ceil(F.size(words) / limit).cast("int") - 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i * limit + 1, limit), " "))

    units = F.flatten(F.transform(sentences(text), cut))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, unit: Column) -> Column:
        n = F.size(F.split(unit, r"\s+"))
        fits = acc["n"] + n <= limit
        return F.when(fits, F.struct(acc["done"].alias("done"), F.trim(F.concat_ws(" ", acc["now"], unit)).alias("now"), (acc["n"] + n).alias("n"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), unit.alias("now"), n.alias("n"))
        )

    return F.aggregate(units, none, add, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda c: c != ""))


def classify_header(header: Column, rules: list[tuple[str, str]], residual: str) -> Column:
    """The role of the first rule (pattern, role) that a speaker header fits."""
    out = F.lit(residual)
    for pattern, role in reversed(rules):
        out = F.when(header.rlike(pattern), role).otherwise(out)
    return F.when(header.isNull() | (F.trim(header) == ""), "unknown").otherwise(out)


def resolve_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among columns, whatever the case."""
    known = {c.lower(): c for c in reversed(columns)}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def label_order(names: dict[int, str]) -> tuple[int, int, int]:
    """Positions of negative, neutral and positive among a model's labels; missing and doubled ones raise ValueError."""
    found = []
    for want in ("neg", "neu", "pos"):
        hits = [k for k, v in names.items() if re.match(want, str(v).strip().lower())]
        if len(hits) != 1:
            raise ValueError(f"{len(hits)} labels for {want} in {names}")
        found.append(int(hits[0]))
    return tuple(found)


def split_giant(text: Column, limit: int) -> Column:
    """A word of more than `limit` characters in pieces of that many; nothing is lost."""
    n = F.greatest(F.ceil(F.length(text) / F.lit(limit)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))


def collapse(text: Column, most: int | None = None) -> Column:
    """One space between words, none at the ends, at most `most` characters."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def after_delimiter(header: Column) -> Column:
    """What follows the first dash, comma or slash of a header; empty without one."""
    parts = F.split(header, r"\s*[-–—,/]\s*", 2)
    return F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def header_role(header: Column, titles: str, firms: str, groups: str, n_tickers: Column | None = None, in_remarks: Column | None = None, tickers: int = 4) -> Column:
    """Role of a speaker header by ordered rules: operator, group, prefix, a title anywhere, a firm after the first delimiter, a
    speaker of `tickers` companies or more is an analyst, one heard in remarks a manager, the rest analysts.

    titles, firms and groups are patterns of the caller; case is ignored."""
    n, remarks = (F.lit(0) if x is None else F.coalesce(x, F.lit(0)) for x in (n_tickers, in_remarks))
    rule = (
        F.when(F.lower(F.trim(header)) == "operator", "operator")
        .when(header.rlike("(?i)^(?:" + groups + ")"), "group")
        .when(header.rlike(r"^Q\s*[-–:]"), "analyst")
        .when(header.rlike(r"^A\s*[-–:]"), "manager")
        .when(header.rlike("(?i)" + titles), "manager")
        .when(after_delimiter(header).rlike("(?i)" + firms), "analyst")
        .when(n >= tickers, "analyst")
        .when(remarks >= 1, "manager")
        .otherwise("analyst")
    )
    return F.when(header.isNull(), "unknown").otherwise(rule)


def gold_role(header: Column, titles: str, firms: str, groups: str, overrides: dict[str, str] | None = None, long: int = 80) -> Column:
    """Label of a header by stricter rules, then a table of exact headers, then manager for those of over `long` characters;
    null where none of them decides."""
    bare = F.trim(header)
    low = F.lower(bare)
    rule = (
        F.when(low == "operator", "operator")
        .when(low.rlike(r"^(analyst for|analyst [-–]|unidentified analyst)"), "analyst")
        .when(bare.rlike("(?i)^(?:" + groups + ")"), "group")
        .when(bare.rlike(r"^[Qq]\s*[-–:]"), "analyst")
        .when(bare.rlike(r"^[Aa]\s*[-–:]"), "manager")
        .when(bare.rlike("(?i)" + titles), "manager")
        .when(after_delimiter(bare).rlike("(?i)" + firms) | F.concat(F.lit(" - "), bare).rlike("(?i)" + firms), "analyst")
    )
    known = F.lit(None).cast("string")
    if overrides:
        known = F.try_element_at(F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair)), header)
    return F.coalesce(rule, known, F.when(F.length(header) > long, "manager"))


def literal_time(text: Column) -> tuple[Column, Column]:
    """(timestamp, has_time) of dates as news pages print them: "Aug 27, 2020, 9:00 p.m. ET", "August 27, 2020", "2020-08-27 21:00".
    The zone's name is dropped; what no form fits is null."""
    bare = F.regexp_replace(F.trim(text), r"\s+E[SD]?T$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*a\.?m\.?$", " AM"), r"(?i)\s*p\.?m\.?$", " PM")
    bare = F.regexp_replace(bare, r"(?<=\p{L}{3})\.", "")
    forms = ["MMM d, yyyy, h:mm a", "MMM d, yyyy h:mm a", "MMMM d, yyyy, h:mm a", "MMMM d, yyyy h:mm a", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in forms)), F.coalesce(bare.rlike(r"\d:\d\d"), F.lit(False))


def header_hint(header: Column, tickers: Column, count: Column, example: Column, most: int = 160) -> Column:
    """One line that shows a header with its companies, number of utterances and the start of an example."""
    return F.concat_ws(" | ", header, F.when(tickers != "", F.concat(F.lit("["), tickers, F.lit("]"))), F.concat(F.lit("n="), count.cast("string")), collapse(example, most))


def answer_array(answer: Column, roles: list[str]) -> Column:
    """index -> role of a model's answer that holds a JSON list of {"i", "role"} somewhere; items of other roles go, junk gives
    an empty list."""
    found = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    items = F.from_json(F.when(found != "", found), "array<struct<i:int,role:string>>")
    listed = F.array(*map(F.lit, roles))
    return F.filter(F.coalesce(items, F.array().cast("array<struct<i:int,role:string>>")), lambda x: x["i"].isNotNull() & F.array_contains(listed, F.coalesce(x["role"], F.lit(""))))


#: clean_name() and match_key() as SQL text, over a string s.
CLEAN_SQL = (
    r"lower(regexp_replace(translate(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(s, '')), "
    r"r'(?U)^\s*[QA]\s*[-–:]\s*', ''), r'(?Us)\s+[-–—]\s+.*$', ''), r'(?<=[a-z])(?=[A-Z])', ' '), r'(?U)\s+', ' ')), "
    f"'{MARKED}', '{PLAIN}'), " + r"r'\p{M}', ''))"
)
KEY_WORDS_SQL = r"filter(split(translate(clean_name(s), '.', ' '), r'(?U)\s+'), w -> length(w) > 1)"


def register(spark: SparkSession) -> list[str]:
    """Names for SQL in this session: clean_name(s), match_key(s), js_distance(p, q), all SQL functions."""
    from cairn.functions import stats

    key = f"CASE WHEN size({KEY_WORDS_SQL}) = 0 THEN clean_name(s) ELSE concat_ws('|', element_at({KEY_WORDS_SQL}, -1), substring(element_at({KEY_WORDS_SQL}, 1), 1, 1)) END"
    for head, body in (("clean_name(s STRING) RETURNS STRING", CLEAN_SQL), ("match_key(s STRING) RETURNS STRING", key), ("js_distance(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE", stats.JS_SQL)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["clean_name", "match_key", "js_distance"]
