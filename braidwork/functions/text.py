"""Text expressions: tokenisers, normalisers, formats, label and answer parsing. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers of claim checks.
CLAIMS = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")
NO_ANSWER = "NOT_ENOUGH_INFO"
#: Words of relation labels, and of spans that are matched softly, that don't count.
LABEL_STOP = tuple("of the a an in on to for and or".split())
SOFT_STOP = tuple("the a an of to in on at for from with and or but by is are was were be been being this that it she he they them her his their its as into over under out up down".split())
MARKER = "\n... (truncated)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Lower-case words between white space (any Unicode space); null gives no words."""
    return F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def graph_tokens(x: Column | str) -> Column:
    """Distinct words with underscore and hyphen as spaces, punctuation kept."""
    return F.array_distinct(words(F.translate(_c(x), "_-", "  ")))


def alnum_tokens(x: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(r"([a-z0-9]+)"), 1))


def mention_key(x: Column | str) -> Column:
    """Trimmed, lower case, runs of space as one; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(_c(x)), r"(?U)\s+", " ")), F.lit(""))


def soft_norm(x: Column | str) -> Column:
    """Lower case, punctuation as space, runs of space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def soft_tokens(x: Column | str, stop: tuple[str, ...] = SOFT_STOP) -> Column:
    return F.filter(F.split(soft_norm(x), " "), lambda w: (w != "") & ~w.isin(*stop))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if one is empty (SCA11)."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Length share if one text stands in the other, else 0 (SCA11)."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), 0.0).when(F.contains(b, a), la / lb).when(F.contains(a, b), lb / la).otherwise(0.0)


def document_id(name: str, text: Column | str) -> Column:
    """CNV1: name - first 16 hex digits of the text's md5."""
    return F.concat(F.lit(f"{name} - "), F.substring(F.md5(_c(text)), 1, 16))


def first_id(*columns: str) -> Column:
    """The first of the columns that is a non-empty string."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def truncated(x: Column | str, limit: int = 8000) -> Column:
    """SCA9: at most limit characters, then a mark."""
    return F.when(F.length(_c(x)) > limit, F.concat(F.substring(_c(x), 1, limit), F.lit(MARKER))).otherwise(_c(x))


def claim_label(x: Column | str) -> Column:
    """SCA5: the first answer word, NOT_ENOUGH_INFO if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(x), rf"\b({'|'.join(CLAIMS)})\b", 1), F.lit("")), F.lit(NO_ANSWER))


def rationale(x: Column | str) -> Column:
    """SCA5: what follows RATIONALE:, trimmed; null if it is not there."""
    return F.nullif(F.trim(F.regexp_extract(_c(x), r"(?s)RATIONALE:(.*)", 1)), F.lit(""))


def canonical_relation(x: Column | str) -> Column:
    """SCA7: the part before the colon, without white space of any kind at its ends."""
    return F.regexp_replace(F.split_part(_c(x), F.lit(":"), F.lit(1)), r"(?U)^\s+|\s+$", "")


def label_tokens(x: Column | str) -> Column:
    """SCA8: words of what follows the first colon of a relation label, or of all of it, without stop words, repeated ones kept."""
    name = F.substr(_c(x), F.instr(_c(x), F.lit(":")) + 1)
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"([a-z0-9]+)"), 1), lambda w: ~w.isin(*LABEL_STOP))


def span_ids(x: Column | str) -> Column:
    """SCA13: 183_184 as [183, 184]; parts that aren't numbers go."""
    return F.filter(F.transform(F.split(_c(x), "_"), lambda p: p.try_cast("int")), lambda p: p.isNotNull())


def relation_types(given: list[str] | None, relations: Column | str, default: str = "causal_relation") -> Column:
    """SCA10: the types given, else the document's own, else a default."""
    own = F.map_keys(_c(relations))
    if given:
        return F.array(*map(F.lit, given))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(default)))


def iso_utc(x: Column) -> Column:
    """SCA17: seconds in UTC."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def slug(x: Column | str) -> Column:
    """SCA16: letters, digits, dot and hyphen kept, runs of others as one underscore."""
    return F.trim(F.regexp_replace(_c(x), r"[^A-Za-z0-9.-]+", "_"))


def error_summary(x: Column | str, limit: int = 240) -> Column:
    """SCA16: the last non-empty line of a log, cut to limit characters."""
    lines = F.filter(F.transform(F.split(_c(x), "\n"), lambda v: F.trim(v)), lambda v: v != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), 1, limit)


def token_count(tokens: Column | str, text: Column | str, title: Column | str, sentences: Column | str) -> Column:
    """AGG15: words of the nested tokens, else of text, title and sentences."""
    nested = F.aggregate(F.coalesce(_c(tokens), F.array().cast("array<array<string>>")), F.lit(0), lambda a, x: a + F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0)))
    flat = F.size(words(F.concat_ws(" ", _c(text), _c(title), F.array_join(_c(sentences), " "))))
    return F.when(nested > 0, nested).otherwise(flat)


def mention_text(m: Column) -> Column:
    """The first non-empty of a mention's trigger word, text and name."""
    return F.coalesce(*(F.nullif(F.trim(m[k]), F.lit("")) for k in ("trigger_word", "text", "name")))


def entity_label(entity: Column, key: Column) -> Column:
    """IDX10: the first mention that has a text, else the entity's id."""
    found = F.filter(F.transform(F.coalesce(entity["mentions"], F.array().cast("array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>")), mention_text), lambda t: t.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), key)
