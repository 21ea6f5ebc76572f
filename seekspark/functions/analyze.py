"""Query analysis as column expressions, so that a table of queries is analysed in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, squeezed

_DOCS = "(?:pages|documents|notes|files)"
_EMBEDS = "embed(?:s|ded|ding)?"
_CLUDES = "transclud(?:e|es|ed|ing)?"
_LINK, _DEPEND, _POINT = r"links?\s+to", r"depends?\s+on", r"points?\s+to"

#: What marks a query for an identifier, a version or a literal phrase.
FACTUAL = [r"[a-z][A-Z]|[A-Z]{2,}[a-z]", r"\b[a-z]+_[a-z_]+\b", "`[^`]+`", r"\b[vV]?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-\w+)?\b", r"\b[A-Za-z0-9]+(?:[_:./\\][A-Za-z0-9]+)+\b"]
QUOTED = "\"[^\"]+\"|'[^']+'"
NAVIGATION = "article chapter doc docs documentation guide overview page section tutorial".split()
QUESTIONS = "describe explain how tell what when where which who whom why".split()
RELATION = rf"(?i)\b(?:call(?:er|ee)?s?|depend(?:s|ency|encies)?|import(?:s|ed)?|referenc(?:e|es|ed)|relat(?:ed|es)|link(?:ed|s)?|connect(?:ed|s)?|neighbor(?:s|ing)?|(?:up|down)stream|(?:in|out)bound|adjacent|similar|{_EMBEDS}|{_CLUDES}|point(?:s|ed)?\s+to)\b"
INBOUND = rf"(?i)\b(?:inbound|upstream)\b|^\s*(?:which|what)\s+(?:pages|documents|notes)\s+(?:{_LINK}|are\s+linked\s+from|{_POINT}|{_EMBEDS}|{_CLUDES})\b|\b(?:pages|documents|notes)\s+that\s+(?:{_EMBEDS}|{_CLUDES})\b"
OUTBOUND = rf"(?i)\b(?:outbound|downstream)\b|\b(?:does|do)\b.*\b(?:link(?:s|ed)?\s+to|{_EMBEDS}|{_CLUDES})\b"

#: (pattern whose first group is the target, direction), tried in this order.
INTENTS = [
    (rf"(?i)^(?:which|what)\s+{_DOCS}\s+are\s+neighbors\s+of\s+(.+?)\s*[?.!]?$", "both"),
    (rf"(?i)^(?:which|what)\s+{_DOCS}\s+(?:{_LINK}(?:\s+or\s+{_DEPEND})?|{_DEPEND}(?:\s+or\s+{_LINK})?|are\s+linked\s+from|{_POINT}|{_EMBEDS}|{_CLUDES})\s+(.+?)\s*[?.!]?$", "incoming"),
    (rf"(?i)^show\s+me\s+{_DOCS}\s+that\s+(?:{_LINK}|{_DEPEND}|{_EMBEDS}|{_CLUDES})\s+(.+?)\s*[?.!]?$", "incoming"),
    (r"(?i)^what\s+links\s+to\s+(.+?)\s*[?.!]?$", "incoming"),
    (rf"(?i)^(?:which|what)\s+{_DOCS}\s+does\s+(.+?)\s+(?:{_LINK}|{_DEPEND}|{_POINT}|{_EMBEDS}|{_CLUDES})\s*[?.!]?$", "outgoing"),
]
_ENDS = r"^[ .?!]+|[ .?!]+$"


def is_factual(q: Column) -> Column:
    """Not a wiki link, and an identifier, version, code or quoted phrase is in it."""
    return ~(F.contains(q, F.lit("[[")) & F.contains(q, F.lit("]]"))) & any_of([q.rlike(p) for p in [*FACTUAL, QUOTED]])


def is_navigational(q: Column) -> Column:
    words = F.split(F.lower(F.trim(q)), r"\s+")
    return F.arrays_overlap(words, F.array(*map(F.lit, NAVIGATION))) | q.rlike(r"(?i)\bin\s+the\s+\w+") | q.rlike(r"\[\[.+?\]\]")


def is_exploratory(q: Column) -> Column:
    first = F.element_at(F.split(F.lower(F.trim(q)), r"\s+"), 1)
    return (F.trim(q) != "") & (first.isin(*QUESTIONS) | F.trim(q).endswith("?"))


def query_type(q: Column) -> Column:
    return F.when(is_factual(q), "factual").when(is_navigational(q), "navigational").otherwise("exploratory")


def relationship_intent(q: Column) -> Column:
    """struct(target, direction), or null."""
    plain = F.regexp_replace(squeezed(q), _ENDS, "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)\s+and\s+what\s+do\s+their\s+neighbors?\s+explain$", ""), _ENDS, "")
    found = None
    for pattern, direction in INTENTS:
        target = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, pattern, 1), r"(?i)^(?:the|a|an)\s+", ""), _ENDS, "")
        test, value = target != "", F.struct(target.alias("target"), F.lit(direction).alias("direction"))
        found = F.when(test, value) if found is None else found.when(test, value)
    return found


def graph_direction(q: Column) -> Column:
    by_words = F.when(q.rlike(INBOUND) & ~q.rlike(OUTBOUND), "incoming").otherwise("outgoing")
    return F.coalesce(relationship_intent(q)["direction"], by_words)


def signals(q: Column) -> Column:
    return F.struct(
        is_factual(q).alias("artifact"), q.rlike(QUOTED).alias("quoted"), is_navigational(q).alias("navigational"), is_exploratory(q).alias("exploratory"),
        q.rlike(RELATION).alias("relationship"), graph_direction(q).alias("graph_direction"), relationship_intent(q).alias("intent"),
    )


def adaptive_weights(kind: Column, semantic: float = 1.0, keyword: float = 1.0, graph: float = 1.0) -> Column:
    """struct(vector, keyword, graph): the lane that a query type favours weighs more."""
    return F.struct(
        F.when(kind.isin("factual", "navigational"), semantic).otherwise(semantic * 1.3).alias("vector"),
        F.when(kind == "factual", keyword * 1.5).otherwise(keyword).alias("keyword"),
        F.when(kind == "navigational", graph * 1.5).otherwise(graph).alias("graph"),
    )


def normalized(q: Column) -> Column:
    return squeezed(q)


def legacy_type(q: Column) -> Column:
    """conceptual or factual, by phrases."""
    text = F.lower(q)
    return F.when(any_of([F.contains(text, F.lit(p)) for p in ("how", "why", "explain", "what is", "describe", "overview", "difference", "compare")]), "conceptual").otherwise("factual")


def expansion(text: Column, query: Column, words: int) -> Column:
    """The first words of an expansion; null if nothing but the query is left."""
    cut = F.array_join(F.slice(F.split(squeezed(text), " "), 1, words), " ")
    return F.when((cut != "") & (cut != squeezed(query)), cut)
