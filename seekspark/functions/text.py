"""Text functions as column expressions: normal forms, tokens, field and identifier scoring ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def squeezed(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def field_text(text: Column) -> Column:
    return F.lower(squeezed(text))


def artifact_text(text: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def header_segments(headers: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(headers, F.lit("")), ">"), lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))), lambda s: s != "")


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase occurs in the text between spaces or ends."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return (text != "") & (phrase != "") & F.contains(padded, F.concat(F.lit(" "), phrase, F.lit(" ")))


def _first(*rungs: tuple[Column, float | Column]) -> Column:
    """The value of the first rung that holds, else 0."""
    out = F.lit(0.0)
    for test, value in reversed(rungs):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def title_score(query: Column, title: Column) -> Column:
    return _first((title == "", 0.0), (title == query, 80.0), (holds_phrase(title, query), 24.0), (F.contains(title, query), 14.0))


def header_score(query: Column, headers: Column, segments: Column) -> Column:
    whole = _first((headers == query, 34.0), (holds_phrase(headers, query), 14.0), (F.contains(headers, query), 10.0))
    by_depth = F.transform(segments, lambda s, i: _first((s == query, 112.0), (holds_phrase(s, query), 20.0), (F.contains(s, query), 10.0)) * F.greatest(F.lit(0.45), 1.0 - i * 0.25))
    return F.greatest(whole, F.coalesce(F.array_max(by_depth), F.lit(0.0)))


def artifact_tokens(query: Column) -> Column:
    """Tokens that look like paths, names with an ending or qualified names."""
    bare = F.transform(F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != ""), lambda t: artifact_text(F.regexp_replace(t, r"^[.,;!?()\[\]{}<>\"'`]+|[.,;!?()\[\]{}<>\"'`]+$", "")))
    return F.filter(bare, lambda t: (t != "") & (F.contains(t, F.lit("/")) | F.contains(t, F.lit(":")) | t.rlike(r"\.[a-z0-9]{1,12}$")))


def looks_like_artifact(query: Column) -> Column:
    one = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")) == 1
    return F.when(one, F.trim(query).rlike(r"[./\\_-]")).otherwise(F.size(artifact_tokens(query)) > 0)


def field_match(query: Column, content: Column, title: Column, headers: Column, source: Column) -> Column:
    """Score of a query against title, headers, source path and content."""
    q, t, h, c, s = field_text(query), field_text(title), field_text(headers), field_text(content), artifact_text(source)
    segments = header_segments(headers)
    name = basename(s)
    start = title_score(q, t) + header_score(q, h, segments)
    found = artifact_tokens(query)
    wanted = F.when(F.size(found) > 0, found).otherwise(F.array(artifact_text(query)))

    def one(score: Column, a: Column) -> Column:
        base = basename(a)
        real = base != ""
        best = F.greatest(score, title_score(a, t), header_score(a, h, segments))
        return best + _first((s == a, 60.0), (name == a, 56.0), (real & (name == base), 52.0), (s.endswith(F.concat(F.lit("/"), a)), 48.0), (real & s.endswith(F.concat(F.lit("/"), base)), 44.0), (F.contains(s, a), 16.0), (real & F.contains(s, base), 12.0))

    total = F.aggregate(wanted, start, one) + F.when(F.contains(c, q), 4.0).otherwise(0.0)
    return F.when(q == "", 0.0).otherwise(total)


def artifact_match(query: Column, content: Column, title: Column, headers: Column, source: Column) -> Column:
    """The highest rung that an identifier, or any of the identifiers in a longer query, reaches."""
    whole, found = artifact_text(query), artifact_tokens(query)
    c, h, t, s = artifact_text(content), artifact_text(headers), artifact_text(title), artifact_text(source)
    name = basename(s)

    def one(a: Column) -> Column:
        base = basename(a)
        real = base != ""
        rungs = [(s == a, 120.0), (name == a, 115.0), (real & (name == base), 112.0), (s.endswith(F.concat(F.lit("/"), a)), 108.0), (real & s.endswith(F.concat(F.lit("/"), base)), 104.0), (t == a, 102.0), (real & (t == base), 100.0)]
        for field, high in ((s, 96.0), (t, 88.0), (h, 82.0), (c, 74.0)):
            rungs += [(F.contains(field, a), high), (real & F.contains(field, base), high - 4.0)]
        return _first(*rungs)

    wanted = F.when(F.size(found) > 0, found).otherwise(F.array(whole))
    return F.coalesce(F.array_max(F.transform(wanted, one)), F.lit(0.0))


def artifact_score(query: Column, title: Column, body: Column, indexed: Column, headers: Column, uri: Column) -> Column:
    """Both ladders; field matching reads the indexed text, identifier matching the whole body."""
    content = F.when(F.coalesce(indexed, F.lit("")) != "", indexed).otherwise(body)
    return field_match(query, content, title, headers, uri) + artifact_match(query, body, title, headers, uri)


KEYWORD_FIELDS = ["tags", "keywords", "source_keywords", "aliases", "header_path", "headers", "file_path", "source_file", "path", "filename", "file_name", "paths", "filenames", "files_changed", "symbols", "symbol", "symbol_path", "symbol_paths", "file_tokens", "commit_file_tokens", "path_tokens", "symbol_tokens", "tokens", "exact_tokens"]
URI_FIELDS = ["uri", "source_file", "file_path", "path", "filename", "file_name"]


def metadata_keywords(metadata: Column) -> Column:
    """Words of the identifier-like fields of JSON metadata, lower-case, in the fields' fixed order."""
    parts = []
    for f in KEYWORD_FIELDS:
        raw = F.get_json_object(metadata, f"$.{f}")
        items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        parts.append(F.array_join(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), field_text), lambda x: x != ""), " "))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def metadata_uri(uri: Column, metadata: Column) -> Column:
    """The uri, else the first of the URI-like metadata fields that isn't empty."""
    return F.coalesce(F.nullif(uri, F.lit("")), *[F.nullif(F.get_json_object(metadata, f"$.{f}"), F.lit("")) for f in URI_FIELDS], F.lit(""))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("...")))


def first_lines(text: Column, n: int) -> Column:
    """struct(text, omitted): the first n lines and how many follow."""
    lines = F.split(text, "\n")
    return F.struct(F.array_join(F.slice(lines, 1, n), "\n").alias("text"), F.greatest(F.size(lines) - n, F.lit(0)).alias("omitted"))


def document_of_chunk(chunk_id: Column) -> Column:
    """The document part of `doc#chunk:x`, `doc#x` or `doc_chunk_3`."""
    return F.when(F.contains(chunk_id, F.lit("#")), F.substring_index(chunk_id, "#", 1)).otherwise(F.regexp_replace(chunk_id, r"_chunk_(?!.*_chunk_).*$", ""))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]+$", "")


def uri_key(uri: Column) -> Column:
    """Lower-case scheme and host, no trailing slash of the path; query and fragment stay."""
    head = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substr(uri, F.length(head) + 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.concat(head, F.regexp_replace(path, "/+$", ""), F.substr(rest, F.length(path) + 1))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
