"""Chunking of records by markdown headings, or by paragraphs where there are none.

The per-record work is sequential (merging and splitting neighbours), so it runs in an Arrow-batched
function that returns an array of chunks, which Spark explodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import storage_key


@dataclass(frozen=True)
class Sizes:
    least: int = 200
    most: int = 2000
    overlap: int = 100


@dataclass(frozen=True)
class Part:
    name: str
    text: str
    path: tuple[str, ...]
    start: int
    end: int


def headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start, end) of `#` and underlined headings outside fenced code."""
    out, at, fence, before = [], 0, None, None
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and bare == mark[1]:
                fence = None
            before = None
        elif mark:
            fence, before = mark[1], None
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line.rstrip("\r\n")):
            out.append((len(m[1]), (m[2] or "").strip(), at + line.index("#"), at + len(line.rstrip("\r\n"))))
            before = None
        elif before and re.match(r" {0,3}(=+|-+)[ \t]*$", line.rstrip("\r\n")):
            out.append((1 if bare[0] == "=" else 2, before[0], before[1], at + len(line.rstrip("\r\n"))))
            before = None
        else:
            before = (bare, at) if bare and not re.match(r" {0,3}([-*+>]|\d+[.)])", line) else None
        at += len(line)
    return out


def _composed(path: tuple[str, ...], body: str) -> str:
    body = body.strip()
    if not path:
        return body
    head = path[-1] + (f"\nContext: {' > '.join(path[:-1])}" if len(path) > 1 else "")
    return f"{head}\n\n{body}" if body else head


def _body(p: Part) -> str:
    head = _composed(p.path, "")
    return p.text[len(head) :].lstrip() if p.path and p.text.startswith(head) else p.text


def _joined(a: Part, b: Part) -> Part:
    """Two neighbours as one; a bare heading vanishes into a chunk below it."""
    if not _body(a) and a.path and b.path[: len(a.path)] == a.path:
        return replace(a, text=b.text, path=b.path, end=b.end)
    if not _body(b) and b.path and a.path[: len(b.path)] == b.path:
        return replace(a, end=b.end)
    shared = 0
    while shared < min(len(a.path), len(b.path)) and a.path[shared] == b.path[shared]:
        shared += 1
    rest = list(dict.fromkeys(x for x in (" > ".join(a.path[shared:]), " > ".join(b.path[shared:])) if x))
    return replace(a, text=f"{a.text}\n\n{b.text}", path=a.path[:shared] + ((" / ".join(rest),) if rest else ()), end=b.end)


def _merged(parts: list[Part], least: int) -> list[Part]:
    out: list[Part] = []
    i = 0
    while i < len(parts):
        if len(parts[i].text) >= least:
            out.append(parts[i])
        elif i + 1 < len(parts):
            out.append(_joined(parts[i], parts[i + 1]))
            i += 1
        elif out:
            out[-1] = _joined(out[-1], parts[i])
        else:
            out.append(parts[i])
        i += 1
    return out


def packed(text: str, most: int) -> list[str]:
    """Paragraphs joined greedily up to `most` characters."""
    out: list[str] = []
    for p in re.split(r"\n\n+", text):
        if out and out[-1] and len(out[-1]) + len(p) + 2 <= most:
            out[-1] += "\n\n" + p
        elif out and not out[-1]:
            out[-1] = p
        else:
            out.append(p)
    return [x for x in out if x]


def _split(p: Part, most: int) -> list[Part]:
    if len(p.text) <= most:
        return [p]
    texts = packed(_body(p) or p.text, most)
    last = len(texts) - 1
    return [replace(p, name=p.name if last == 0 else f"{p.name}_sub_{i}", text=_composed(p.path, t)) for i, t in enumerate(texts)]


def chunks(source_id: str, body: str, sizes: Sizes = Sizes()) -> list[Part]:
    found = headings(body)
    if not found:
        texts = [body] if len(body) <= sizes.most else packed(body, sizes.most)
        out, at = [], 0
        for i, t in enumerate(texts):
            out.append(Part(f"{source_id}_chunk_{i}", t, (), at, at + len(t)))
            at += len(t)
        return out
    parts, stack = [], []
    for i, (level, title, start, end) in enumerate(found):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        stop = found[i + 1][2] if i + 1 < len(found) else len(body)
        path = tuple(t for _, t in stack)
        parts.append(Part(f"{source_id}_chunk_{i}", _composed(path, body[end:stop]), path, start, stop))
    parts = [x for p in _merged(parts, sizes.least) for x in _split(p, sizes.most)]
    out = []
    for before, p in zip([None, *parts], parts):
        siblings = before and "_sub_" in p.name and "_sub_" in before.name and p.name.rsplit("_sub_", 1)[0] == before.name.rsplit("_sub_", 1)[0]
        out.append(replace(p, text=f"[...{before.text[-sizes.overlap :]}]\n\n{p.text}") if siblings and sizes.overlap > 0 else p)
    return out


_SCHEMA = T.ArrayType(T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("header_path", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))


def chunk_records(records: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(parent_key, chunk_key, chunk_id, chunk_index, content, header_path, start_pos, end_pos, content_hash) of records."""

    @F.pandas_udf(_SCHEMA)
    def cut(ids: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_id": p.name, "chunk_index": i, "content": p.text, "header_path": " > ".join(p.path), "start_pos": p.start, "end_pos": p.end} for i, p in enumerate(chunks(s, b or "", sizes))] for s, b in zip(ids, bodies)])

    c = records.select("storage_key", "workspace_id", "source_kind", "source_id", F.explode(cut("source_id", "body")).alias("c"))
    key = storage_key(F.col("workspace_id"), F.col("source_kind"), F.concat("source_id", F.lit("#chunk:"), "c.chunk_id"))
    return c.select(F.col("storage_key").alias("parent_key"), key.alias("chunk_key"), "c.*", F.sha2("c.content", 256).alias("content_hash"))


def with_chunks(records: DataFrame, parts: DataFrame) -> DataFrame:
    """Records followed by their chunks as records of their own."""
    meta = records.select(F.col("storage_key").alias("parent_key"), "workspace_id", "source_kind", "source_id", "title", "uri", "status", "updated_at", "keywords")
    own = parts.join(meta, "parent_key").select(F.col("chunk_key").alias("storage_key"), "workspace_id", "source_kind", F.concat("source_id", F.lit("#chunk:"), "chunk_id").alias("source_id"), "title", F.col("content").alias("body"), F.to_json(F.struct(F.lit(True).alias("_chunk"), F.col("chunk_id").alias("_chunk_id"), F.col("chunk_index").alias("_chunk_index"), F.col("parent_key").alias("_chunk_parent_storage_key"))).alias("metadata"), "uri", "keywords", "status", "updated_at")
    return records.select(own.columns).unionByName(own)
