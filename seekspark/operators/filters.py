"""The filter vocabulary, compiled to one Catalyst predicate (plus semi- and anti-joins for key lists).

The first alias that is present and not None counts. An empty include list matches nothing, a null
value never matches an include filter, and JSON values compare as their JSON text.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import parse_storage_key
from ..functions.text import any_of, squeezed, without_suffix

FIELD = re.compile(r"[A-Za-z_]\w*", re.ASCII)
MODES = ("hybrid", "semantic", "semantic_only")


def as_list(value: Any) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _given(filters: Mapping[str, Any], *names: str) -> Any:
    return next((filters[n] for n in names if filters.get(n) is not None), None)


def _json(field: str, metadata: str = "metadata") -> Column:
    if not FIELD.fullmatch(field):
        raise ValueError(f"not a metadata field: {field!r}")
    return F.get_json_object(F.col(metadata), f"$.{field}")


def _among(c: Column, values: Iterable) -> Column:
    values = [str(v) for v in values]
    return c.isin(*values) if values else F.lit(False)


def statuses(filters: Mapping[str, Any]) -> list[str] | None:
    """The statuses asked for; None means all, the default is active alone."""
    if filters.get("include_inactive"):
        return None
    found = _given(filters, "status", "lifecycle_status", "statuses", "lifecycle_statuses")
    return ["active"] if found is None else [str(v) for v in as_list(found)]


def document_path() -> Column:
    """First of file_path, path, source_file in the metadata, else the uri."""
    return F.coalesce(*[F.nullif(_json(f), F.lit("")) for f in ("file_path", "path", "source_file")], F.col("uri"))


def path_variants(path: Column) -> Column:
    """Whole path, without suffix, leaf, leaf without suffix."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    leaf = F.substring_index(slashed, "/", -1)
    return F.array(slashed, without_suffix(slashed), leaf, without_suffix(leaf))


def _variants(values: Iterable) -> list[str]:
    out: dict[str, None] = {}
    for v in values:
        whole = str(v).replace("\\", "/")
        for x in (whole, whole.rsplit("/", 1)[-1]):
            out[x] = out[re.sub(r"\.[^./]+$", "", x)] = None
    return list(out)


def document_id() -> Column:
    return F.coalesce(F.nullif(_json("doc_id"), F.lit("")), F.col("source_id"))


def source_scoped(scopes: Mapping[str, Mapping[str, Any]]) -> list[Column]:
    """Conditions that bind only the rows of one source kind."""
    out = []
    for kind, scope in scopes.items():
        unknown = set(scope) - {"workspace_ids", "metadata_non_empty", "metadata_contains_any"}
        if unknown:
            raise ValueError(f"unknown conditions of {kind!r}: {sorted(unknown)}")
        other = F.col("source_kind") != kind
        if scope.get("workspace_ids") is not None:
            out.append(other | F.coalesce(_among(F.col("workspace_id"), as_list(scope["workspace_ids"])), F.lit(False)))
        for f in as_list(scope.get("metadata_non_empty")):
            out.append(other | (F.coalesce(F.json_array_length(_json(f)), F.lit(0)) > 0))
        for f, values in (scope.get("metadata_contains_any") or {}).items():
            items = F.coalesce(F.from_json(_json(f), "array<string>"), F.array().cast("array<string>"))
            quoted = F.transform(items, lambda x: F.struct(x.alias("v"), F.contains(_json(f), F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)).alias("text")))
            wanted = [str(v) for v in as_list(values)]
            out.append(other | (F.exists(quoted, lambda x: x["text"] & x["v"].isin(*wanted)) if wanted else F.lit(False)))
    return out


def predicate(filters: Mapping[str, Any] | None) -> Column:
    """All filters but the key lists as one condition on the columns of records; cheap scalars come first."""
    filters = filters or {}
    if filters.get("retrieval_mode") is not None and filters["retrieval_mode"] not in MODES:
        raise ValueError(f"retrieval_mode must be one of {MODES}")
    tests: list[Column] = []
    if (found := statuses(filters)) is not None:
        tests.append(_among(F.col("status"), found))
    if filters.get("workspace_id") is not None:
        tests.append(F.col("workspace_id") == F.lit(str(filters["workspace_id"])))
    if (found := _given(filters, "source_kinds", "source_kind", "source_filter")) is not None:
        tests.append(_among(F.col("source_kind"), as_list(found)))
    project = _json("project_id")
    if filters.get("project_ids") is not None:
        tests.append(_among(project, as_list(filters["project_ids"])))
    elif (found := _given(filters, "project_id", "project_filter")) is not None and as_list(found):
        tests.append(_among(project, as_list(found)))
    if (found := _given(filters, "excluded_projects", "excluded_project_ids")) is not None:
        tests.append(project.isNull() | ~_among(project, as_list(found)))
    if (found := _given(filters, "paths", "file_paths", "source_files", "path", "file_path", "source_file")) is not None:
        wanted = _variants(as_list(found))
        tests.append(F.coalesce(F.arrays_overlap(path_variants(document_path()), F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False))
    if found := as_list(_given(filters, "excluded_files", "excluded_paths", "excluded_file_paths", "excluded_source_files")):
        tests.append(~F.coalesce(F.arrays_overlap(path_variants(document_path()), F.array(*map(F.lit, _variants(found)))), F.lit(False)))
    if (found := _given(filters, "document_ids", "document_id", "doc_ids", "doc_id")) is not None:
        tests.append(_among(document_id(), as_list(found)))
    if found := as_list(_given(filters, "excluded_documents", "excluded_document_ids", "excluded_doc_ids")):
        tests.append(~_among(document_id(), found) & ~_among(F.col("source_id"), found))
    for f, v in (filters.get("metadata_equals") or {}).items():
        if v is not None:
            tests.append(_json(f) == F.lit(str(v)))
    for f, values in (filters.get("metadata_in") or {}).items():
        tests.append(_among(_json(f), as_list(values)))
    tests += source_scoped(filters.get("source_scoped_filters") or {})
    out = F.lit(True)
    for t in tests:
        out = out & t
    return F.coalesce(out, F.lit(False))


def apply(records: DataFrame, filters: Mapping[str, Any] | None, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Records that match. Keys may be lists in the filters or DataFrames with storage_key; only canonical keys count."""
    filters = filters or {}
    out = records.filter(predicate(filters))

    def keys(listed: Any, df: DataFrame | None) -> DataFrame | None:
        if listed is not None:
            df = records.sparkSession.createDataFrame([(str(k),) for k in as_list(listed)], "storage_key string")
        return None if df is None else df.select("storage_key").filter(parse_storage_key(F.col("storage_key")).isNotNull())

    if (wanted := keys(_given(filters, "candidate_ids", "candidate_storage_keys"), candidates)) is not None:
        out = out.join(wanted, "storage_key", "left_semi")
    if (unwanted := keys(filters.get("exclude_storage_keys"), excluded)) is not None:
        out = out.join(unwanted, "storage_key", "left_anti")
    return out


def by_confidence(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("score") >= threshold) if threshold > 0 else hits


def limit_per_group(hits: DataFrame, group: str, n: int) -> DataFrame:
    """The first n of each group of each query, in rank order."""
    w = Window.partitionBy("query_id", group).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def project_matches(project: Column, wanted: Iterable[str] | None) -> Column:
    names = [w.strip() for w in wanted or [] if w and w.strip()]
    return F.trim(project).isin(*names) if names else F.lit(True)


def matches_excluded(path: Column, names: Iterable[str]) -> Column:
    bare = without_suffix(path)
    return any_of([_among(bare, names), _among(F.substring_index(path, "/", -1), names)])


def glob(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a path, or it with a slash before, matches any shell pattern."""
    tests = [F.lit(False)]
    for p in patterns:
        java = fnmatch.translate(p).replace("\\Z", "\\z").replace("(?s:", "(?s:")
        java = re.sub(r"\\z$", "", java)
        tests += [path.rlike(f"^{java}$"), F.concat(F.lit("/"), path).rlike(f"^{java}$")]
    return any_of(tests)


def policy(hits: DataFrame, hook: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A user's filter or re-ranking of hits; the identity without one."""
    return hits if hook is None else hook(hits)


def query_text(q: Column) -> Column:
    return squeezed(q)
