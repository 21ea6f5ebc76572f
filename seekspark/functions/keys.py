"""Record identity: (workspace_id, source_kind, source_id) and its canonical text key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "record:"


def storage_key(workspace: Column, kind: Column, source_id: Column) -> Column:
    """`record:["ws","kind","id"]`; a null workspace is the JSON null."""
    return F.concat(F.lit(PREFIX), F.to_json(F.array(workspace, kind, source_id), {"ignoreNullFields": "false"}))


def parse_storage_key(key: Column) -> Column:
    """struct(workspace_id, source_kind, source_id), or null unless the key is canonical."""
    parts = F.from_json(F.substring(key, len(PREFIX) + 1, 1 << 30), "array<string>")
    canonical = key.startswith(PREFIX) & (F.size(parts) == 3) & parts[1].isNotNull() & parts[2].isNotNull()
    again = storage_key(parts[0], parts[1], parts[2])
    fields = F.struct(parts[0].alias("workspace_id"), parts[1].alias("source_kind"), parts[2].alias("source_id"))
    return F.when(canonical & (again == key), fields)
