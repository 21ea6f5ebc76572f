"""Query expansion by synonyms, as a join of query terms with a synonym table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import tokens


def synonyms(queries: DataFrame, table: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, text, expanded): the text with the synonyms of its terms after it, each once, in term order.

    table: (term, synonyms array<string>); a synonym that is a term of the query isn't added.
    """
    terms = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    known = table.select(F.lower("term").alias("term"), F.posexplode("synonyms").alias("i", "synonym"))
    found = terms.join(known, "term")
    own = terms.select("query_id", F.col("term").alias("own")).distinct()
    found = found.join(own, (found.query_id == own.query_id) & (F.lower(found.synonym) == own.own), "left_anti")
    first = found.groupBy("query_id", F.lower("synonym").alias("key")).agg(F.min(F.struct("pos", "i", "synonym")).alias("s"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("s.pos", "s.i"))
    kept = first.withColumn("n", nth).filter(F.col("n") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "s.synonym"))).alias("a"))
    out = queries.join(kept, "query_id", "left")
    extra = F.array_join(F.transform("a", lambda x: x["synonym"]), " ")
    return out.select("query_id", "text", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", extra)).alias("expanded"))
