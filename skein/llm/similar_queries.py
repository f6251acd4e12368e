"""The entries most similar to each entry of the retrieval indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.similar import neighbours
from skein.sources.tables import table

SIZE, K, LEAST = 64, 5, 0.85


def p4_found(spark, d):
    near = neighbours(table(spark, d, "index_entries"), "vec_id", "embedding", SIZE, K, LEAST)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": f"""with usable as (select distinct vec_id id, cast(embedding as double[64]) v from index_entries
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 pairs as (select a.id a, b.id b, round(array_cosine_similarity(a.v, b.v), 9) cos from usable a join usable b on a.id <> b.id),
 best as (select *, row_number() over (partition by a order by cos desc, b) place from pairs where cos >= {LEAST})
 select distinct least(a, b) vec_a, greatest(a, b) vec_b from best where place <= {K}"""
}
