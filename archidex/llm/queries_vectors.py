"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.llm import ann, vectorcodes
from archidex.llm.common import table

OP6_SQL = """
with usable as (
    select vec_id, cast(embedding as double[]) as v from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
    from usable q, usable c
    where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, F.col("id") % 20 == 0)


_START = """
with usable as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), kept as materialized (
    select row_number() over (order by vec_id nulls last, v) - 1 as n, vec_id, label, v from usable
    where len(v) = (select len(v) from usable order by vec_id nulls last, v limit 1)
), parts as materialized (
    select n, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as x from kept, (select unnest(range(16)) as p)
), book0 as materialized (
    select p, n as e, x from parts where n < 64
)"""
_ASSIGN = """, nearest{r} as materialized (
    select n, p, x, min({{'d': d, 'e': e}}) as best from (
        select a.n, a.p, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as d
        from parts a join book{r} b on a.p = b.p
    ) group by n, p, x
)"""
_UPDATE = """, sums{r} as (
    select p, e, i, sum(y) as s, count(*) as c from (
        select p, best.e as e, unnest(x) as y, unnest(range(len(x))) as i from nearest{r}
    ) group by p, e, i
), moved{r} as (
    select p, e, list(cast((s - ((s % c) + c) % c) // c as bigint) order by i) as x from sums{r} group by p, e
), book{next} as materialized (
    select b.p, b.e, coalesce(m.x, b.x) as x from book{r} b left join moved{r} m on b.p = m.p and b.e = m.e
)"""
_END = """, coded as (
    select n, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' order by p) as code, cast(sum(best.d) as bigint) as error
    from nearest2 group by n
), rows as (
    select k.vec_id, k.label, c.code, c.error from kept k join coded c using (n)
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from book2) as codebooks_sha256
from rows
"""
OP12_SQL = "".join(
    [_START, *(_ASSIGN.format(r=r) + _UPDATE.format(r=r, next=r + 1) for r in range(2)), _ASSIGN.format(r=2), _END]
)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))
