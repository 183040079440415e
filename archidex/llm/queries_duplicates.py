"""Queries that find repeated documents, lines and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.llm import decontam, linededup, minhash, simhash
from archidex.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line,
           unnest(range(len(string_split(text, chr(10))))) as place
    from documents
), masked as (
    select *, regexp_replace(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') as m
    from lines
), split as (
    select *, string_split(m, ' ') as t, len(string_split(m, ' ')) as n from masked
), leafed as (
    select doc_id, place, m, t, n, cast(n as varchar) || ' ' || array_to_string(t[1:3], ' ') as leaf from split where n >= 3
), leaves as (
    select leaf, count(*) as total from leafed group by leaf having min(doc_id) < max(doc_id)
), weighed as (
    select leaf, m, any_value(t) as t, any_value(n) as n, count(*) as weight
    from leafed where leaf in (select leaf from leaves) group by leaf, m
), tokens as (
    select leaf, m, n, weight, unnest(t) as token, unnest(range(n)) as place from weighed
), shared as (
    select leaf, place, token from tokens join leaves using (leaf) where place >= 3
    group by leaf, place, token, total having 2 * sum(weight) > total
), fitting as (
    select leaf, m, n from tokens join shared using (leaf, place, token) where n > 3
    group by leaf, m, n having 10 * count(*) >= 7 * (n - 3)
), templates as (
    select l.doc_id, l.place, case when f.m is null then 'line ' || l.m else 'leaf ' || l.leaf end as template
    from leafed l semi join leaves v on l.leaf = v.leaf left join fitting f on l.leaf = f.leaf and l.m = f.m
), firsts as (
    select template, min(doc_id) as first from templates group by template having min(doc_id) < max(doc_id)
), dropped as (
    select t.doc_id, t.place from templates t join firsts f on t.template = f.template where t.doc_id > f.first
)
select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.place) filter (where d.place is null), '') as text,
       count(*) as n_lines, count(d.place) as n_dropped
from lines l left join dropped d on l.doc_id = d.doc_id and l.place = d.place
group by l.doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


OP11_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else
        list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s
    from words
), singles as (
    select doc_id, unnest(s) as shingle from sets
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as both
    from singles a join singles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as (
    select c.a, c.b from common c join sets x on x.doc_id = c.a join sets y on y.doc_id = c.b
    where 100 * c.both >= 80 * (len(x.s) + len(y.s) - c.both)
), reach as (
    select doc_id, doc_id as other from sets
    union
    select r.doc_id, l.b from reach r join links l on r.other = l.a
), smallest as (
    select doc_id, min(other) as component_id from reach group by doc_id
)
select s.doc_id, len(s.s) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
from sets s join smallest m using (doc_id)
"""


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
