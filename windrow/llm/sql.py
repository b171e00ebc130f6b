"""DuckDB SQL of the queries that SQL can express."""

#: Systematic sampling over one ordered window per source; Spark's plan gets the same ranks from buckets.
OP1 = r"""
with d as (
  select doc_id, coalesce(source, '') as src, cast(source is null as int) as none,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as h
  from documents
), b as (
  select *, greatest(length(bin(size)) - 5, 0) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) as band from d
), s as (
  select src, none, cast(sum(size) as bigint) as source_size from b group by all
), w as (
  select *, [1, 2, 3][(row_number() over (order by none, src) - 1) % 3 + 1] as w from s
), r as (
  select *, source_size * 3 / w as ratio from w
), l as (
  select *, (sum(source_size) over ()
           - coalesce(sum(source_size * 3) over (order by ratio, none, src rows between unbounded preceding and 1 preceding), 0))
           / sum(w) over (order by ratio, none, src rows between current row and unbounded following) as level
  from r
), t as (
  select src, none, source_size, least(cast(source_size * 3 as double), w * (select arg_min(level, row(ratio, none, src)) from l where level <= ratio)) as target,
         cast(('0x' || substr(md5('windrow:' || none || ':' || src), 1, 5)) as bigint) / 1048576.0::double as u
  from l
), k as (
  select b.*, t.source_size, t.target, t.u, case when t.source_size = 0 then 0.0::double else t.target / t.source_size end as rate,
         row_number() over (partition by b.src, b.none order by band, substr(h, 1, 2), h, doc_id, size) as k
  from b join t on b.src = t.src and b.none = t.none
)
select doc_id, size, source_size, cast(target as double) as target,
       cast(floor(k * rate + u) - floor((k - 1) * rate + u) as bigint) * size as taken
from k
"""

ORACLES: dict[str, str] = {"op1_mixing": OP1}
