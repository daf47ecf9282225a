"""DuckDB SQL for the registered queries of this package that SQL can express."""

OP10 = r"""
with docs as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                     md5('17:' || coalesce(cast(doc_id as varchar), '')) as k from documents),
src as (select source, cast(sum(size) as bigint) as n, row_number() over (order by source is null, encode(source)) as pos from docs group by source),
weighed as (select source, n, pos, cast(case (pos - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as bigint) as w from src),
filled as (select *, 1.5::double * (select sum(n) from src)::double as total, sum(w) over () as all_w,
           coalesce(sum(2 * n) over (order by 2.0::double * n / w, pos rows between unbounded preceding and 1 preceding), 0) as cap_before,
           coalesce(sum(w) over (order by 2.0::double * n / w, pos rows between unbounded preceding and 1 preceding), 0) as w_before from weighed),
judged as (select *, (total - cap_before::double) * w::double / (all_w - w_before)::double > 2.0::double * n as capped from filled),
rest as (select 1.5::double * (select sum(n) from src)::double - coalesce(sum(case when capped then 2 * n end), 0)::double as left_, sum(case when not capped then w end)::double as w_ from judged),
target as (select source, n, case when capped then 2.0::double * n else left_ * w::double / w_ end as target from judged, rest),
quota as (select source, n, target, case when n > 0 then least(2, cast(floor(target / n) as bigint)) else 0 end as base from target),
keyed as (select d.doc_id, d.size, d.k, q.n, q.target, q.base, q.target - q.base * q.n as rest, q.source from docs d join quota q on d.source is not distinct from q.source),
ids as (select source, k, sum(size) as s, any_value(rest) as rest from keyed group by source, k),
upto as (select *, coalesce(sum(s) over (partition by source order by k rows between unbounded preceding and 1 preceding), 0) as b from ids),
picked as (select source, k, b + s / 2.0::double <= rest and b < rest as once from upto)
select d.doc_id, d.size, d.n as source_size, d.target, cast(d.size * least(2, d.base + case when p.once then 1 else 0 end) as bigint) as taken
from keyed d join picked p on d.k = p.k and d.source is not distinct from p.source
"""

OP11 = r"""
with docs as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
               ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
               ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from docs),
drawn as (select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
                 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
                      when h4 % 100 < 50 then 'spm' else 'psm' end as form from cut),
parts as (select doc_id, text, n, form, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:n], '') as s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""

ORACLE = {"op10_source_mixing": OP10, "op11_fill_middle": OP11}
