"""The core queries once more, as SQL for DuckDB."""

from __future__ import annotations

import json

from quillspark.functions import field_maps as maps
from quillspark.functions import fixed_values as fixed
from quillspark.functions import text as T
from quillspark.operators import scoring
from quillspark.plans import sample as samples
from quillspark.plans.sample import PLAN

_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _map(table: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table.items()) + "}"


def _squeeze(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_WS}', ' ', 'g'), '^ | $', '', 'g')"


_POST = "post as (select distinct token, doc_id from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) token from documents))"


_POST_K = _POST.replace("post as (", "post as (select token, doc_id k from (") + ")"
_POST_IDX = "post as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) token, idx k from entries)"


def _hit(term: str) -> str:
    return f"select distinct doc_id from post where contains(token, '{term}')"


_ENTRIES = """docs as (select *, lower(trim(coalesce(text, ''))) h from documents),
per as (select h, count(distinct lower(trim(source))) n_sources from docs group by h),
entries as (select row_number() over (order by n_sources desc, coalesce(title, ''), doc_id) - 1 idx, doc_id id, coalesce(title, '') as "primary",
  lower(trim(source)) category, n_sources, length(text) >= 1000 has_traditional, url is not null has_evidence, text from docs join per using (h))"""


def _search(query: str, where: str = "true") -> str:
    q = query.strip().lower()
    words = [w for w in q.split() if len(w) >= 3]
    posted = "tok as (select distinct idx, unnest(regexp_extract_all(lower(concat_ws(' ', \"primary\", '', text)), '[a-z]{3,}')) token from entries)"
    hits = " and ".join(f"idx in (select idx from tok where contains(token, '{w}'))" for w in words) or "true"
    bonus = f"case when contains(lower(concat_ws(' ', \"primary\", '')), '{q}') then 100 else 0 end" if q else "0"
    return f"""with {_ENTRIES}, {posted}, hit as (select * from entries where {hits} and {where} order by idx limit 300),
scored as (select idx, id, "primary", n_sources, n_sources + {bonus} score, count(*) over () total from hit)
select idx::int idx, id, "primary", n_sources::int n_sources, score::int score, total from scored order by score desc, idx limit 100"""


_STOP = _list(fixed.STOP_WORDS)
_KEPT = f"list_filter(regexp_extract_all(lower(sx_desc), '[a-z]{{3,}}'), lambda x: not list_contains({_STOP}, x))"
_KEYS = f"""k0 as (select *, coalesce(nullif(names.latin, ''), names."primary") nm from source_record),
k1 as (select *, lower(strip_accents(regexp_replace(regexp_split_to_array(regexp_replace(coalesce(nm, ''), '\\([^)]*\\)', ' ', 'g'), '[—–,-]')[1], '[æÆ]', 'ae', 'g'))) s from k0),
k2 as (select *, list_filter(regexp_extract_all(s, '[a-z]+'), lambda t: not list_contains({_list(fixed.NOISE_TOKENS)}, t)) tk from k1),
k3 as (select *, coalesce({", ".join(f"case when len(tk) >= {n} then {_map(fixed.COMMON_TO_LATIN)}[array_to_string(tk[1:{n}], ' ')] end" for n in (4, 3, 2, 1))},
  {_map(fixed.ABBREVIATIONS)}[tk[1]], array_to_string(tk[1:2], ' ')) nk from k2),
keyed as (select *, trim(regexp_replace(lower(nk), '[^a-z0-9]+', '-', 'g'), '-') as "key" from k3)"""


def _distinct(value: str, source: str, out: str) -> str:
    """First-seen distinct values of each key as one string."""
    return f"""{out} as (select "key", string_agg(v, '|' order by ats) v, list(v order by ats) l from (select "key", v, min(ats) ats from ({source}) where v is not null and v <> '' group by "key", v) group by "key")"""


def _kept(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z]{{3,}}'), lambda x: not list_contains({_STOP}, x))"


def _lists(table: dict[str, list[str]]) -> str:
    return "map {" + ", ".join(f"{_q(k)}: {_list(v)}" for k, v in table.items()) + "}"


def _case(p: scoring.Profile, **rules: str) -> str:
    """Points by rule; ``{name}`` in a rule is replaced by the profile's points."""
    class Points(dict):
        def __missing__(self, name: str) -> str:
            return str(p.points[name])

    kept = {r: e.format_map(Points()) for r, e in rules.items() if all(n in p.points for n in _names_in(e))}
    return "case " + " ".join(f"when rule = '{r}' then {e}" for r, e in kept.items()) + " end"


def _names_in(text: str) -> list[str]:
    return [x.split("}")[0] for x in text.split("{")[1:]]


def _form(p: scoring.Profile) -> str:
    """Tables of form scoring: plan rows ``x`` and awards ``a`` over postings ``post(token, k)``."""
    rows = ["select c, n seq, 0 sec, 0 i, 'loc' rule, loc label, lt terms, loc || ' + ' || sens pair, len(lt) > 0 placed, len(st) > 0 felt from t where len(lt) > 0", "select c, n, 1, 0, 'sens', sens, st, loc || ' + ' || sens, len(lt) > 0, true from t where len(st) > 0"]
    each = lambda sec, rule, label, terms, source: rows.append(f"select c, n, {sec}, i, '{rule}', {label}, {terms}, '', placed, felt from (select c, n, loc, side, unnest({source}) v, generate_subscripts({source}, 1) i, len(lt) > 0 placed, len(st) > 0 felt from t)")
    if "side" in p.points:
        each(2, "side", "concat_ws(' ', side, loc)", "[v]", f"case when len(lt) > 0 and side not in ('', 'N/A', 'Both sides') then {_kept('side')} else [] end")
    if "modality_in" in p.points:
        for k, name in ((3, "better"), (4, "worse")):
            each(k, "modality", f"'{name}: ' || v", _kept("coalesce(v, '')"), name)
    for k, width in enumerate(p.windows):
        each(5 + k, "window", "v", "string_split(v, ' ')", f"list_transform(range(1, greatest(1, len(d) - {width - 2})), lambda j: array_to_string(d[j:j + {width - 1}], ' '))")
    if "word" in p.points:
        each(7, "word", "v", "[v]", "d")
    kind = "case when field = 'ailments_from' then 'ailments' when field in ('thermal', 'thirst', 'build', 'appetite') then 'constitution' when field = '_checked' then 'checked' when field in ('past_medical', 'family_history', 'medications', 'additional') then 'free' else 'habit' end"
    terms = f"case when list_contains({_list(p.looked_up)}::varchar[], field) then coalesce({_lists(p.sensation_terms)}[v], {_kept('v')}) else {_kept('v')} end"
    points = _case(
        p,
        loc="case when not felt then {location_only} * got_all when has_sens then {both} else {location_rest} end",
        sens="case when not placed then {sensation_only} * got_all when not has_loc then {sensation_rest} end",
        side="case when has_loc then {side} end",
        modality="case when not placed then {modality_alone} when has_loc then {modality_in} else {modality_out} end",
        window="case when got = need then {window} end",
        word="{word}",
        ailments="case when got = need then case when len(terms) >= 2 then {ailments_all} else {ailments_one} end end",
        constitution="{constitution_any} * got_all" if "constitution_any" in p.points else "case when got = need then case when len(terms) >= 2 then {constitution_all} else {constitution_one} end end",
        habit="{habit} * got_all",
        checked="case when got = need then case when len(terms) >= 2 then {checked_all} else {checked_one} end end",
        free="{free}",
    )
    return f"""s as (select distinct on (case_id, n) case_id c, n, coalesce(trim(sx_location), '') loc, coalesce(trim(sx_sensation), '') sens, coalesce(sx_side, '') side,
  coalesce(sx_better, []) better, coalesce(sx_worse, []) worse, {_kept("coalesce(sx_desc, '')")} d from symptom where case_id % 100 = 0),
t as (select *, coalesce({_lists(p.location_terms)}[loc], {_kept("loc")}) lt, coalesce({_lists(p.sensation_terms)}[sens], {_kept("sens")}) st from s),
f as (select distinct on (case_id, field, seq) case_id c, field, seq i, field_value v from form_field where case_id % 100 = 0 and field_value is not null and field_value <> ''),
f1 as (select c, 1000000 + list_position({_list(p.fields)}, field) seq, i, {kind} rule, case when field = 'ailments_from' then 'Ailments from: ' || v else v end label, {terms} terms from f where list_contains({_list(p.fields)}, field)),
plan as ({" union all ".join(rows)}
  union all select c, seq, 0, i, rule, label, terms, '', false, false from f1 where rule <> 'free'
  union all select c, seq, 0, i, rule, w, [w], '', false, false from (select c, seq, i, rule, unnest(terms) w from f1 where rule = 'free')),
x as (select row_number() over () r, * from plan where len(terms) > 0 or seq >= 1000000),
term as (select r, term, count(*) m from (select r, unnest(terms) term from x) group by all),
hit as (select distinct term, k from (select distinct term from term) w join (select distinct token from post) v on contains(token, term) join post using (token)),
g as (select r, k, count(*) got, sum(m) got_all from term join hit using (term) group by all),
y as (select x.*, k, got, got_all, len(list_distinct(terms)) need, bool_or(rule = 'loc') over (partition by c, seq, k) has_loc, bool_or(rule = 'sens') over (partition by c, seq, k) has_sens from g join x using (r)),
a as (select c, seq, sec, i, k, case when rule = 'loc' and felt and has_sens then pair else label end label, ({points})::decimal(18, 4) p from y where ({points}) is not null)"""


_RANKED = """sc as (select c, k, sum(p) s from a group by all),
rk as (select *, row_number() over (partition by c order by s desc, k) rank, max(s) over (partition by c) top from sc),
lab as (select c, k, label, min(row(seq, sec, i)) f from a group by all),
lq as (select *, row_number() over (partition by c, k order by f, label) q from lab),
ml as (select c, k, string_agg(label, '|' order by q) matched from lq where q <= 20 group by all),
ranked as (select c as "case", k as "key", rank::int as rank, round(s, 1)::double score, coalesce(round(100 * s / nullif(top, 0)), 0)::int pct, matched from rk join ml using (c, k) where rank <= {top})"""


def _keywords(p: scoring.Profile) -> str:
    always = "'ailments', 'constitution'" if "constitution_any" in p.points else "'ailments'"
    return f"""with {_POST_K}, {_form(p)},
n as (select c, case when rule in ('loc', 'sens') and placed and felt then pair else label end label from x where rule not in ('word', 'window', 'free') and (rule in ({always}) or len(terms) > 0)
  union all select c, label from y where rule = 'window' and got = need),
u as (select c, count(distinct label) u from n where c in (select c from a) group by c)
select c as "case", coalesce(u, 0)::bigint keywords_used from (select case_id c from symptom union select case_id from form_field) left join u using (c) where c % 100 = 0"""


def _plan() -> str:
    """Awards of the sample plan over postings ``post(token, k)``."""
    body = json.loads(PLAN.strip().removeprefix("```json").removesuffix("```"))
    terms = lambda found: _list([t.lower() for t in found if len(t) >= 3]) + "::varchar[]"
    groups = ", ".join(f"({k}, {_q(g['label'])}, {terms(g['required_terms'])}, {terms(g['bonus_terms'])}, {g.get('weight', 2.0)}::decimal(18, 4))" for k, g in enumerate(body["search_groups"]))
    names = ", ".join(f"({k}, {_q(n if isinstance(n, str) else n['name'])})" for k, n in enumerate(body["suggested_remedies"]))
    return f"""gr as (select * from (values {groups}) v(seq, label, req, bon, w) where len(req) > 0),
hit as (select distinct term, k from (select distinct unnest(list_concat(req, bon)) term from gr) q join (select distinct token from post) v on contains(token, term) join post using (token)),
b as (select seq, label, w, k from (select seq, label, w, list_distinct(req) l, unnest(list_distinct(req)) term from gr) join hit using (term) group by seq, label, w, l, k having count(*) = len(l)),
nm as (select * from (values {names}) v(i, n)),
np as (select i, n, unnest(list_concat([lower(n)], list_filter(regexp_split_to_array(lower(n), '\\s+'), lambda z: length(z) >= 4))) p from nm),
pa as (select seq, 0 sec, 0 i, k, label, w p from b
  union all select g.seq, 0, bi, k, '+ ' || term, (w * 0.3)::decimal(18, 4) from (select seq, w, unnest(bon) term, generate_subscripts(bon, 1) bi from gr) g join hit using (term) where exists (select 1 from b where b.k = hit.k and b.seq <= g.seq)
  union all select 1000000, 0, i, min(idx), 'AI suggested: ' || n, 8 from np join entries on contains(lower("primary"), p) group by i, n)"""


_MARK = r"([A-Z][A-Za-z ,]{1,30}?)\.\s*--"
_SNIP = f"""one as (select rec_id, field, seq, min(substr({_squeeze("text")}, 1, 400)) t from entry where length(text) > 10 group by all),
snip as (select rec_id, field, substr(string_agg(t, ' | ' order by seq), 1, 800) snippet from one group by all)"""


def _contains_any(c: str, parts: list[str], how: str) -> str:
    return "(" + " or ".join(f"{how}({c}, {_q(p)})" for p in parts) + ")"


def _slug(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


_AE = "replace(replace(nm, 'Æ', 'AE'), 'æ', 'ae')"
_OE = f"replace(replace({_AE}, 'Œ', 'OE'), 'œ', 'oe')"



def _nth(values: list[str], key: str) -> str:
    return f"{_list(values)}[{key} % {len(values)} + 1]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"


def _decoded(c: str) -> str:
    """The entities that these pages hold."""
    return f"replace(replace({c}, '&eacute;', 'é'), '&amp;', '&')"


def _clean(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(?is)<script[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\\s*>', ' ', 'g')"
    return _squeeze(_decoded(f"regexp_replace({bare}, '<[^>]+>', ' ', 'g')"))


def _commas(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({c}, ','), lambda z: trim(z, ' .,;')), lambda z: z <> ''), '|')"


def _holds(c: str, parts) -> str:
    return _contains_any(f"lower({c})", list(parts), "contains") if parts else "true"


def _cascade(routes, value: str) -> str:
    return "case " + " ".join(f"when {_holds('h', parts)} then {value.format(field=field, length=length)}" for parts, field, length in routes) + " end"


def _book(book: str, routes, summary, where: str) -> str:
    rows = f"select entry_id, '{book}' book, i, {_cascade(routes, chr(39) + '{field}' + chr(39))} field, h head, length({_cascade(routes, 'substr(text, 1, {length})')}) n from s where {where}"
    if summary:
        rows += f" union all select entry_id, '{book}', -1, 'summary', arg_max(h, i), length(substr(any_value(text), 1, {summary[1]})) from s where {_holds('h', summary[0])} group by entry_id, text"
    return rows


_PAGE = """concat('<html><head><title>', title, ' - Herb | Notes</title><script>var p = ''<b>'';</script><style>p {}</style></head><body><h1>', title, '</h1><p>Common Names: ', title, ' tea, old &amp; ', source, ' root Latin Names: ', title, ' vera, ', source,
'. Background</p><h2>Background</h2><p>', text, '</p><h2>Uses</h2><p>x</p><p>* * *</p><p>second caf&eacute;</p><h2>Background</h2><p>again</p></body></html>')"""
_SNIPS = """f1 as (select {key}, p, j.key f, null::varchar sf, j.type ty, j.value v from b, json_each(b.j) j where b.j is not null),
f2 as (select * from f1 where ty <> 'OBJECT' union all select {key}, p, f, k.key, k.type, k.value from f1, json_each(f1.v) k where ty = 'OBJECT'),
f3 as (select {key}, p, f, sf, 'list' leaf, l.key::bigint pos, l.type ty, l.value v from f2, json_each(f2.v) l where f2.ty = 'ARRAY' union all select {key}, p, f, sf, 'scalar', 0, ty, v from f2 where ty <> 'ARRAY'),
f4 as (select *, case when ty = 'VARCHAR' then v->>'$' when ty = 'OBJECT' then v->>'$.text' end t from f3),
f5 as (select {key}, p || concat_ws('.', f, sf) field, pos, substr(regexp_replace(t, '[\\s\\x{{00A0}}]+', ' ', 'g'), 1, 400) x from f4 where leaf = 'scalar' and ty = 'VARCHAR' and length(t) > 10 or leaf = 'list' and (ty = 'VARCHAR' and length(t) > 5 or ty = 'OBJECT' and length(t) > 0)),
sn as (select {key}, field, substr(string_agg(x, ' | ' order by pos), 1, 800) snippet from f5 group by all)"""

SQL: dict[str, str] = {
    "inverted_index": f"with {_POST} select token, doc_id from post",
    "token_df": f"with {_POST} select token, count(*) df from post group by token",
    "search_and": f"with {_POST} {_hit('throb')} intersect {_hit('temple')}",
    "search_or": f"with {_POST} {_hit('oyster')} union {_hit('vinegar')}",
    "search_minus": f"with {_POST} {_hit('oyster')} except {_hit('vinegar')}",
    "search_ranked": _search("On gastro"),
    "search_category": _search("fever", "category = 'harvask-web'"),
    "search_dual": _search("fever", "has_traditional and has_evidence"),
    "search_all": _search(" "),
    "search_pct": f"select idx, id, round(100 * score / max(score) over ())::int pct from ({_search('On gastro')})",
    "index_order": f"with {_ENTRIES} select idx::int idx, id, n_sources::int n_sources from entries",
    "point_lookup": r"""with asked as (select distinct regexp_replace(lower(id), '[^a-z0-9\-]', '', 'g') id from entity)
select rec_id as "row", id from (select rec_id, id from source_record union all select row_id, id from entity) where id in (select id from asked)""",
    "phrase_in_fields": f"with {_SNIP} select distinct rec_id from snip where contains(lower(snippet), 'on waking') and (contains(field, 'head') or contains(field, 'skin'))",
    "first_match": f"""with {_ENTRIES}, asked as (select latin nm, lower(trim(latin)) n from remedy_ref where ref_id % 100 = 0),
parts as (select distinct nm, unnest(list_concat([n], list_filter(regexp_split_to_array(n, '\\s+'), lambda w: length(w) >= 4))) p from asked)
select nm as "name", min(idx)::int idx from parts join entries on contains(lower("primary"), p) group by nm""",
    "kept_words": f"select case_id, n, array_to_string({_KEPT}, ' ') kept from (select distinct case_id, n, sx_desc from symptom)",
    "word_windows": f"""with w as (select distinct case_id, n, {_KEPT} w from symptom), k as (select unnest([2, 3]) k),
x as (select case_id, n, k, w, unnest(range(0, len(w) - k + 1)) pos from w, k where len(w) >= k)
select case_id, n, k::int k, pos::int pos, array_to_string(w[pos + 1:pos + k], ' ') words from x""",
    "form_scores": f"with {_POST_K}, {_form(scoring.SERVER)}, {_RANKED.format(top=50)} select * from ranked",
    "form_scores_browser": f"with {_POST_K}, {_form(scoring.BROWSER)}, {_RANKED.format(top=10)} select * from ranked",
    "form_keywords": _keywords(scoring.SERVER),
    "form_keywords_browser": _keywords(scoring.BROWSER),
    "plan_scores": f"with {_ENTRIES}, {_POST_IDX}, {_plan()}, a as (select 1::bigint c, * from pa), {_RANKED.format(top=50)} select * from ranked",
    "plan_fallback": f"""with {_ENTRIES}, {_POST_IDX}, q as (select min(case_id) c from symptom where case_id % 100 = 0), fa as (with {_form(scoring.SERVER)} select * from a),
{_plan()}, a as (select c, pa.* from pa, q where c is not null union all select * from fa where c not in (select c from q)), {_RANKED.format(top=50)} select ranked.*, case when "case" in (select c from q) then 'plan' else 'form' end "by" from ranked""",
    "plan_keywords": "select * from (values (1::bigint, 3::bigint), (2, 0)) v(\"case\", keywords_used)",
    "checked_classes": f"""with i as (select concat(upper(field_value[1]), lower(field_value[2:])) item from form_field where field = '_checked' and field_value is not null),
c as (select item, count(*) n, {_contains_any("lower(item)", fixed.EMOTION_PARTS, "contains")} emotion, {_contains_any("item", fixed.FEAR_STARTS, "starts_with")} fear,
list_contains({_list(fixed.FOOD_DESIRES)}, item) desire, list_contains({_list(fixed.FOOD_AVERSIONS)}, item) and not list_contains({_list(fixed.FOOD_DESIRES)}, item) aversion from i group by item)
select *, not (emotion or fear or desire or aversion) as "system" from c""",
    "browser_classes": f"""with i as (select concat(upper(field_value[1]), lower(field_value[2:])) item from form_field where field = '_checked' and field_value is not null)
select item, count(*) n, case when {_contains_any("lower(item)", fixed.EMOTION_PARTS, "contains")} then 'emotion' when list_contains({_list(fixed.FOOD_DESIRES)}, item) then 'desire' else 'system' end kind from i group by item""",
    "case_summaries": f"""with s as (select distinct on (case_id, n) * from symptom),
l as (select case_id c, 0 a, n b, concat_ws(chr(10), concat('SYMPTOM ', n + 1, ':'), '  Description: ' || nullif(sx_desc, ''), '  Location: ' || nullif(sx_location, ''), '  Sensation: ' || nullif(sx_sensation, ''),
  '  Side: ' || case when sx_side not in ('', 'N/A') then sx_side end, '  Better from: ' || nullif(array_to_string(list_filter(sx_better, lambda x: x <> ''), ', '), ''), '  Worse from: ' || nullif(array_to_string(list_filter(sx_worse, lambda x: x <> ''), ', '), '')) line from s),
f as (select distinct on (case_id, field, seq) case_id c, field, seq, field_value v from form_field where field_value <> ''),
k as (select *, {_contains_any("lower(v)", fixed.EMOTION_PARTS, "contains")} e, {_contains_any("v", fixed.FEAR_STARTS, "starts_with")} fe, list_contains({_list(fixed.FOOD_DESIRES)}, v) de, list_contains({_list(fixed.FOOD_AVERSIONS)}, v) and not list_contains({_list(fixed.FOOD_DESIRES)}, v) av from f where field = '_checked'),
q as (select c, 'emotion' field, seq, v from k where e union all select c, 'fear', seq, v from k where fe union all select c, 'desire', seq, v from k where de union all select c, 'aversion', seq, v from k where av
  union all select c, 'system', seq, v from k where not (e or fe or de or av)),
g as (select c, field, string_agg(v, ', ' order by seq, v) v from q group by c, field union all select c, field, arg_min(v, seq) v from f where field <> '_checked' group by c, field),
n as (select * from (values {", ".join(f"({k}, {_q(a)}, {_q(b)})" for k, (a, b) in enumerate(scoring.SUMMARY_LABELS))}) v(b, field, label)),
m as (select * from l union all select c, 1, n.b, label || ': ' || v from g join n using (field) where field not in ('past_medical', 'family_history', 'medications', 'additional') or regexp_matches(v, '[^\\s\\x{{00A0}}]'))
select c as "case", string_agg(line, chr(10) order by a, b) summary from m group by c""",
    "canonical_keys": f'with {_KEYS} select rec_id, "key" from keyed',
    "merged_names": f"""with {_KEYS}, r as (select *, names."primary" pr, coalesce(nullif(names.latin, ''), nullif(names."primary", '')) la, row(source_file, ord) ats from keyed where "key" <> ''),
base as (select "key", coalesce(arg_min(pr, ats) filter (where pr <> ''), '') as "primary", coalesce(arg_min(la, ats) filter (where la is not null), '') latin,
  coalesce(arg_max(category, ats) filter (where category <> '' and category <> 'homeopathic'), 'homeopathic') category, count(*) n_records from r group by "key"),
{_distinct("v", 'select "key", u.v, row(source_file, ord, u.p) ats from r, (select unnest(names.common) v, generate_subscripts(names.common, 1) p) u', "co")},
{_distinct("v", 'select "key", u.v, row(source_file, ord, u.p) ats from r, (select unnest(provenance.sources) v, generate_subscripts(provenance.sources, 1) p) u', "so")},
{_distinct("v", 'select "key", pr v, row(source_file, ord, 0) ats from r', "pn")}
select base.*, coalesce(co.v, '') common, coalesce(array_to_string(pn.l[2:], '|'), '') synonyms, coalesce(so.v, '') sources
from base left join co using ("key") left join so using ("key") left join pn using ("key")""",
    "block_kinds": """select j.key field, case j.type when 'ARRAY' then 'list' when 'OBJECT' then 'dict' else 'scalar' end kind, count(distinct rec_id) n
from source_record, json_each(traditional) j where traditional is not null and not (j.type = 'ARRAY' and json_array_length(j.value) = 0) and not (j.type = 'OBJECT' and len(json_keys(j.value)) = 0) group by 1, 2""",
    "corpus_counts": f"""with {_KEYS} select source_file, count(*) n_records, count(distinct nullif("key", '')) n_keys, count(*) filter (where "key" = '') n_skipped from keyed group by rollup (source_file)""",
    "entry_snippets": f"with {_SNIP} select * from snip",
    "prefix_dedup": "select arg_min(entry_id, row(seq, entry_id)) entry_id from entry where text is not null group by rec_id, field, substr(text, 1, 200)",
    "donor_texts": """with r as (select distinct entry_id, field, text, source_id from entry where text is not null)
select entry_id, field from r where source_id like '%synopsis%' and (field, substr(text, 1, 200)) not in (select (field, substr(text, 1, 200)) from r where source_id like '%keynotes%')""",
    "evidence_rating": f"""select doc_id, case {" ".join(f"when regexp_matches(f, {_q(cue)}) then '{rating}'" for rating, cue in maps.EVIDENCE_CUES)} else 'insufficient_data' end rating
from (select doc_id, lower(coalesce(text, '') || ' ' || {_nth(samples.FINDINGS, "doc_id")}) f from documents)""",
    "page_meta": rf"""with p as (select doc_id, {_clean(f"substr({_PAGE}, 1, 50000)")} x, {_clean(f"regexp_extract({_PAGE}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} nm from documents)
select doc_id, nm as "name", {_commas(r"regexp_extract(x, '(?i)Common Names?:\s*([^.]+?)(?:Latin Names?:|Background)', 1)")} common, {_commas(r"regexp_extract(x, '(?i)Latin Names?:\s*([^.]+?)(?:\.|Background)', 1)")} latin from p""",
    "page_titles": f"""with p as (select doc_id, {_clean(f"regexp_extract({_PAGE}, '(?is)<title[^>]*>(.*?)</title>', 1)")} t, {_clean("coalesce(title, '')")} h from documents)
select doc_id, t title, {_squeeze("string_split(t, ' - ')[1]")} "before", case when contains(t, '|') then trim(substr(t, position('|' in t) + 1)) else t end "after",
array_to_string(list_transform(regexp_extract_all(h, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') cased from p""",
    "page_sections": f"""with p as (select doc_id, {_clean("coalesce(text, '')")} x from documents)
select doc_id, 0 pos, 'Background' head, 'again' body, true sheet from p union all select doc_id, 1, 'Uses', 'x * * * second caf&eacute;', true from p""",
    "page_paragraphs": f"""with p as (select doc_id, {_squeeze(f"regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')")} x, {_squeeze("regexp_replace(concat('Common Names: ', title, ' tea, old &amp; ', source, ' root Latin Names: ', title, ' vera, ', source, '. Background'), '<[^>]+>', ' ', 'g')")} m from documents),
l as (select doc_id, list_filter([m, x, 'x', '* * *', 'second caf&eacute;', 'again'], lambda y: length(y) >= 4 and not regexp_matches(y, '^\\* \\* \\*$') and not regexp_matches(y, '(?i)^related entries')) l from p)
select doc_id, (unnest(range(len(l))))::int pos, unnest(l) paragraph from l""",
    "herbal_routes": f"""with e as (select distinct entry_id, text, {_nth(samples.HEADINGS, "entry_id")} h from entry where text is not null)
select entry_id, {_cascade(maps.HERBAL_ROUTES, "'{field}'")} field, {_cascade(maps.HERBAL_ROUTES, "substr(text, 1, {length})")} text from e where not contains(lower(h), 'synonym')
union all select entry_id, 'synonyms', s from (select entry_id, array_to_string((list_filter(list_transform(string_split(text, ','), lambda x: {_strip("x")}), lambda x: x <> ''))[1:20], '|') s, len(list_filter(list_transform(string_split(text, ','), lambda x: {_strip("x")}), lambda x: x <> '')) n from e where contains(lower(h), 'synonym')) where n > 0""",
    "evidence_routes": f"""with e as (select distinct entry_id, text from entry where text is not null), s as (select entry_id, text, 0 i, {_nth(samples.HEADINGS, "entry_id")} h from e union all select entry_id, text, 1, {_nth(samples.HEADINGS, "(entry_id + 1)")} from e),
r as ({_book("lactation", maps.LACTATION_ROUTES, maps.LACTATION_SUMMARY, "true")} union all {_book("liver", maps.LIVER_ROUTES, maps.LIVER_SUMMARY, f"not {_holds('h', maps.LIVER_SUMMARY[0])}")} union all {_book("supplement", maps.SUPPLEMENT_ROUTES, None, f"lower(h) not in ({', '.join(map(_q, maps.SUPPLEMENT_SKIPPED))})")})
select entry_id, book, (row_number() over (partition by entry_id, book order by i) - 1)::int pos, field, head, n::int "length" from r""",
    "field_labels": f"""with e as (select distinct entry_id, coalesce(text, '') text, {_nth([*maps.NUMBERED, *maps.ANCHORS, "Mind and soul", "stool and blood", "Outer Chest wall", "knees"], "entry_id")} "label" from entry),
w as (select *, lower("label") l, string_split(lower("label"), ' ') ws from e)
select entry_id, "label", coalesce({_map(maps.ANCHORS)}[l], 'generalities') anchored, coalesce({_map(maps.LABELS)}[l], 'generalities') labelled,
case when {_map(maps.LABELS)}[l] is null then '[' || array_to_string(list_transform(string_split("label", ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || '] ' || text else text end text,
coalesce({_map(maps.NUMBERED)}[l], {_map(maps.NUMBERED)}[array_to_string(ws[1:2], ' ')], {_map(maps.NUMBERED)}[ws[1]], 'generalities') numbered,
case {" ".join(f"when entry_id % 50 between {k.replace('-', ' and ')} then '{v}'" for k, v in maps.CHAPTERS.items())} else 'generalities' end chapter from w""",
    "header_names": f"""with p as (select doc_id, coalesce(lang, 'xx') s, list_filter(list_transform(string_split_regex(substr(concat_ws(chr(10), title, text), 1, 600), '\\r\\n|\\n|\\r'), lambda x: {_strip("x")}), lambda x: regexp_full_match(x, '[A-Z][A-Za-z]+(\\s+[a-z]+){{0,2}}\\.?') and length(x) > 3 and length(x) < 60) l from documents)
select doc_id, coalesce(regexp_replace(l[1], '\\.+$', ''), case s when 'en' then 'Englishwort' when 'de' then 'Germanwort' end, upper(s[1]) || lower(s[2:])) as "name" from p""",
    "botanical_names": f"""with p as (select doc_id, regexp_replace({_strip(f"regexp_extract(concat('x Botanical: ', title, '. ', {_nth([' Family: y', ' --- z', ' Description z', ''], 'doc_id')}), 'Botanical:\\s*(.+?)(?:\\s+Family:|\\s+---|\\s+Description)', 1)")}, '\\.+$', '') b,
string_split_regex({_squeeze(f"concat(title, {_nth(['.—Bark.', ' - Root', ''], 'doc_id')})")}, '\\s*[—–\\-]\\s*') t, {_squeeze(f"concat(title, {_nth(['.—Bark.', ' - Root', ''], 'doc_id')})")} w from documents)
select doc_id, case when length(b) < 80 then b else '' end as "name", {_strip("regexp_replace(t[1], '\\.+$', '')")} latin, case when len(t) > 1 then {_strip("regexp_replace(regexp_replace(w, '^.*?\\s*[—–\\-]\\s*', ''), '\\.+$', '')")} else '' end common from p""",
    "title_categories": f"""with p as (select doc_id, lower(concat(title, ' ', {_nth([*maps.BOTANICALS, *maps.VITAMINS, "Other", ""], "doc_id")})) t from documents)
select doc_id, case when {_contains_any("t", maps.BOTANICALS, "contains")} then 'herbal' else 'supplement' end by_plant, case when {_contains_any("t", maps.VITAMINS, "contains")} then 'supplement' else 'herbal' end by_vitamin from p""",
    "denied_pages": f"""with p as (select doc_id, concat({_nth([*maps.NAVIGATION, "illustration-7-", "MyDS-", ""], "doc_id")}, case when doc_id % 3 > 0 then {_slug(f"strip_accents({_OE.replace('nm', 'coalesce(title, chr(32))')})")} end) as "name" from documents)
select * from p where not ("name" in ({", ".join(map(_q, maps.NAVIGATION))}) or {_contains_any('"name"', maps.NAVIGATION_STARTS, "starts_with")} or {_contains_any('"name"', maps.NAVIGATION_PARTS, "contains")})""",
    "payloads": "select event_type, coalesce(json_valid(props) and json_type(props) = 'OBJECT' and json_extract(props, '$.k')::varchar not in ('null', 'false', '0', '\"\"'), false) valid, count(*) n from events group by all",
    "modality_chunks": f"""with t as (select distinct case_id, n, concat('Worse ', sx_desc, ' - better: ', sx_location, '; worse, ', sx_sensation) x from symptom),
p as (select case_id, n, string_split_regex(x, '(?i)\\b(?:better|worse)\\b')[2:] c, regexp_extract_all(x, '(?i)\\b(better|worse)\\b') m from t),
u as (select case_id, n, unnest(range(1, len(m) + 1)) i, unnest(m) side, unnest(c) chunk from p), k as (select case_id, n, i, lower(side) side, trim({_strip("chunk")}, ' .,;:-') text from u)
select case_id, n, (row_number() over (partition by case_id, n order by i) - 1)::int pos, side, text from k where text <> ''""",
    "relation_lists": f"""with c as (select doc_id, concat('Complementary: ', coalesce(title, 'x'), '; Sulph, . Antidotes to it: ', coalesce(source, 'y'), ' , Camph. Follows well: Bry') c from documents),
k as ({" union all ".join(f"select doc_id, '{kind}' kind, regexp_extract(c, {_q('(?i)' + cut)}, 1) v from c" for kind, cut in T.RELATIONS.items())}),
l as (select doc_id, kind, list_filter(list_transform(string_split_regex(v, '[;,]'), lambda x: trim(x, ' .,;')), lambda x: x <> '') l from k)
select doc_id, kind, array_to_string(l, '|') items from l where len(l) > 0""",
    "bullet_items": rf"""with d as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: regexp_replace(x, '^[\s\x{{00A0}}.,;]+|[\s\x{{00A0}}.,;]+$', '', 'g')), lambda x: length(x) >= 5) l from documents)
select doc_id, (unnest(range(len(l))))::int pos, unnest(l) item from d""",
    "joined_bodies": """with d as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), u as (select doc_id, unnest(range(len(l))) i, unnest(l) b from d)
select doc_id, 'h' || (i % 2) head, substr(string_agg(b, chr(10) order by i), 1, 500) body from u group by 1, 2""",
    "entity_entries": f"""with b as (select row_id, '' p, traditional j from entity union all select row_id, 'ev.', evidence from entity), {_SNIPS.format(key="row_id")},
m as (select row_id, string_agg(field || '=' || snippet, chr(10) order by field) snippets from sn group by row_id)
select row_id, coalesce(names."primary", '') as "primary", coalesce(names.latin, '') latin, coalesce(category, '') category, coalesce(len(provenance.sources), 0)::int n_sources, coalesce(len(json_keys(traditional)) > 0, false) has_traditional, coalesce(len(json_keys(evidence)) > 0, false) has_evidence, coalesce(snippets, '') snippets from entity left join m using (row_id)""",
    "record_entries": f"""with b as (select rec_id, '' p, traditional j from source_record union all select rec_id, 'ev.', '{{"summary": "seen in "}}' from source_record), {_SNIPS.format(key="rec_id")}
select rec_id, coalesce(len(provenance.sources), 0)::int n_sources, field, snippet from sn join source_record using (rec_id)""",
    "slugs": f"""select rec_id, {_slug("nm")} plain, {_slug("strip_accents(nm)")} marks, {_slug(f"strip_accents({_AE})")} ae, {_slug(f"strip_accents({_OE})")} oe
from (select rec_id, names."primary" nm from source_record) where nm is not null""",
    "page_links": r"""select doc_id, url, min(pos)::int pos from (select doc_id, unnest(u) url, generate_subscripts(u, 1) - 1 pos
from (select doc_id, regexp_extract_all(text, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1) u from documents)) group by all""",
    "page_text": f"select doc_id, {_clean(_PAGE)} plain, {_squeeze(f"regexp_replace({_decoded(_PAGE)}, '<[^>]+>', '', 'g')")} glued from documents",
    "labelled_sections": rf"""with d as (select doc_id, regexp_extract_all(text, '{_MARK}', 1) l, string_split_regex(text, '{_MARK}') t from documents)
select doc_id, pos::int pos, case when pos = 0 then '' else lower(regexp_extract(l[pos], '^([A-Za-z]+)', 1)) end as "label", {_squeeze("t[pos + 1]")} text
from (select *, unnest(range(0, len(l) + 1)) pos from d)""",
    "numbered_items": rf"""with d as (select doc_id, list_filter(list_transform(string_split_regex(text, '(?m)^\s*\d{{1,4}}[.)]\s+')[2:], lambda x: {_squeeze("x")}), lambda x: length(x) between 6 and 1499) i from documents)
select doc_id, pos::int pos, i[pos + 1] item from (select *, unnest(range(0, len(i))) pos from d)""",
    "scanned_paragraphs": rf"""with d as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '(?m)^\s*\d{{1,4}}\s*$', '', 'g'), '-\n\s*', '', 'g'), '\n\s*\n'), lambda x: {_squeeze("x")}), lambda x: length(x) >= 21) i from documents)
select doc_id, pos::int pos, i[pos + 1] paragraph from (select *, unnest(range(0, len(i))) pos from d)""",
    "heading_lines": rf"""with l as (select doc_id, {_squeeze(r"regexp_extract(title, '\A\s*([^\r\n]*)', 1)")} h from documents)
select doc_id, h heading from l where length(h) > 3 and length(h) < 60 and length(regexp_replace(h, '[^A-Z]', '', 'g')) > 0.7 * length(regexp_replace(h, '[^A-Za-z]', '', 'g'))""",
    "frequent_marks": r"""with m as (select unnest(a) mark, generate_subscripts(a, 1) - 1 pos from (select regexp_extract_all(text, '\b([A-Z][a-z]{2,4}-[a-z]{1,2})\.', 1) a from documents))
select mark, count(*) n, min(pos)::int first_pos from m group by mark having count(*) >= 3""",
    "json_props": "select event_type, count(k) n, sum(k)::bigint total, max(k) most from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by event_type",
    "daily_limit": "select event_id, ts is not null and row_number() over (partition by ts::date order by ts, event_id) <= 100 allowed from events",
    "link_bfs": """with recursive e as (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer),
b as (select 'r1' node, 0 depth union select dst, depth + 1 from b join e on src = node where depth < 4) select node, min(depth)::int depth from b group by node""",
}
SQL["merged_block"] = f"""with {_KEYS},
f1 as (select k."key", row(source_file, ord) ats, j.key field, case j.type when 'ARRAY' then 'list' when 'OBJECT' then 'dict' else 'scalar' end kind, j.value v from (select * from keyed where "key" <> '' and json_type(traditional) = 'OBJECT') k, json_each(k.traditional) j),
f2 as (select "key", ats, field, kind, null::varchar subfield, null::varchar subkind, v from f1 where kind <> 'dict' union all
  select d."key", ats, field, kind, s.key, case s.type when 'ARRAY' then 'list' when 'OBJECT' then 'dict' else 'scalar' end, s.value from (select * from f1 where kind = 'dict') d, json_each(d.v) s),
f3 as (select x."key", ats, field, kind, subfield, subkind, l.key::bigint pos, l.value v from (select * from f2 where coalesce(subkind, kind) = 'list') x, json_each(x.v) l union all select "key", ats, field, kind, subfield, subkind, 0, v from f2 where coalesce(subkind, kind) <> 'list'),
a as (select *, arg_min(kind, ats) over (partition by "key", field) k1 from f3),
b as (select *, arg_min(coalesce(subkind, ''), ats) over (partition by "key", field, subfield) k2, min(ats) over (partition by "key", field, subfield) a1 from a where kind = k1),
c as (select * from b where coalesce(subkind, '') = k2 and (coalesce(subkind, kind) = 'list' or ats = a1))
select "key", field, kind, subfield, subkind, (row_number() over (partition by "key", field, subfield order by ats, pos) - 1)::int n,
case when json_type(v) = 'OBJECT' then '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda z: to_json(z)::varchar || ':' || json_extract(v, '$."' || z || '"')::varchar), ',') || '}}' else v::varchar end v from c"""
_MERGED = SQL["merged_names"]
SQL["summary_counts"] = f"""select (select count(*) from source_record) total_records, (select count(*) from ({SQL["canonical_keys"]}) where "key" = '') skipped, count(*) entities, count(*) filter (where contains(sources, '|')) multi_source from ({_MERGED})"""
SQL["summary_entries"] = f"""select "key" id, "primary", latin, synonyms, category, (case when sources = '' then 0 else len(string_split(sources, '|')) end)::int n_sources, sources from ({_MERGED})"""
