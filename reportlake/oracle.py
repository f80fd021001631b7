"""SQL of the core queries, for a second engine over the same tables.

Vocabularies come from ``vocabulary``; the logic is written anew in relational form
(rows and windows where the operators fold arrays inside a row)."""

from reportlake import vocabulary as v
from reportlake.functions.text import MODALITIES, SOUNDS, numeral, rate_patterns

_MINUTE = "left(replace({c}, ' ', 'T'), 16)"
_LATEST = f"""(select * from (select *, row_number() over (partition by id order by {_MINUTE.format(c='updated')} desc nulls last,
  coalesce(len(trail), -1) desc, arrived desc nulls last) as rn from records where id is not null) where rn = 1)"""
_TOKENS = r"regexp_extract_all(lower(text), '([0-9]+(?:\.[0-9]+)?|[a-z0-9]+)')"
_WORDS = r"regexp_extract_all(lower(text), '([a-z][a-z''\-]{2,}|\d+(?:\.\d+)?)')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_q, values))


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q('(?i)' + pattern)})"


def _split(style: str, c: str = "text") -> str:
    """Sentence list by replacing the end mark and its space with a separator."""
    body = {
        "a": rf"regexp_replace({c}, '([.;\n])\s+', '\1' || chr(1), 'g')",
        "b": rf"regexp_replace(regexp_replace({c}, '([.;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')",
        "c": rf"regexp_replace({c}, '([.;])\s+', '\1' || chr(1), 'g')",
    }[style]
    return rf"list_filter(list_transform(string_split({body}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _numbered(source: str, parts: str, key: str = "id", name: str = "s") -> str:
    return f"(select {key}, unnest(xs) as {name}, unnest(range(0, len(xs))) as pos from (select {key}, {parts} as xs from {source}))"


# blocks of a report

_HEAD = rf"(?is)^[\s•*–—-]*({v.longest_first(v.HEADINGS)})\s*(?:([:–—-])(.*)|)$"
_MARKER = rf"^\s*(?:[{v.BULLETS[:-1]}-]+|\(?\d{{1,2}}[.)]|\(?[a-z][.)])\s+"
_LABEL = r"(?s)^([^:\n]{1,60}?)\s*:\s*(.*)$"


def _is_sub(c: str) -> str:
    return rf"""({c} <> '' and ({c} like '%:' or (length({c}) <= {v.SUBHEADING_CHARS} and len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')) <= {v.SUBHEADING_WORDS}
  and not regexp_matches({c}, '[.,;]$') and (not regexp_matches({c}, '\d') or regexp_matches({c}, '^[A-Za-z ]+ ?\d*$')))))"""


def _is_end(c: str) -> str:
    return f"(len(list_filter([{_list(v.SIGN_OFF)}], lambda h: contains(lower({c}), h))) > 0)"


_BLOCKS = rf"""texts as (select id, report_text as t from {_LATEST} where report_text is not null),
lines as {_numbered('texts', rf"list_filter(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')", name='line')},
heads as (select *, case when pos > 0 then nullif(upper(regexp_extract(line, {_q(_HEAD)}, 1)), '') end as head, regexp_extract(line, {_q(_HEAD)}, 2) as mark,
  {_strip(f"regexp_extract(line, {_q(_HEAD)}, 3)")} as rest from lines),
placed as (select *, coalesce(last_value(head ignore nulls) over (partition by id order by pos rows between unbounded preceding and current row), 'GENERAL') as section,
  head is not null and rest <> '' and head in ({_list(v.INLINE_HEADINGS)}) as kept from heads),
content as (select id, pos, section, case when head is not null then rest else {_strip(f"regexp_replace(line, {_q(_MARKER)}, '')")} end as line
  from placed where pos > 0 and not kept),
typed as (select *, {_strip(f"regexp_extract(line, {_q(_LABEL)}, 1)")} as label, {_strip(f"regexp_extract(line, {_q(_LABEL)}, 2)")} as body,
  {_is_sub('line')} as sub, {_is_end('line')} as closing, section in ({_list(v.FINDINGS)}) as finding, section in ({_list(v.IMPRESSION)}) as imp, section in ({_list(v.TAIL)}) as tail
  from content where line <> ''),
b as (
  select id, pos, 0 as part, 'title' as kind, upper(line) as text, '' as trailer, '' as section from placed where pos = 0
  union all select id, pos, 0, case when kept then 'heading_inline' else 'heading' end, head || case when mark = ':' then ':' else '' end, case when kept then rest else '' end, section
  from placed where head is not null
  union all select id, pos, 1, 'subheading', label || ':', '', section from typed where finding and not sub and not closing and label <> '' and body <> ''
  union all select id, pos, 2, case when finding then case when sub then 'subheading' when closing then 'text' else 'bullet' end
    when imp then case when closing then 'text' else 'bold_bullet' end when tail and not closing then 'bullet' else 'text' end,
    case when finding and not sub and not closing and label <> '' and body <> '' then body else line end, '', section from typed)"""
_HEADS = "kind in ('heading', 'heading_inline')"
_LINE = f"case when {_HEADS} then trailer else text end"


def _under(sections, name: str = "read", sep: str = "chr(10)") -> str:
    return f"""{name} as (select id, string_agg({_LINE}, {sep} order by pos, part) as t from b where kind <> 'title' and section in ({_list(sections)}) and trim({_LINE}) <> '' group by id)"""


_READ = (*v.FINDINGS, *v.IMPRESSION, *v.TAIL)
_TRIAGE = rf"""with {_BLOCKS}, {_under(_READ)},
everything as (select id, string_agg(text, chr(10) order by pos, part) as t from b where trim(text) <> '' group by id),
chosen as (select e.id, coalesce(r.t, e.t) as t from everything e left join read r on r.id = e.id),
s as {_numbered('chosen', _split('a', 't'))},
terms as (select unnest([{_list((*v.STAT, *v.URGENT))}]) as term, unnest(range(0, {len(v.STAT) + len(v.URGENT)})) as n),
m as (select id, pos, s, term, n < {len(v.STAT)} as stat, regexp_extract(lower(s), '(?s)^(.*?)\b' || term || '\b', 1) as before
  from s join terms on contains(lower(s), term) where regexp_matches(lower(s), '\b' || term || '\b')),
o as (select *, row_number() over (partition by id, term order by pos) as k from m where not {_has(f"right(before, {v.DISMISS_CHARS['triage']})", v.any_word(v.TRIAGE_DISMISSED))}),
f as (select id, term, stat, left(s, 200) as s from o where k = 1),
k as (select * from f where stat or not exists (select 1 from f g where g.stat and g.id = f.id and g.s = f.s))
select x.id, case when bool_or(stat) then 'stat' when count(term) > 0 then 'urgent' else 'routine' end as level,
  coalesce(array_to_string(list_sort(list_distinct(list(term) filter (where term is not null))), ', '), '') as terms
from (select id from {_LATEST}) x left join k on k.id = x.id group by x.id"""

_MASK = "lower(s)"
for _p in v.PSEUDO_NEGATIONS:
    _MASK = f"replace({_MASK}, {_q(_p)}, '{' ' * len(_p)}')"
_PRE = v.longest_first(v.PRE_NEGATIONS)


def _singular(c: str) -> str:
    listed = " ".join(f"when {c} = {_q(a)} then {_q(b)}" for a, b in v.PLURALS.items())
    keeps = " and ".join(f"not {c} like '%{e}'" for e in v.SINGULAR_ENDS)
    return f"case {listed} when {c} like '%s' and {keeps} then left({c}, length({c}) - 1) else {c} end"


def _entities(source: str) -> str:
    """``id, pos, i, term, negated, s`` of every entity of a table ``id, t``."""
    pieces = rf"string_split(regexp_replace({_MASK}, {_q('(' + v.any_word(v.ENTITIES) + ')')}, chr(1) || '\1' || chr(2), 'g'), chr(1))"
    return rf"""(select id, pos, i, {_singular('trim(e)')} as term, left(s, 200) as s,
  (regexp_matches(before, {_q(rf'\b(?:{_PRE})\b')}) and not regexp_matches(between_, {_q(v.any_word(v.SCOPE_ENDS))}) and length(between_) < {v.SCOPE_CHARS})
    or regexp_matches(left(after, 40), {_q(rf'^\W{{0,4}}(?:{v.longest_first(v.POST_NEGATIONS)})\b')}) as negated
  from (select *, regexp_extract(before, {_q(rf'(?s)^.*\b(?:{_PRE})\b(.*?)$')}, 1) as between_ from (
    select id, pos, s, i, split_part(p[i], chr(2), 1) as e, replace(array_to_string(p[1:i - 1], ''), chr(2), '') as before,
      split_part(p[i], chr(2), 2) || replace(array_to_string(p[i + 1:], ''), chr(2), '') as after
    from (select *, unnest(range(2, len(p) + 1)) as i from (select id, pos, s, {pieces} as p from {_numbered(source, _split('b', 't'))})))))"""


_POLARITY = f"""with texts as (select id, report_text as t from {_LATEST} where report_text is not null)
select id, term, bool_and(negated) as negated from {_entities('texts')} group by 1, 2"""
_GUARD = f"""with {_BLOCKS}, {_under(v.FINDINGS, 'f')}, {_under(v.IMPRESSION, 'i')},
fe as {_entities('f')}, ie as {_entities('i')},
fm as (select id, term, bool_and(negated) as no, arg_max(s, pos * 1000 + i) filter (where negated) as said from fe group by 1, 2),
im as (select id, term, bool_and(negated) as no, arg_max(s, pos * 1000 + i) filter (where not negated) as said from ie group by 1, 2)
select fm.id, fm.term, case when im.term is null then 'omitted' else 'flipped' end as verdict, fm.said as source_sentence,
  case when im.term is null then '' else coalesce(im.said, '') end as draft_sentence
from fm left join im on im.id = fm.id and im.term = fm.term where fm.no and (im.term is null or not im.no)"""

_CONTEXT = f"""case when {_has('s', v.any_word(v.FAMILY))} then 'family' when {_has('s', v.any_word(v.HISTORICAL))} then 'historical'
 when {_has('s', v.any_word(v.DIFFERENTIAL))} then 'differential' else 'current' end"""


def _measured(source: str) -> str:
    pattern = rf"(?i)(\d+(?:\.\d+)?)\s*(?:{'|'.join(v.MEASURE_UNITS)})\b"
    scale = " ".join(f"when '{u}' then {s}" for u, (_, s) in v.UNIT_SCALE.items())
    family = " ".join(f"when '{u}' then '{f}'" for u, (f, _) in v.UNIT_SCALE.items())
    return rf"""(select distinct id, value, unit, case unit {family} else unit end as family, round_even(cast(value as double) * case unit {scale} else 1.0 end, 3) as size
  from (select id, regexp_extract(m, '^\d+(?:\.\d+)?') as value, lower(regexp_extract(m, '[^\d.\s].*$')) as unit from (select id, unnest(regexp_extract_all(t, {_q(pattern)})) as m from {source})))"""


def _side(c: str, name: str) -> str:
    return _has(c, v.any_word(v.SIDES[name]))


_GUESS = "case " + " ".join(f"when {_has('title', chr(92) + 'b' + n)} then '{m}'" for n, m in v.RULE_MODALITIES) + " else '' end"


def _rule(scope: str, kind: str, value: str, severity: str) -> str:
    broken = {
        "required_section": f"not exists (select 1 from filled where filled.id = w.id and filled.section = {_q(value)})",
        "recommended_section": f"not exists (select 1 from filled where filled.id = w.id and filled.section = {_q(value)})",
        "required_phrase": f"not contains(lower(w.t), {_q(value.lower())})",
        "banned_phrase": _has(_strip("w.t"), rf"\b{value}\b\s*\.?\s*$"),
    }[kind]
    here = "true" if scope == "default" else f"guess = {_q(scope)}"
    return f"""select id, {_q(kind.replace('_', ' '))}, '{severity}', '', {_q(value)} from (select *, {_GUESS} as guess from whole) w where {here} and {broken}"""


_CHECKS = rf"""with {_BLOCKS},
heads_of as (select id, section, min(pos) as start from b where {_HEADS} group by 1, 2),
fk as (select id, arg_min(section, start) as k from heads_of where section in ({_list(v.FINDINGS)}) group by 1),
ik as (select id, arg_min(section, start) as k from heads_of where section in ({_list(v.IMPRESSION)}) group by 1),
filled as (select id, section, string_agg({_LINE}, ' ' order by pos, part) as t from b where kind <> 'title' and trim({_LINE}) <> '' group by 1, 2),
f as (select fk.id, k, coalesce(t, '') as t from fk left join filled on filled.id = fk.id and section = k),
i as (select ik.id, k, coalesce(t, '') as t from ik left join filled on filled.id = ik.id and section = k),
r as (select distinct id from b),
whole as (select id, string_agg({_LINE}, ' ' order by pos, part) filter (where trim({_LINE}) <> '') as t, coalesce(max(text) filter (where kind = 'title'), '') as title from b group by 1),
fm as {_measured('f')}, im as {_measured('i')},
fnow as (select id, coalesce(string_agg(s, ' ' order by pos) filter (where {_CONTEXT} = 'current'), '') as t from {_numbered('f', _split('b', 't'))} group by 1),
inow as (select id, coalesce(string_agg(s, ' ' order by pos) filter (where {_CONTEXT} = 'current'), '') as t from {_numbered('i', _split('b', 't'))} group by 1),
bt as (select id, {_strip("text || ' ' || trailer")} as t, coalesce(nullif(section, ''), kind) as place from b),
cs as (select id, lower(s) as s from {_numbered('whole', _split('c', 't'))}),
watched as (select unnest([{_list(v.CONTRADICTED)}]) as term),
seen as (select id, term, {_has(f"right(left(s, cast(strpos(s, term) as int) - 1), {v.DISMISS_CHARS['contradiction']})", v.any_word(v.DENIED))} as no from cs join watched on contains(s, term))
select id, 'no impression' as "check", 'critical' as severity, '' as section, '' as detail from r where id not in (select id from ik)
union all select id, 'empty impression', 'critical', k, '' from i where trim(t) = ''
union all select id, 'no findings', 'warning', '', '' from r where id not in (select id from fk)
union all select id, 'empty findings', 'critical', k, '' from f where trim(t) = ''
union all select id, 'no patient name', 'warning', '', '' from r where not exists (select 1 from filled where filled.id = r.id and section in ({_list(v.FIELDS['patient'])}))
union all select id, 'no age or sex', 'note', '', '' from r where not exists (select 1 from filled where filled.id = r.id and section in ({_list(v.FIELDS['age_sex'])}))
union all select id, 'short impression', 'warning', k, '' from i where length({_strip('t')}) between 1 and 14
union all select h.id, 'empty section', 'warning', h.section, h.section from heads_of h left join fk on fk.id = h.id left join ik on ik.id = h.id
  where h.section is distinct from fk.k and h.section is distinct from ik.k and not exists (select 1 from filled where filled.id = h.id and filled.section = h.section)
union all select im.id, 'measurement not in findings', case when list_contains(regexp_extract_all(f.t, '\b\d+(?:\.\d+)?\b'), im.value) then 'warning' else 'critical' end, i.k, im.value || ' ' || im.unit
  from im join f on f.id = im.id join i on i.id = im.id
  where not exists (select 1 from fm where fm.id = im.id and ((fm.value = im.value and fm.unit = im.unit) or (fm.family = im.family and fm.size = im.size)))
union all select i.id, 'laterality', 'critical', i.k, 'left against right' from i join fnow using (id) join inow using (id)
  where {_side('inow.t', 'left')} and not {_side('fnow.t', 'left')} and {_side('fnow.t', 'right')}
union all select i.id, 'laterality', 'critical', i.k, 'right against left' from i join fnow using (id) join inow using (id)
  where {_side('inow.t', 'right')} and not {_side('fnow.t', 'right')} and {_side('fnow.t', 'left')}
union all select id, 'unconfirmed dictation', 'critical', place, unnest(regexp_extract_all(t, '\[\[(.+?)\]\]', 1)) from bt
union all select id, 'placeholder', 'critical', place, lower(trim(regexp_extract(t, {_q('(?i)' + v.any_word(v.PLACEHOLDERS) + '|(?i)' + chr(92) + 'bn/?a' + chr(92) + 's*$')}))) from bt
  where regexp_matches(t, {_q('(?i)' + v.any_word(v.PLACEHOLDERS) + '|(?i)' + chr(92) + 'bn/?a' + chr(92) + 's*$')})
union all select id, 'unfilled bracket', 'critical', place, lower(regexp_extract(' ' || t || ' ', {_q(r'[^\[](\[(?:\s*(?:(?i:' + '|'.join(v.BRACKETED) + r'))?\s*|[A-Z]{2,}[^\]\n]{0,60})\])[^\]]')}, 1)) from bt
  where regexp_matches(' ' || t || ' ', {_q(r'[^\[](\[(?:\s*(?:(?i:' + '|'.join(v.BRACKETED) + r'))?\s*|[A-Z]{2,}[^\]\n]{0,60})\])[^\]]')})
union all select id, 'self-correction', 'critical', place, lower(trim(regexp_extract(t, {_q('(?i)' + v.any_word(v.SELF_CORRECTIONS) + '|(?i)' + chr(92) + 'brather' + chr(92) + 'b,')}))) from bt
  where regexp_matches(t, {_q('(?i)' + v.any_word(v.SELF_CORRECTIONS) + '|(?i)' + chr(92) + 'brather' + chr(92) + 'b,')})
union all select id, 'denied and stated', 'note', '', term from seen group by id, term having bool_or(no) and bool_or(not no)
union all {' union all '.join(_rule(*rule) for rule in v.RULES)}"""


def _mm(c: str) -> str:
    return rf"""list_max(list_transform(regexp_extract_all({c}, '(?i)\d+(?:\.\d+)?\s*(?:mm|cm)\b'), lambda m: cast(regexp_extract(m, '^[\d.]+') as double) * case when lower(m) like '%cm' then 10.0 else 1.0 end))"""


_NODULE_CLASS = f"""case when {_has('s', v.NODULE['ground glass'])} and not {_has('s', v.NODULE['part solid'])}
  then case when mm < 6 then 'ground-glass below 6 mm: none' else 'ground-glass: CT at 6-12 months, then every 2 years' end
 when {_has('s', v.NODULE['part solid'])} then 'part-solid: CT at 3-6 months, then yearly'
 when {_has('s', v.NODULE['several'])} and mm >= 6 then 'several, 6 mm or more: CT at 3-6 months, then 18-24 months'
 when mm is null then 'size not stated' when mm < 6 then 'below 6 mm: none if low risk'
 when mm <= 8 then '6-8 mm: CT at 6-12 months, then 18-24 months' else 'above 8 mm: CT at 3 months, PET-CT or sampling' end"""


def _stands(trigger: str) -> str:
    before = f"right(regexp_extract(s, {_q('(?is)^(.*?)(?:' + trigger + ')')}, 1), {v.DISMISS_CHARS['advice']})"
    return f"{_has('s', trigger)} and not {_has(before, v.any_word(v.ADVICE_DISMISSED))}"


_ADVICE = rf"""with {_BLOCKS}, {_under((*v.FINDINGS, *v.IMPRESSION))},
everything as (select id, string_agg(text, chr(10) order by pos, part) as t, max(text) filter (where kind = 'title') as title from b where trim(text) <> '' group by id),
chosen as (select e.id, title, coalesce(r.t, e.t) as t from everything e left join read r on r.id = e.id),
s as (select x.*, c.title, c.t from {_numbered('chosen', _split('a', 't'))} x join chosen c on c.id = x.id),
found as (
  select id, 'Fleischner 2017' as system, arg_min(s, pos) as s from s where {_stands(chr(92) + 'bnodules?' + chr(92) + 'b')} and ({_has('s', v.NODULE['ground glass'])} or {_has('s', v.NODULE['part solid'])}
    or {_has('s', v.NODULE['lung'])} or {_has('title', v.NODULE['chest'])}) and not {_has('s', v.NODULE['thyroid'])} and not {_has('t', 'fleischner')} group by id
  {' '.join(f"union all select id, {_q(name)}, arg_min(s, pos) from s where {_stands(trigger)} and {_has('s', place)} and not {_has('t', quoted)} group by id" for name, quoted, trigger, place in v.SCORING)})
select id, system, case when system = 'Fleischner 2017' then {_NODULE_CLASS} else 'category missing' end as advice, left(s, 200) as sentence from (select *, {_mm('s')} as mm from found)"""

_CUE = "(" + v.any_word(v.ABNORMAL) + ")"
_PROPOSALS = rf"""with {_BLOCKS}, {_under(v.FINDINGS, 'f')},
s as (select id, pos, regexp_replace(s, '^[•\-–*\s]+|[•\-–*\s]+$', '', 'g') as s from {_numbered('f', _split('b', 't'))}),
c as (select *, string_split(regexp_replace(s, {_q('(?i)' + _CUE)}, chr(1) || '\1', 'g'), chr(1)) as p from s where length(s) >= 8),
k as (select id, pos, regexp_replace(s, '[.;]+$', '') as s from c
  where len(list_filter(range(1, len(p)), lambda i: not {_has(f"right(array_to_string(p[1:i], ''), {v.DISMISS_CHARS['impression']})", v.any_word(v.IMPRESSION_DISMISSED))})) > 0),
o as (select id, min(pos) as pos, arg_min(s, pos) as s from k group by id, lower(s)),
n as (select id, row_number() over (partition by id order by pos) as n, s from o)
select id, n, s as sentence from n where n <= 8
union all select id, 0, {_q(v.NORMAL_LINE)} from f where trim(t) <> '' and id not in (select id from n)"""

_REGION_ROWS = [(o, r) for r, os in v.REGIONS.items() for o in os]
_ORGAN = rf"(?i)\b(?:(right|left|both|bilateral)\s+)?({v.longest_first(o for o, _ in _REGION_ROWS)})s?\b"
_PART = " ".join(
    f"when organ = '{o}' then case " + " ".join(f"when contains(lower(s), '{p}') then '{p.upper()}'" for p in parts) + " else 'GENERAL' end" for o, parts in v.SUBPARTS.items()
)
_ANATOMY = rf"""with {_BLOCKS}, {_under(v.FINDINGS, 'f')},
s as (select *, lower(regexp_extract(s, {_q(_ORGAN)}, 2)) as organ, upper(regexp_extract(s, {_q(_ORGAN)}, 1)) as side, regexp_matches(s, {_q(rf'(?i)^\s*(?:{"|".join(v.CONTINUED)})\b')}) as goes_on
  from {_numbered('f', _split('b', 't'))}),
p as (select *, case when organ <> '' then case {' '.join(f"when organ = '{o}' then '{r}'" for o, r in _REGION_ROWS)} end || '|' ||
    trim(case when side in ('BOTH', 'BILATERAL') then 'BILATERAL' else side end || ' ' || upper(organ)) || '|' || case {_PART} else 'GENERAL' end end as place from s),
o as (select *, case when place is not null and not (goes_on and count(place) over (partition by id order by pos rows between unbounded preceding and 1 preceding) > 0) then place end as opened from p),
t as (select *, coalesce(last_value(opened ignore nulls) over (partition by id order by pos rows between unbounded preceding and current row), 'UNASSIGNED|GENERAL|GENERAL') as spot from o)
select id, cast(pos as int) as pos, split_part(spot, '|', 1) as region, split_part(spot, '|', 2) as organ, split_part(spot, '|', 3) as subpart, s as sentence from t"""

_FIELD_OF = " ".join(f"when section in ({_list(names)}) then '{f}'" for f, names in v.FIELDS.items())
_FIELDS = rf"""with {_BLOCKS},
h as (select *, case {_FIELD_OF} end as field, row_number() over (partition by id order by pos, part) as n from b),
nxt as (select a.id, a.field, a.n, (select arg_min(c.text, c.n) from h c where c.id = a.id and c.n > a.n and c.kind not in ('title', 'heading', 'heading_inline') and trim(c.text) <> ''
    and not exists (select 1 from h d where d.id = a.id and d.kind = 'heading' and d.n > a.n and d.n < c.n)) as value from h a where a.kind = 'heading' and a.field is not null),
v as (select id, field, n, trailer as value from h where kind = 'heading_inline' and field is not null union all select * from nxt where value is not null),
g as (select id, field, arg_min({_strip('value')}, n) as value from v where trim(value) <> '' group by 1, 2)
select r.id, {', '.join(f"coalesce(max(value) filter (where field = '{f}'), '') as {f}" for f in v.FIELDS)}, coalesce(any_value(t.text), '') as study
from (select distinct id from texts) r left join g on g.id = r.id left join (select id, text from b where kind = 'title') t on t.id = r.id group by r.id"""

_MEASURES = rf"""with s as (select id, pos, lower(regexp_extract(s, '(?i)\b(?:(right|left|rt|lt)\.?\s+)?({'|'.join(v.TARGETS)})s?\b', 1)) as side,
  lower(regexp_extract(s, '(?i)\b(?:(right|left|rt|lt)\.?\s+)?({'|'.join(v.TARGETS)})s?\b', 2)) as organ,
  list_max(list_transform(regexp_extract_all(regexp_extract(s, '{{DIMS}}', 1), '(\d+(?:\.\d+)?)'), lambda x: cast(x as double)))
    * case when lower(regexp_extract(s, '{{DIMS}}', 2)) = 'cm' then 10.0 else 1.0 end as mm from {_numbered(f"(select id, report_text as t from {_LATEST} where report_text is not null)", _split('a', 't'))}),
t as (select *, case when organ <> '' then trim(case when side in ('rt', 'right') then 'right' when side in ('lt', 'left') then 'left' else '' end || ' ' || organ) end as own from s),
c as (select *, last_value(own ignore nulls) over (partition by id order by pos rows between unbounded preceding and current row) as target from t),
f as (select *, row_number() over (partition by id, target order by pos) as n from c where target is not null and mm is not null)
select id, target, round_even(mm, 1) as size_mm, case when own is null then 'anaphora' else 'stated' end as via from f where n = 1""".replace(
    "{DIMS}", r"(?i)(\d+(?:\.\d+)?(?:\s*[x×*]\s*\d+(?:\.\d+)?){0,2})\s*(mm|cm)\b"
)

_ENDS = ", ".join(map(_q, v.SUFFIXES))
_STARTS = ", ".join(map(_q, v.PREFIXES))
_REASON = f"""select reason, count(*) as n from (select case when length(low) not between 4 and 60 then '' when e is not null then 'ends in ' || e when p is not null then 'begins with ' || p
  when length(low) >= 10 and regexp_full_match(low, '[a-z]+') then 'long' else '' end as reason
from (select low, list_filter([{_ENDS}], lambda x: ends_with(low, x) or ends_with(case when low like '%s' and not low like '%ss' then left(low, length(low) - 1) else low end, x))[1] as e,
  list_filter([{_STARTS}], lambda x: starts_with(low, x))[1] as p from (select distinct doc_id, w as low from (select doc_id, unnest({_TOKENS}) as w from documents where text is not null)))) group by 1"""

# de-identification


def _first_seen(c: str, pattern: str) -> str:
    return f"(select list_filter(list_filter(xs, lambda x, i: list_position(xs, x) = i), lambda x: x <> '') from (select regexp_extract_all({c}, {_q(pattern)}, 1) as xs))"


def _marked(label: str, xs: str, t: str, swap: str) -> str:
    """``t`` with the values ``xs`` replaced, longest first; ``swap`` uses acc, val and mark."""
    ordered = f"list_transform(list_sort(list_transform({xs}, lambda x, i: {{'l': -length(x), 'i': i, 'v': x}})), lambda e: e.i || '|' || e.v)"
    swap = swap.replace("val", r"regexp_replace(x, '^\d+\|', '')").replace("mark", f"'[{label}-' || split_part(x, '|', 1) || ']'")
    return f"list_reduce(list_concat([{t}], {ordered}), lambda acc, x: {swap})"


_ID_LABEL = "|".join(v.ID_LABELS)
_TITLES = "|".join(v.NAME_TITLES)
_BARE = rf"regexp_replace(regexp_replace({{c}}, '(?i)\b(?:{_TITLES})\b\.?', '', 'g'), '^\s+|\s+$', '', 'g')"
_NAME_PATTERN = rf"'(?i)(?:\b(?:{_TITLES})\.?\s+)?' || regexp_replace(regexp_escape({{c}}), '(?:\\ )+', '\\s+', 'g')"


def _deid() -> str:
    steps, last, n = [], "k2", "n2"
    patterns = [("ID", rf"(?i)\b(?:{_ID_LABEL})\s*[:#-]?\s*([A-Za-z0-9/-]{{4,20}})")]
    patterns += [(k, rf"(?i)(?:^|\D)({p})(?:\D|$)" if k == "PHONE" else f"(?i)({p})") for k, p in v.ID_FORMATS.items()]
    for k, (label, pattern) in enumerate(patterns):
        swap = rf"regexp_replace(acc, '(?i)(\b(?:{_ID_LABEL})\s*[:#-]?\s*)' || val || '([^A-Za-z0-9/-]|$)', '\1' || mark || '\2', 'g')" if label == "ID" else "replace(acc, val, mark)"
        steps.append(f"v{k} as (select id, t, n, {_first_seen('t', pattern)} as xs from {last}), r{k} as (select id, {_marked(label, 'xs', 't', swap)} as t, n + len(xs) as n from v{k})")
        last = f"r{k}"
    return rf"""with names as (select id, report_text as t, {_BARE.format(c='patient')} as a, {_BARE.format(c='referrer')} as b from {_LATEST} where report_text is not null),
p1 as (select *, length(coalesce(a, '')) >= 3 and regexp_matches(t, {_NAME_PATTERN.format(c='a')}) as hit from names),
k1 as (select id, a, b, case when hit then 1 else 0 end as n, case when hit then regexp_replace(t, {_NAME_PATTERN.format(c='a')}, '[NAME-1]', 'g') else t end as t from p1),
p2 as (select *, length(coalesce(b, '')) >= 3 and b is distinct from a and regexp_matches(t, {_NAME_PATTERN.format(c='b')}) as hit from k1),
k2 as (select id, n + case when hit then 1 else 0 end as n, case when hit then regexp_replace(t, {_NAME_PATTERN.format(c='b')}, '[NAME-' || (n + 1) || ']', 'g') else t end as t from p2),
{', '.join(steps)}
select id, md5(t) as digest, cast(n as bigint) as n from {last}"""


def _grams(n: int) -> str:
    return f"""select array_to_string(w[i:i+{n - 1}], ' ') as gram, count(*) as n
from (select w, unnest(range(1, len(w) - {n} + 2)) as i from (select {_WORDS} as w from (select distinct on (chunk_id) text from chunks where text is not null)) where len(w) >= {n})
group by 1 having count(*) >= 5"""


_PAIRS = f"""select t.transcript_id, t.text as source, r.report_text as output from (select distinct on (transcript_id) transcript_id, record_id, text from transcriptions where text is not null order by transcript_id, text) t
  join {_LATEST} r on r.id = t.record_id where r.report_text is not null"""
_BAGS = rf"""with p as ({_PAIRS}), a as (select transcript_id, unnest({_TOKENS.replace('text', 'source')}) as token, 1 as d from p
  union all select transcript_id, unnest({_TOKENS.replace('text', 'output')}), -1 from p),
s as (select transcript_id, token, cast(sum(d) as bigint) as d from a group by all having sum(d) <> 0)
select transcript_id, token, greatest(d, 0) as missing, greatest(-d, 0) as added from s"""

_COMPARE = f"""with r as (select tenant, patient_key, id, {_MINUTE.format(c='created')} as made, measurements from {_LATEST} where patient_key is not null and patient_key <> ''),
l as (select *, lag(id) over w as prior_id, lag(made) over w as prior_made from r window w as (partition by tenant, patient_key order by made nulls first, id)),
m as (select id, unnest(measurements) as m, unnest(range(1, len(measurements) + 1)) as pos from r where measurements is not null),
f as (select id, m.key as key, arg_min(m.size_mm, pos) as mm from m where m is not null and m.size_mm is not null group by 1, 2),
p as (select id, prior_id, abs(date_diff('minute', try_cast(replace(prior_made, 'T', ' ') || ':00' as timestamp), try_cast(replace(made, 'T', ' ') || ':00' as timestamp))) // 1440 as days
  from l where prior_id is not null),
n as (select p.id, p.prior_id, f.key, f.mm as now_mm from p join f on f.id = p.id),
t as (select p.id, p.prior_id, f.key, f.mm as then_mm from p join f on f.id = p.prior_id),
b as (select coalesce(n.id, t.id) as id, coalesce(n.prior_id, t.prior_id) as prior_id, coalesce(n.key, t.key) as key, now_mm, then_mm
  from n full join t on n.id = t.id and n.prior_id = t.prior_id and n.key = t.key),
k as (select *, case when then_mm is null then case when string_split(key, ' ')[-1] in ({_list(v.TRANSIENT)}) then 'new' end
  when now_mm is null then case when string_split(key, ' ')[-1] in ({_list(v.TRANSIENT)}) then 'gone' end
  when abs(now_mm - then_mm) < greatest(2.0, then_mm * 0.10) then 'stable' when now_mm > then_mm then 'grew' else 'shrank' end as kind from b)
select k.id, k.prior_id, key, kind, round(now_mm - then_mm, 1) as change_mm,
  coalesce(case when days < 45 then days || ' days' else cast(round_even(days / 30.4, 0) as bigint) || ' months' end, '') as "interval"
from k join p on p.id = k.id and p.prior_id = k.prior_id where kind is not null"""


def _sound(c: str) -> str:
    out = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    for a, b in SOUNDS:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    for x in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{x}{x}+', '{x}', 'g')"
    return out


_NAME = r"regexp_replace({c}, '(?i)\b(mrs?|ms|miss|dr|master|baby)\b\.?', '', 'g')"
_ESCAPED = r"replace(replace(replace(replace(replace({c}, '\', '\E\'), '|', '\F\'), '^', '\S\'), '&', '\T\'), '~', '\R\')"

_LINKS = """(with p as (select user_id, list(event_id || '|' || event_type order by event_id) as xs, list(event_id order by event_id) as ids, list(event_type order by event_id) as types from events group by 1),
e as (select *, unnest(range(1, len(xs) + 1)) as i from p)
select user_id, i, ids[i] as event_id, types[i] as event_type, list_reduce(list_concat([''], xs[1:i]), lambda acc, x: sha256(acc || '|' || x)) as link from e)"""
_FILLED = "coalesce(nullif({c}, ''), '{o}')"
_ALERT_TERMS = "coalesce(nullif(array_to_string(list_filter(triage_terms, lambda t: t is not null), ', '), ''), 'critical finding')"
_AUDIT = rf"""with p as ({_PAIRS}), m as (select transcript_id, output, regexp_replace(source, '(?m)^\s*(?:[{v.BULLETS[:-1]}-]+|\(?(?:\d{{1,2}}|[a-z])[.)])\s+', '', 'g') as source from p),
a as (select transcript_id, unnest({_TOKENS.replace('text', 'source')}) as token, 1 as d from m union all select transcript_id, unnest({_TOKENS.replace('text', 'output')}), -1 from m),
s as (select transcript_id, token, sum(d) as d from a group by all)
select p.transcript_id, cast(coalesce(sum(greatest(d, 0)), 0) as bigint) as missing, cast(coalesce(sum(greatest(-d, 0)), 0) as bigint) as added, coalesce(sum(greatest(d, 0)), 0) = 0 as passed
from p left join s on s.transcript_id = p.transcript_id group by 1"""
_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_KEY = "trim(regexp_replace(lower({c}), '" + _SPACES.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_ENTRIES = f"""(select key, cast(sum(n) as bigint) as n, count(distinct source) as files from (select {_KEY.format(c='term')} as key, unnest(map_keys(sources)) as source, unnest(map_values(sources)) as n
from (select distinct on (entry_id) entry_id, term, sources from corpus_terms where sources is not null) where term is not null) where key <> '' group by 1)"""
_MEMORIES = """(select distinct on (memory_id) *, concat_ws('/', tenant, doctor) as owner from memories where memory_id is not null)"""
_CONTENT = r"lower(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\.+$', ''))"

ORACLE = {
    "chain_links": f"select event_id, link from {_LINKS}",
    "chain_status": f"""with l as {_LINKS}, c as (select user_id, i - 1 as pos, link = sha256(coalesce(lag(link) over (partition by user_id order by event_id), '') || '|' || event_id || '|' ||
  case when event_id % 997 = 0 then 'edited' else event_type end) as ok from l)
select user_id, count(*) as links, bool_and(ok) as intact, min(case when not ok then pos end) as first_break from c group by 1""",
    "trail_checks": f"""with s as (select id, list_filter(list_transform(trail, lambda s: lower(regexp_replace(s.what, ' (?:via|past) .*$', ''))), lambda x: x in ('created', 'signed', 'delivered')) as t from {_LATEST} where trail is not null),
r as (select t[i] as what, i, case when i > 1 then t[i - 1] else '' end as b from (select t, unnest(range(1, len(t) + 1)) as i from s))
select what, count(*) as n, count_if(not case what when 'created' then i = 1 when 'signed' then b in ('', 'created') else b in ('signed', 'delivered') end) as illegal from r group by 1""",
    "kept_versions": f"""select id, "at", version from (select *, row_number() over (partition by id order by "at") as version, row_number() over (partition by id order by "at" desc) as age
from (select distinct id, {_MINUTE.format(c='updated')} as "at" from records where id is not null and updated is not null)) where age <= 2""",
    "sealed_round_trip": "select doc_id, md5(text) as digest, text is not null as hidden from documents",
    "pasted_parts": r"""select doc_id, count(*) as parts from (select doc_id, regexp_replace(unnest(string_split_regex(replace(text, chr(10) || chr(10), chr(10) || '----' || chr(10)), '(?m)^\s*-{3,}\s*$')), '^\s+|\s+$', '', 'g') as p
from documents where text is not null) where p <> '' group by 1""",
    "oru_fields": rf"""select id, id as control_id, case when regexp_matches(coalesce(age_sex, ''), '(?i)female') then 'F' when regexp_matches(coalesce(age_sex, ''), '(?i)male') then 'M'
  else upper(regexp_extract(' ' || coalesce(age_sex, '') || ' ', '[^A-Za-z]([MFmf])[^A-Za-z]', 1)) end as sex,
  len(list_filter(string_split(replace(report_text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '')) as lines from {_LATEST} where report_text is not null""",
    "order_round_trip": f"select id, true as ok, 'no room' as why from {_LATEST} where report_text is not null",
    "fhir_reports": f"""select id, case when status in ('signed', 'delivered') then 'final' else 'preliminary' end as status, case when regexp_matches(coalesce(age_sex, ''), '(?i)female') then 'female'
  when regexp_matches(coalesce(age_sex, ''), '(?i)male') then 'male' when regexp_matches(' ' || coalesce(age_sex, '') || ' ', '[^A-Za-z][fF][^A-Za-z]') then 'female'
  when regexp_matches(' ' || coalesce(age_sex, '') || ' ', '[^A-Za-z][mM][^A-Za-z]') then 'male' end as gender, nullif(patient, '') as name, md5(report_text) as digest, true as linked from {_LATEST} where report_text is not null""",
    "alerts": f"""select id, '[' || upper(urgency) || '] ' || {_ALERT_TERMS} || ' - ' || {_FILLED.format(c='patient', o='an unnamed patient')} as subject,
  left(upper(urgency) || ': ' || {_ALERT_TERMS} || '. ' || {_FILLED.format(c='patient', o='an unnamed patient')} || ', ' || {_FILLED.format(c='study', o='a radiology study')} || '. Full report to follow.', 320) as short,
  md5('Dear ' || {_FILLED.format(c='referrer', o='Doctor')} || ',' || chr(10) || chr(10) || 'A ' || upper(urgency) || ' finding needs your attention.' || chr(10) || chr(10) || 'Patient: ' || {_FILLED.format(c='patient', o='an unnamed patient')}
    || ' (' || {_FILLED.format(c='age_sex', o='age/sex not stated')} || ')' || chr(10) || 'Study: ' || {_FILLED.format(c='study', o='a radiology study')} || chr(10) || 'Finding: ' || {_ALERT_TERMS} || chr(10) || 'Signed: '
    || coalesce(nullif(signed_at, ''), updated, '') || ' by ' || {_FILLED.format(c='signed_by', o='the reporting radiologist')} || chr(10) || chr(10) || 'The full report follows. Please acknowledge receipt.') as digest
from {_LATEST} where urgency in ('stat', 'urgent')""",
    "unique_filenames": r"""with s as (select referrer_id, left(coalesce(nullif(replace(trim(regexp_replace(city, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_'), ''), 'report'), 80) as safe from referrers),
n as (select referrer_id, safe, row_number() over (partition by safe order by referrer_id) as n from s)
select referrer_id, case when n = 1 then safe else safe || '_' || n end as filename from n""",
    "intake_texts": rf"""with r as (select id, nullif(trim(patient), '') as p, nullif(trim(age_sex), '') as a, upper(nullif(trim(study), '')) as s, trim(report_text) as t from {_LATEST} where report_text is not null),
m as (select id, t, concat_ws(chr(10), s || case when s like '%REPORT' then '' else ' REPORT' end || chr(10), 'PATIENT NAME: ' || p, 'AGE/SEX: ' || a) as m from r)
select id, md5(case when m <> '' then m || chr(10) || chr(10) || t else t end) as digest from m""",
    "audit_verdicts": _AUDIT,
    "library_entries": f"select key, n, files from {_ENTRIES}",
    "library_top": f"select key as term, n from {_ENTRIES} order by n desc, key limit 50",
    "memory_replayed": f"""with m as (select owner, kind, trim(coalesce(concept, '')) as concept, memory_id as seq, {_CONTENT.format(c='content')} as content from {_MEMORIES} where content is not null and trim(content) <> ''),
o as (select owner, kind, content, lower(arg_min(concept, seq)) as concept, min(seq) as first_, max(seq) as last_ from m group by 1, 2, 3)
select a.owner, a.kind, a.concept, a.content, case when a.concept <> '' and a.kind in ('style_rule', 'episodic_case')
  then pow(0.5, (select count(*) from o b where b.owner = a.owner and b.kind = a.kind and b.concept = a.concept and b.first_ > a.last_)) else 1.0 end as confidence from o a""",
    "latest_records": f"select id, {_MINUTE.format(c='updated')} as updated, cast(coalesce(len(trail), -1) as bigint) as steps from {_LATEST}",
    "event_tail": "select event_id, event_type, user_id from events order by ts desc, event_id desc limit 100",
    "commits_accepted": """select user_id, count_if(rn = 1) as accepted, count_if(rn > 1) as conflicts from (
select user_id, row_number() over (partition by user_id, cast(ts as date) order by event_id) as rn from events) group by 1""",
    "capped_history": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 10",
    "imported_once": "select sha1(text) as digest, min(doc_id) as doc_id from documents where text is not null group by 1",
    "without_deleted": "select doc_id, source from documents where not (text is null or trim(text) = '')",
    "tenants": r"""select distinct coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(tenant)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'default') as tenant from records""",
    "trail_transitions": f"""with t as (select id, list_filter(trail, lambda s: s is not null) as t from {_LATEST} where trail is not null),
s as (select id, unnest(t) as s, unnest(range(1, len(t) + 1)) as i from t),
n as (select id, i, regexp_replace(s.what, ' via .*$', '') as what from s)
select before, what, count(*) as n from (select case when i > 1 then lag(what) over (partition by id order by i) else '' end as before, what from n) group by all""",
    "urgency_counts": f"select coalesce(nullif(urgency, ''), 'routine') as urgency, status, count(*) as n from {_LATEST} group by all",
    "urgency_rollup": f"""select m as modality, status, count(*) as n, cast(grouping(m) * 2 + grouping(status) as bigint) as level
from (select lower(modality) as m, status from {_LATEST}) group by rollup (m, status)""",
    "worklist": f"""select id, tenant, coalesce(urgency, 'routine') as urgency, {_MINUTE.format(c='updated')} as updated from {_LATEST}
where status = 'draft' order by {_MINUTE.format(c='updated')} desc nulls last, id limit 100""",
    "priors": f"""with r as (select tenant, patient_key, id, status, {_MINUTE.format(c='created')} as made, trim(coalesce(report_text, '')) as body from {_LATEST} where patient_key is not null and patient_key <> ''),
o as (select *, row_number() over (partition by tenant, patient_key order by made nulls first, id) as n from r),
p as (select a.id, b.id as prior_id, a.body <> b.body as other, row_number() over (partition by a.id order by b.n desc) as rank from o a join o b
  on a.tenant is not distinct from b.tenant and a.patient_key = b.patient_key and b.n < a.n and b.status in ('signed', 'delivered'))
select id, prior_id, rank from p where rank <= 5 and other""",
    "measure_compare": _COMPARE,
    "delta_summary": f"select kind, count(*) as n from ({_COMPARE}) group by kind",
    "report_blocks": f"with {_BLOCKS} select id, kind, section, text, trailer from b",
    "report_fields": _FIELDS,
    "triage_levels": _TRIAGE,
    "negation_polarity": _POLARITY,
    "draft_guard": _GUARD,
    "quality_findings": _CHECKS,
    "quality_histogram": f"select severity, count(*) as n from ({_CHECKS}) group by 1",
    "guideline_advice": _ADVICE,
    "impression_proposals": _PROPOSALS,
    "anatomy_placed": _ANATOMY,
    "anatomy_counts": f"select region, organ, count(*) as n from ({_ANATOMY}) group by 1, 2",
    "report_measurements": _MEASURES,
    "section_lines": f"with {_BLOCKS} select section, count(*) as lines, count(distinct id) as reports from b where kind <> 'title' group by 1",
    "term_reasons": _REASON,
    "deid_clean": _deid(),
    "token_counts": f"select doc_id, token, count(*) as n from (select doc_id, unnest({_TOKENS}) as token from documents where text is not null) group by all",
    "bag_difference": _BAGS,
    "missing_numbers": rf"select transcript_id, token as number from ({_BAGS}) where missing > 0 and regexp_full_match(token, '\d+(\.\d+)?')",
    "sentence_counts": "select doc_id, " + ", ".join(f"cast(len({_split(s)}) as bigint) as style_{s}" for s in "abc") + " from documents where text is not null",
    "sentence_contexts": f"select {_CONTEXT} as context, count(*) as n from (select unnest({_split('b')}) as s from documents where text is not null) group by 1",
    "modalities": "select case " + " ".join(f"when contains(' ' || lower(coalesce(study, '')) || ' ', '{a}') then '{b}'" for a, b in MODALITIES) + " else '' end as modality, count(*) as n from records group by 1",
    "patient_slugs": r"""select patient, age_sex, left(regexp_replace(concat(
regexp_replace(regexp_replace(regexp_replace(lower(coalesce(patient, '')), '\b(mrs?|ms|miss|dr|master|baby|b/o|s/o|d/o|w/o)\b\.?', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'),
'-', left(regexp_extract(lower(coalesce(age_sex, '')), '\b(male|female|m|f)\b', 1), 1)), '^-+|-+$', '', 'g'), 80) as slug from (select distinct patient, age_sex from records)""",
    "sound_keys": f"""select term, concat(left(k, 1), regexp_replace(substring(k, 2), '[aeiou]', '', 'g')) as key from (select term, {_sound('term')} as k
from (select distinct term from corpus_terms where term is not null))""",
    "hl7_names": rf"""select patient, case when len(p) = 0 then '' when len(p) = 1 then {_ESCAPED.format(c='upper(p[1])')}
  else {_ESCAPED.format(c='upper(p[-1])')} || '^' || {_ESCAPED.format(c="upper(array_to_string(p[1:-2], ' '))")} end as name
from (select patient, list_filter(string_split_regex(trim({_NAME.format(c='patient')}), '\s+'), lambda w: w <> '') as p from (select distinct patient from records where patient is not null))""",
    "bigrams": _grams(2),
    "trigrams": _grams(3),
    "hash_vectors": f"""with w as (select doc_id, unnest({_WORDS}) as w from documents where text is not null),
c as (select doc_id, cast(('0x' || right(sha1(w), 2)) as bigint) as bucket, count(*) as n from w group by all)
select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 4) as weight from c""",
    "vector_search": """with p as (select q.vec_id as query, e.vec_id as id, list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) as s
from embeddings q join embeddings e on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id),
r as (select query, id, s, row_number() over (partition by query order by round(s, 6) desc, id) as rank from p)
select query, id, rank, round(s, 4) as score from r where rank <= 5""",
    "profile_stats": """select tenant, doctor, count(*) as n, count(distinct concept) as concepts, cast(sum(uses) as bigint) as uses
from (select distinct on (memory_id) tenant, doctor, concept, uses from memories) group by all""",
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_replay": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "confidence_by_engine": """select engine, count(*) as pages, round(avg(case when confidence > 0 then confidence end), 4) as confidence
from (select distinct on (page_id) engine, confidence from ocr_results) group by 1""",
    "critical_impressions": """select tenant, count(*) filter (where i.is_critical) as critical, count(*) as n from (select tenant, unnest(impression) as i
from (select distinct on (report_id) tenant, impression from structured_reports)) where i is not null group by 1""",
}


def _restyled(c: str) -> str:
    for pattern, to in rate_patterns():
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(to.replace('$1', chr(92) + '1'))}, 'g')"
    for n in range(1, 6):
        c = f"regexp_replace({c}, {_q(rf'(?i)\bgrade[ -](?:{v.ONES[n]}|{n}|{numeral(n)})\b')}, 'Grade {numeral(n)}', 'g')"
    return c


_KEY_PAD = [bytes(b ^ p for b in b"demo key".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
_SIMPLE_WORDS = r"list_distinct(regexp_extract_all(lower({c}), '([a-z][a-z''\-]{{2,}}|\d+(?:\.\d+)?)'))"
_SEEN = "try_cast(left(coalesce(nullif(last_used, ''), created), 10) as date)"
_NAMED = r"list_filter(regexp_extract_all(lower(full_name), '[\p{L}]{2,}'), lambda x: x <> 'dr')"

ORACLE |= {
    "unit_style": f"select transcript_id, md5({_restyled('text')}) as digest from (select distinct transcript_id, text from transcriptions where text is not null)",
    "keyed_hashes": f"select c_custkey, sha256(unhex('{_KEY_PAD[1]}') || unhex(sha256(unhex('{_KEY_PAD[0]}') || encode(c_name)))) as mac from customer",
    "memory_strength": f"""select distinct memory_id, round(confidence * exp(-ln(2) / 180.0 * greatest(date_diff('day', {_SEEN}, date '2026-01-01'), 0)), 4) as strength
from memories where memory_id is not null""",
    "draft_badges": rf"""with {_BLOCKS}, {_under(v.FINDINGS, 'f')}, {_under(v.IMPRESSION, 'i')}, fe as {_entities('f')},
t as (select distinct id, term from fe), n as (select id, count_if(negated) as negated from fe group by 1),
k as (select t.id, count_if(contains(lower(coalesce(i.t, '')), term)) as carried, count(*) as all_ from t left join i on i.id = t.id group by 1)
select x.id, coalesce(negated, 0) as negated, len(list_distinct(regexp_extract_all(lower(coalesce(i.t, '')), '\d+(?:\.\d+)?'))) as numbers, coalesce(carried, 0) as carried, coalesce(all_ - carried, 0) as missing
from (select distinct id from texts) x left join n on n.id = x.id left join k on k.id = x.id left join i on i.id = x.id""",
    "anatomy_paths": f"""select id, array_to_string(list_filter([region, organ, subpart], lambda p: p <> 'GENERAL'), ' > ') as path, md5(string_agg(sentence, chr(10) order by pos)) as digest from ({_ANATOMY}) group by 1, 2""",
    "routed_reports": rf"""with r as (select id, lower(coalesce(report_text, '')) as t from {_LATEST}),
w as (select id, regexp_extract_all(t, '[\p{{L}}]+') as w, true as tail from (select id, right(t, 400) as t from r) union all select id, regexp_extract_all(t, '[\p{{L}}]+'), false from r),
p as (select distinct id, tail, w[i] || ' ' || w[i + 1] as pair from (select *, unnest(range(1, len(w))) as i from w)),
k as (select distinct full_name, array_to_string(({_NAMED})[1:2], ' ') as pair from referrers),
f as (select p.id, list_distinct(list(full_name) filter (where tail)) as signed, list_distinct(list(full_name)) as named from p join k on k.pair = p.pair group by 1),
c as (select r.id, case when len(signed) > 0 then signed else coalesce(named, []) end as pool, coalesce(len(signed), 0) > 0 as at_end from r left join f on f.id = r.id)
select id, case when len(pool) = 1 then pool[1] end as doctor, case when len(pool) = 0 then 'none' when len(pool) > 1 then 'ambiguous' when at_end then 'signature' else 'mention' end as how from c""",
    "memory_retrieved": f"""with m as (select memory_id, owner, content, {_SIMPLE_WORDS.format(c='content')} as w, embedder, vector, coalesce(confidence, 1.0) as confidence,
  greatest(coalesce(date_diff('day', {_SEEN}, date '2026-01-01'), 0), 0) as age from {_MEMORIES} where owner is not null and content is not null and vector is not null),
p as (select q.memory_id as query, m.memory_id, lower(m.content) as c, round_even(case when m.embedder = q.embedder then case when len(m.vector) = len(q.vector) and list_dot_product(m.vector, m.vector) * list_dot_product(q.vector, q.vector) > 0
    then list_dot_product(m.vector, q.vector) / sqrt(list_dot_product(m.vector, m.vector) * list_dot_product(q.vector, q.vector)) else 0.0 end
  when len(m.w) > 0 and len(q.w) > 0 then len(list_intersect(q.w, m.w)) / sqrt(cast(len(q.w) as double) * len(m.w)) else 0.0 end * exp(-ln(2) / 180.0 * m.age) * m.confidence, 4) as score
  from m q join m on q.memory_id % 10 = 0 and m.owner = q.owner)
select query, memory_id, score, rank from (select *, row_number() over (partition by query order by score desc, c, memory_id) as rank from p where score >= 0.05) where rank <= 5""",
    "memory_reinforced": "",
}
ORACLE["memory_reinforced"] = f"""with h as (select distinct memory_id from ({ORACLE['memory_retrieved']}) where rank = 1), n as (select memory_id, count(*) as k from ({ORACLE['memory_retrieved']}) where rank = 1 group by 1)
select coalesce(h.memory_id is not null or last_used = '2026-01-01', false) as fresh, count(*) as n, cast(sum(coalesce(uses, 0) + coalesce(k, 0)) as bigint) as uses
from {_MEMORIES} m left join h on h.memory_id = m.memory_id left join n on n.memory_id = m.memory_id group by 1"""
