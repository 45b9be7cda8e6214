"""SQL that gives the rows of those queries which SQL can express."""

from logspark.llm.quality_divergence import CLASSES, COMMON_WORDS, MAX_REPEATED, MIN_WORDS

_BLANKS = r"[\x20\x09-\x0D]"
_LISTS = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
_CODES = ", ".join(f"'{k}'" for k in COMMON_WORDS)


def _class_counts() -> str:
    """Steps that strip one class after the other, and the list of what each took."""
    steps, left, names = [], "t", []
    for name, kind in CLASSES:
        steps.append(f"regexp_replace({left}, '{kind.replace(chr(39), chr(39) * 2)}+', '', 'g') as c_{name}")
        names.append((left, f"c_{name}"))
        left = f"c_{name}"
    counts = ", ".join(f"length({a}) - length({b})" for a, b in names)
    return ", ".join(steps), f"[{counts}, length({left})]"


_STEPS, _COUNTS = _class_counts()
_ODD, _UPPER, _LETTERS = f"cls[{len(CLASSES) + 1}]", "cls[3]", "(cls[1] + cls[3] + cls[4])"


def _term(p: str, m: str) -> str:
    return f"case when {p} > 0 then {p} * log2({p} / {m}) else 0.0 end"


def _distance(counts: str, total: str, shares: str) -> str:
    p, q = f"({counts}[i] / {total}::double)", f"{shares}[i]"
    m = f"(({p} + {q}) / 2)"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {_term(p, m)} + {_term(q, m)})), 0.0) / 2)"


OP1 = rf"""
with d as (select doc_id, coalesce(text, '') as t, case when lower(lang) in ({_CODES}) then lower(lang) else 'other' end as l from documents),
 s as (select *, {_STEPS}, list_filter(string_split_regex(t, '{_BLANKS}+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
 c as (select doc_id, t, l, ws, ls, {_COUNTS} as cls, len(ws) as n_words, list_transform(ws, lambda x: lower(x)) as lows, case l {_LISTS} end as list from s),
 k as (select *, case when list is not null then list_transform(list, lambda w: len(list_filter(lows, lambda x: x = w))) end as own from c),
 h as (select *, case when own is not null then list_append(own, n_words - list_sum(own)::bigint) end as com from k),
 u as (select * from h where n_words >= {MIN_WORDS} and {_UPPER} <= cls[1] + cls[4] and {_ODD} <= 0.05 * ({_LETTERS} + {_ODD})),
 rc as (select l, list(n order by i) as rcls from (select l, i, sum(cls[i]) + 1 as n from u, range(1, {len(CLASSES) + 2}) r(i) group by l, i) group by l),
 rw as (select l, list(n order by i) as rcom from (select l, i, sum(com[i]) + 1 as n from u, range(1, 100) r(i) where i <= len(com) group by l, i) group by l),
 refs as (select rc.l, list_transform(rcls, lambda x: x / list_sum(rcls)::double) as qc, list_transform(rcom, lambda x: x / list_sum(rcom)::double) as qw from rc left join rw on rw.l = rc.l),
 win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w from (select doc_id, ws, unnest(range(1, n_words - 1)) as i from h)),
 dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from win) where n > 1),
 cov as (select doc_id, sum(g)::bigint as n from (select doc_id, least(3, coalesce(lead(i) over (partition by doc_id order by i) - i, 3)) as g from dup) group by doc_id),
 b as (select h.*, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, qc, qw
  from h left join cov using (doc_id) left join refs using (l)),
 e as (select *, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEATED} as base_failed,
  case when word_chars >= 200 and length(t) > 0 then {_distance('cls', 'length(t)', 'qc')} end as dc, case when n_words >= 50 and com is not null then {_distance('com', 'n_words', 'qw')} end as dw from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not ((coalesce(dc, 0) > 0.16 and coalesce(dw, 1) > 0.24) or coalesce(dc, 0) > 0.32) as kept, round(dc, 9) as class_distance, round(dw, 9) as word_distance from e
"""


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".replace("\\\\", "\\")
OP11 = f"""
with d as (select doc_id, {_TERMS.format('text')} as ts from documents where text is not null),
 c as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
 q as materialized (select item_id, t, count(*) as k from (select item_id, unnest({_TERMS.format('text')}) as t from benchmark) group by all),
 f as materialized (select doc_id, t, count(*) as tf, any_value(n) as n from (select doc_id, len(ts) as n, unnest(ts) as t from d) where t in (select t from q) group by all),
 w as (select t, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)::double))::bigint as w from f, c group by t, c.n),
 s as (select q.item_id, f.doc_id, sum(q.k * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * f.n * c.n) // c.l))))::bigint as score from q join f using (t) join w using (t), c group by all),
 r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"p as materialized (select vec_id, label, i as part, v[i * len(v) // {parts} + 1 : (i + 1) * len(v) // {parts}] as x from k, range(0, {parts}) r(i))",
        f"c0 as materialized (select part, (row_number() over (partition by part order by vec_id) - 1)::int as e, x from p where vec_id in (select vec_id from k order by vec_id limit {entries}))",
    ]
    for n in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"a{n} as materialized (select vec_id, part, min(d) as d, arg_min(e, (d, e)) as e from (select p.vec_id, p.part, c.e, {far} as d from p join c{n} c using (part)) group by vec_id, part)")
        if n < rounds:
            mean = "list(floor(m) order by j)"
            steps.append(f"m{n} as (select part, e, {mean} as x from (select part, e, j, sum(x[j]) // 1 / count(*) as m from (select a{n}.part, a{n}.e, p.x, unnest(range(1, len(p.x) + 1)) as j from a{n} join p using (vec_id, part)) group by part, e, j) group by part, e)")
            steps.append(f"c{n + 1} as materialized (select c.part, c.e, coalesce(m.x::bigint[], c.x) as x from c{n} c left join m{n} m using (part, e))")
    last = rounds
    steps += [
        f"f as (select vec_id, string_agg(printf('%02x', e::int), '' order by part) as code, sum(d)::bigint as error from a{last} group by vec_id)",
        "l as (select k.label, sum(f.error)::bigint as label_error from f join k using (vec_id) group by k.label)",
        f"h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) as codebooks_sha256 from c{last})",
    ]
    return "with " + ",\n ".join(steps) + "\nselect f.vec_id, f.code, f.error, l.label_error, h.codebooks_sha256 from f join k using (vec_id) join l on l.label is not distinct from k.label, h"


OP12 = _codes_sql()

OP13 = r"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5('13|' || coalesce(doc_id::varchar, chr(1)) || '|' || coalesce(lang, chr(1)) || '|' || coalesce(source, chr(1)) || '|' || coalesce(n_chars::varchar, chr(1)) || '|' || coalesce(md5(text), chr(1))), 1, 15))::bigint as lot from documents),
 s as (select source, sum(size)::bigint as size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
 o as (select *, 2.0 * size as cap, sum(2.0 * size) over b as caps, sum(w) over b as ws, 2.0 * size / w as level from s window b as (order by 2.0 * size / w, source nulls last)),
 t as (select sum(size) * 1.5::double as total, sum(w) as ws from s),
 c as (select o.*, (t.total - (o.caps - o.cap)) / (t.ws - (o.ws - o.w)) as open_level from o, t),
 y as (select max(open_level) as level from c where open_level <= level),
 p as (select source, size, least(cap, coalesce(w * y.level, cap)) as target from o, y),
 g as (select source, size, target, least(round(target)::bigint, 2 * size) as want from p),
 e as (select source, size, target, case when size > 0 then want // size else 0 end as epochs, want - case when size > 0 then want // size else 0 end * size as rest from g),
 x as (select d.*, e.size as source_size, e.target, e.epochs, e.rest, sum(d.size) over (partition by d.source order by d.lot) as upto, sum(d.size) over (partition by d.source, d.lot) as same from d join e on e.source is not distinct from d.source)
select doc_id, size, source_size, round(target, 6) as target,
 (size * epochs + case when upto <= rest then size when upto - same < rest then case when same = size then rest - (upto - same) else floor(size * ((rest - (upto - same)) / same::double)) end else 0 end)::bigint as taken from x
"""
