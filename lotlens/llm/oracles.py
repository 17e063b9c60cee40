"""DuckDB SQL for the rows of the operators that SQL can express; written from their definitions, not from their steps."""

from __future__ import annotations

from . import decontamination, secrets

TOP_K = """
with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e
           from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select q.vec_id as query_id, v.vec_id,
                  cast(list_sum([p[1] * p[2] for p in list_zip(q.e, v.e)]) as bigint) as score
           from v as q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id
           where q.vec_id % 20 = 0),
ranked as (select query_id, vec_id, score,
                  row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, cast(n as integer) as rank, vec_id, score from ranked where n <= 20"""

HARD_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
           from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
anchors as (select row_number() over () as a, * from (select distinct * from v where vec_id % 50 = 0)),
scored as (select a, q.vec_id as anchor_id, v.vec_id, q.label = v.label as same,
                  cast(list_sum([p[1] * p[2] for p in list_zip(q.e, v.e)]) as bigint) as score
           from anchors as q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id),
positives as (select a, anchor_id, vec_id as positive_id, score as positive_score,
                row_number() over (partition by a order by score desc, vec_id) as n from scored where same
              qualify n <= 5),
negatives as (select p.*, s.vec_id as negative_id, s.score as negative_score,
                row_number() over (partition by p.a, p.n order by s.score desc, s.vec_id) as m
              from positives p join scored s on s.a = p.a and not s.same
              where 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(m as integer) as rank, negative_id, positive_score, negative_score from negatives where m <= 3"""


def spelling_variants() -> str:
    """Checksums bit by bit as their definition has it; near words by what is left when one letter is taken away."""
    table = "cast(range(0, 256) as ubigint[])"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))"
    return rf"""
with recursive crc as (select {table} as t),
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
lowered as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
bytes as (select id, run, n, hex(encode(id || ':' || run)) as x from lowered where length(run) >= 6),
summed as (select id, run, n, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as int), 2) as ubigint))),
    lambda c, b: xor(t[cast(xor(c, b) & 255 as int) + 1], c >> 8))) as h from bytes, crc),
counted as (select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from summed),
words as (select word, cast(sum(n) as bigint) as n, length(word) as l from counted where length(word) >= 6 group by word having sum(n) >= 5),
places as (select word, n, l, unnest(range(1, l + 1)) as i from words),
cut as (select word, n, i, l, substr(word, 1, cast(i - 1 as int)) || substr(word, cast(i + 1 as int)) as rest from places),
near as (select a.word, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
   union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
   union select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
first as (select b.word, b.n_near, b.m, min(x.other) as other from best b join near x on x.word = b.word and x.m = b.m group by all),
forms as (select w.word, w.n, coalesce(f.n_near, 0) as n_near, case when f.m >= 5 * w.n then f.other end as form,
   case when f.m >= 5 * w.n then f.m end as form_n from words w left join first f using (word)),
walk(word, root) as (select word, word from forms union all select walk.word, forms.form from walk join forms on forms.word = walk.root where forms.form is not null),
roots as (select walk.word, walk.root from walk join forms on forms.word = walk.root where forms.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def linked_secrets() -> str:
    found = []
    for rank, (kind, role, strong, pattern, group, least) in enumerate(secrets.KINDS, 1):
        p = _quoted(pattern)
        found.append(f"""
select rid, {rank} as rank, '{kind}' as kind, '{role}' as role, {str(strong).lower()} as strong, start, start + length(f[i]) as stop
from (select rid, f, g, i, cast(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in f[1:i - 1]]), 0) as bigint) as start
      from (select rid, f, g, s, unnest(range(1, len(f) + 1)) as i
            from (select rid, regexp_extract_all(text, {p}, 0) as f, regexp_extract_all(text, {p}, {group}) as g,
                         regexp_split_to_array(text, {p}) as s from t where regexp_matches(text, {p})))) x
where length(g[i]) >= {least}""")
    count = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank){}, '')"
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
parts as ({" union all ".join(found)}),
listed as (select * from parts p where strong or not exists (
    select 1 from parts s where s.strong and s.rid = p.rid and s.start < p.stop and p.start < s.stop)),
shown as (select * from listed a where strong or exists (
    select 1 from listed b where b.rid = a.rid and abs(a.start - b.start) <= {secrets.REACH}
      and case when a.role = 'secret' then b.role in ('identifier', 'endpoint') else b.role = 'secret' end)),
summed as (select rid, {count}, sha256({listed.format(" filter (strong)")}) as base_sha256, {listed.format("")} as spans from shown group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in secrets.BASE)}, coalesce(base_sha256, sha256('')) as base_sha256,
  coalesce(spans, '') as spans from t left join summed using (rid)"""


def repeated_windows(span: int) -> str:
    return rf"""
with t as (select row_number() over () as rid, doc_id, [w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] as w from documents),
words as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from t),
windows as (select rid, j, word, string_agg(word, ' ') over following as k, count(*) over following as n from words
  window following as (partition by rid order by j rows between current row and {span - 1} following)),
repeated as (select k from windows where n = {span} group by k having count(*) > 1),
marked as (select w.rid, w.j, w.word, n = {span} and k in (select k from repeated) as starts from windows w),
covered as (select rid, j, word, max(starts) over (partition by rid order by j rows between {span - 1} preceding and current row) as gone from marked),
summed as (select rid, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by j) filter (not gone), '') as kept from covered group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join summed using (rid)"""


def jaccard_groups(width: int, threshold: float) -> str:
    return rf"""
with recursive t as (select row_number() over () as rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents),
words as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as j, len(w) as n from t),
runs as (select rid, run from (
    select rid, n, string_agg(word, ' ') over following as run, count(*) over following as m, j from words
    window following as (partition by rid order by j rows between current row and {width - 1} following))
  where m = {width} or (n < {width} and j = 1) group by rid, run),
sets as (select rid, md5(string_agg(run, '|' order by run)) as s, count(*) as n from runs group by rid),
kinds as (select s, min(rid) as k, min(doc_id) as copy_id, count(*) as copies, any_value(n) as n from sets join t using (rid) group by s),
kept as (select rid as k, run from runs where rid in (select k from kinds)),
linked as (select x.a, x.b, p.copies as ca, q.copies as cb from (
    select a.k as a, b.k as b, count(*) as c from kept a join kept b on a.run = b.run and a.k < b.k group by 1, 2) x
  join kinds p on p.k = x.a join kinds q on q.k = x.b where c >= {threshold} * (p.n + q.n - c) - 1e-9),
ties as (select a, b, cb as copies from linked union all select b, a, ca from linked),
reach(k, other) as (select k, k from kinds union select reach.k, ties.b from reach join ties on ties.a = reach.other),
classes as (select r.k, min(o.copy_id) as class_id from reach r join kinds o on o.k = r.other group by r.k),
links as (select a as k, cast(sum(copies) as bigint) as n from ties group by a)
select t.doc_id, coalesce(c.class_id, t.doc_id) as class_id, coalesce(g.copy_id, t.doc_id) as copy_id,
  case when g.k is null then 0 else coalesce(l.n, 0) + g.copies - 1 end as n_links
from t left join sets using (rid) left join kinds g on g.s = sets.s left join classes c on c.k = g.k left join links l on l.k = g.k"""


def benchmark_overlaps() -> str:
    """Every diagonal of every document and item that share enough words, and every stretch of it."""
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    m, share = decontamination.MIN_WORDS, decontamination.MIN_SHARE
    return rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') as w from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') as w from benchmark where item_id is not null),
dw as (select rid, unnest(w) as word, unnest(range(0, len(w))) as j from d),
bw as (select item_id, unnest(w) as word, unnest(range(0, len(w))) as i, len(w) as n, least({m}, cast(ceil(len(w) * 4 / 5.0) as bigint)) as need
  from b where len(w) >= {decontamination.LEAST_ITEM}),
lines as (select rid, item_id, j - i as line, need, n from dw join bw using (word) group by all having count(*) >= need),
places as (select l.*, bw.i, dw.word is not null and dw.word = bw.word as agree from lines l join bw on bw.item_id = l.item_id
  join dw on dw.rid = l.rid and dw.j = bw.i + l.line),
summed as (select *, sum(cast(agree as int)) over w as total, row_number() over w as p from places
  window w as (partition by rid, item_id, line order by i rows between unbounded preceding and current row)),
ends as (select rid, item_id, line, need, i, p, total from summed union all select rid, item_id, line, need, min(i) - 1, 0, 0 from summed group by rid, item_id, line, need),
stretches as (select e.rid, e.item_id, e.line, s.i + 1 as first, e.i as last, e.total - s.total as matched
  from ends s join ends e on e.rid = s.rid and e.item_id = s.item_id and e.line = s.line and e.p > s.p
  where e.total - s.total >= e.need and e.total - s.total >= {share} * (e.p - s.p) - 1e-9),
best as (select rid, item_id, line, first, last, matched from stretches
  qualify row_number() over (partition by rid, item_id, line order by matched desc, last, first) = 1),
trimmed as (select x.rid, x.item_id, x.line, x.matched, min(p.i) as i0, max(p.i) as i1 from best x join places p
  on p.rid = x.rid and p.item_id = x.item_id and p.line = x.line and p.agree and p.i between x.first and x.last group by all)
select doc_id, item_id, i0 + line as doc_start, i0 as item_start, i1 - i0 + 1 as n_words, cast(matched as bigint) as n_matched
from trimmed join d using (rid)
qualify row_number() over (partition by rid, item_id order by matched desc, i0 + line, i0, i1 - i0 desc) = 1"""
