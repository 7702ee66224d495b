"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import clustering, decontamination, language, line_dedup, lm_scoring, media, mixing, quality, resampling, secrets, sharding, shingle_join, suffix_dedup

QUERIES = {
    "op1_hash_tree": sharding.op1_hash_tree,
    "op2_media_columns": media.op2_media_columns,
    "op3_suffix_search": decontamination.op3_suffix_search,
    "op4_attention_lm": lm_scoring.op4_attention_lm,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_additive_quality": quality.op6_additive_quality,
    "op7_jaccard_join": shingle_join.op7_jaccard_join,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_importance_sample": resampling.op11_importance_sample,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_centroid_clusters": clustering.op13_centroid_clusters,
}

ORACLE_SQL = {
    "op5_source_mix": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(concat_ws(':', '17', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight,
             2.0::double * source_size as cap from s),
l as (select *, 1.5::double * (sum(source_size) over ())::double as mix,
             coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0) as filled,
             sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as thirst
      from w),
v as (select *, max(case when (mix - filled) / thirst * weight <= cap then (mix - filled) / thirst end) over () as water from l),
t as (select source, source_size, case when water is null then cap else least(cap, water * weight) end as target from v),
r as (select d.doc_id, d.size, t.source_size, t.target,
             case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size - before)::bigint)))::bigint as taken
from r""",
    "op3_suffix_search": r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from low),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bk as (select item_id, w, least(10, len(w)) k from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') g from (select *, unnest(range(1, len(w) - k + 2)) p from bk)),
ks as (select distinct k from win),
grams as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p from d, ks where len(w) >= k)),
hits as (select doc_id, k, p, item_id from grams join win using (k, g)),
n_hit as (select doc_id, count(distinct q)::bigint n from (select doc_id, unnest(range(p, p + k)) q from (select distinct doc_id, k, p from hits)) group by doc_id),
items as (select doc_id, count(*)::bigint n, string_agg(i, ',' order by i) s from (select distinct doc_id, item_id::varchar i from hits) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit.n, 0) n_hit, coalesce(items.n, 0) n_items, sha256(coalesce(items.s, '')) items_sha256, coalesce(n_hit.n, 0) > 0 contaminated
from d left join n_hit using (doc_id) left join items using (doc_id)""",
    "op7_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end)) s from w where len(w) > 0),
n as (select doc_id, count(*) n from sh group by doc_id),
both_ as (select a.doc_id x, b.doc_id y, count(*) i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from both_ join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 75 * (p.n + q.n - i)),
ends as (select x, y from link union all select y, x from link),
reach as (select doc_id v, doc_id l from documents union select ends.y, reach.l from reach join ends on ends.x = reach.v where reach.l < ends.y),
least_ as (select v, min(l) l from reach group by v)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, l component_id from w left join n using (doc_id) join least_ on least_.v = w.doc_id""",
    "op9_line_dedup": r"""
with l as (select doc_id, unnest(string_split(lower(text), chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 k from documents),
s as (select doc_id, k, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) w from l),
c as (select w, min({'d': doc_id, 'k': k}) f, row_number() over () id, len(w) n from s where len(w) > 0 group by w),
tok as (select id, n, f, unnest(w) t from c),
df as (select t, count(*) c from tok group by t),
pre as (select id, n, t from tok join df using (t) qualify row_number() over (partition by id order by df.c, t) <= n - ceil(n * 0.75) + 1),
cand as (select distinct a.id x, b.id y from pre a join pre b on a.t = b.t and a.id < b.id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
pair as (select p.f fx, q.f fy, p.id x, q.id y from cand join c p on p.id = x join c q on q.id = y where 100 * len(list_intersect(p.w, q.w)) >= 75 * (p.n + q.n - len(list_intersect(p.w, q.w)))),
late as (select distinct case when fx < fy then y else x end id from pair),
g as (select s.doc_id, s.k, c.id is not null and (late.id is not null or c.f <> {'d': s.doc_id, 'k': s.k}) gone from s left join c on c.w = s.w left join late on late.id = c.id),
o as (select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_removed, coalesce(string_agg(k::varchar, ',' order by k) filter (gone), '') removed from g group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(removed, '') removed from documents d left join o using (doc_id)""",
    "op11_importance_sample": r"""
with recursive step as (select range::bigint b, range::bigint v, 0 k from range(256)
  union all select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from step where k < 8),
one as (select b, v from step where k = 8),
d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
t as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
k as (select unnest([1, 2, 3]) k),
fd as (select r, f, count(*) n from (select r, array_to_string(w[p:p + k - 1], ' ') f from (select r, w, k, unnest(range(1, len(w) - k + 2)) p from d, k where len(w) >= k)) group by r, f),
ft as (select f, count(*) n from (select array_to_string(w[p:p + k - 1], ' ') f from (select w, k, unnest(range(1, len(w) - k + 2)) p from t, k where len(w) >= k)) group by f),
fs as (select row_number() over () i, f, octet_length(encode(f)) n, hex(encode(f)) h from (select f from fd union select f from ft)),
far as (select b, v, 0 q from one union all select far.b, xor(far.v // 256, o.v), q + 1 from far join one o on o.b = far.v % 256 where q < (select max(n) from fs)),
zero as (select 4294967295::bigint v, 0 q union all select xor(zero.v // 256, o.v), q + 1 from zero join one o on o.b = zero.v % 256 where q < (select max(n) from fs)),
linear as (select i, n, bit_xor(far.v) v from (select i, n, p, ('0x' || h[2 * p + 1:2 * p + 2])::bigint b from (select i, n, h, unnest(range(n)) p from fs)) x join far on far.b = x.b and far.q = x.n - 1 - p group by i, n),
hashed as (select f, xor(xor(l.v, zero.v), 4294967295) % 10000 as bucket from fs join linear l using (i) join zero on zero.q = l.n),
sb as (select bucket, sum(n)::double s from fd join hashed using (f) group by bucket),
tb as (select bucket, sum(n)::double t from ft join hashed using (f) group by bucket),
total as (select (select coalesce(sum(s), 0) from sb) s_all, (select coalesce(sum(t), 0) from tb) t_all),
gain as (select f, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint g from hashed join sb using (bucket) left join tb using (bucket), total),
weigh as (select r, sum(n * g)::bigint weight, sum(n)::bigint n from fd join gain using (f) group by r),
scored as (select r, doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5) / 4294967296)))::bigint score from d left join weigh using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, r) k, count(*) over () n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when k <= 5 * n // 100 then k end as rank from scored left join ranked using (r)""",
    "op13_centroid_clusters": """
with x as (select row_number() over () v, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
m0 as (select row_number() over (order by h, x) - 1 as c, x from (select x, sha256('1:' || coalesce(vec_id::varchar, '')) h from x order by h, x limit 16)),
a0 as (select v, c, d from (select v, c, d, row_number() over (partition by v order by d, c) k from
  (select x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - m.x[i]) * (x.x[i] - m.x[i])))::bigint d from x, m0 m)) where k = 1),
s0 as (select c, p, sum(u) s, count(*) n from (select a.c, unnest(range(1, 65)) p, unnest(x.x) u from a0 a join x using (v)) group by c, p),
m1 as (select c, coalesce(n.x, m.x) x from m0 m left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) x from s0 group by c) n using (c)),
a1 as (select v, c, d from (select v, c, d, row_number() over (partition by v order by d, c) k from
  (select x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - m.x[i]) * (x.x[i] - m.x[i])))::bigint d from x, m1 m)) where k = 1),
s1 as (select c, p, sum(u) s, count(*) n from (select a.c, unnest(range(1, 65)) p, unnest(x.x) u from a1 a join x using (v)) group by c, p),
m2 as (select c, coalesce(n.x, m.x) x from m1 m left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) x from s1 group by c) n using (c)),
a2 as (select v, c, d from (select v, c, d, row_number() over (partition by v order by d, c) k from
  (select x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - m.x[i]) * (x.x[i] - m.x[i])))::bigint d from x, m2 m)) where k = 1),
s2 as (select c, p, sum(u) s, count(*) n from (select a.c, unnest(range(1, 65)) p, unnest(x.x) u from a2 a join x using (v)) group by c, p),
m3 as (select c, coalesce(n.x, m.x) x from m2 m left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) x from s2 group by c) n using (c)),
a3 as (select v, c, d from (select v, c, d, row_number() over (partition by v order by d, c) k from
  (select x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - m.x[i]) * (x.x[i] - m.x[i])))::bigint d from x, m3 m)) where k = 1)
select vec_id, c::int as "cluster", d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(m3.x, ',')) as centroid_sha256
from a3 join x using (v) join m3 using (c)""",
}
