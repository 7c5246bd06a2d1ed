"""What the corpus queries give that SQL can say, by brute force: all pairs, transitive closures, plain sums."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# the smallest node reachable over the links of ``l`` (a, b)
REACH = """both_ways as (select a, b from l union all select b, a from l),
reach as (select a as node, b as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
least_of as (select node, min(other) as other from reach group by 1)"""

WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

EMBEDDINGS = f"""with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95),
{REACH},
n as (select a as node, count(*) as n from both_ways group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(other, vec_id)) as component_id, coalesce(other, vec_id) >= vec_id as kept
from embeddings left join n on vec_id = n.node left join least_of on vec_id = least_of.node"""

MINHASH = f"""with recursive w as (select doc_id, {WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from e x join e y on x.x = y.x and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
{REACH}
select doc_id, len(s) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id, coalesce(other, doc_id) >= doc_id as kept
from s left join least_of on doc_id = node"""

BM25 = f"""with w as (select doc_id, {WORDS} as w from documents),
n as (select count(*) as n, avg(len(w)) as mean from w),
t as (select doc_id, any_value(len(w)) as length, x, count(*) as tf from (select doc_id, w, unnest(w) as x from w) group by doc_id, x),
df as (select x, count(*) as df from t group by x),
sc as (select q.doc_id as query_id, t.doc_id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * t.tf * 2.2e0 / (t.tf + 1.2e0 * (0.25e0 + 0.75e0 * t.length / mean))) as score
    from t q join t on t.x = q.x and t.doc_id <> q.doc_id join df on df.x = t.x cross join n where q.doc_id % 100 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as k from sc)
select query_id, cast(k as integer) as rank, doc_id, round(score, 6) as score from r where k <= 10"""

BLANK = r"regexp_full_match(x, '[\s\x0b\x1c-\x1f\x85\p{Z}]*')"

# candidates share one of the rarest runs: the first n - ceil(0.8 n) + 1 of a line's n in the order of frequency
LINES = f"""with recursive d as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
o as (select doc_id, unnest(parts) as x, unnest(range(1, len(parts) + 1)) as pos from d),
own as (select * from o where not {BLANK}),
u as (select row_number() over (order by x) as id, x from (select distinct x from own)),
g as (select id, x, list_distinct(case when length(x) < 5 then [x] else list_transform(range(1, length(x) - 3), lambda i: substr(x, i, 5)) end) as g from u),
e as (select id, len(g) as n, unnest(g) as t from g),
f as (select t, count(*) as f from e group by t),
p as (select id, n, t, row_number() over (partition by id order by f, t) as r from e join f using (t)),
pre as (select * from p where r <= n - ceil(0.8 * n) + 1),
c as (select distinct x.id as a, y.id as b from pre x join pre y on x.t = y.t and x.id < y.id and 10 * x.n >= 8 * y.n and 10 * y.n >= 8 * x.n),
k as (select a, b, len(x.g) as na, len(y.g) as nb, len(list_intersect(x.g, y.g)) as i from c join g x on x.id = a join g y on y.id = b),
l as (select a, b from k where 100 * i >= 80 * (na + nb - i)),
{REACH},
comp as (select x, least(id, coalesce(other, id)) as c from u left join least_of on id = node),
ranked as (select doc_id, pos, row_number() over (partition by c order by doc_id, pos) > 1 as gone from own join comp using (x)),
lost as (select doc_id, list(pos) as lost from ranked where gone group by 1)
select d.doc_id, cast(coalesce(len(parts), 0) as bigint) as n_lines, cast(coalesce(len(lost), 0) as bigint) as n_removed,
    case when lost is null then text else array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda y: not list_contains(lost, y)), lambda y: parts[y]), chr(10)) end as text
from d left join lost using (doc_id)"""

BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(concat('0x', substr(h, 1 + 5 * (i // 4), 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), '')"

WARC = f"""with p as (select page_id, coalesce(url, '') as url, encode(coalesce(html, '')) as body from pages),
d as (select page_id, url, octet_length(body) as n, sha1(body) as h from p),
r as (select *, min(page_id) over (partition by h) as first, sha1(from_hex('{{namespace}}') || encode(cast(page_id as varchar))) as u from d)
select page_id, cast(n as bigint) as payload_bytes, {BASE32} as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
    case when first <> page_id then first end as refers_to,
    concat('<urn:uuid:', substr(u, 1, 8), '-', substr(u, 9, 4), '-5', substr(u, 14, 3), '-', substr('89ab', 1 + cast(cast(concat('0x', substr(u, 17, 1)) as bigint) % 4 as integer), 1), substr(u, 18, 3), '-', substr(u, 21, 12), '>') as record_id,
    case when regexp_replace(url, '\\s', '', 'g') = '' then '-' else regexp_replace(url, '\\s', '', 'g') end as url, '1996-09-23T14:21:03Z' as date, 'text/html' as mime
from r"""

# runs of digits, letters and all beyond ASCII, A-Z lower-cased
TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""with d as (select doc_id, {TERMS} as terms from documents),
size as (select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d where len(terms) > 0),
asked as (select distinct item_id, unnest({TERMS}) as term from benchmark where item_id is not null),
p as (select doc_id, len(terms) as n, unnest(terms) as term from d),
tf as (select doc_id, n, term, count(*) as tf from p where term in (select term from asked) group by 1, 2, 3),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, size group by term, n_docs),
gain as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) as gain from tf join w using (term), size),
s as (select item_id, doc_id, cast(sum(gain) as bigint) as score from asked join gain using (term) where doc_id is not null group by 1, 2),
r as (select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""

# CRC-32 of the decimal number x: each byte, then eight steps of a bit (-1)
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, len(x::varchar) + 1), lambda i: [unicode((x::varchar)[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))"""

TRIE = f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) as nr,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as turn, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null),
c as (select conv_id as x, {CRC} % 9 as h, conv_id - conv_id % 5 as base from (select distinct conv_id from conversations where conv_id is not null)),
rows_of as (select x, 0 as part, nr, turn, bytes from c join t on t.conv_id = base and nr <= h union all select x, 1, nr, turn, bytes from c join t on t.conv_id = x and nr > h),
p as (select x, row_number() over (partition by x order by part, nr) as depth, string_agg(turn, ',') over (partition by x order by part, nr) as path, bytes from rows_of),
len as (select x, coalesce(max(depth), 0) as n from c left join p using (x) group by 1),
m as (select x, depth, path, bytes, depth = n as last from p join len using (x) union all select x, 0, '', 0, n = 0 from len),
node as (select path, depth, min(x) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, coalesce(string_agg(x::varchar, ',' order by x) filter (where last), '') as ids from m group by 1, 2),
up as (select node.*, case when depth = 1 then '' else left(path, greatest(len(path) - 33, 0)) end as above from node),
kids as (select above, depth - 1 as depth, count(*) as n from up where depth > 0 group by 1, 2),
k as (select up.*, coalesce(kids.n, 0) as n_children from up left join kids on up.path = kids.above and up.depth = kids.depth),
sums as (select a.path, a.depth, count(*) filter (where b.n_children = 0) as n_leaves, cast(sum((b.n_convs - 1) * b.bytes) as bigint) as saved from k a join k b on b.depth >= a.depth and starts_with(b.path, a.path) group by 1, 2)
select k.conv_id, k.depth, q.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved as saved_tokens, sha256(k.ids) as ends_sha256
from k join sums s on k.path = s.path and k.depth = s.depth left join node q on k.depth > 0 and q.path = k.above and q.depth = k.depth - 1"""
