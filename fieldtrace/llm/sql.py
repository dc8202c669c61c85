"""DuckDB SQL for the training-data queries that SQL can express."""

JACCARD = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
), items as (
  select doc_id, len(s) as n, unnest(s) as item from sets
), overlap as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as n_both
  from items x join items y on x.item = y.item and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from overlap where n_both * 100 >= 80 * (na + nb - n_both)
), edges as (
  select a, b from links union all select b, a from links
), reach(doc_id, seen) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, e.b from reach r join edges e on e.a = r.seen
)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id
from sets s join (select doc_id, min(seen) as component_id from reach group by 1) c on c.doc_id = s.doc_id
"""

NEAR_VECTORS = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
    and len(list_filter(embedding, lambda v: v <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from good x join good y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_cosine_similarity(x.e, y.e) >= 0.93
), reach(vec_id, seen) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.b from reach r join links l on l.a = r.seen
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from embeddings v join (select vec_id, min(seen) as component_id from reach group by 1) c on c.vec_id = v.vec_id
left join (select a, count(*) as n from links group by 1) n on n.a = v.vec_id
"""

CONTAINED_ITEMS = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from benchmark
), item_sets as (
  select item_id, least(5, len(w)) as width, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) as s
  from item_words where len(w) > 0
), item_grams as (
  select item_id, width, len(s) as n_item, unnest(s) as gram from item_sets
), doc_grams as (
  select doc_id, k as width, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as gram
  from doc_words, (select distinct width as k from item_sets) where len(w) >= k
)
select d.doc_id, i.item_id, any_value(i.n_item)::bigint as n_item, count(*)::bigint as n_common, count(*) / any_value(i.n_item) as containment
from doc_grams d join item_grams i on i.width = d.width and i.gram = d.gram
group by 1, 2 having count(*) * 100 >= 80 * any_value(i.n_item)
"""

HARD_NEGATIVES = """
with x as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from x a join x b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), grams as (
  select lang, unnest([array_to_string(w[i:i], ' '), case when i + 1 <= len(w) then array_to_string(w[i:i + 1], ' ') end, case when i + 2 <= len(w) then array_to_string(w[i:i + 2], ' ') end]) as phrase,
    unnest([1, 2, 3]) as size
  from places
), f as (
  select lang, phrase, size, count(*) as f from grams where phrase is not null group by all
), totals as (
  select lang, sum(f)::bigint as n from f where size = 1 group by 1
), candidates as (
  select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size >= 2 and f >= 10
), cuts as (
  select lang, phrase, size, a, w, unnest(range(1, size)) as k from candidates
), scored as (
  select c.lang, c.phrase, c.size, c.a, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.k) = 1
), inside as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from candidates where size = 3
), longest as (
  select lang, phrase, max(a) as a from inside group by 1, 2
)
select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, s.l, s.r, t.n, s.score
from scored s join totals t on t.lang = s.lang left join longest g on g.lang = s.lang and g.phrase = s.phrase
where g.a is null or 100 * g.a < 50 * s.a
qualify rank <= 2000
"""
