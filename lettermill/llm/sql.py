"""DuckDB counterparts of contamination and near duplicates, for the tables ``documents`` and ``benchmark``."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = rf"""
with item as (
  select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
),
win as (
  select distinct item, least(13, len(w)) as size, array_to_string(w[i:i + 12], ' ') as words
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from item where len(w) > 0)
),
doc as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
spot as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as words
  from (select doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) as i from doc cross join (select distinct size from win) where len(w) >= size)
),
hit as (select doc_id, i, s.size, item from spot s join win using (size, words)),
word as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as pos from hit) group by doc_id),
owner as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join word using (doc_id) left join owner using (doc_id)
"""

NEAR_DUPLICATES = rf"""
with recursive doc as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from doc where len(w) > 0)
),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingle a join shingle b using (s) where a.doc_id < b.doc_id group by all),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
least_ as (select a as doc_id, min(b) as b from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id <= coalesce(b, doc_id) as kept
from doc left join size using (doc_id) left join least_ using (doc_id)
"""
