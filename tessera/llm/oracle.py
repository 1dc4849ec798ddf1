"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from tessera.llm.rankwalk import DAMPING, ONE, ROUNDS

_PART = round(DAMPING * 1000)
_LISTS = """
with rows_ as (
  select query_id, 'search:' || coalesce(scorer, '') as list, scorer is null as nameless, chunk_id, score from search_result
  union all select query_id, 'display:' || coalesce(engine, ''), engine is null, chunk_id, cast(score as double) from display_result
), best as (
  select query_id, list, nameless, chunk_id, max(score) as score from rows_
  where score is not null and not isnan(score) and query_id is not null and chunk_id is not null group by all
), ranked as (
  select *, rank() over (partition by query_id, list, nameless order by score desc) - 1 as higher from best
), n as (select query_id, count(distinct (list, nameless)) as lists from best group by query_id)
"""

_GRAMS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item where text is not null),
dg as (select doc_id, unnest(range(1, len(w) - 11)) as k, unnest([array_to_string(w[k:k + 12], ' ') for k in range(1, len(w) - 11)]) as g from d where len(w) >= 13),
ig as (select distinct item_id, unnest([array_to_string(w[k:k + 12], ' ') for k in range(1, len(w) - 11)]) as g from i where len(w) >= 13)
"""

ORACLE = {
    "p1_found": r"select distinct chunk_id from chunks where len(regexp_extract_all(text, '[^ \t\n\f\r]+')) > 512",
    "p3_found": _LISTS
    + """select r.query_id, r.chunk_id from ranked r join n using (query_id)
group by r.query_id, r.chunk_id, n.lists having count(*) = n.lists and max(r.higher) < 5""",
    "p3_ranking": _LISTS.replace("with rows_", "with recursive rows_", 1)
    + f""", listed as (
  select b.*, l.lists, count(*) over (partition by query_id, list, nameless) as size, count(*) over (partition by query_id, list, nameless order by score desc) as at_least from best b join n l using (query_id)
), items as (select query_id, chunk_id, count(*) over (partition by query_id) as items from (select distinct query_id, chunk_id from best)),
walk as (
  select query_id, chunk_id, {ONE} // items as mass, 0 as i from items
  union all
  select query_id, chunk_id, cast({ONE // 1000 * (1000 - _PART)} // any_value(items) + sum(got) // 1000 * {_PART} + sum(got) % 1000 * {_PART} // 1000 as bigint), any_value(i) + 1 from (
    select query_id, chunk_id, items, i, cast(sum(mass // (lists * at_least)) over (partition by query_id, list, nameless order by score) + greatest(0, {ONE} - sum(mass) over (partition by query_id, list, nameless)) // (lists * size) as hugeint) as got
    from walk join listed using (query_id, chunk_id) join items using (query_id, chunk_id) where i < {ROUNDS}) group by query_id, chunk_id
)
select query_id, chunk_id, rank() over (partition by query_id order by mass desc) as position, mass / {float(ONE)} as stationarity from walk where i = {ROUNDS}""",
    "p4_found": """
with terms as (
  select rid, chunk_id, translate(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select row_number() over () as rid, chunk_id, text from chunks)
), counts as (select rid, chunk_id, term, count(*) as tf from terms where length(term) >= 6 and term >= 'a' and term < '{' group by all),
dfs as (select term, count(*) as df from counts group by term)
select distinct c.chunk_id, c.term from counts c join dfs using (term) where c.tf >= 3 and df between 2 and 5""",
    "p4_terms": r"""
with terms as (
  select rid, chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_]+')) as term from (select row_number() over () as rid, chunk_id, text from chunks)
), pairs as (select rid, chunk_id, term, count(*) as tf from terms where not regexp_matches(term, '^[0-9_]') group by all),
lengths as (select rid, sum(tf) as n from pairs group by rid), total as (select sum(tf) as total from pairs),
stats as (select term, count(*) as df, sum(tf) as cf from pairs group by term),
joined as (select p.*, df, cast(cf as double) as K, cast(n as double) as n, cast(total as double) as N_ from pairs p join lengths using (rid) join stats using (term), total),
tails as (
  select *, list_transform(range(tf, cast(least(n, K) as bigint) + 1), lambda x: lgamma(K + 1) - lgamma(x + 1) - lgamma(K - x + 1) + lgamma(N_ - K + 1) - lgamma(n - x + 1)
    - lgamma(N_ - K - n + x + 1) - lgamma(N_ + 1) + lgamma(n + 1) + lgamma(N_ - n + 1)) as logs from joined
), ps as (select *, least(0, list_max(logs) + ln(list_sum(list_transform(logs, lambda y: exp(y - list_max(logs)))))) as log_p from tails),
ranked as (select *, log_p + ln(count(*) over (partition by rid) / cast(row_number() over (partition by rid order by log_p, term) as double)) as q from ps),
adjusted as (select *, least(0, min(q) over (partition by rid order by log_p desc, term desc rows unbounded preceding)) as log_q from ranked)
select chunk_id, term, tf, df, round(-log_q / ln(10), 4) + 0.0 as score from adjusted""",
    "p8_found": _GRAMS + "select distinct doc_id, item_id from dg join ig using (g)",
    "p8_items": _GRAMS
    + """, hits as (select distinct doc_id, item_id, k from dg join ig using (g)),
runs as (select *, lead(k) over (partition by doc_id, item_id order by k) as next_k from hits),
pairs as (select doc_id, item_id, cast(sum(least(13, coalesce(next_k - k, 13))) as integer) as n_words from runs group by all)
select i.item_id, i.suite, count(*) as n_documents, max(n_words) as most_words from eval_item i join pairs using (item_id) group by all""",
}
