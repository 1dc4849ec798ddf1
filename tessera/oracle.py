"""DuckDB SQL of the queries, over whole tables."""

from tessera.operators.discovery import SYNONYMS
from tessera.operators.files import DENIED
from tessera.queries import WORDS
from tessera.spec import MIN_TOKENS

WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DOC = "select doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' as path, strlen(text) as length, text as content from documents where text is not null"
LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COUNT = lambda c: f"len(regexp_extract_all({c}, '[^{WS}]+'))"
TF = lambda c, w: f"len(list_filter(regexp_extract_all({c}, '[A-Za-z0-9_]+'), lambda x: lower(x) = '{w}'))"
IDF = lambda n, df: f"case when {df} = 0 then 0.0 else ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1) end"


def _millis(c: str) -> str:
    """Milliseconds since the epoch of a time string; without an offset it is UTC."""
    t = f"replace(trim({c}), 'T', ' ')"
    return f"""epoch_ms(cast(case when regexp_matches({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then replace({t}, 'Z', '+00:00') else {t} || '+00:00' end as timestamptz))"""


def _score(c: str, terms: list[str]) -> str:
    return " + ".join(f"cast(contains({LOW(c)}, '{t}') as int)" for t in terms)


def _scored(terms: list[str]) -> str:
    return f"""select *, row_number() over (order by score desc, path) - 1 as file_rank from (
  select * from (select *, {_score('content', terms)} as score from ({DOC})) where score > 0 order by score desc, path limit 200)"""


def _windows(source: str, size: int, stride: int, also: str = "") -> str:
    """Windows of a (path, content) relation."""
    blank = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
    return f"""select path, {also} w // {stride} as ordinal, lead + strlen(array_to_string(tk[1:w], '')) as byte_offset,
  len(string_split(content[1:lead] || array_to_string(tk[1:w], ''), chr(10))) as line_number,
  rtrim(array_to_string(tk[w + 1:w + {size}], ''), {blank}) as text, least({size}, len(tk) - w) as token_count
from (select *, unnest(range(0, len(tk), {stride})) as w from (
  select path, {also} content, strlen(content) - strlen(ltrim(content, {blank})) as lead, regexp_extract_all(content, '[^ \\t\\n\\f\\r]+[ \\t\\n\\f\\r]*') as tk from ({source})))"""


def _bm25(source: str, key: str, terms: list[str], name: str = "b") -> str:
    """CTEs that end in {name}(key, score): BM25 of (key, text)."""
    distinct = list(dict.fromkeys(terms))
    tfs = ", ".join(f"{TF('text', w)} as tf{i}" for i, w in enumerate(distinct))
    dfs = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(distinct)))
    total = " + ".join(f"({IDF('n', f'df{distinct.index(t)}')}) * (tf{distinct.index(t)} * 2.2) / (tf{distinct.index(t)} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for t in terms)
    return f"""{name}_tf as (select {key}, {COUNT('text')} as dl, {tfs} from ({source})),
{name}_st as (select count(*) as n, avg(dl) as avgdl, {dfs} from {name}_tf),
{name} as (select * from (select {key}, {total} as score from {name}_tf, {name}_st) where score > 0)"""


_CHUNKS = f"""numbered as (select row_number() over (order by file_rank, ordinal) - 1 as chunk_id, path as file_path, * exclude (path)
  from ({_windows(_scored(WORDS), 64, 52, 'doc_id, file_rank,')}))"""
_CANDIDATES = """best as (select chunk_id from b order by score desc, chunk_id limit {budget}),
boost as (select chunk_id from numbered where ({in_path}) and chunk_id not in (select chunk_id from best) order by chunk_id limit {half}),
sizes as (select (select count(*) from numbered) as n, (select count(*) from b) as hits),
cand as (select chunk_id from best, sizes where n > {budget} and hits > 0 union all select chunk_id from boost, sizes where n > {budget} and hits > 0
  union all select chunk_id from numbered, sizes where n <= {budget} or hits = 0)"""


def _candidates(terms: list[str], budget: int) -> str:
    return _CANDIDATES.format(budget=budget, half=budget // 2, in_path=" or ".join(f"contains(lower(file_path), '{t}')" for t in terms))


_VEC = "(select cast(embedding as double[]) from embeddings where vec_id = 0)"
_DOT = f"list_dot_product(cast(embedding as double[]), {_VEC})"
_HAM = "1 - 2 * len(list_filter(range(1, 65), lambda i: (embedding[i] > 0) <> (q[i] > 0))) / 64.0"
#: Letters, digits and underscore; the marks of Devanagari, Thai and Arabic that count as alphabetic.
WORD = r"\p{L}\p{N}_\x{610}-\x{61a}\x{64b}-\x{657}\x{659}-\x{65f}\x{670}\x{900}-\x{903}\x{93a}\x{93b}\x{93e}-\x{94c}\x{94e}\x{94f}\x{955}-\x{957}\x{962}\x{963}\x{e31}\x{e34}-\x{e3a}\x{e4d}"
_TWO = f"""{_bm25("select doc_id as chunk_id, text from documents where text is not null", 'chunk_id', WORDS)},
l as (select chunk_id, row_number() over (order by score desc, chunk_id) - 1 as rank from (select * from b order by score desc, chunk_id limit 100)),
ns as (select vec_id as chunk_id, {_DOT} as score from embeddings order by score desc, chunk_id limit 100),
"""
_NEAREST = """r as (select *, row_number() over (partition by query order by score desc, chunk_id) - 1 as rank from s) select query, chunk_id, rank, round(score, 4) as score from r where rank < 10"""
_RRF = """v as (select chunk_id, score, row_number() over (order by score desc, chunk_id) - 1 as rank from ns),
miss as (select (select count(*) from l) + (select count(*) from v) as m),
f as (select coalesce(l.chunk_id, v.chunk_id) as chunk_id, coalesce(l.rank, m) as r1, coalesce(v.rank, m) as r2, l.rank as bm25_rank, v.rank as neural_rank
  from l full join v on l.chunk_id = v.chunk_id, miss),
fused as (select *, 1.0 / (60 + r1) + 1.0 / (60 + r2) as rrf from f order by 1.0 / (60 + r1) + 1.0 / (60 + r2) desc, r1, r2, chunk_id limit {top})"""
_RESTORED = "restored as (select fused.*, v.score, row_number() over (order by rrf desc, r1, r2, fused.chunk_id) - 1 as rank from fused join v using (chunk_id))"
_DEDUP = """lined as (select *, line_number as s, line_number + (case when text = '' then 0 else len(string_split(text, chr(10))) - cast(ends_with(text, chr(10)) as int) end) as e from {src}),
firsts as (select *, row_number() over w as n1, first_value(s) over w as s0, first_value(e) over w as e0 from lined window w as (partition by file_path order by rank, line_number)),
kept as (select * from (select *, row_number() over (partition by file_path order by rank, line_number) as n2 from firsts where n1 = 1 or not (s < e0 and e > s0)) where n2 <= 2)"""

_LATEST = "select * from (select *, row_number() over (partition by repo, number order by updated_at desc nulls last, row_id desc) as rn from gh_issue) where rn = 1"
_SLUG = lambda c: f"substr(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50)"
_TRIM = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"
_NAMES = lambda c, f: f"case when len({c}) > 0 then '{{}}: [' || array_to_string(list_transform({c}, lambda x: x.{f}), ', ') || ']' || chr(10) else '' end"
_YAML = r"""replace(replace({}, '\', '\\'), '"', '\"')"""
_NL = "chr(10)"
_MARKDOWN = f"""'---' || {_NL} || 'type: ' || case when pull_request is not null then 'pull_request' else 'issue' end || {_NL} || 'number: ' || number || {_NL}
 || 'title: "' || {_YAML.format("coalesce(title, '')")} || '"' || {_NL} || 'state: ' || coalesce(state, '') || {_NL} || 'author: ' || coalesce("user".login, '') || {_NL}
 || {_NAMES('assignees', 'login').format('assignees')} || {_NAMES('labels', 'name').format('labels')}
 || 'created: ' || coalesce(created_at, '') || {_NL} || 'updated: ' || coalesce(updated_at, '') || {_NL} || 'url: ' || coalesce(html_url, '') || {_NL} || '---' || {_NL} || {_NL}
 || '# ' || case when pull_request is not null then 'PR' else 'Issue' end || ' #' || number || ': ' || coalesce(title, '') || {_NL} || {_NL}
 || case when {_TRIM("coalesce(body, '')")} <> '' then {_TRIM('body')} || {_NL} || {_NL} else '' end"""
_COMMENTS = f"""select repo, number, string_agg('### @' || coalesce("user".login, '') || ' (' || coalesce(created_at, '') || ')' || {_NL} || {_NL} || {_TRIM("coalesce(body, '')")} || {_NL} || {_NL}, ''
  order by created_at nulls last, "user".login nulls last, coalesce(body, '')) as c from gh_comment group by repo, number"""
_KIND = "case when pull_request is not null then 'prs' else 'issues' end"

_SYN = " union all ".join(f"select {i} as i, {a.split()!r} as triggers, {b.split()!r} as words" for i, (a, b) in enumerate(SYNONYMS))
_URL = """case number % 5 when 0 then 'git@github.com:' when 1 then 'https://github.com/' when 2 then 'ssh://git@github.com/' when 3 then 'http://github.com/' else 'https://forge.example/' end
 || repo || case number % 5 when 1 then '.git' when 2 then '/' when 0 then '.git.git' else '' end"""
_EXT = lambda p: f"regexp_extract({p}, '[^/\\\\]\\.([^./\\\\]*)$', 1)"
_SHORT = lambda p: f"""case when regexp_matches(replace({p}, '\\', '/'), 'sources/github/[^/]*/[^/]*/[^/]*/') then regexp_replace(regexp_replace(regexp_replace(replace({p}, '\\', '/'),
  '^.*?sources/github/([^/]*)/([^/]*)/prs/(.*)$', 'github:\\1/\\2 PR#\\3'), '^.*?sources/github/([^/]*)/([^/]*)/[^/]*/(.*)$', 'github:\\1/\\2#\\3'), '\\.md$', '') else {p} end"""  # noqa: E731

_DUE = f"""
with src as (select lower(repo) as k, min(repo) as repo, number, max({_millis('updated_at')}) as v from gh_issue where repo is not null and number is not null group by lower(repo), number),
tgt as (select lower(repo) as k, number, max({_millis('updated_at')}) as v from manifest_entry where updated_at is not null group by lower(repo), number)
"""
#: Paragraphs of documents: a walk over the lines that carries the tokens gathered and the number of closed paragraphs.
_PROSE = f"""
with recursive docs as ({DOC}),
split as (select path, content, string_split(content, chr(10)) as raw from docs),
lines as (select path, unnest(range(1, len(raw) + 1)) as i, rtrim(unnest(raw), chr(13)) as line, len(raw) as n_lines, ends_with(content, chr(10)) as closed from split),
kept as (select path, i, line, {_TRIM('line')} = '' as blank, starts_with(line, '#') as head, {COUNT('line')} as n from lines where not (closed and i = n_lines)),
walk as (
  select path, 0 as i, 0 as chunk, cast(null as integer) as part, cast(0 as bigint) as t, true as fresh from docs
  union all
  select path, i, case when t2 >= 512 then chunk2 + 1 else chunk2 end, case when skip then null else chunk2 end, case when t2 >= 512 then 0 else t2 end, t2 >= 512 or skip and fresh2 from (
    select *, blank and fresh2 as skip, case when blank and fresh2 then t1 else t1 + n end as t2 from (
      select k.path, k.i, k.blank, k.n, case when cut then w.chunk + 1 else w.chunk end as chunk2, case when cut then 0 else w.t end as t1, cut or w.fresh as fresh2
      from (select w.*, k.i as ki, (k.head or k.blank) and w.t >= {MIN_TOKENS} as cut from walk w join kept k on k.path = w.path and k.i = w.i + 1) w join kept k on k.path = w.path and k.i = w.ki))
),
parts as (select w.path, w.part, {_TRIM("string_agg(k.line, chr(10) order by k.i)")} as text, sum(k.n) as n, min_by(k.line, k.i) as first_line from walk w join kept k using (path, i) where w.part is not null group by w.path, w.part),
tops as (select *, row_number() over (partition by path order by part desc) = 1 as last, row_number() over (partition by path order by part) as part_no from parts where text <> ''),
joined as (select *, last and n < {MIN_TOKENS} and part_no > 1 as tail, lead(case when last and n < {MIN_TOKENS} and part_no > 1 then text end) over w as more, lead(case when last and n < {MIN_TOKENS} and part_no > 1 then n end) over w as n_more from tops window w as (partition by path order by part)),
placed as (select j.*, strpos(content, first_line) as pos, content from joined j join docs using (path) where not tail)
select path, part_no - 1 as ordinal, strlen(content[1:pos - 1]) as byte_offset, len(string_split(content[1:pos - 1], chr(10))) as line_number,
  case when more is null then text else text || chr(10) || more end as text, cast(n + coalesce(n_more, 0) as integer) as token_count from placed"""

_HYBRID = f"""with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)}, {_candidates(WORDS, 50)},
{_bm25('select chunk_id, text from cand join numbered using (chunk_id)', 'chunk_id', WORDS, 'c')},
l as (select chunk_id, row_number() over (order by score desc, chunk_id) - 1 as rank from c),
ns as (select chunk_id, {_DOT} as score from cand join numbered using (chunk_id) join embeddings on vec_id = doc_id order by score desc, chunk_id limit 30),
{_RRF.format(top=20)}, {_RESTORED},
r as (select numbered.*, restored.score, restored.rank from restored join numbered using (chunk_id)), {_DEDUP.format(src='r')}
select rank, round(score, 4) as score, chunk_id, file_path, byte_offset, line_number, text, token_count from kept order by rank limit 10"""

ORACLE = {
    "file_scan_filter": f"""select chunk_id, file_path as path, strlen(text) as length from chunks
where strlen(text) between 1 and 2000000 and lower({_EXT('file_path')}) not in ({', '.join(f"'{x}'" for x in DENIED)})""",
    "glob_filter": r"select chunk_id, file_path as path from chunks where regexp_matches(file_path, '(^|/)[^/]*_[^/]*\.(py|rs)$')",
    "hidden_filter": f"select doc_id, 'r/x/' || path as path from ({DOC}) where doc_id % 3 <> 0 and not regexp_matches(path, '(^|/)[.][^/.]')",
    "synced_union": f"""select path from ({DOC}) union all
select '/data/sources/github/' || repo || '/' || path from manifest_entry where regexp_matches('/data/sources/github/' || repo || '/' || path, '/(issues|prs)/[^/]*\\.md$')""",
    "line_numbers": f"""select doc_id, strlen(p) as byte_offset, len(string_split(p, chr(10))) as line from (
select doc_id, substr(content, 1, strpos(content, 'cache') - 1) as p from ({DOC}) where contains(content, 'cache'))""",
    "run_statistics": f"""with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)}, {_candidates(WORDS, 50)}
select 'seen' as what, count(*) as n from ({DOC}) union all select 'scored', count(*) from ({_scored(WORDS)}) union all select 'chunks', count(*) from numbered union all select 'embedded', count(*) from cand""",
    "comments_joined": f"""select i.repo, i.number, case when body is null or c.n is null then 0 else c.n end as n_comments, case when body is null then null else c.last end as last_comment
from ({_LATEST}) i left join (select repo, number, count(*) as n, max(created_at) as last from gh_comment group by repo, number) c on i.repo = c.repo and i.number = c.number""",
    "titles_truncated": "select row_id, substr(title, 1, 50) as title from gh_issue",
    "json_round_trip": """select row_id, number, title, "user".login as login, coalesce(array_to_string(list_transform(labels, lambda x: x.name), ','), '') as labels, pull_request is not null as is_pr, updated_at from gh_issue""",
    "path_parts": f"""select distinct file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)[.][^.]*$', '\\1') as stem, {_EXT('file_path')} as ext from chunks""",
    "keyword_file_score": f"select path, score, file_rank from ({_scored(WORDS)})",
    "literal_boost_score": f"select path, score, file_rank from ({_scored(['cache', 'limit', 'of', 'the', 'window', 'when the'])})",
    "candidate_budget": f"""select row_id, n as n_terms, least(case when n <= 2 then 3 when n <= 4 then 5 else 8 end * 10, 150) as budget
from (select row_id, len(list_filter(regexp_extract_all(title, '[{WORD}]+'), lambda w: strlen(w) >= 2)) as n from gh_issue where title is not null)""",
    "query_terms": f"""select row_id, cast(i - 1 as int) as pos, w[i] as term from (select row_id, w, unnest(range(1, len(w) + 1)) as i
from (select row_id, list_transform(list_filter(regexp_extract_all(title, '[{WORD}]+'), lambda w: strlen(w) >= 2), lambda w: lower(w)) as w from gh_issue))""",
    "synonyms": f"""with t as ({_SYN}), q as (select row_id, lower(body) as q from gh_issue),
hit as (select row_id, q, unnest(words) as synonym from q, t where len(list_filter(triggers, lambda x: contains(q, x))) > 0)
select distinct row_id, synonym from hit where not contains(q, synonym)""",
    "prose_chunks": _PROSE,
    "naive_chunks": f"select path, ordinal, byte_offset, line_number, text, token_count from ({_windows(DOC, 512, 410)})",
    "naive_chunks_small": f"select path, ordinal, byte_offset, line_number, token_count, md5(text) as text_md5 from ({_windows(DOC, 40, 8)})",
    "doc_length": f"select doc_id, {COUNT('content')} as dl from ({DOC})",
    "average_length": f"select count(*) as n, round(avg({COUNT('content')}), 6) as avgdl from ({DOC})",
    "term_freq": f"select doc_id, {', '.join(f'{TF("content", w)} as tf_{w}' for w in WORDS)} from ({DOC})",
    "doc_freq": f"""with t as (select count(*) as n, {', '.join(f'count(*) filter (where {TF("content", w)} > 0) as df_{w}' for w in WORDS)} from ({DOC}))
select n, {', '.join(f'df_{w}' for w in WORDS)}, {', '.join(f'round({IDF("n", f"df_{w}")}, 6) as idf_{w}' for w in WORDS)} from t""",
    "bm25_topk": f"with {_bm25('select doc_id, text from documents where text is not null', 'doc_id', WORDS)} select doc_id, round(score, 4) as score from (select * from b order by score desc, doc_id limit 50)",
    "bm25_repeated_terms": f"with {_bm25('select doc_id, text from documents where text is not null', 'doc_id', ['cache', 'cache', 'limit'])} select doc_id, round(score, 4) as score from b",
    "bm25_chunks_topk": f"with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)} select chunk_id, round(score, 4) as score from (select * from b order by score desc, chunk_id limit 50)",
    "candidates_with_path_boost": f"with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)}, {_candidates([*WORDS, 'docs_site/es'], 50)} select chunk_id, file_path from cand join numbered using (chunk_id)",
    "bm25_rerank": f"""with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)}, {_candidates(WORDS, 50)},
{_bm25('select chunk_id, text from cand join numbered using (chunk_id)', 'chunk_id', WORDS, 'c')} select chunk_id, round(score, 4) as score from c""",
    "cosine_topk": f"select chunk_id, round(score, 4) as score from (select vec_id as chunk_id, {_DOT} as score from embeddings order by score desc, chunk_id limit 20)",
    "cosine_threshold": f"select chunk_id, round(score, 4) as score from (select vec_id as chunk_id, {_DOT} as score from embeddings) where score >= 0.25",
    "cosine_query_set": f"with s as (select q.vec_id as query, e.vec_id as chunk_id, round(list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])), 12) as score from embeddings e, embeddings q where q.vec_id % 100 = 0), {_NEAREST}",
    "hamming_query_set": f"with s as (select q.vec_id as query, e.vec_id as chunk_id, 1 - 2 * len(list_filter(range(1, 65), lambda i: (e.embedding[i] > 0) <> (q.embedding[i] > 0))) / 64.0 as score from embeddings e, embeddings q where q.vec_id % 100 = 0), {_NEAREST}",
    "sign_bits": """select vec_id as chunk_id, (len(embedding) + 63) // 64 as n_words, cast(case when w >= 9223372036854775808 then w - 18446744073709551616 else w end as bigint) as word
from (select vec_id, embedding, list_sum(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then cast(power(cast(2 as double), i - 1) as hugeint) else 0 end)) as w from embeddings)""",
    "hamming_topk": f"select chunk_id, round(score, 4) as score from (select vec_id as chunk_id, {_HAM} as score from embeddings, (select embedding as q from embeddings where vec_id = 0) order by score desc, chunk_id limit 20)",
    "l2_norm": "select vec_id as chunk_id, round(2 * sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 4) as norm, cast(1 as double) as unit from embeddings",
    "mean_pooling": """select vec_id as chunk_id, j - 1 as dim, round((e[8 + j] + e[24 + j] + e[40 + j] + e[56 + j]) / 4, 5) as v
from (select vec_id, cast(embedding as double[]) as e, unnest(range(1, 9)) as j from embeddings)""",
    "rrf_fusion": f"with {_TWO}{_RRF.format(top=80)} select chunk_id, round(rrf, 8) as rrf, bm25_rank, neural_rank from fused",
    "rrf_restored": f"with {_TWO}{_RRF.format(top=80)}, {_RESTORED} select chunk_id, rank, round(score, 4) as score from restored",
    "dedup_overlap": f"""with {_CHUNKS}, {_bm25('select chunk_id, text from numbered', 'chunk_id', WORDS)},
r as (select numbered.*, row_number() over (order by score desc, chunk_id) - 1 as rank from (select * from b order by score desc, chunk_id limit 300) join numbered using (chunk_id)),
{_DEDUP.format(src='r')} select chunk_id, file_path, rank from kept""",
    "hybrid_search": _HYBRID,
    "json_output": f"""with shown as ({_HYBRID}) select '[ ' || string_agg('{{' || chr(10) || array_to_string(['  "' || f[1] || '" : ' || f[2] for f in [
  ['score', cast(score as varchar)], ['file_path', cast(to_json(file_path) as varchar)], ['byte_offset', cast(byte_offset as varchar)], ['line_number', cast(line_number as varchar)], ['text', cast(to_json(text) as varchar)], ['token_count', cast(token_count as varchar)]] if f[2] is not null], ',' || chr(10)) || chr(10) || '}}', ', ' order by rank) || ' ]' as json
from shown having count(*) > 0""",
    "discovery_union": rf"""with every as (select 'f/' || doc_id || '/' || coalesce(nullif(regexp_extract(text, '[A-Z][a-z]+[A-Z][a-z]+'), ''), 'none') || '.md' as path, strlen(text) as length, text as content from documents where text is not null),
scored as (select *, row_number() over (order by score desc, path) - 1 as file_rank from (select * from (select *, {_score('content', ['cache', 'limit'])} as score from every) where score > 0 order by score desc, path limit 200)),
names as (select unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+')) as name from scored where file_rank < 30),
lines as (select regexp_replace(unnest(string_split(content, chr(10))), '^[{WS}]+|[{WS}]+$', '', 'g') as t from scored where file_rank < 30),
froms as (select string_split(w, '.')[-1] as name from (select unnest(string_split_regex(t, '[{WS}]+')) as w from lines where starts_with(t, 'from ') or starts_with(t, 'import '))
  where strlen(w) >= 4 and w not in ('from', 'import', 'as') and regexp_matches(w, '^\p{{L}}')),
terms as (select lower(name) as stem from names where strlen(name) >= 10 and regexp_matches(name, '^\p{{Lu}}') and regexp_matches(name, '\p{{Ll}}') union select lower(name) from froms where strlen(name) >= 8),
rest as (select path, lower(regexp_extract(path, '([^/]*)\.md$', 1)) as stem, length from every where path not in (select path from scored))
select path from scored union all select path from (select path from rest where strlen(stem) >= 4 and length between 1 and 2000000 and (stem in (select stem from terms)
  or {' or '.join(f"(contains(stem, '{w}') and strlen(stem) > {len(w)})" for w in ('redis', 'memory', 'invalidate', 'expire', 'ttl'))}) order by path limit 50)""",
    "type_names": rf"""select distinct path, name from (select path, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+')) as name from ({DOC}))
where strlen(name) >= 6 and regexp_matches(name, '^\p{{Lu}}') and regexp_matches(name, '\p{{Ll}}')""",
    "imports": r"""with p as (select cast(p_partkey as varchar) as path, replace(p_name, ' ', '.') as name, p_type, p_size, p_brand from part),
n as (select path, string_split(name, '.')[-1] as name from p
  union all select path, 'Kind' || p_size from p
  union all select path, string_split(name, '.')[-1] from p where strlen(name) >= 4 and regexp_matches(name, '^\p{L}')
  union all select path, p_brand from p where strlen(p_brand) >= 4 and regexp_matches(p_brand, '^\p{L}')
  union all select path, string_split(name, '.')[-1] from p)
select path, name from n where strlen(name) >= 4""",
    "cochange": """with c as (select distinct cast(l_orderkey as varchar) as commit, cast(l_partkey as varchar) as path from lineitem),
w as (select cast(l_partkey as varchar) as path from lineitem group by l_partkey order by count(*) desc, cast(l_partkey as varchar) limit 20),
h as (select distinct commit from c where path in (select path from w)),
n as (select path, count(*) as n from c where commit in (select commit from h) and path not in (select path from w) group by path order by n desc, path limit 20)
select path, n from n where n >= 2""",
    "slugify": f"select row_id, {_SLUG('title')} as slug from gh_issue",
    "escape_yaml": f"select row_id, {_YAML.format('body')} as escaped from gh_comment",
    "kind_filter": "select row_id, number from gh_issue where pull_request is not null",
    "issues_filtered": "select row_id, repo, number, updated_at from gh_issue where pull_request is null and state = 'open' and updated_at >= '2025-01-01T00:00:00Z'",
    "issues_limited": f"select repo, number, updated_at from ({_LATEST}) where updated_at is not null order by updated_at, repo, number limit 100",
    "labels_filter": "select row_id from gh_issue where list_contains(list_transform(labels, lambda x: x.name), 'bug')",
    "sync_watermark": "select max(updated_at) as last_sync, count(*) as item_count from gh_issue",
    "incremental_upsert": f"select repo, number, row_id, updated_at from ({_LATEST})",
    "sync_stream": f"select repo, number, row_id, updated_at from ({_LATEST}) where updated_at is not null",
    "render_issue": f"""select i.repo, i.number, {_KIND} as kind, {_KIND} || '/' || i.number || '-' || {_SLUG("coalesce(title, '')")} || '.md' as path,
{_MARKDOWN.replace('number ||', 'i.number ||')} || case when body is not null and c is not null then '---' || {_NL} || {_NL} || '## Comments' || {_NL} || {_NL} || c else '' end as markdown
from ({_LATEST}) i left join ({_COMMENTS}) c on i.repo = c.repo and i.number = c.number""",
    "render_without_comments": f"select repo, number, md5({_MARKDOWN}) as md5 from ({_LATEST})",
    "manifest": "select repo, count(*) as n_files, max(updated_at) as synced_at, count(*) filter (where kind = 'prs') as n_prs, count(*) filter (where kind = 'issues') as n_issues from manifest_entry group by repo",
    "manifest_lines": r"""select repo, '{"number":' || number || ',"kind":' || coalesce(to_json(kind), 'null') || ',"path":' || coalesce(to_json(path), 'null') || ',"updated_at":' || coalesce(to_json(updated_at), 'null') || '}' as line from manifest_entry""",
    "manifest_header": "select 1 as version, 'github' as source_type, 'o' as owner, 'r' as repo, 'prs,issues' as included_kinds, max(updated_at) as synced_at from manifest_entry",
    "shorten_path": f"""select distinct p as full_path, {_SHORT('p')} as shown from (select case when number % 2 = 0 then '/home/u/sources/github/' else 'C:\\u\\sources\\github\\' end || repo || '/' || path as p from manifest_entry)""",
    "parse_repo_url": f"""select row_id, url, nullif(regexp_extract(r, '^([^/]+)/(.+)$', 1), '') as owner, nullif(regexp_extract(r, '^([^/]+)/(.+)$', 2), '') as name from (
select row_id, url, rtrim(regexp_replace(regexp_extract(url, '^(git@github\\.com:|https?://github\\.com/|ssh://git@github\\.com/)(.*)$', 2), '(\\.git)+$', ''), '/') as r from (select row_id, {_URL} as url from gh_issue))""",
    "parse_repo_argument": "select row_id, string_split(repo, '/')[1] as owner, substr(repo, strpos(repo, '/') + 1) as name from gh_issue",
    "preview": r"""with l as (select chunk_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') as l from chunks)
select chunk_id, array_to_string(list_transform(l[1:3], lambda x: case when strlen(x) > 120 then substr(x, 1, 117) || '...' else x end)
  || case when len(l) > 3 then ['... (' || (len(l) - 3) || ' more lines)'] else [] end, chr(10)) as shown from l""",
    "result_lines": rf"""with l as (select *, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') as l from display_result where text is not null)
select distinct query_id || '/' || coalesce(engine || '/', '') || chunk_id || '/' || cast(score as double) as rank, printf('%.4f', cast(score as double)) || '  ' || {_SHORT('file_path')} || ':' || line_number || chr(10)
  || array_to_string(list_transform(list_transform(l[1:3], lambda x: case when strlen(x) > 120 then substr(x, 1, 117) || '...' else x end)
  || case when len(l) > 3 then ['... (' || (len(l) - 3) || ' more lines)'] else [] end, lambda x: '  ' || x), chr(10)) as shown from l""",
    "p6_found": _DUE + "select src.repo, src.number from src left join tgt on src.k = tgt.k and src.number = tgt.number where tgt.v is null or src.v > tgt.v",
    "p6_pending": _DUE
    + """select src.repo, src.number, src.v as version_ms, tgt.v as rendered_ms, case when tgt.v is null then 'new' else 'changed' end as reason
from src left join tgt on src.k = tgt.k and src.number = tgt.number where tgt.v is null or src.v > tgt.v""",
    "p6_published": _DUE + "select 1 as run, src.repo, src.number, src.v as version_ms from src left join tgt on src.k = tgt.k and src.number = tgt.number where tgt.v is null or src.v > tgt.v",
    "p6_watermarks": f"""
with s as (select lower(repo) as repo, {_millis('last_sync')} as ms, saved_at from sync_state where regexp_matches(last_sync, '^[0-9]{{4}}-') and repo is not null)
select repo, max_by(ms, (saved_at, ms)) as last_sync_ms from s group by repo""",
}
