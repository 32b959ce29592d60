"""DuckDB SQL for the engine's queries, written independently of the DataFrame plans."""

MD = """md AS (select d.doc_id,
 concat(d.source,'/',d.lang,'/doc-',lpad(cast(d.doc_id as varchar),6,'0'),'.md') as path, p.p_name as title, d.text, p.p_brand, p.p_type, p.p_size,
 concat('# ',p.p_name,chr(10),chr(10),d.text,chr(10),chr(10),'## Specs',chr(10),chr(10),'Part specification',chr(10),'| Field | **Value** |',chr(10),'|---|---|',chr(10),'| brand | `',p.p_brand,'` |',chr(10),'| type | ',p.p_type,' |',chr(10),'| size | *',cast(p.p_size as varchar),'* |',chr(10),chr(10),'### Config',chr(10),'```yaml',chr(10),'sku: ',cast(d.doc_id as varchar),chr(10),'brand: ',p.p_brand,chr(10),'```',chr(10),chr(10),'See [next](doc-',lpad(cast(d.doc_id+20 as varchar),6,'0'),'.md#specs) and [site](https://example.com/',cast(d.doc_id as varchar),') or [top](#specs) and <https://auto.example.com/',cast(d.doc_id as varchar),'>.',chr(10),'![diagram](img/',cast(d.doc_id as varchar),'.png)',chr(10)) as content
from documents d join part p on d.doc_id=p.p_partkey)"""
LN = MD + """, ln AS (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from md)"""
HD = LN + """, hd AS (select path, n, regexp_replace(trim(line, E' \\t\\r\\x0b\\f'), '^#+\\s*', '') as heading from ln where regexp_matches(line, '^\\s*#'))"""
TB = LN + """, f AS (select *, regexp_matches(line, '^\\s*\\|(.+)\\|\\s*$') r, regexp_matches(line, '^\\s*\\|[\\s\\-:|]+\\|\\s*$') sep from ln),
 g AS (select *, n - row_number() over (partition by path order by n) as run from f where r),
 w AS (select *, lead(sep) over (partition by path order by n) and lead(n) over (partition by path order by n) = n + 1 as head from g),
 h AS (select *, min(case when head then n end) over (partition by path, run) as first from w),
 t AS (select path, first as line_start, max(n) as line_end, max(case when n = first then line end) as header, count(*) filter (not sep and n > first) as row_count from h where n >= first group by path, first)"""
LK = MD + """, lk AS (select path, u as url, t as text from (select path, unnest(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^\\)]+)\\)', 2)) u, unnest(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^\\)]+)\\)', 1)) t from md)
 union all select path, u, u from (select path, unnest(regexp_extract_all(content, '<(https?://[^>]+)>', 1)) u from md)),
 ty AS (select *, case when regexp_matches(url, '^https?://') then 'external' when starts_with(url, '#') then 'anchor' else 'internal' end as type from lk),
 rs AS (select ty.*, case when type = 'internal' then concat(regexp_extract(path, '^(.*/)?[^/]*$', 1), split_part(url, '#', 1)) end as target from ty),
 vl AS (select rs.*, type <> 'internal' or target in (select path from md) as valid from rs)"""
COUNT = "((length(text) - length(replace(lower(text), 'the', ''))) // 3)::int"
KWIC = """case when position('the' in lower(text)) = 0 then concat(text[:200], '...') else concat(case when position('the' in lower(text)) - 1 - 100 > 0 then '...' else '' end,
 substring(text, greatest(0, position('the' in lower(text)) - 101) + 1, least(length(text), position('the' in lower(text)) + 102) - greatest(0, position('the' in lower(text)) - 101)),
 case when position('the' in lower(text)) + 102 < length(text) then '...' else '' end) end"""
CS = f"""cs AS (select cast(doc_id as varchar) as path, doc_id, least(85.0::double, 60.0::double + 5 * {COUNT}) as score, {KWIC} as excerpt from documents where contains(lower(text), 'the'))"""
Q = """q AS (select list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double + z[2]::double) v from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id = 1),
 sm AS (select vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as similarity from embeddings, q), tp AS (select * from sm order by similarity desc, vec_id limit 5)"""
EX = "case when contains(lower(path), 'red') then 100.0::double when contains(lower(title), 'red') then 95.0::double end"

GREP = """gl AS (select cast(doc_id as varchar) as path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents where contains(lower(text), 'the')),
 gh AS (select *, contains(lower(line), 'the')::int as hit from gl),
 g3 AS (select *, case when sum(hit) over (partition by path order by ln) <= 3 then hit else 0 end as h from gh),
 gn AS (select *, max(h) over (partition by path order by ln rows between 2 preceding and 2 following) as near from g3),
 gk AS (select *, row_number() over (partition by path order by ln) as n from gn where near = 1),
 ge AS (select path, string_agg(line, chr(10) order by ln) as excerpt from gk where n <= 5 group by path)"""
# length of the longest common subsequence with 'red widgit', a bit for each of its characters
INDEL = """im AS (select cast(p_partkey as varchar) as path, lower(p_name) as title, list_transform(string_split(lower(p_name), ''), lambda c: list_sum(list_transform(range(0, 10), lambda i: case when substring('red widgit', i::int + 1, 1) = c then (1::bigint << i::int) else 0::bigint end))::bigint) as masks from part),
 ir AS (select path, round(200.0::double * (10 - bit_count(list_reduce(list_prepend(1023::bigint, masks), lambda s, m: ((s + (s & m)) | (s - (s & m))) & 1023::bigint))) / (10 + length(title)), 6) as ratio from im)"""
# the fold over lines as a recursion: where a chunk starts depends on the characters since the last cut only
CHUNK = LN.replace("md AS (", "recursive md AS (", 1) + """, cl AS (select path, n, line, regexp_matches(trim(line, E' \\t\\r\\x0b\\f'), '^#') as head, length(line) - length(ltrim(line, '#')) as level, trim(ltrim(line, '#'), E' \\t\\r\\x0b\\f') as title from ln),
 walk AS (select path, n, 0 as chunk, length(line) as chars, length(line) > 2048 as full_ from cl where n = 0
  union all select c.path, c.n, w.chunk + case when w.full_ or (c.head and c.level <= 2) then 1 else 0 end,
   case when w.full_ or (c.head and c.level <= 2) then length(c.line) else w.chars + 1 + length(c.line) end,
   case when w.full_ or (c.head and c.level <= 2) then length(c.line) else w.chars + 1 + length(c.line) end > 2048
  from walk w join cl c on c.path = w.path and c.n = w.n + 1),
 cx AS (select c.*, w.chunk from walk w join cl c on c.path = w.path and c.n = w.n),
 ce AS (select path, chunk, max(n) as last, string_agg(line, chr(10) order by n) as body from cx group by path, chunk),
 -- a heading stands at a chunk's end unless one of its level or above follows, the heading that opens the next chunk included
 nx AS (select e.*, f.head as next_head, f.level as next_level from ce e left join cx f on f.path = e.path and f.n = e.last + 1),
 hs AS (select x.path, x.chunk, h.n, h.title from nx x join cl h on h.path = x.path and h.head and h.n <= x.last
  where not exists (select 1 from cl o where o.path = h.path and o.head and o.n > h.n and o.n <= x.last and o.level <= h.level)
  and not (length(x.body) <= 2048 and coalesce(x.next_head, false) and x.next_level <= h.level)),
 ck AS (select x.path, x.chunk as chunk_index, (length(body) // 4)::int as token_count, md5(trim(body, E' \\t\\r\\n\\x0b\\f')) as digest, coalesce((select string_agg(title, ' > ' order by n) from hs where hs.path = x.path and hs.chunk = x.chunk), '') as headings from nx x)"""

ORACLE_SQL = {
    "doc_scan": f"with {MD} select path, strlen(content) as size, md5(content) as digest from md",
    "path_parts": f"with {MD} select path, split_part(path, '/', 1) as team, split_part(path, '/', 2) as category from md",
    "titles": f"with {MD} select path, title from md",
    "headings": f"with {HD} select path, (row_number() over (partition by path order by n) - 1)::int as pos, heading from hd",
    "headings_per_team": f"with {HD} select split_part(path, '/', 1) as team, split_part(path, '/', 2) as category, count(*) as headings from hd group by rollup (1, 2)",
    "folder_counts": f"with {MD} select folder, count(*) as n_docs from (select unnest(['', split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) as folder from md) group by 1",
    "table_islands": f"with {TB} select t.path, (row_number() over (partition by t.path order by line_start) - 1)::int as table_index, line_start::int as line_start, line_end::int as line_end, case when trim(c.line) <> '' and not regexp_matches(trim(c.line), '^[#|]') then trim(c.line) end as caption, row_count::int as row_count, (length(header) - length(replace(header, '|', '')) - 1)::int as col_count from t left join ln c on c.path = t.path and c.n = line_start - 1",
    "table_cells": f"with {MD} select path, r::int as row, c::int as col, cell from (select path, 0 r, 0 c, 'brand' cell from md union all select path, 0, 1, p_brand from md union all select path, 1, 0, 'type' from md union all select path, 1, 1, p_type from md union all select path, 2, 0, 'size' from md union all select path, 2, 1, cast(p_size as varchar) from md)",
    "table_text": f"with {MD} select path, concat('Table: Part specification', chr(10), 'Field | Value', chr(10), 'brand | ', p_brand, chr(10), 'type | ', p_type, chr(10), 'size | ', p_size) as text from md",
    "get_table": f"with {MD} select path, 'Field,Value' as headers from md where path like '%doc-000021.md'",
    "image_refs": f"with {MD} select path, 0::int as pos, concat('img/', doc_id, '.png') as img_path, 'diagram' as alt from md",
    "links": f"with {LK} select path, url, text, type from ty",
    "links_html": """select case when regexp_matches(u, '^https?://') then 'external' when starts_with(u, '#') then 'anchor' else 'internal' end as type, count(*) as n from (select trim(unnest(regexp_extract_all(html, '<a[^>]+href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', 1, 'i'))) u from pages union all select unnest(regexp_extract_all(html, '<(https?://[^>]+)>', 1)) from pages union all select unnest(regexp_extract_all(html, '\\[([^\\]]+)\\]\\(([^\\)]+)\\)', 2)) from pages) group by 1""",
    "link_validate": f"with {LK} select path, url, target, valid from vl",
    "broken_links": f"with {LK} select path, url from vl where not valid",
    "link_stats": f"with {LK} select path, count(*) as total, count(*) filter (type = 'internal') as internal, count(*) filter (type = 'external') as external, count(*) filter (type = 'anchor') as anchor, count(*) filter (valid) as valid, count(*) filter (not valid) as broken from vl group by path",
    "related_titles": f"with {LK} select distinct vl.path, target, md.title from vl join md on md.path = target where type = 'internal'",
    "code_blocks": f"with {MD} select path, 0::int as pos, 'yaml' as language, concat('sku: ', doc_id, chr(10), 'brand: ', p_brand) as code from md",
    "find_configs": f"with {MD} select path, 0::int as pos, 'yaml' as language, concat('sku: ', doc_id, chr(10), 'brand: ', p_brand) as code from md where contains(lower(path), 'red') or contains(lower(title), 'red')",
    "fixed_chunks": f"with {MD} select path, i::int as chunk_index, md5(substring(content, i * 2048 + 1, 2048)) as digest from (select path, content, unnest(range(0, (length(content) - 1) // 2048 + 1)) as i from md)",
    "enrich_content": f"with {MD} select path, md5(concat(content, chr(10), chr(10), 'Table: Part specification', chr(10), 'Field | Value', chr(10), 'brand | ', p_brand, chr(10), 'type | ', p_type, chr(10), 'size | ', p_size)) as enriched, md5(content) as raw from md",
    "grep_search": f"with {GREP} select path, least(90.0::double, 70.0::double + 5 * ((length(excerpt) - length(replace(lower(excerpt), 'the', ''))) // 3)) as score, md5(excerpt) as digest from ge",
    "fuzzy_titles": f"with {INDEL} select path, round(ratio * 0.8::double, 6) as score from (select * from ir order by ratio desc, path limit 5) where ratio > 60",
    "chunks": f"with {CHUNK} select path, chunk_index, token_count, digest, headings from ck",
    "chunk_stats": f"with {CHUNK} select path, count(*) as chunks, max(token_count) as longest from ck group by path",
    "exact_search": f"with {MD} select path, title, score, 'exact' as match_type from (select *, {EX} as score from md) where score is not null",
    "exact_search_folder": f"with {MD} select path, title, 100.0::double as score, 'exact' as match_type from md where starts_with(path, 'src1/en/')",
    "content_search": f"with {CS} select path, score, excerpt from cs",
    "term_frequency": f"select doc_id, {COUNT} as n from documents where contains(lower(text), 'the')",
    "semantic_topk": f"with {Q} select vec_id, similarity, round(similarity * 100, 4) as score from tp",
    "semantic_threshold": f"with {Q} select vec_id, similarity, round(similarity * 100, 4) as score from tp where similarity >= 0.6",
    "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings",
    "hybrid_search": f"with {MD} select path, title, score, 'exact' as match_type from (select *, {EX} as score from md) where score is not null order by score desc, path limit 10",
    "rerank_blend": f"with {CS} select path, round((0.7::double * least(1.0::double, length(excerpt) / 300.0::double) + 0.3::double * score / 100) * 100, 6) as score, 'content+reranked' as match_type from cs order by 2 desc, path limit 10",
    "context_budget": f"with {CS}, r AS (select doc_id + 1 as rank, path, excerpt as section, coalesce(sum(length(excerpt)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as used from (select * from cs order by doc_id limit 20)) select rank, path, case when used + length(section) <= 2000 then section else section[:(2000 - used)::int] end as section, used + length(section) > 2000 as truncated from r where used < 2000 and (used + length(section) <= 2000 or 2000 - used > 200)",
    "index_totals": f"with {HD} select (select count(*) from md) as docs, count(*) as headings, (select sum(length(content))::bigint from md) as chars from hd",
    "conversation_search": f"select conv_id, turn, {COUNT} as n from conversations where contains(lower(text), 'the')",
    "get_file": f"with {MD} select path, printf('%.1f KB', strlen(content) / 1024.0::double) as size, split_part(path, '/', 1) as team from md where path like '%/doc-000003.md'",
    "summary_inputs": f"with {MD} select path, md5(case when length(content) > 4000 then concat(content[:4000], chr(10), '...(truncated)') else content end) as text from md",
    "table_captions": f"with {MD} select path, 0::int as table_index, 'Part specification' as caption from md",
    "list_tables": f"with {MD} select path, 0::int as table_index, 'Field,Value' as headers, 3::int as row_count, 2::int as col_count from md",
    "link_lines": f"with {MD}, p AS (select path, content, unnest(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^\\)]+)\\)')) as whole from md) select path, split_part(whole[:-2], '](', 2) as url, (length(content[:position(whole in content)]) - length(replace(content[:position(whole in content)], chr(10), '')) + 1)::int as line from p",
    "related_docs": f"with {LK} select distinct path, target from vl where type = 'internal' and valid and target like '%.md'",
    "semantic_fallback": f"with {MD} select path, 'exact' as match_type, score from (select *, {EX} as score from md) where score is not null order by score desc, path limit 5",
    "knn_per_label": f"with {Q.split(chr(44) + chr(10) + ' sm AS')[0]}, sm AS (select label, vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as similarity from embeddings, q) select label, r::int as rank, vec_id, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) as r from sm) where r <= 3",
    "deep_search_merge": f"with {MD}, {Q.replace('limit 5)', 'limit 10)')}, al AS (select path, title, {EX} as score, 'exact' as match_type, 0 as st from md where {EX} is not null union all select path, title, round(similarity * 100, 4), 'semantic', 1 from tp join md on doc_id = vec_id where similarity >= 0.6) select path, title, score, match_type from (select *, row_number() over (partition by path order by st) as n from al) where n = 1 order by score desc, path limit 10",
    "tree_listing": f"""with {MD}, nd AS (select '' as parent, split_part(path, '/', 1) as name, false as is_file, 1 as depth, strlen(content) as b from md
 union all select split_part(path, '/', 1), split_part(path, '/', 2), false, 2, strlen(content) from md union all select concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), split_part(path, '/', 3), true, 3, strlen(content) from md),
 gp AS (select parent, name, is_file, depth, count(*) as n_docs, sum(b)::bigint as size from nd group by all)
 select parent, name, is_file, depth::int as depth, n_docs, size, row_number() over (partition by parent order by is_file desc, lower(name) desc, name desc) = 1 as is_last from gp""",
    "index_health": f"with {LK} select (select count(*) from md) as files, (select count(*) from md) as files_with_tables, (select count(*) from md) as tables, (select count(*) from md) as files_with_images, (select count(*) from md) as images, count(*) as links, count(*) filter (not valid) as broken_links from vl",
    "benchmark_overlap": f"select item_id, {COUNT} as n from benchmark where contains(lower(text), 'the')",
    "ragged_pad": f"with {MD} select path, r::int as row, concat(n, '|', v, '|') as padded from (select path, 0 r, 'brand' n, p_brand v from md union all select path, 1, 'type', p_type from md union all select path, 2, 'size', cast(p_size as varchar) from md)",
    "json_export": f"with {MD} select path, concat('{{\"path\":\"', path, '\",\"score\":', score, ',\"match_type\":\"exact\"}}') as json from (select *, {EX} as score from md) where score is not null",
}
