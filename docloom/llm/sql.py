"""DuckDB SQL for those corpus queries that SQL can express, written independently of the DataFrame plans.

The others have none: learnt scores (op5, op10), tokenizers (op3, op4), pseudorandom draws (op2, pipeline), and windows of
near passages (op8); they are tested against brute force."""

# ids on links(a, b), both ways -> the smallest id reachable
REACH = """reach(id, root) AS (select a, a from links union select l.b, r.root from reach r join links l on l.a = r.id),
 comp AS (select id, min(root) as root from reach group by id)"""

MINHASH = f"""with recursive w AS (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s AS (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end as s from w),
 n AS (select doc_id, len(s) as n from s),
 e AS (select doc_id, unnest(s) as g from s),
 shared AS (select x.doc_id as a, y.doc_id as b, count(*) as k from e x join e y on x.g = y.g and x.doc_id <> y.doc_id group by all),
 links AS (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
 {REACH}
 select doc_id, n as n_shingles, coalesce(root, doc_id) as component_id, coalesce(root, doc_id) = doc_id as kept from n left join comp on comp.id = n.doc_id"""

USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

EMBEDDINGS = f"""with recursive v AS (select vec_id, embedding::double[] as v from embeddings where {USABLE}),
 u AS (select vec_id, v, sqrt(list_dot_product(v, v)) as size from v),
 links AS (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_dot_product(x.v, y.v) / x.size / y.size >= 0.95::double),
 {REACH},
 k AS (select a, count(*) as k from links group by a)
 select vec_id, coalesce(k, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from embeddings left join comp on comp.id = vec_id left join k on k.a = vec_id"""

NEAREST = f"""with v AS (select vec_id, embedding::double[] as v from embeddings where {USABLE}),
 p AS (select q.vec_id as query_id, v.vec_id, list_dot_product(v.v, q.v) as score from v q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v) where q.vec_id % 20 = 0),
 r AS (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from p)
 select query_id, r::int as rank, vec_id, score from r where r <= 20"""

# leaves, their templates and what recurs, in plain strings instead of hashes
LINES = """with t AS (select doc_id, md5(text) as th, text, string_split(text, chr(10)) as ls from documents where text is not null),
 l AS (select th, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from t),
 k AS (select *, list_transform(string_split(line, ' '), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as tokens from l),
 m AS (select *, len(tokens) as n, concat(len(tokens), ' ', array_to_string(tokens[:4], ' ')) as leaf from k where len(tokens) >= 3 or regexp_matches(line, '[\\p{L}\\p{N}]')),
 busy AS (select leaf from m group by leaf having count(*) >= 10),
 rows_ AS (select m.* from m join busy using (leaf)),
 place AS (select leaf, i, token, count(*) as c from (select leaf, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from rows_ where n >= 3) group by all),
 top AS (select leaf, i, token, c, sum(c) over (partition by leaf, i) as all_, row_number() over (partition by leaf, i order by c desc, token desc) as r from place),
 tp AS (select leaf, list(case when c >= 0.6::double * all_ then token else '<*>' end order by i) as template from top where r = 1 group by leaf),
 good AS (select * from tp where 2 * len(list_filter(template, lambda x: x <> '<*>')) >= len(template)),
 of_ AS (select distinct th, pos, case when template is not null and len(list_filter(list_zip(tokens, template), lambda z: z[2] <> '<*>' and z[1] <> z[2])) = 0 then concat('leaf ', leaf) else concat('line ', line) end as tid from rows_ left join good using (leaf)),
 each AS (select tid, th, min(pos) as pos from of_ group by tid, th),
 rec AS (select tid, min(th) as first_th, arg_min(pos, th) as first_pos from each group by tid having count(*) >= 10),
 gone AS (select th, list(pos) as drops from of_ join rec using (tid) where th <> first_th or pos <> first_pos group by th)
 select d.doc_id, coalesce(len(t.ls), 0) as n_lines, coalesce(len(drops), 0) as n_dropped,
 md5(case when drops is null then d.text else array_to_string(list_filter(t.ls, lambda x, i: not list_contains(drops, i - 1)), chr(10)) end) as text_md5
 from documents d left join t on t.doc_id = d.doc_id left join gone using (th)"""

ORACLE_SQL: dict[str, str] = {"op1_minhash": MINHASH, "op6_embedding_dedup": EMBEDDINGS, "op7_nearest": NEAREST, "op9_lines": LINES}
