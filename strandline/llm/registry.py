"""Queries of the corpus operators, by name, and the SQL that states their results."""

from __future__ import annotations

from strandline.llm.chat import op2_chat_formatting
from strandline.llm.codec import op8_token_files
from strandline.llm.lattice import op9_lattice_near_dedup
from strandline.llm.licenses import op1_license_scan
from strandline.llm.mixing import op5_curriculum_mixing
from strandline.llm.packing import op3_best_fit_packing
from strandline.llm.pii import op13_personal_data
from strandline.llm.simhash import op6_simhash_near_dedup
from strandline.llm.suffixes import op10_suffix_array_dedup
from strandline.llm.topk import op4_exact_topk
from strandline.llm.toxicity import op7_string_kernel_toxicity
from strandline.llm.trie import op12_conversation_prefix_trie
from strandline.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_topk": op4_exact_topk,
    "op5_curriculum_mixing": op5_curriculum_mixing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_string_kernel_toxicity": op7_string_kernel_toxicity,
    "op8_token_files": op8_token_files,
    "op9_lattice_near_dedup": op9_lattice_near_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) as body, length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) as head from t)
select conv_id::bigint as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(body + case role when 'system' then 15 when 'user' then 15 when 'assistant' then 7 else head + 14 end) as bigint) as formatted_chars
from e group by conv_id""",
    "op4_exact_topk": """
with v as (select vec_id, [floor(64 * x::double)::bigint for x in embedding] as q from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)])::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    # crc32 bit by bit: each byte is followed by eight shifts, marked -1
    "op12_conversation_prefix_trie": r"""
with t as (select conv_id::bigint as conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
g as (select conv_id, count(*) as n, conv_id - conv_id % 20 as base, flatten([[ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(conv_id::varchar, '')]) as steps from t group by conv_id),
c as (select conv_id, n, base, xor(list_reduce(list_prepend(4294967295::bigint, steps), lambda a, b: case when b = -1 then xor(a >> 1, 3988292384::bigint * (a & 1)) else xor(a, b) end), 4294967295::bigint) % 4 as h from g),
i as (select c.*, least(c.h, coalesce(b.n, 0)) as taken from c left join c b on b.conv_id = c.base),
r as (select i.conv_id, pos, role, text from i join t on t.conv_id = i.base and pos < h union all select i.conv_id, pos - h + taken, role, text from i join t on t.conv_id = i.conv_id and pos >= h),
s as (select i.conv_id, coalesce(list({'role': role, 'text': text} order by pos) filter (where pos is not null), []) as turns from i left join r on r.conv_id = i.conv_id group by i.conv_id),
p as (select conv_id, turns[1:d] as prefix, d, len(turns) = d as ended from (select *, unnest(range(len(turns) + 1)) as d from s)),
n as (select prefix, d as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256,
    (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) end as own from p group by prefix, d),
k as (select prefix[1:depth - 1] as prefix, count(*) as n_children from n where depth > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.prefix = n.prefix),
a as (select prefix[1:d] as prefix, sum(own) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves from (select *, unnest(range(depth + 1)) as d from f) group by 1)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, f.ends_sha256
from f join a on a.prefix = f.prefix left join f u on f.depth > 0 and u.depth = f.depth - 1 and u.prefix = f.prefix[1:f.depth - 1]""",
}
