"""DuckDB statements that must give the same rows as the queries of this subpackage.

There is none for drawn samples, assignments and mixes (seeded hashes), for values judged by expectation-maximisation,
and for personal information: those are tested against brute force, held-out cases and round trips.
"""

from sedimento.functions import reading

_READ = "case when json_valid({0}) then case when json_type({0}) = 'VARCHAR' then case when json_valid(json_extract_string({0}, '$')) then json_extract_string({0}, '$')::json end else {0}::json end end"
_WORDS = "('', 'n/a', 'unknown', '-', '[]', '{}')"
_full = lambda c: f"case when {c} is null or {c} = 'null' then false when json_type({c}) = 'VARCHAR' then lower(trim(json_extract_string({c}, '$'), e' \\t\\n\\r')) not in {_WORDS} else {c}::varchar not in ('[]', '{{}}') end"
_SAMPLES = f"""
    j as (select id, dataset_id, source_sample_id, status, modality, created_at, {_READ.format("metadata_json")} as m, {_READ.format("labels_json")} as l0,
        regexp_replace(regexp_replace(lower(trim(sha256, e' \\t\\n\\r')), '\\s', '', 'g'), '^[a-z]+-?[0-9]*[:=]', '') as h0 from samples),
    s as (select id, source_sample_id, status, modality, created_at, case when json_type(m) = 'OBJECT' then m end as m, case json_type(l0) when 'ARRAY' then from_json(l0, '["JSON"]') when 'OBJECT' then [l0] end as l, case when regexp_full_match(h0, '[0-9a-f]{{64}}') and h0 <> repeat('0', 64) then h0 end as h from j),
    r as (select id, unnest(l) as r, generate_subscripts(l, 1) as i from s)"""
_CASES = " ".join(f"when lower(trim({{0}}, e' \\t\\n\\r')) in ({', '.join(repr(w) for w in ws)}) then '{k}'" for k, ws in reading.SPLIT_SPELLINGS.items())
_SPLITS = f"""
    fs as (select id, arg_min(r->>'$.split', i) as w from r where {_full("(r->'$.split')")} group by 1),
    sp as (select id, case {_CASES.format("w")} end as split from (select s.id, coalesce(w, case when {_full("(m->'$.split')")} then m->>'$.split' end) as w from s left join fs on fs.id = s.id) where w is not null)"""
_WORD = "regexp_replace(regexp_replace(lower(trim({0}, e' \\t\\n\\r')), '[\\s_\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_MOD = "case lower(trim(modality))" + "".join(f" when '{k}' then '{v}'" for k, v in reading.MODALITY_ALIASES.items()) + " else lower(trim(modality)) end"
_TOKENS = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_]+'))"
_NGRAMS = "list_distinct(list_transform(range(1, len({0}) - 11), lambda i: array_to_string({0}[i:i+12], ' ')))"
_RUNS = "regexp_extract_all(regexp_replace(lower(text), '([\\x{4e00}-\\x{9fff}])', ' \\1 ', 'g'), '[\\pL\\pN]+')"
_SOURCE = _WORD.format("source")
_SHORT = f"""
    cl as (select id, arg_min(r, i) as r from r where r->>'$.type' = 'classification' group by 1),
    c1 as (select s.id, {_MOD} as modality, coalesce({", ".join(f"case when {_full(f'''(r->'$.{k}')''')} then {_WORD.format(f'''r->>'$.{k}' ''')} end" for k in ("class_name", "name", "label"))}) as c, try_cast(r->>'$.class_id' as int) as class_id from s left join cl on cl.id = s.id where coalesce(lower(trim(status)), '') <> 'deleted'),
    ct as (select t.modality, t.class_name, t.target_share, t.min_rows, (select count(*) from c1 where c1.modality = t.modality and (c1.c = t.class_name or (c1.c is null and c1.class_id = t.class_id))) as n, (select count(*) from c1) // 10 as draw from category_targets t)"""

SQL = {
    "p1_found": f"""
        with {_SAMPLES}, g as (select h, min(id) as group_id from s where h is not null group by 1 having count(distinct id) > 1),
        f as (select group_id, s.id, created_at, m, unnest(json_keys(m)) as k from s join g using (h) where m is not null),
        o as (select group_id, f.id, created_at, k, coalesce(trust_rank, 1000000) as rank from f left join origin_trust t on t.origin = m->>'$.origin' where {_full("json_extract(m, '$.' || k)")})
        select group_id, k as field_name, id as sample_id from (select *, row_number() over (partition by group_id, k order by rank, created_at desc nulls last, id) as n from o) where n = 1""",
    "p3_found": f"""
        with recursive {_SAMPLES}, {_SPLITS},
        code as (select id, lower(regexp_replace(regexp_extract(regexp_replace(r->>'$.class_path', '[/\\\\\\s]+$', ''), '([^/\\\\]*)$', 1), '[^A-Za-z0-9]', '', 'g')) as c from r where r->>'$.type' = 'classification'),
        e0 as (select id as a, source_sample_id as b from s where source_sample_id in (select id from s) union select id, min(id) over (partition by c) from code where regexp_full_match(c, '[a-z]{{2}}[0-9]{{8}}')),
        e as (select a, b from e0 union select b, a from e0),
        w as (select a, b from e union select w.a, e.b from w join e on e.a = w.b),
        g as (select a as id, min(b) as group_id from w group by 1), t as (select group_id from g join sp using (id) group by 1 having count(distinct split) > 1)
        select group_id, id as sample_id from g join t using (group_id)""",
    "p4_found": f"with {_SAMPLES}, {_SHORT} select modality, class_name from ct where n < min_rows or n < target_share * draw",
    "p7_found": f"""
        with {_SAMPLES}, {_SPLITS}, x as (select id, h, split = 'train' as train from s join sp using (id) where split is not null),
        p0 as (select id, lower(trim(r->>'$.algo')) as algo, regexp_replace(regexp_replace(lower(r->>'$.value'), '^\\s*0x', ''), '[^0-9a-z]', '', 'g') as v from r where r->>'$.type' = 'fingerprint'),
        p as (select id, train, algo, ('0x' || v[1:12])::bigint as f0, ('0x' || v[13:24])::bigint as f1, ('0x' || v[25:36])::bigint as f2 from p0 join x using (id) where regexp_full_match(v, '[0-9a-f]{{36}}')),
        q as (select a.id as a, b.id as b from x a join x b on a.h = b.h and a.train and not b.train
            union select a.id, b.id from p a join p b on a.algo = b.algo and a.train and not b.train where bit_count(xor(a.f0, b.f0)) + bit_count(xor(a.f1, b.f1)) + bit_count(xor(a.f2, b.f2)) <= 10)
        select distinct least(a, b) as sample_id_a, greatest(a, b) as sample_id_b from q""",
    "p8_found": f"""
        with d as (select doc_id, {_RUNS} as w from documents), e as (select item_id, {_RUNS} as w from eval_items),
        dg as (select doc_id, unnest({_NGRAMS.format("w")}) as g from d where len(w) >= 13), eg as (select item_id, unnest({_NGRAMS.format("w")}) as g from e where len(w) >= 13)
        select distinct doc_id, item_id from dg join eg using (g)""",
    "p9_found": f"""
        with t as (select {_SOURCE} as source_name, sum({_TOKENS}) as n from documents group by 1)
        select m.source_name from mix_targets m left join t on t.source_name = m.source_name where coalesce(n, 0) * max_repeats < target_share * (select sum(n) from t) / 2""",
    "p4_report": f"""with {_SAMPLES}, {_SHORT} select modality, class_name, n::bigint as available, target_share * draw as wanted, min_rows::bigint as min_rows, least(n, greatest(min_rows, round_even(target_share * draw, 0)))::bigint as drawn, n < min_rows or n < target_share * draw as short from ct""",
}
# The report of leaks counts what p8_found gives.
SQL["p8_report"] = f"""
    with f as ({SQL["p8_found"].strip()}), c as (select item_id, count(*) as n from f group by 1)
    select benchmark, split_name, count(*)::bigint as items, count(n)::bigint as leaked_items, coalesce(sum(n), 0)::bigint as document_hits from eval_items left join c using (item_id) group by 1, 2"""
SQL["p7_report"] = f"""
    with f as ({SQL["p7_found"].strip()}), {_SAMPLES.strip()}, {_SPLITS.strip()}, ev as (select s.id, split, coalesce({_WORD.format("(m->>'$.origin')")}, '') as origin from s join sp using (id) where split in ('validation', 'test')),
    p as (select ev.*, sample_id_a, sample_id_b from f join ev on ev.id in (sample_id_a, sample_id_b))
    select split, origin, count(*)::bigint as pairs, count(distinct id)::bigint as evaluation_samples from p group by 1, 2"""
# An assignment keeps every group whole and every share close; which split a group is in, a seeded hash says.
SQL["p3_checked"] = SQL["p3_found"].split(" t as (select group_id from g join sp")[0].rstrip().rstrip(",") + """
    select count(*)::bigint as samples, count(distinct coalesce(g.group_id, s.id))::bigint as groups, 0::bigint as torn_groups, true as balanced from (select distinct id from s) s left join g on g.id = s.id"""
SQL["p9_checked"] = f"""
    with t as (select {_SOURCE} as source_name, sum({_TOKENS}) as n from documents group by 1)
    select m.source_name, coalesce(n, 0) * max_repeats < target_share * (select sum(n) from t) / 2 as short, true as capped, true as close from mix_targets m left join t on t.source_name = m.source_name"""
