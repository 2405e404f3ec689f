"""DuckDB statements for lineages, orphan references and nested records."""

_READ = "case when json_valid({0}) then case when json_type({0}) = 'VARCHAR' then case when json_valid(json_extract_string({0}, '$')) then json_extract_string({0}, '$')::json end else {0}::json end end"
_ORPHANS = """
    ps as (select id, coalesce(lower(trim(status)) = 'deleted', false) as gone, created_at from samples), pd as (select id, coalesce(is_deleted, false) or coalesce(lower(trim(status)) = 'deleted', false) as gone, created_at from datasets), pt as (select id, false as gone, created_at from tasks),
    r as (select 'cleaning_suggestions' as table_name, 'sample_id' as field_name, c.id, sample_id as ref, c.created_at as ts, p.id as pid, gone, p.created_at as pts from cleaning_suggestions c left join ps p on p.id = sample_id
        union all select 'cleaning_suggestions', 'output_sample_id', c.id, output_sample_id, c.updated_at, p.id, gone, p.created_at from cleaning_suggestions c left join ps p on p.id = output_sample_id
        union all select 'samples', 'dataset_id', c.id, dataset_id, c.created_at, p.id, gone, p.created_at from samples c left join pd p on p.id = dataset_id
        union all select 'task_logs', 'task_id', c.id, task_id, c.created_at, p.id, gone, p.created_at from task_logs c left join pt p on p.id = task_id),
    k as (select table_name, field_name, id as record_id, case when pid is null then 'missing' when gone then 'deleted' when pts > ts then 'late' end as orphan_kind, ts from r where ref is not null and ref <> 0),
    f as (select table_name, field_name, record_id, orphan_kind, min(ts) as ts from k where orphan_kind is not null group by all)"""
_LINEAGE = """
    with recursive n as (select 'datasets' as t, id, parent_dataset_id as p from datasets union all select 'samples', id, source_sample_id from samples),
    e as (select n.t, n.id, n.p from n where exists (select 1 from n m where m.t = n.t and m.id = n.p)),
    w as (select t, id as node, id as cur, [id] as path, false as cyc from n where p is not null
        union all select w.t, node, e.p, list_append(path, e.p), list_contains(path, e.p) from w join e on e.t = w.t and e.id = w.cur where not cyc),
    x as (select t, node, arg_max(cur, len(path)) as cur, arg_max(path, len(path)) as path, bool_or(cyc) as cyc from w group by 1, 2)"""

SQL = {
    "p2_found": f"""{_LINEAGE} select t as table_name, node as node_id, case when cyc then list_min(path[list_position(path, cur):]) else cur end as root_id, case when cyc then -1 else len(path) - 1 end::bigint as depth from x""",
    "p2_paths": f"""{_LINEAGE}, l as (select t, node, path from x where not cyc union all select t, id, [id] from n where p is null), y as (select t, node, path, unnest(range(1, len(path) + 1)) as i from l) select t as table_name, node as node_id, (len(path) - i)::bigint as step, path[i] as ancestor_id from y""",
    "p2_descendants": f"""{_LINEAGE}, y as (select t, node, unnest(path) as a from x where not cyc) select t as table_name, a as node_id, node as descendant_id from y where a <> node""",
    "p2_intervals": f"""{_LINEAGE}, l as (select t, node, path from x where not cyc union all select t, id, [id] from n where p is null), y as (select t, node, unnest(path) as a from l), z as (select t, a, count(*)::bigint as c from y group by 1, 2)
        select l.t as table_name, node as node_id, path[-1] as root_id, (len(path) - 1)::bigint as depth, c as subtree_size from l join z on z.t = l.t and z.a = l.node""",
    "p5_found": f"with {_ORPHANS} select table_name, field_name, record_id, orphan_kind from f",
    "p5_report": f"with {_ORPHANS} select table_name, field_name, orphan_kind, strftime(ts, '%Y-%m') as period, count(*)::bigint as n from f group by all",
    "p6_found": f"""
        with c as (select 'samples' as table_name, 'labels_json' as column_name, id, {_READ.format("labels_json")} as j from samples union all select 'samples', 'metadata_json', id, {_READ.format("metadata_json")} from samples
            union all select 'algorithms', 'input_contract_json', id, {_READ.format("input_contract_json")} from algorithms union all select 'tasks', 'result_json', id, {_READ.format("result_json")} from tasks),
        d as (select table_name, column_name, id, j from c where j is not null),
        a as (select d.table_name, d.column_name, d.id, k.fullkey as path, k.type, json_extract_string(k.atom, '$') as s from d, json_tree(d.j) k),
        b as (select a.table_name, a.column_name, a.id, a.path || substr(k.fullkey, 2) as path, k.type from a, json_tree(case when a.type = 'VARCHAR' and left(ltrim(s), 1) in ('[', '{{') and json_valid(s) then s::json else 'null'::json end) k where a.type = 'VARCHAR' and left(ltrim(s), 1) in ('[', '{{') and json_valid(s))
        select table_name, column_name, id as record_id, path from a where type = 'OBJECT' and path like '%]' union all select table_name, column_name, id, path from b where type = 'OBJECT' and path like '%]'""",
    "p6_regions": f"""
        with j as (select id, {_READ.format("labels_json")} as j from samples), r as (select id, unnest(from_json(j, '["JSON"]')) as r, generate_subscripts(from_json(j, '["JSON"]'), 1) - 1 as k from j where json_type(j) = 'ARRAY'),
        g as (select id, k, case when json_type(r->'$.regions') = 'VARCHAR' and json_valid(r->>'$.regions') then (r->>'$.regions')::json else r->'$.regions' end as g from r),
        o as (select id, k, unnest(from_json(g, '["JSON"]')) as o, generate_subscripts(from_json(g, '["JSON"]'), 1) - 1 as p from g where json_type(g) = 'ARRAY')
        select id as record_id, '$[' || k || '].regions[' || p || ']' as path, '$[' || k || ']' as parent_path, p::int as position, (o->>'$.region_id')::bigint as region_id,
            (o->>'$.bbox[0]')::bigint as x, (o->>'$.bbox[1]')::bigint as y, (o->>'$.bbox[2]')::bigint as w, (o->>'$.bbox[3]')::bigint as h from o where json_type(o) = 'OBJECT'""",
}
