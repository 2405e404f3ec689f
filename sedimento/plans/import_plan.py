"""Queries of imports, runs and reports, and their SQL. The catalog's samples stand for the files of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.operators import runs
from sedimento.session import table
from sedimento.sources import imports

# Class and place of a file, made of sample ids: the same in both engines.
_CLASS = "concat('class_', id % 5)"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("id", "dataset_id", F.regexp_replace("relative_path", r"\\", "/").alias("relative_path")).where("relative_path is not null")


def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    x = _listed(spark, d).select("dataset_id", F.concat(F.expr("case when id % 10 = 0 then '' else concat('deep/', 'c', id % 4, '/') end"), F.expr("case when id % 23 = 0 then 'labels.txt' else concat('f', id, '.png') end")).alias("relative_path"))
    return imports.folder_tree(x, "root", by=["dataset_id"]).select("dataset_id", "relative_path", "class_path", "class_name", "split")


def folder_import(spark: SparkSession, d: str) -> DataFrame:
    """Labels of files: stated in a manifest for every seventh file, else the first folder."""
    x = _listed(spark, d).select("id", F.concat("relative_path", F.lit("#"), "id").alias("relative_path"))
    stated = x.where("id % 7 = 0").select("relative_path", F.lit('[{"type":"classification","class_name":"stated","source":"manifest"}]').alias("labels_json"))
    return imports.folder_labels(x, stated).select("id", F.get_json_object("labels_json", "$[0].class_name").alias("class_name"), F.get_json_object("labels_json", "$[0].source").alias("source"))


def file_record(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "samples").where("file_path is not null").select("id", F.col("file_path").alias("path"))
    return imports.file_record(x).select("id", "class_name", F.get_json_object("labels_json", "$[0].class_path").alias("class_path"))


def manifest_import(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for each dataset, odd ones as objects and even ones as lists of entries; every ninth file is missing."""
    s = table(spark, d, "samples").where("dataset_id is not null and id is not null")
    entry = F.struct(F.concat(F.lit("/f"), "id").alias("path"), F.expr(f"case when id % 3 = 0 then concat('[\"', {_CLASS}, '\",\"b\"]') else {_CLASS} end").alias("labels"), F.expr("case when id % 4 = 0 then 'test' when id % 4 = 1 then 'train' end").alias("split"))
    one = F.regexp_replace(F.regexp_replace(F.to_json(entry), r'"labels":"\[(.*?)\]"', r'"labels":[$1]'), r'\\"', '"')
    m = s.groupBy("dataset_id").agg(F.collect_list(F.struct("id", one.alias("e"))).alias("es"))  # a manifest is one file
    listed = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]"))
    named = F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: F.concat(F.lit('"'), x["id"].cast("string"), F.lit('":'), x["e"])), ","), F.lit("}"))
    text = F.concat(F.lit('{"samples":'), F.when(F.col("dataset_id") % 2 == 0, listed).otherwise(named), F.lit("}"))
    got = imports.manifest_import(m.select(F.col("dataset_id").alias("source"), text.alias("text")), s.where("id % 9 <> 0").select(F.col("dataset_id").alias("source"), F.concat(F.lit("f"), "id").alias("relative_path")))
    return got.select("source", "relative_path", "class_name", F.get_json_object("labels_json", "$[1].class_name").alias("second"), "split", "role")


def labeled_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Every file twice, once in a train and once in a test list if its id is even."""
    s = table(spark, d, "samples").where("dataset_id is not null and id is not null").select(F.col("dataset_id").alias("dataset"), F.concat(F.lit("/p/"), "id").alias("path"), F.col("id").alias("ord"), F.lit("train").alias("split"), F.expr("cast(id % 5 as int)").alias("class_id"), F.expr(_CLASS).alias("class_name"))
    tests = s.where("ord % 2 = 0").withColumn("split", F.lit("test")).withColumn("class_name", F.lit("test_class")).withColumn("class_id", F.lit(9))
    return imports.labeled_datasets(s.unionByName(tests))


def project_import(spark: SparkSession, d: str) -> DataFrame:
    """A project of label lists, one dataset folder for each task type; odd datasets have a test list."""
    s = table(spark, d, "samples").where("id is not null")
    name = F.concat(F.lit("d"), F.pmod("id", F.lit(6)).cast("string"))
    place = F.expr("case id % 3 when 0 then 'big/a' when 1 then 'tire/b' else 'gone/c' end")
    lines = s.select(name.alias("dataset"), F.expr("case when id % 6 in (1, 3, 5) and id % 4 = 1 then 'test' else 'train' end").alias("list"), F.concat(F.lit("/p/data/"), name, F.lit("/list.txt")).alias("file"), F.col("id").alias("line_number"), F.concat(place, "id", F.lit(".jpg "), F.expr("cast(id % 5 as string)")).alias("value"))
    listed = s.where("id % 3 <> 2").select(F.concat(F.lit("/p/"), F.expr("case when id % 3 = 0 then 'code/' else 'data/' end"), place, "id", F.lit(".jpg")).alias("path"))
    return imports.project_records(lines, listed).select("dataset", "path", "split", "class_id", "class_name")


def labelled_images(spark: SparkSession, d: str) -> DataFrame:
    return imports.labelled_images(table(spark, d, "samples")).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of evaluators, made of tasks: every third lists two results, every fifth none, the others are one themselves."""
    one = F.expr("""concat('{"model_name":"m', id % 4, '","metrics":{"acc":', id % 10, '}}')""")
    j = F.when(F.col("id") % 15 == 0, "[broken").when(F.col("id") % 5 == 0, '{"results":[]}').when(F.col("id") % 3 == 0, F.concat(F.lit('{"results":['), one, F.lit(',{"summary":"s"}]}'))).otherwise(one)
    return runs.results(table(spark, d, "tasks").select(F.col("id").alias("task_id"), j.alias("result_json")))


def eval_reports(spark: SparkSession, d: str) -> DataFrame:
    r = runs.report_rows(eval_results(spark, d).select("task_id", "n", "model_name"))
    return r.select("task_id", "items", F.get_json_object("report", "$[0].model_name").alias("first"), F.get_json_object("report", "$[1].model_name").alias("second"))


def preview_random(spark: SparkSession, d: str) -> DataFrame:
    """How many of a dataset's rows a random preview shows, that all are of the dataset, and of how many."""
    s = table(spark, d, "samples")
    of = s.where("dataset_id is not null").groupBy("dataset_id").count().orderBy(F.desc("count"), "dataset_id").first()
    total, shown = runs.random_preview(s, of["dataset_id"], 500, "raw", seed=3)
    return shown.agg(F.count("*").alias("shown"), F.count_distinct("id").alias("different"), F.count_if((F.col("dataset_id") == of["dataset_id"]) & (F.col("status") == "raw")).alias("of_it")).withColumn("total", F.lit(total).cast("bigint"))


def system_stats_legacy(spark: SparkSession, d: str) -> DataFrame:
    return runs.system_stats(table(spark, d, "datasets"), table(spark, d, "samples")).select("total_datasets", "total_samples", "processed_samples", F.col("total_size").cast("bigint").alias("total_size"))


QUERIES = {f.__name__: f for f in (folder_tree, folder_import, file_record, manifest_import, labeled_datasets, project_import, labelled_images, eval_results, eval_reports, preview_random, system_stats_legacy)}

_SPLIT = "case when k <= (case when n <= 1 then n else greatest(1, n - greatest(1, round(n * 0.2))) end) then 'train' else 'test' end"
_READ = "case when json_valid(labels_json) then case when json_type(labels_json) = 'VARCHAR' then case when json_valid(json_extract_string(labels_json, '$')) then json_extract_string(labels_json, '$')::json end else labels_json::json end end"
_RESULTS = """r as (select id as task_id, 0 as n, 'm' || (id % 4) as model_name, '{"acc":' || (id % 10) || '}' as metrics_json, '' as summary from tasks where id % 5 <> 0
        union all select id, 1, 'default-evaluator', '{}', 's' from tasks where id % 5 <> 0 and id % 3 = 0)"""

SQL = {
    "folder_tree": f"""with s as (select dataset_id, case when id % 10 = 0 then '' else 'deep/c' || (id % 4) end as class_path, case when id % 23 = 0 then 'labels.txt' else 'f' || id || '.png' end as f from samples where relative_path is not null),
        t as (select dataset_id, class_path, case when class_path = '' then f else class_path || '/' || f end as relative_path, case when class_path = '' then 'root' else split_part(class_path, '/', 2) end as class_name from s where f <> 'labels.txt'),
        r as (select *, row_number() over (partition by dataset_id order by class_name, relative_path) as k, count(*) over (partition by dataset_id) as n from t) select dataset_id, relative_path, class_path, class_name, {_SPLIT} as split from r""",
    "folder_import": r"""with s as (select id, replace(relative_path, '\', '/') || '#' || id as p from samples where relative_path is not null)
        select id, case when id % 7 = 0 then 'stated' when contains(p, '/') then split_part(p, '/', 1) end as class_name, case when id % 7 = 0 then 'manifest' when contains(p, '/') then 'folder_name' end as source from s""",
    "file_record": r"""with s as (select id, file_path as p, string_split(file_path, '/') as f from samples where file_path is not null), c as (select id, coalesce(nullif(case when len(f) > 1 then f[-2] end, ''), regexp_replace(f[-1], '(.)\.[^.]*$', '\1')) as c from s) select id, c as class_name, c as class_path from c""",
    "manifest_import": """with s as (select dataset_id, id, case when id % 4 = 0 then 'test' else 'train' end as split from samples where dataset_id is not null and id is not null and id % 9 <> 0), h as (select distinct dataset_id from s where split = 'train')
        select dataset_id as source, 'f' || id as relative_path, 'class_' || (id % 5) as class_name, case when id % 3 = 0 then 'b' end as second, split, case when split = 'test' and dataset_id in (select dataset_id from h) then 'test' else 'train' end as role from s""",
    "labeled_datasets": """with s as (select dataset_id as dataset, id, case when id % 2 = 0 then 9 else id % 5 end as class_id, case when id % 2 = 0 then 'test_class' else 'class_' || (id % 5) end as class_name from samples where dataset_id is not null and id is not null),
        m as (select distinct dataset, class_id, class_name from s), m2 as (select dataset, string_agg(class_id || ':' || class_name, ',' order by class_id) as class_map from m group by 1), c as (select dataset, class_name, count(*) as n from s group by 1, 2)
        select dataset, sum(n)::bigint as samples, any_value(class_map) as class_map, string_agg(class_name || ':' || n, ',' order by class_name) as class_distribution from c join m2 using (dataset) group by 1""",
    "project_import": f"""with s as (select id, 'd' || (id % 6) as dataset, id % 6 in (1, 3, 5) and id % 4 = 1 as tested, case when id % 3 = 0 then '/p/code/big/a' else '/p/data/tire/b' end || id || '.jpg' as path, case when id % 3 = 0 then 'big' else 'tire' end as class_name, (id % 5)::int as class_id from samples where id is not null and id % 3 <> 2),
        h as (select distinct dataset from s where tested), r as (select *, row_number() over (partition by dataset order by class_name, path) as k, count(*) over (partition by dataset) as n from s)
        select dataset, path, case when dataset in (select dataset from h) then case when tested then 'test' else 'train' end else {_SPLIT} end as split, class_id, class_name from r""",
    "labelled_images": rf"""with s as (select file_path, {_READ} as j from samples where coalesce(file_path, '') <> '' and lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) in ('.jpg', '.jpeg', '.png', '.bmp', '.gif', '.webp', '.tif', '.tiff')),
        l as (select file_path, case when json_type(j) = 'OBJECT' then j when json_type(j) = 'ARRAY' then j->0 end as r from s), p as (select file_path, coalesce(nullif(r->>'$.class_name', ''), nullif(r->>'$.name', ''), nullif(r->>'$.label', '')) as label from l)
        select label, count(*)::bigint as n, count(distinct file_path)::bigint as paths from p where label is not null group by 1""",
    "eval_results": f"with {_RESULTS} select task_id, n::bigint as n, model_name, metrics_json, summary, '[]' as artifacts_json from r",
    "eval_reports": f"with {_RESULTS} select task_id, count(*)::bigint as items, min(model_name) filter (where n = 0) as first, min(model_name) filter (where n = 1) as second from r group by 1",
    "preview_random": """with b as (select dataset_id, count(*) as c from samples where dataset_id is not null group by 1 order by c desc, dataset_id limit 1), n as (select count(*) as n from samples where dataset_id = (select dataset_id from b) and status = 'raw')
        select least(n, 200)::bigint as shown, least(n, 200)::bigint as different, least(n, 200)::bigint as of_it, n::bigint as total from n""",
    "system_stats_legacy": "select (select count(*) from datasets)::bigint as total_datasets, count(*)::bigint as total_samples, count(*) filter (where status in ('processed', 'cleaned', 'enhanced'))::bigint as processed_samples, (select coalesce(sum(size_bytes), 0) from datasets)::bigint as total_size from samples",
}
