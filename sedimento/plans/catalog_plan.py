"""Catalog queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.functions import text as T
from sedimento.operators import catalog as C
from sedimento.session import table

NOW = "2025-01-31 00:00:00"


def page_datasets(spark: SparkSession, d: str) -> DataFrame:
    x = C.active_datasets(table(spark, d, "datasets"))
    return C.page(x.select("id", "name", "status", "created_at"), 2, 20, *C.newest()).select("id", "name", "status", F.lit(x.count()).alias("total"))


def page_samples(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "samples").where("dataset_id = 4 and status = 'raw'").select("id", "name", "status", "created_at")
    return C.page(x, 2, 50, *C.newest()).select("id", "name", "status")


def preview_samples(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "samples").where("dataset_id = 4").select("id", "name", "created_at")
    return C.page(x, 1, 12, *C.newest()).select("id", "name")


def recent_topk(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "task_logs").where("log_level = 'error'").select("id", "task_id", "message", "created_at").distinct()
    return C.page(x, 1, 100, *C.newest()).select("id", "task_id", "message")


def page_task_logs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "task_logs").select("id", "task_id", "log_level", "message", "created_at").distinct()
    return C.page(x, 3, 100, F.col("created_at").asc_nulls_last(), F.col("id")).select("id", "task_id", "log_level", "message")


def page_tasks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "tasks").where("task_type = 'cleaning'").select("id", "title", "status", "source_dataset_id", "target_dataset_id", "created_at")
    return C.with_names(C.page(x, 1, 50, *C.newest()), table(spark, d, "datasets")).select("id", "title", "status", "source_dataset_name", "target_dataset_name")


def task_payload(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "tasks").select("id", "title", "status", "source_dataset_id", "target_dataset_id")
    return C.with_names(x, table(spark, d, "datasets")).select("id", "title", "status", "source_dataset_name", "target_dataset_name")


def dataset_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks counted for each dataset they read, by type and status."""
    x = table(spark, d, "tasks").where("source_dataset_id is not null")
    return x.groupBy(F.col("source_dataset_id").alias("dataset_id"), "task_type", "status").agg(F.count("*").alias("n"))


def page_suggestions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "cleaning_suggestions").where("status = 'pending'").select("id", "task_id", "sample_id", "issue_type").distinct()
    return C.page(x, 2, 100, F.col("id"), F.col("task_id"), F.col("sample_id"), F.col("issue_type"))


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    return C.directory(table(spark, d, "samples"))


def preview_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("id", C.preview_kind(F.col("extension"), F.col("mime_type"), F.col("modality")).alias("kind"))


def modality_guess(spark: SparkSession, d: str) -> DataFrame:
    """From the mime type's prefix, else the extension."""
    s = table(spark, d, "samples")
    e, m = F.lower("extension"), F.lower(F.coalesce("mime_type", F.lit("")))
    rule = lambda kind, ext: m.startswith(f"{kind}/") | e.isin(*ext)
    return s.select("id", F.when(rule("image", C.IMAGE_EXT), "image").when(rule("audio", C.AUDIO_EXT), "audio").when(rule("text", C.TEXT_EXT), "text").otherwise("other").alias("guess"))


def modality_infer(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent guess of each dataset; the one that sorts first wins a tie."""
    guess = modality_guess(spark, d).join(table(spark, d, "samples").select("id", "dataset_id"), "id")
    per = guess.groupBy("dataset_id", "guess").agg(F.count("*").alias("n"))
    return per.groupBy("dataset_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "guess"))["guess"].alias("modality"))


def modality_any(spark: SparkSession, d: str) -> DataFrame:
    """By the extensions that occur in a dataset: image before text before audio."""
    has = lambda ext: F.max(F.lower("extension").isin(*ext))
    x = table(spark, d, "samples").groupBy("dataset_id").agg(has(C.IMAGE_EXT).alias("i"), has(C.TEXT_EXT).alias("t"), has(C.AUDIO_EXT).alias("a"))
    return x.select("dataset_id", F.when(F.col("i"), "image").when(F.col("t"), "text").when(F.col("a"), "audio").otherwise("other").alias("modality"))


def search_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.search(table(spark, d, "datasets"), "Reshoot", "image").select("id", "name", "stage")


def stage_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.search(table(spark, d, "datasets"), at_stage="cleaned").select("id", "name")


def dataset_stage(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "datasets")
    s = lambda *name: C.stage(F.col("status"), F.col("tags"), F.col("is_deleted"), *name)
    return x.select("id", s().alias("stage"), s(F.col("name")).alias("stage_with_test"))


def human_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").select("id", T.human_size(F.col("size_bytes")).alias("size"))


def algo_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "algorithms").where("category = 'cleaning' and modality in ('image', 'multimodal') and status = 'enabled'")
    return x.select("id", "algo_key", "modality")


def group_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Algorithms of each modality, in the fixed order of modalities."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in C.MODALITY_ORDER]), F.col("modality")), F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))
    x = table(spark, d, "algorithms").groupBy("modality").agg(F.array_join(F.array_sort(F.collect_list("algo_key")), ",").alias("keys"), F.count("*").alias("n"))
    return x.select("modality", rank.alias("rank"), "keys", "n")


def decision_bucket(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "cleaning_suggestions")
    return x.groupBy(C.operation(F.col("suggested_action")).alias("operation"), "status").agg(F.count("*").alias("n"))


def scenario_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "algorithms").where("status <> 'retired' and category = 'evaluation'")
    return x.groupBy("modality").agg(F.count("*").alias("n"))


def count_by_modality(spark: SparkSession, d: str) -> DataFrame:
    return C.count_by_modality(table(spark, d, "samples"), table(spark, d, "datasets"))


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Modalities with their share of all active samples, in per cent (0 if there are none)."""
    x = C.count_by_modality(table(spark, d, "samples"), table(spark, d, "datasets"))
    total = x.agg(F.sum("n")).first()[0] or 0
    return x.select("modality", "n", (F.lit(100.0) * F.col("n") / F.lit(float(total))).alias("percent"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.dataset_stats(table(spark, d, "samples"))


def dataset_stats_active(spark: SparkSession, d: str) -> DataFrame:
    known = C.active_datasets(table(spark, d, "datasets")).select(F.col("id").alias("dataset_id"), "name", F.coalesce("total_samples", F.lit(0)).cast("bigint").alias("stored_total"))
    x = known.join(C.dataset_stats(table(spark, d, "samples")).drop("breakdown"), "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select("dataset_id", "name", "stored_total", zero("total"), zero("size_bytes"), F.when(F.coalesce("processed", F.lit(0)) > 0, "processed").otherwise("created").alias("state"))


def system_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.system_stats(table(spark, d, "samples"), table(spark, d, "datasets"))


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.class_distribution(table(spark, d, "samples"))


def class_map(spark: SparkSession, d: str) -> DataFrame:
    return C.class_map(table(spark, d, "samples"))


def class_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.class_ids(C.class_distribution(table(spark, d, "samples")))


def growth_day(spark: SparkSession, d: str) -> DataFrame:
    return C.growth_trend(table(spark, d, "samples"), NOW, 1, "1 hour", "HH:00")


def growth_week(spark: SparkSession, d: str) -> DataFrame:
    return C.growth_trend(table(spark, d, "samples"), NOW, 7, "1 day", "MM-dd")


def growth_month(spark: SparkSession, d: str) -> DataFrame:
    return C.growth_trend(table(spark, d, "samples"), NOW, 30, "1 day", "MM-dd")


def growth_year(spark: SparkSession, d: str) -> DataFrame:
    return C.growth_trend(table(spark, d, "samples"), NOW, 365, "30 days", "yyyy-MM")


def suggestion_payload(spark: SparkSession, d: str) -> DataFrame:
    return C.suggestion_payload(table(spark, d, "cleaning_suggestions"), table(spark, d, "samples"))


def output_payload(spark: SparkSession, d: str) -> DataFrame:
    """Generated samples with the sample they were made from."""
    s = table(spark, d, "samples")
    made = s.where("status = 'generated'").select("id", "name", "source_sample_id")
    return made.join(s.select(F.col("id").alias("source_sample_id"), F.col("name").alias("source_name"), F.col("status").alias("source_status")), "source_sample_id", "left")


def mime_map(spark: SparkSession, d: str) -> DataFrame:
    """Recorded mime types that disagree with the extension's, and how often."""
    from sedimento.sources.files import MIME

    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    x = table(spark, d, "samples").select(F.lower("extension").alias("extension"), "mime_type", F.coalesce(known[F.lower("extension")], F.lit("application/octet-stream")).alias("expected"))
    return x.where("mime_type is null or mime_type <> expected").groupBy("extension", "mime_type", "expected").agg(F.count("*").alias("n"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        page_datasets, page_samples, preview_samples, recent_topk, page_task_logs, page_tasks, task_payload, dataset_tasks, page_suggestions, directory_listing, preview_kind, modality_guess, modality_infer, modality_any,
        search_filter, stage_filter, dataset_stage, human_size, algo_filter, group_ordered, decision_bucket, scenario_filter, count_by_modality, type_distribution, dataset_stats, dataset_stats_active,
        system_stats, class_distribution, class_map, class_ids, growth_day, growth_week, growth_month, growth_year, suggestion_payload, output_payload, mime_map, content_hash,
    )
}

_q = lambda words: ", ".join(f"'{w}'" for w in words)
_MOD = "case lower(trim({0}))" + "".join(f" when '{k}' then '{v}'" for k, v in reading.MODALITY_ALIASES.items()) + " else lower(trim({0})) end"
_STAGE = """case when coalesce(is_deleted, false) or lower(status) = 'deleted' then 'deleted' when lower(status) = 'cleaned' or list_contains(tags, 'cleaned') then 'cleaned'
    when lower(status) = 'generated' or list_contains(tags, 'generated') then 'generated' {0} when lower(status) = 'raw' or list_contains(tags, 'raw') then 'raw' else coalesce(lower(status), 'raw') end"""
_TEST = "when lower(status) = 'test' or list_contains(tags, 'test') or contains(lower(name), 'test') then 'test'"
_ACTIVE = "(status is null or status <> 'deleted')"
_KIND = f"""case when lower(coalesce(extension, '')) in ({_q(C.IMAGE_EXT)}) or starts_with(lower(coalesce(mime_type, '')), 'image/') then 'image'
    when lower(coalesce(extension, '')) in ({_q(C.AUDIO_EXT)}) or starts_with(lower(coalesce(mime_type, '')), 'audio/') then 'audio'
    when lower(coalesce(extension, '')) in ({_q(C.TEXT_EXT)}) or starts_with(lower(coalesce(mime_type, '')), 'text/') then 'text'"""
_OP = "case when lower(trim(coalesce(suggested_action, ''))) = '' then 'review'" + "".join(f" when lower(trim(suggested_action)) in ({_q(w)}) then '{b}'" for b, w in C.OPERATIONS.items()) + " else lower(trim(suggested_action)) end"
#: Label records of samples: id, i (position from 1), r (JSON); the reading rules of the catalog.
LABELS_SQL = """
    lt as (select id, status, case when json_valid(labels_json) then case when json_type(labels_json) = 'VARCHAR' then case when json_valid(json_extract_string(labels_json, '$')) then json_extract_string(labels_json, '$')::json end else labels_json::json end end as j from samples),
    la as (select id, status, case json_type(j) when 'ARRAY' then from_json(j, '["JSON"]') when 'OBJECT' then [j] end as a from lt),
    lr as (select id, status, unnest(a) as r, generate_subscripts(a, 1) as i from la)"""
_FILLED = lambda c: f"(trim(lower({c})) not in ('', 'n/a', 'unknown', '-', '[]', '{{}}'))"
_WORD = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '[\\s_\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_PICK = "coalesce(" + ", ".join(f"case when {_FILLED(f'''r->>'$.{k}' ''')} then {_WORD(f'''r->>'$.{k}' ''')} end" for k in ("class_name", "name", "label")) + ")"
_GROWTH = lambda days, step, label: f"""
    with e as (select unnest(generate_series(timestamptz '{NOW}+00' - interval {days} days, timestamptz '{NOW}+00', interval {step})) as t)
    select (row_number() over (order by t) - 1)::int as bucket, strftime(t, '{label}') as label,
        (select count(*) from samples where created_at >= timestamptz '{NOW}+00' - interval {days} days and created_at <= e.t)::bigint as n from e"""  # noqa: E731
_STATS = f"""
    pm as (select dataset_id, {_MOD.format("modality")} as m, count(*) as n, coalesce(sum(size_bytes), 0) as b, count(*) filter (where status in ('processed', 'cleaned', 'enhanced')) as p from samples where {_ACTIVE} group by 1, 2),
    st as (select dataset_id, sum(n)::bigint as total, sum(b)::bigint as size_bytes, sum(p)::bigint as processed, string_agg(m || '=' || n, ',' order by m) as breakdown from pm group by 1)"""


def _mime_sql() -> str:
    from sedimento.sources.files import MIME

    cases = " ".join(f"when '{k}' then '{v}'" for k, v in MIME.items())
    return f"""with x as (select lower(extension) as extension, mime_type, case lower(extension) {cases} else 'application/octet-stream' end as expected from samples)
        select extension, mime_type, expected, count(*)::bigint as n from x where mime_type is null or mime_type <> expected group by 1, 2, 3"""


SQL = {
    "page_datasets": "select id, name, status, (select count(*) from datasets where not coalesce(is_deleted, false))::int as total from datasets where not coalesce(is_deleted, false) order by created_at desc nulls last, id desc limit 20 offset 20",
    "page_samples": "select id, name, status from samples where dataset_id = 4 and status = 'raw' order by created_at desc nulls last, id desc limit 50 offset 50",
    "preview_samples": "select id, name from samples where dataset_id = 4 order by created_at desc nulls last, id desc limit 12",
    "recent_topk": "select id, task_id, message from (select distinct id, task_id, message, created_at from task_logs where log_level = 'error') order by created_at desc nulls last, id desc limit 100",
    "page_task_logs": "select id, task_id, log_level, message from (select distinct id, task_id, log_level, message, created_at from task_logs) order by created_at nulls last, id limit 100 offset 200",
    "page_tasks": """with p as (select * from tasks where task_type = 'cleaning' order by created_at desc nulls last, id desc limit 50)
        select p.id, title, p.status, s.name as source_dataset_name, t.name as target_dataset_name from p left join datasets s on s.id = source_dataset_id left join datasets t on t.id = target_dataset_id""",
    "task_payload": "select p.id, title, p.status, s.name as source_dataset_name, t.name as target_dataset_name from tasks p left join datasets s on s.id = source_dataset_id left join datasets t on t.id = target_dataset_id",
    "dataset_tasks": "select source_dataset_id as dataset_id, task_type, status, count(*)::bigint as n from tasks where source_dataset_id is not null group by 1, 2, 3",
    "page_suggestions": "select distinct id, task_id, sample_id, issue_type from cleaning_suggestions where status = 'pending' order by id, task_id, sample_id, issue_type limit 100 offset 100",
    "directory_listing": r"""with x as (select dataset_id, replace(coalesce(relative_path, name), '\', '/') as p from samples)
        select distinct dataset_id, case when contains(p, '/') then 'folder' else 'file' end as kind, split_part(p, '/', 1) as name from x where p is not null""",
    "preview_kind": f"select id, {_KIND} when modality in ('image', 'audio', 'text') then modality else 'file' end as kind from samples",
    "modality_guess": f"select id, {_KIND} else 'other' end as guess from samples",
    "modality_infer": f"with g as (select dataset_id, {_KIND} else 'other' end as guess from samples), c as (select dataset_id, guess, count(*) as n from g group by 1, 2) select dataset_id, arg_min(guess, (-n, guess)) as modality from c group by 1",
    "modality_any": f"""with x as (select dataset_id, max(lower(extension) in ({_q(C.IMAGE_EXT)})) as i, max(lower(extension) in ({_q(C.TEXT_EXT)})) as t, max(lower(extension) in ({_q(C.AUDIO_EXT)})) as a from samples group by 1)
        select dataset_id, case when i then 'image' when t then 'text' when a then 'audio' else 'other' end as modality from x""",
    "search_filter": f"select id, name, {_STAGE.format('')} as stage from datasets where not coalesce(is_deleted, false) and contains(lower(name), 'reshoot') and {_MOD.format('modality')} = 'image'",
    "stage_filter": f"select id, name from datasets where not coalesce(is_deleted, false) and {_STAGE.format('')} = 'cleaned'",
    "dataset_stage": f"select id, {_STAGE.format('')} as stage, {_STAGE.format(_TEST)} as stage_with_test from datasets",
    "human_size": """select id, case when size_bytes is null then '0 B' when size_bytes < 1024 then size_bytes || ' B' when size_bytes < 1048576 then printf('%.1f KB', size_bytes / 1024.0::double)
        when size_bytes < 1073741824 then printf('%.1f MB', size_bytes / 1048576.0::double) else printf('%.1f GB', size_bytes / 1073741824.0::double) end as size from datasets""",
    "algo_filter": "select id, algo_key, modality from algorithms where category = 'cleaning' and modality in ('image', 'multimodal') and status = 'enabled'",
    "group_ordered": f"select modality, case modality {' '.join(f'''when '{m}' then {i + 1}''' for i, m in enumerate(C.MODALITY_ORDER))} else 99 end::bigint as rank, string_agg(algo_key, ',' order by algo_key) as keys, count(*)::bigint as n from algorithms group by modality",
    "decision_bucket": f"select {_OP} as operation, status, count(*)::bigint as n from cleaning_suggestions group by 1, 2",
    "scenario_filter": "select modality, count(*)::bigint as n from algorithms where status <> 'retired' and category = 'evaluation' group by 1",
    "count_by_modality": f"select {_MOD.format('s.modality')} as modality, count(*)::bigint as n from samples s join datasets d on d.id = s.dataset_id where (s.status is null or s.status <> 'deleted') and not coalesce(d.is_deleted, false) group by 1",
    "type_distribution": f"""with c as (select {_MOD.format('s.modality')} as modality, count(*)::bigint as n from samples s join datasets d on d.id = s.dataset_id where (s.status is null or s.status <> 'deleted') and not coalesce(d.is_deleted, false) group by 1)
        select modality, n, 100.0::double * n / (select sum(n) from c)::double as percent from c""",
    "dataset_stats": f"with {_STATS} select dataset_id, total, total as valid, size_bytes, processed, breakdown from st",
    "dataset_stats_active": f"""with {_STATS} select d.id as dataset_id, name, coalesce(total_samples, 0)::bigint as stored_total, coalesce(total, 0)::bigint as total, coalesce(st.size_bytes, 0)::bigint as size_bytes,
        case when coalesce(processed, 0) > 0 then 'processed' else 'created' end as state from datasets d left join st on st.dataset_id = d.id where not coalesce(is_deleted, false)""",
    "system_stats": f"""with {_STATS} select (select count(*) from datasets where not coalesce(is_deleted, false))::int as datasets, coalesce(sum(total), 0)::bigint as samples, coalesce(sum(st.size_bytes), 0)::bigint as size_bytes, coalesce(sum(processed), 0)::bigint as processed
        from st join datasets d on d.id = st.dataset_id and not coalesce(d.is_deleted, false)""",
    "class_distribution": f"with {LABELS_SQL} select coalesce({_PICK}, 'unknown') as class_name, count(*)::bigint as n from lr where {_ACTIVE} and r->>'$.type' = 'classification' group by 1",
    "class_map": f"""with {LABELS_SQL}, x as (select try_cast(r->>'$.class_id' as int) as class_id, case when {_FILLED("r->>'$.class_name'")} then {_WORD("r->>'$.class_name'")} end as class_name from lr where r->>'$.type' = 'classification')
        select class_id, max(class_name) as class_name from x where class_id is not null and class_name is not null group by 1""",
    "class_ids": f"""with {LABELS_SQL}, x as (select distinct coalesce({_PICK}, 'unknown') as class_name from lr where {_ACTIVE} and r->>'$.type' = 'classification')
        select class_name, (row_number() over (order by class_name) - 1)::int as class_id from x""",
    "growth_day": _GROWTH(1, "1 hour", "%H:00"),
    "growth_week": _GROWTH(7, "1 day", "%m-%d"),
    "growth_month": _GROWTH(30, "1 day", "%m-%d"),
    "growth_year": _GROWTH(365, "30 days", "%Y-%m"),
    "suggestion_payload": f"""select c.id, c.task_id, c.sample_id, issue_type, suggested_action, c.status, confidence, c.output_sample_id, s.name as sample_name, s.modality as sample_type, o.name as output_sample_name, {_OP} as operation
        from cleaning_suggestions c left join samples s on s.id = c.sample_id left join samples o on o.id = c.output_sample_id""",
    "output_payload": "select m.id, m.name, m.source_sample_id, s.name as source_name, s.status as source_status from samples m left join samples s on s.id = m.source_sample_id where m.status = 'generated'",
    "content_hash": "select doc_id, sha256(text) as sha256, strlen(text)::bigint as size_bytes from documents",
    "mime_map": _mime_sql(),
}
