"""Queries of image, sound and file operators, and their SQL.

No table holds media, so small ones are made of the rows of `embeddings`: gray pictures of 8 x 8, colour ones of 7 x 3,
flat ones of one colour, and sounds of 64 frames, as bytes of real files; every 17th has no content and every 19th is cut
off. The SQL works on the numbers that the bytes were made of.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.operators import cleaning, pixels, sounds, train
from sedimento.session import table
from sedimento.sources import imports
from sedimento.sources.files import decode_text

PGM, PPM = "P5\n8 8\n255\n".encode().hex(), "P6\n7 3\n255\n".encode().hex()
WAV = "52494646a400000057415645666d74201000000001000100401f0000803e0000020010006461746180000000"  # one channel, 8,000 Hz, 16 bits, 128 bytes
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "samples", "datasets", "tasks")


def _byte(v: Column) -> Column:
    return F.lpad(F.hex(F.pmod(F.floor(F.abs(v.cast("double")) * 1000), F.lit(256))), 2, "0")


def _word(v: Column) -> Column:
    h = F.lpad(F.hex(F.pmod(F.floor(v.cast("double") * 10_000), F.lit(65536))), 4, "0")
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def _files(spark: SparkSession, d: str, head: str, values: Column) -> DataFrame:
    """id, content; some without content, some cut off."""
    whole = F.unhex(F.concat(F.lit(head), F.array_join(values, "")))
    content = F.when(F.col("vec_id") % 17 == 0, F.lit(None)).when(F.col("vec_id") % 19 == 0, F.unhex(F.lit(head))).otherwise(whole)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), content.alias("content"))


def gray(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, PGM, F.transform("embedding", _byte))


def colour(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, PPM, F.transform(F.slice("embedding", 1, 63), _byte))


def flat(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, PGM, F.array_repeat(_byte(F.element_at("embedding", 1)), 64))


def sound(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, WAV, F.transform("embedding", _word))


def _grown(files: DataFrame, run, operator: str, **params: object) -> DataFrame:
    return run(files, files.count(), operator, seed=7, **params)


def _pixels(source, operator: str, spark: SparkSession, d: str, **params: object) -> DataFrame:
    x = _grown(source(spark, d), pixels.augment_images, operator, **params).select(F.col("source_sample_id").alias("id"), "content")
    return pixels.pixel_rows(x)


def _repaired(repair: str, spark: SparkSession, d: str) -> DataFrame:
    return pixels.pixel_rows(pixels.repair_images(flat(spark, d), repair))


def _picture_shapes(operator: str, spark: SparkSession, d: str, **params: object) -> DataFrame:
    made = _grown(colour(spark, d), pixels.augment_images, operator, **params)
    return pixels.image_shapes(made, "i").join(made.select("i", "source_sample_id"), "i")


def img_read(spark: SparkSession, d: str) -> DataFrame:
    return pixels.pixel_rows(gray(spark, d))


def img_channel_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Channels may stand in any order: the sorted values of every pixel."""
    x = _pixels(colour, "channel_shuffle", spark, d)
    v = F.array_sort(F.collect_list("value"))
    return x.groupBy("id", "y", "x").agg(v.alias("v")).select("id", "y", "x", *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(3)])


def img_hashes(spark: SparkSession, d: str) -> DataFrame:
    return pixels.image_hashes(gray(spark, d))


def img_findings(spark: SparkSession, d: str) -> DataFrame:
    return pixels.image_findings(gray(spark, d), noise_above=70.0, contrast_below=0.995)


def _twice(files: DataFrame) -> DataFrame:
    return files.unionByName(files.withColumn("id", F.col("id") + 1_000_000))


def near_images(spark: SparkSession, d: str) -> DataFrame:
    """Every picture comes twice: copies are found from the bytes, by difference hashes."""
    x = cleaning.near_duplicates(_twice(gray(spark, d)), max_bits=0)
    return x.select("sample_id", "issue_type", "confidence", F.col("related_id").alias("duplicate_of"))


def ahash_images(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.average_hash_duplicates(_twice(gray(spark, d)), 0).select("id", "leader_id", "bits")


def _sounds(operator: str, spark: SparkSession, d: str, **params: object) -> DataFrame:
    x = _grown(sound(spark, d), sounds.augment_audio, operator, **params).select(F.col("source_sample_id").alias("id"), "content")
    return sounds.sound_rows(x)


def _sound_shapes(operator: str, spark: SparkSession, d: str, **params: object) -> DataFrame:
    made = _grown(sound(spark, d), sounds.augment_audio, operator, **params)
    return sounds.sound_shapes(made, "i").join(made.select("i", "source_sample_id"), "i")


def wav_read(spark: SparkSession, d: str) -> DataFrame:
    return sounds.sound_rows(sound(spark, d))


def wav_normalize(spark: SparkSession, d: str) -> DataFrame:
    return sounds.sound_rows(sounds.repair_audio(sound(spark, d), "normalize"))


def _mended(repair: str, spark: SparkSession, d: str) -> DataFrame:
    return sounds.sound_shapes(sounds.repair_audio(sound(spark, d), repair))


def wav_level(spark: SparkSession, d: str) -> DataFrame:
    return sounds.audio_findings(sound(spark, d)).where("issue_type in ('audio_level', 'invalid_audio')")


def valid_files(spark: SparkSession, d: str) -> DataFrame:
    """id, valid: pictures, sounds and texts by their type; empty files aren't valid, other types are."""
    g, s = gray(spark, d), sound(spark, d)
    ok = lambda x, good: x.select("id").join(good.select("id").distinct().withColumn("valid", F.lit(True)), "id", "left")
    a = ok(g, pixels.image_shapes(g).where("width is not null")).withColumn("kind", F.lit("image"))
    b = ok(s, sounds.sound_shapes(s)).withColumn("kind", F.lit("audio"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) > 0).alias("valid"), F.lit("text").alias("kind"))
    return a.unionByName(b).unionByName(t).select("kind", "id", F.coalesce("valid", F.lit(False)).alias("valid"))


def text_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every second text as UTF-8, the others as Latin-1 where they can be."""
    t = table(spark, d, "documents").where("text is not null and (doc_id % 2 = 0 or not text rlike '[^\\\\x00-\\\\xff]')")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return t.select(F.col("doc_id").alias("id"), decode_text(content).alias("text"))


def scan_samples(spark: SparkSession, d: str) -> DataFrame:
    """The files of this folder's tables and one that isn't there: what is found and what is an error."""
    paths = [f"{d}/{t}.parquet" for t in (*TABLES, "no_such_table")]
    found, missing = imports.scan_samples(spark, paths)
    a = found.select("name", "extension", "status", F.lit(None).cast("string").alias("reason"))
    name = F.element_at(F.split("path", "/"), -1)
    return a.unionByName(missing.select(name.alias("name"), F.lit(".parquet").alias("extension"), F.lit(None).cast("string").alias("status"), "reason"))


def train_forest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("label", "embedding")
    _, right = train.forest(v, trees=20, depth=6)
    return v.agg(F.count("*").alias("samples"), F.count_distinct("label").alias("classes")).withColumn("learned", F.lit(bool(right > 0.5)))


def train_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on the three parts of a 6 : 2 : 2 split, and whether it is better than the largest class would be."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    got = train.classifier(v, "vec_id", epochs=20)
    return spark.createDataFrame([(k, 0.0 <= a <= 1.0) for k, a in got.items()], "split string, measured boolean")


_IMAGES = {
    "img_flip": partial(_pixels, gray, "geometric", flip_horizontal=True, flip_vertical=True), "img_shift": partial(_pixels, gray, "geometric", translate_x_pct=25.0), "img_turn": partial(_pixels, gray, "geometric", rotation_degrees=180.0),
    "img_color_space": partial(_pixels, gray, "color_space", brightness=30.0, contrast=1.5), "img_occlusion": partial(_pixels, gray, "occlusion", occlusion_type="gridmask", area_ratio=0.25, fill_mode="zero", grid_size=4),
    "img_environment_simulation": partial(_pixels, gray, "environment_simulation", fog_intensity=0.5), "img_imaging_simulation": partial(_pixels, gray, "imaging_simulation", downsample=2.0),
    "img_deformation_distortion": partial(_pixels, flat, "deformation_distortion", elastic_strength=3.0, distortion_k1=0.1), "img_clarity": partial(_pixels, flat, "clarity", blur_strength=0.5, sharpen_strength=0.5), "img_style_transfer": partial(_pixels, flat, "style_transfer", strength=0.5),
    "img_erasing": partial(_pixels, flat, "occlusion", fill_mode="mean"), "img_vit_mae_fallback": partial(_pixels, flat, "vit_mae_fallback"), "img_wgan_gp_fallback": partial(_pixels, flat, "wgan_gp_fallback"),
    "img_deblur": partial(_repaired, "deblur"), "img_denoise": partial(_repaired, "denoise"), "img_high_pass": partial(_repaired, "high_pass"),
    "img_cross_modal_fusion": partial(_pixels, flat, "cross_modal_fusion"), "img_cross_modal_shapes": partial(_picture_shapes, "cross_modal_fusion"), "img_hue": partial(_pixels, colour, "color_space", hue=60.0), "img_diffusion_fallback": partial(_picture_shapes, "diffusion_fallback"), "img_snow": partial(_picture_shapes, "environment_simulation", snow_intensity=0.5, shadow_intensity=0.5),
}
_SOUNDS = {
    "wav_energy_amplitude": partial(_sounds, "energy_amplitude", volume_scale=0.5, mute_probability=0.0), "wav_reverse": partial(_sounds, "timeseries_structure", operation="reverse", reverse_probability=1.0), "wav_channel_config": partial(_sounds, "channel_config", target_channel="stereo", dither=0.0, swap_probability=0.0),
    "wav_quality_distortion": partial(_sounds, "quality_distortion", downsample_ratio=1.0, quantize_bits=8), "wav_spatial_acoustics": partial(_sounds, "spatial_acoustics", probability=1.0, count=1, delay=0.001, decay=0.5), "wav_filter_processing": partial(_sounds, "filter_processing", filter_type="highpass", low_cutoff_hz=1.0),
    **{f"wav_{k}": partial(_sound_shapes, k) for k in ("noise_injection", "spectrum_reconstruction", "tempo_pitch", "specaugment", "environment_noise_injection", "composite")}, "wav_crop": partial(_sound_shapes, "timeseries_structure", operation="crop"), "wav_concat": partial(_sound_shapes, "timeseries_structure", operation="concat"),
    "wav_denoise": partial(_mended, "denoise"), "wav_trim_silence": partial(_mended, "trim_silence"),
}
QUERIES = {f.__name__: f for f in (img_read, img_channel_shuffle, img_hashes, img_findings, near_images, ahash_images, wav_read, wav_normalize, wav_level, valid_files, text_decode, scan_samples, train_forest, train_classifier)} | _IMAGES | _SOUNDS

_G = "g as (select vec_id as id, list_transform(embedding, lambda v: floor(abs(v::double) * 1000)::bigint % 256) as px from embeddings where vec_id % 17 <> 0 and vec_id % 19 <> 0), c as (select k::int as k, (k // 8)::int as y, (k % 8)::int as x from range(64) t(k))"
_W = "w as (select vec_id as id, list_transform(embedding, lambda v: floor(v::double * 10000)::bigint) as s from embeddings where vec_id % 17 <> 0 and vec_id % 19 <> 0), t as (select t::int as t from range(64) r(t))"
_px = lambda value: f"with {_G} select id, y, x, 0 as channel, ({value})::int as value from g, c"
_wv = lambda value, channels="(values (0)) q(channel)": f"with {_W} select id, channel::int as channel, t, ({value})::int as value from w, t, {channels}"
_FLAT = _px("px[1]")
_SHAPES = "with e as (select row_number() over (order by vec_id) - 1 as i, vec_id as source_sample_id from embeddings) select i, source_sample_id, {} from e where source_sample_id % 17 <> 0 and source_sample_id % 19 <> 0"
_PICTURE, _SOUND = _SHAPES.format("7 as width, 3 as height, 3 as channels"), _SHAPES.format("8000 as rate, 1 as channels, 64 as frames")
_at = lambda y, x: f"px[({y}) * 8 + ({x}) + 1]"
_near = lambda v: f"(7 - abs(7 - abs({v})))"
_HEX = lambda bits: f"(select string_agg('0123456789abcdef'[b[4 * k + 1] * 8 + b[4 * k + 2] * 4 + b[4 * k + 3] * 2 + b[4 * k + 4] + 1], '' order by k) from (select {bits} as b), range(16) r(k))"
_D = "list_transform(range(64), lambda k: (px[round_even((k // 8) * 7 / 7.0, 0)::int * 8 + round_even((k % 8) * 7 / 8.0, 0)::int + 1] > px[round_even((k // 8) * 7 / 7.0, 0)::int * 8 + round_even((k % 8 + 1) * 7 / 8.0, 0)::int + 1])::int)"
_A = "list_transform(px, lambda v: (v > list_avg(px))::int)"
_H = f"h as (select id, {_D} as d, {_A} as a from g)"
_copies = lambda bits: f"with {_G}, {_H}, u as (select id, {bits} as b from h union all select id + 1000000, {bits} from h), l as (select id, min(id) over (partition by b) as l from u)"

SQL = {
    "img_read": _px("px[k + 1]"), "img_flip": _px(_at("7 - y", "7 - x")), "img_shift": _px(f"case when x >= 2 then {_at('y', 'x - 2')} else 0 end"), "img_turn": _px(f"case when y = 0 or x = 0 then 0 else {_at('8 - y', '8 - x')} end"),
    "img_color_space": _px("floor(least(255, px[k + 1] * 1.5::double + 30))"), "img_occlusion": _px("case when y % 4 < 2 and x % 4 < 2 then 0 else px[k + 1] end"),
    "img_environment_simulation": _px("round_even(px[k + 1] * exp(-(1 - y / 7.0::double)) + 200 * (1 - exp(-(1 - y / 7.0::double))), 0)"), "img_imaging_simulation": _px(_at("y // 2 * 2", "x // 2 * 2")),
    **dict.fromkeys(("img_deformation_distortion", "img_clarity", "img_erasing", "img_vit_mae_fallback", "img_wgan_gp_fallback", "img_deblur", "img_denoise", "img_high_pass"), _FLAT), "img_style_transfer": _px("round_even(px[1] * 0.5::double, 0)"),
    **dict.fromkeys(("img_cross_modal_shapes", "img_diffusion_fallback", "img_snow"), _PICTURE), "img_cross_modal_fusion": _px("floor(px[1] * 0.5::double)"),
    # A third of a turn of the hue moves every channel to the next one.
    "img_hue": f"with {_G}, q as (select k::int as k from range(63) r(k)) select id, (k // 21)::int as y, (k // 3 % 7)::int as x, (k % 3)::int as channel, px[k // 3 * 3 + (k + 2) % 3 + 1]::int as value from g, q",
    "img_channel_shuffle": f"with {_G}, q as (select k::int as k from range(21) r(k)), v as (select id, (k // 7)::int as y, (k % 7)::int as x, list_sort(px[3 * k + 1:3 * k + 3]) as v from g, q) select id, y, x, v[1]::int as v0, v[2]::int as v1, v[3]::int as v2 from v",
    "img_hashes": f"with {_G}, {_H} select id, {_HEX('d')} as dhash, {_HEX('a')} as ahash from h",
    "img_findings": f"""with {_G}, p as (select id, px, y, x, {_at(_near('y - 1'), 'x')} + {_at(_near('y + 1'), 'x')} + {_at('y', _near('x - 1'))} + {_at('y', _near('x + 1'))} - 4 * px[k + 1] as lap,
            abs(px[k + 1] - list_median(list_transform(range(9), lambda j: px[greatest(least(y + j // 3 - 1, 7), 0)::int * 8 + greatest(least(x + j % 3 - 1, 7), 0)::int + 1]))) as off from g, c),
        s as (select id, var_pop(lap) as s, avg(off) as n, (list_max(any_value(px)) - list_min(any_value(px)))::double / (list_max(any_value(px)) + list_min(any_value(px))) as c from p group by id),
        f as (select id, 'image_blur' as issue_type, 1 - s / 100 as v from s where s < 100 union all select id, 'image_noise', (n - 70) / 140 from s where n > 70 union all select id, 'low_contrast', 1 - c / 0.995 from s where c < 0.995)
        select id as sample_id, issue_type, 'repair' as suggested_action, round_even(least(1.0, greatest(0.0, v)), 4)::double as confidence from f union all select vec_id, 'invalid_image', 'delete', 1.0 from embeddings where vec_id % 17 = 0 or vec_id % 19 = 0""",
    "near_images": f"{_copies('d')} select id as sample_id, 'near_duplicate_image' as issue_type, 1.0::double as confidence, l as duplicate_of from l where id <> l",
    "ahash_images": f"{_copies('a')} select id, l as leader_id, 0 as bits from l where id <> l",
    "wav_read": _wv("s[t + 1]"), "wav_normalize": _wv("round_even((s[t + 1] / 32768.0::double) / (list_max(list_transform(s, lambda v: abs(v))) / 32768.0::double) * 0.95::double * 32767, 0)"),
    "wav_energy_amplitude": _wv("round_even(s[t + 1] / 32768.0::double * 0.5::double * 32767, 0)"), "wav_reverse": _wv("round_even(s[64 - t] / 32768.0::double * 32767, 0)"), "wav_channel_config": _wv("round_even(s[t + 1] / 32768.0::double * 32767, 0)", "(values (0), (1)) q(channel)"),
    "wav_quality_distortion": _wv("round_even((round_even((s[t + 1] / 32768.0::double + 1) / 2 * 255, 0) / 255 * 2 - 1) * 32767, 0)"), "wav_spatial_acoustics": _wv("round_even((s[t + 1] / 32768.0::double + case when t >= 8 then s[t - 7] / 32768.0::double * 0.5::double else 0 end) * 32767, 0)"),
    "wav_filter_processing": _wv("round_even((s[t + 1] - list_avg(s)) / 32768.0::double * 32767, 0)"),
    **dict.fromkeys([k for k, f in _SOUNDS.items() if f.func is _sound_shapes], _SOUND),
    **dict.fromkeys(("wav_denoise", "wav_trim_silence"), f"with {_W} select id, 8000 as rate, 1 as channels, 64 as frames from w"),
    "wav_level": f"""with {_W}, p as (select id, list_max(list_transform(s, lambda v: abs(v))) / 32768.0::double as p from w) select id as sample_id, 'audio_level' as issue_type, 'repair' as suggested_action, round_even(least(1.0, abs(p - 0.95) / 0.95), 4)::double as confidence from p where p < 0.5 or p > 0.99
        union all select vec_id, 'invalid_audio', 'delete', 1.0 from embeddings where vec_id % 17 = 0 or vec_id % 19 = 0""",
    "valid_files": """select k as kind, vec_id as id, vec_id % 17 <> 0 and vec_id % 19 <> 0 as valid from embeddings, (values ('image'), ('audio')) q(k) union all select 'text', doc_id, coalesce(text, '') <> '' from documents""",
    "text_decode": r"select doc_id as id, text from documents where text is not null and (doc_id % 2 = 0 or not regexp_matches(text, '[^\x{00}-\x{ff}]'))",
    "scan_samples": f"select t || '.parquet' as name, '.parquet' as extension, case when t <> 'no_such_table' then 'raw' end as status, case when t = 'no_such_table' then 'missing_file' end as reason from (values {', '.join(f'({t!r})' for t in (*TABLES, 'no_such_table'))}) q(t)",
    "train_forest": "select count(*)::bigint as samples, count(distinct label)::bigint as classes, true as learned from embeddings",
    "train_classifier": "select s as split, true as measured from (values ('train'), ('validation'), ('test')) q(s)",
}
