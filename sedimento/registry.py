"""Operators as registered, parameterised functions: validation, aliases, user operators.

A parameter has one canonical name and may be given under aliases (other names in use, also Chinese ones). An explicit 0
is a value, not a wish for the default. Operators take DataFrames and parameters and return DataFrames; functions of one
row are adapted to Arrow batches.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

KINDS = {"string": str, "int": int, "float": float, "bool": bool, "select": str}
RETIRED_KINDS = {"number": "float", "integer": "int"}


class OperatorError(Exception):
    code = "ALGORITHM_RUNTIME_ERROR"


class ValidationError(OperatorError):
    code = "VALIDATION_ERROR"


class NotFound(OperatorError):
    code = "NOT_FOUND"


class MissingDependency(OperatorError):
    code = "MISSING_DEPENDENCY"


class NoInput(OperatorError):
    code = "NO_INPUT_SAMPLES"


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: object
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    required: bool = False

    def __post_init__(self) -> None:
        kind = RETIRED_KINDS.get(self.kind, self.kind)
        if not self.name or kind not in KINDS:
            raise ValidationError(f"parameter {self.name!r} has unknown kind {self.kind!r}")
        if kind == "select" and not self.options:
            raise ValidationError(f"parameter {self.name!r} needs options")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValidationError(f"parameter {self.name!r} has an empty range")
        object.__setattr__(self, "kind", kind)

    def read(self, given: dict[str, object]) -> object:
        value = next((given[k] for k in (self.name, *self.aliases) if k in given and given[k] is not None), None)
        if value is None:
            if self.required:
                raise ValidationError(f"parameter {self.name!r} is missing")
            return self.default
        try:
            if self.kind == "bool" and isinstance(value, str):
                value = value.strip().lower() in ("1", "true", "yes", "on")
            value = KINDS[self.kind](value)
        except (TypeError, ValueError) as e:
            raise ValidationError(f"parameter {self.name!r}: {value!r} is no {self.kind}") from e
        if self.kind == "select" and value not in self.options:
            raise ValidationError(f"parameter {self.name!r}: {value!r} is none of {', '.join(self.options)}")
        if self.kind in ("int", "float") and ((self.low is not None and value < self.low) or (self.high is not None and value > self.high)):
            raise ValidationError(f"parameter {self.name!r}: {value!r} is out of range")
        return value


@dataclass(frozen=True)
class Operator:
    key: str
    category: str
    modality: str
    run: Callable[..., DataFrame]
    parameters: tuple[Parameter, ...] = ()
    enabled: bool = True


@dataclass
class Registry:
    """Operators by key; listing, switching on and off, running with validated parameters."""

    operators: dict[str, Operator] = field(default_factory=dict)

    def register(self, op: Operator, replace: bool = False) -> None:
        if op.key in self.operators and not replace:
            raise ValidationError(f"operator {op.key!r} exists")
        if not callable(op.run):
            raise ValidationError(f"operator {op.key!r} can't be called")
        names = [n for p in op.parameters for n in (p.name, *p.aliases)]
        if len(names) != len(set(names)):
            raise ValidationError(f"operator {op.key!r} has a parameter name twice")
        self.operators[op.key] = op

    def get(self, key: str) -> Operator:
        if key not in self.operators:
            raise NotFound(f"no operator {key!r}")
        return self.operators[key]

    def delete(self, key: str) -> None:
        self.get(key)
        del self.operators[key]

    def set_enabled(self, key: str, on: bool) -> None:
        op = self.get(key)
        self.operators[key] = Operator(op.key, op.category, op.modality, op.run, op.parameters, on)

    def listed(self, category: str | None = None, modality: str | None = None) -> list[Operator]:
        """Operators of a category for a modality; multimodal ones fit every modality."""
        return [o for o in self.operators.values() if (category is None or o.category == category) and (modality is None or o.modality in (modality, "multimodal"))]

    def run(self, key: str, df: DataFrame, **given: object) -> DataFrame:
        op = self.get(key)
        if not op.enabled:
            raise ValidationError(f"operator {key!r} is switched off")
        known = {n for p in op.parameters for n in (p.name, *p.aliases)}
        if unknown := sorted(set(given) - known):
            raise ValidationError(f"operator {key!r} has no parameter {', '.join(unknown)}")
        return op.run(df, **{p.name: p.read(given) for p in op.parameters})


def row_function(f: Callable[[dict], dict | None], schema: str) -> Callable[..., DataFrame]:
    """A function of one row (dict in, dict or None out) as an operator over Arrow batches."""

    def run(df: DataFrame, **params: object) -> DataFrame:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                rows = [r for x in b.to_dict("records") if (r := f({**x, **params})) is not None]
                yield pd.DataFrame(rows) if rows else pd.DataFrame({k.split()[0]: [] for k in schema.split(", ")})

        return df.mapInPandas(batches, schema)

    return run


def _user_module(path: str):
    spec = importlib.util.spec_from_file_location("user_operator", path)
    if spec is None or spec.loader is None or not path.lower().endswith(".py"):
        raise NotFound(path)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except FileNotFoundError as e:
        raise NotFound(path) from e
    except ImportError as e:
        raise MissingDependency(f"{path}: {e}") from e
    except Exception as e:
        raise OperatorError(f"{path}: {e}") from e
    return module


def load_user_operator(spark: SparkSession, path: str, name: str = "run") -> Callable:
    """The function of a user's file, shipped to the executors as well."""
    module = _user_module(path)
    if not callable(getattr(module, name, None)):
        raise ValidationError(f"{path} has no function {name}")
    spark.sparkContext.addPyFile(path)
    return getattr(module, name)


def user_parameters(path: str) -> tuple[Parameter, ...]:
    """The parameters that a user's file declares in PARAMETERS: a list of objects with name, type and default, and,
    where wanted, label, min, max, options, required and aliases. Numbers that are given as texts are read by their type."""
    declared = getattr(_user_module(path), "PARAMETERS", None)
    if not isinstance(declared, list):
        raise ValidationError(f"{path} has no list PARAMETERS")
    out = []
    for n, item in enumerate(declared):
        if not isinstance(item, dict) or (missing := [k for k in ("name", "type", "default") if k not in item]):
            raise ValidationError(f"{path}: parameter {n} lacks {', '.join(missing) if isinstance(item, dict) else 'everything'}")
        kind = str(item["type"])
        for bound in ("min", "max"):
            if kind in ("int", "float") and item.get(bound) is not None and not isinstance(item[bound], int | float):
                raise ValidationError(f"{path}: {bound} of parameter {n} is no number")
        p = Parameter(str(item["name"]), kind, item["default"], item.get("min"), item.get("max"), tuple(map(str, item.get("options") or ())), tuple(item.get("aliases") or ()), bool(item.get("required", False)))
        default = p.read({p.name: item["default"]}) if item["default"] not in (None, "") else item["default"]
        out.append(Parameter(p.name, kind, default, p.low, p.high, p.options, p.aliases, p.required))
    return tuple(out)


def register_user_operator(registry: Registry, spark: SparkSession, key: str, path: str, category: str, modality: str, schema: str) -> Operator:
    """Register the run function of a user's file, one row in and one row of the schema or none out, with its parameters."""
    op = Operator(key, category, modality, row_function(load_user_operator(spark, path), schema), user_parameters(path))
    registry.register(op)
    return op


def default_registry() -> Registry:
    """The built-in operators with their parameters, defaults, ranges and aliases."""
    from functools import partial

    from sedimento.operators import cleaning, generate, pixels, sounds, tabular, textops

    r, P = Registry(), Parameter
    r.register(Operator("duplicate_detector", "cleaning", "multimodal", cleaning.exact_duplicates))
    r.register(Operator("image_near_duplicate_detector", "cleaning", "image", cleaning.near_duplicates, (P("max_bits", "int", 10, 0, 64, aliases=("hamming_threshold",)), P("min_confidence", "float", 0.75, 0, 1), P("hash_size", "int", 8, 4, 16))))
    r.register(Operator("image_quality", "cleaning", "image", pixels.image_findings, (P("blur_below", "float", 100.0, 0, aliases=("blur_threshold",)), P("noise_above", "float", 12.0, 0, aliases=("noise_threshold",)), P("contrast_below", "float", 0.3, 0, 1))))
    r.register(Operator("audio_quality", "cleaning", "audio", sounds.audio_findings, (P("snr_threshold", "float", 18.0), P("target_peak", "float", 0.95, 0, 1), P("top_db", "float", 30.0, 0), P("silence_ratio_threshold", "float", 0.2, 0, 1))))
    r.register(Operator("text_deduplicate_line", "cleaning", "text", textops.dedup_lines))
    r.register(Operator("text_deduplicate_token", "cleaning", "text", textops.dedup_tokens))
    r.register(Operator("text_stopwords", "cleaning", "text", textops.remove_stop_words, (P("extra", "string", "", aliases=("stop_words",)),)))
    r.register(Operator("text_stemming", "cleaning", "text", textops.stem_tokens))
    r.register(Operator("text_quality", "cleaning", "text", textops.text_quality, (P("min_length", "int", 200, 0),)))
    columns = P("columns", "string", "", required=True)
    split = lambda f: lambda df, columns, **p: f(df, [c.strip() for c in columns.split(",") if c.strip()], **p)
    r.register(Operator("tabular_missing_values", "cleaning", "tabular", split(tabular.fill_missing), (columns, P("strategy", "select", "mean", options=("mean", "median", "constant", "drop"), aliases=("missing_strategy",)), P("fill_value", "float", 0.0))))
    r.register(Operator("tabular_outliers", "cleaning", "tabular", split(tabular.clip_outliers), (columns, P("method", "select", "iqr", options=("iqr", "zscore"), aliases=("outlier_method",)), P("threshold", "float", 3.0, 0, aliases=("zscore_threshold",)))))
    r.register(Operator("tabular_normalize", "cleaning", "tabular", split(tabular.normalize), (columns, P("method", "select", "minmax", options=("minmax", "zscore"), aliases=("normalization",)))))
    grow = (P("target", "int", 1, 1, aliases=("target_count",)), P("seed", "int", 0))
    r.register(Operator("copy_augmenter", "generation", "multimodal", lambda df, target, seed: generate.copies(df, target), grow))
    text = {"structure_noise": (P("strength", "float", 0.1, 0, 1, aliases=("perturbation_strength",)),), "sentence_reordering": (P("strength", "float", 0.5, 0, 1, aliases=("shuffle_strength", "shuf")), P("granularity", "select", "sentence", options=("sentence", "paragraph"), aliases=("reorder_granularity",)), P("keep_ends", "bool", True, aliases=("preserve_first_last",))),
        "vocabulary_phrase": (P("ratio", "float", 0.3, 0, 1, aliases=("替换比例",)), P("phrase", "bool", True, aliases=("是否短语级替换",))), "context_embedding": (P("mask_ratio", "float", 0.1, 0, 1),), "back_translation": (P("probability", "float", 1.0, 0, 1, aliases=("back_translate_probability", "bt_prob")), P("restructure", "float", 0.3, 0, 1, aliases=("sentence_restructure_strength", "recon"))),
        "style_controlled": (P("style", "select", "concise", options=("formal", "casual", "concise"), aliases=("style_label",)), P("strength", "float", 0.5, 0, 1, aliases=("conciseness_strength", "concise")))}
    for key, params in text.items():
        r.register(Operator(f"{key}_text_augmenter", "generation", "text", partial(lambda df, key, **p: generate.augment_text(df, operator=key, **p), key=key), grow + params))
    for names, modality, run in ((pixels.AUGMENTATIONS, "image", pixels.augment_images), (sounds.AUGMENTATIONS, "audio", sounds.augment_audio)):
        for key, f in names.items():
            r.register(Operator(f"{key}_{modality}_augmenter", "generation", modality, partial(lambda df, key, run, **p: run(df, operator=key, **p), key=key, run=run), grow + _of(f)))
    return r


#: Other names under which parameters are given.
ALIASES = {
    "rotation_degrees": ("angle",), "strength": ("风格强度",), "pca_jitter": ("pca_strength",), "sharpen_strength": ("sharp_strength",), "sharpen_amount": ("sharp_amount",), "occlusion_type": ("mode",), "erase_count": ("cutout_count",), "fog_intensity": ("fog",), "snow_intensity": ("snow",),
    "shadow_intensity": ("shadow",), "elastic_gaussian_kernel": ("elastic_sigma",), "distortion_k1": ("k1",), "distortion_k2": ("k2",), "shot_noise": ("shot_strength",), "shuffle": ("do_shuffle",), "patch_size": ("ps",), "noise_intensity": ("noise_level",), "time_stretch": ("rate_factor", "时间拉伸速率"),
    "n_steps": ("pitch_shift_semitones", "音高半音偏移"), "volume_scale": ("gain",), "mute_probability": ("sil_prob",), "mute_count": ("sil_times",), "min_sec": ("sil_min",), "max_sec": ("sil_max",), "operation": ("op",), "shift_sec": ("max_shift",), "concat_segments": ("concat_parts",), "reverse_probability": ("rev_prob",),
    "target_channel": ("target_ch",), "mix_strategy": ("mix_strat",), "dither": ("jitter",), "swap_probability": ("swap_prob",), "freq_mask_param": ("freq_mask",), "time_mask_param": ("time_mask",), "filter_type": ("ft",), "low_cutoff_hz": ("low_hz",), "high_cutoff_hz": ("high_hz",), "probability": ("echo_prob", "reverb_prob"),
    "count": ("num_echoes",), "decay": ("echo_decay",), "tau": ("reverb_tau",), "downsample_ratio": ("ds_ratio",), "quantize_bits": ("bits",), "distortion_drive": ("drive",), "combination_count": ("combo",), "include_specaugment": ("inc_spec",), "include_spatial": ("inc_spatial",),
}


def _of(f: Callable) -> tuple[Parameter, ...]:
    """Parameters of an augmentation from its signature."""
    import inspect

    kind = {bool: "bool", int: "float", float: "float", str: "string"}
    out = []
    for p in inspect.signature(f).parameters.values():
        if p.default is not inspect.Parameter.empty:
            k = "int" if p.annotation == "int" else kind[type(p.default)]
            out.append(Parameter(p.name, k, p.default, aliases=ALIASES.get(p.name, ())))
    return tuple(out)
