"""Stages and mechanisms: what a request chain is made of, and how users add to it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.params import UNSET, parse_age, parse_rate
from tidegauge.operators.filters import allow_sensors, filter_age, filter_threshold
from tidegauge.operators.rates import rate_limit
from tidegauge.schema import Compat

Build = Callable[[DataFrame, Mapping[str, str]], DataFrame]


@dataclass(frozen=True)
class StageParam:
    name: str
    kind: str = "String"
    default: str | None = None
    customizable: bool = True


@dataclass(frozen=True)
class Stage:
    """Observations in, observations out: ``build(df, params)`` with text parameters."""

    stage_id: str
    name: str
    build: Build
    params: tuple[StageParam, ...] = ()
    adaptable: bool = False
    operators: tuple[str, ...] = ("NONE",)
    builtin: bool = False

    def defaults(self) -> dict[str, str]:
        return {p.name: p.default for p in self.params if p.default is not None}

    def customizable(self) -> list[str]:
        return [p.name for p in self.params if p.customizable]


@dataclass
class StageSettings:
    """Parameter values of one use of a stage."""

    stage: Stage
    values: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.values = {**self.stage.defaults(), **self.values}

    def set_param(self, name: str, value: str) -> bool:
        """Set a parameter only if it is declared customizable; else change nothing."""
        if name not in self.stage.customizable():
            return False
        self.values[name] = value
        return True

    def reset(self) -> None:
        self.values = self.stage.defaults()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.transform(self.stage.build, self.values)


@dataclass(frozen=True)
class Mechanism:
    """A stateful step in its two forms, which give equal rows on ordered input."""

    name: str
    batch: Callable[..., DataFrame]
    streaming: Callable[..., DataFrame] | None = None

    def __call__(self, df: DataFrame, **options) -> DataFrame:
        if not df.isStreaming:
            return self.batch(df, **options)
        if self.streaming is None:
            raise ValueError(f"mechanism {self.name!r} has no streaming form")
        return self.streaming(df, **options)


def _number(text: str | None) -> float | None:
    return None if text in (None, UNSET) else float(text)


def _ingest(df: DataFrame, params: Mapping[str, str]) -> DataFrame:
    allowed = params.get("allowed_sensors")
    prefixes = [p for p in params.get("bypass_prefixes", "").split(";") if p]
    return df if allowed is None else allow_sensors(df, allowed, prefixes)


def _threshold(df: DataFrame, params: Mapping[str, str], compat: Compat = Compat()) -> DataFrame:
    return filter_threshold(df, _number(params.get("threshold_min")), _number(params.get("threshold_max")), compat)


def _throttle(df: DataFrame, params: Mapping[str, str]) -> DataFrame:
    limit = parse_rate(params.get("obsRate_max"))
    if limit is None:
        return df
    if df.isStreaming:
        from tidegauge.streaming.mechanisms import stream_rate_limit

        return stream_rate_limit(df, limit[0], limit[1])
    return rate_limit(df, limit[0], limit[1])


def _output(df: DataFrame, params: Mapping[str, str]) -> DataFrame:
    age = params.get("age_max", UNSET)
    if parse_age(age) is None:
        return df
    as_of = int(params["as_of_ms"]) if "as_of_ms" in params else F.unix_millis(F.current_timestamp())
    return filter_age(df, age, as_of)


BUILT_IN = (
    Stage(
        "ingest",
        "Sensor selection",
        _ingest,
        (StageParam("allowed_sensors", customizable=True), StageParam("bypass_prefixes", default="")),
        builtin=True,
    ),
    Stage(
        "threshold",
        "Value thresholds",
        _threshold,
        (StageParam("threshold_min", "Double", UNSET), StageParam("threshold_max", "Double", UNSET)),
        adaptable=True,
        builtin=True,
    ),
    Stage("throttle", "Rate limit", _throttle, (StageParam("obsRate_max", default=UNSET),), adaptable=True, builtin=True),
    Stage(
        "output",
        "Delivery",
        _output,
        (StageParam("age_max", default=UNSET), StageParam("interested_in", default=""), StageParam("as_of_ms")),
        builtin=True,
    ),
)


class StageRegistry:
    """Stages by id."""

    def __init__(self, stages: Sequence[Stage] = BUILT_IN):
        self._stages = {s.stage_id: s for s in stages}

    def register(
        self,
        stage_id: str,
        build: Build,
        *,
        name: str | None = None,
        params: Sequence[StageParam] = (),
        adaptable: bool = False,
        operators: Sequence[str] = ("NONE",),
    ) -> Stage:
        if "_" in stage_id:
            raise ValueError("a stage id must not contain '_', which separates it from its instance")
        stage = Stage(stage_id, name or stage_id, build, tuple(params), adaptable, tuple(operators))
        self._stages[stage_id] = stage
        return stage

    def __getitem__(self, stage_id: str) -> Stage:
        return self._stages[stage_id]

    def use(self, stage_id: str, **values: str) -> StageSettings:
        return StageSettings(self._stages[stage_id], dict(values))

    def describe(self, spark: SparkSession, include_builtin: bool = False) -> DataFrame:
        rows = [
            (s.stage_id, s.name, list(s.operators), s.adaptable, s.customizable())
            for s in sorted(self._stages.values(), key=lambda s: s.stage_id)
            if include_builtin or not s.builtin
        ]
        return spark.createDataFrame(
            rows, "stage_id string, name string, operators array<string>, adaptable boolean, customizable array<string>"
        )

    def ids(self, spark: SparkSession, include_builtin: bool = False) -> DataFrame:
        return self.describe(spark, include_builtin).select("stage_id")

    def chain(
        self,
        params: Mapping[str, str],
        custom: Sequence[StageSettings] = (),
        custom_params: Mapping[str, str] | None = None,
        compat: Compat = Compat(),
    ) -> list[StageSettings]:
        """Settings of the stages that a request with these parameters needs, in order.

        ``custom_params`` reach the stages in ``custom``, where these declare them
        customizable; ``compat`` reaches the built-in thresholds.
        """
        wanted = ["ingest"]
        if "threshold_min" in params or "threshold_max" in params:
            wanted.append("threshold")
        if "obsRate_max" in params:
            wanted.append("throttle")
        settings = [stage_defaults(self._stages[s], params) for s in wanted]
        for one in settings:
            if one.stage.build is _threshold:
                one.stage = replace(one.stage, build=partial(_threshold, compat=compat))
        own = [StageSettings(c.stage, dict(c.values)) for c in custom]
        for one in own:
            for name, value in (custom_params or {}).items():
                one.set_param(name, value)
        return [*settings, *own, stage_defaults(self._stages["output"], params)]

    def replace(self, stage: Stage, **changes) -> Stage:
        changed = replace(stage, **changes)
        self._stages[changed.stage_id] = changed
        return changed


def stage_defaults(stage: Stage, params: Mapping[str, str]) -> StageSettings:
    """Default settings with the customizable ones that a request names replaced."""
    settings = StageSettings(stage)
    for name, value in params.items():
        settings.set_param(name, value)
    return settings


def stage_settings(requests: DataFrame, defaults: Mapping[str, str], params: str = "params") -> DataFrame:
    """Column form of :func:`stage_defaults`: request_id and the merged ``settings`` map.

    Only the names in ``defaults`` are taken over from the requests.
    """
    names = [F.lit(n) for n in defaults]
    base = F.create_map(*[x for n, v in defaults.items() for x in (F.lit(n), F.lit(v))])

    def value(name: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(params), name), F.try_element_at(base, name))

    merged = F.map_from_arrays(F.array(*names), F.transform(F.array(*names), value))
    return requests.select("request_id", merged.alias("settings"))
