"""Stages over tables, tool and plug-in registries, and the events of a run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cues


class ToolError(ValueError):
    pass


class Registry:
    """Names to tools (tables, columns, functions); adding several is all or nothing."""

    def __init__(self) -> None:
        self.tools: dict[str, object] = {}

    def add(self, name: str, tool: object) -> None:
        self.add_many({name: tool})

    def add_many(self, tools: dict[str, object]) -> None:
        names = [n.strip() for n in tools]
        if any(not n for n in names) or len(set(names)) < len(names) or any(n in self.tools for n in names):
            raise ToolError(f"empty or taken: {names}")
        self.tools |= dict(zip(names, tools.values(), strict=True))

    def get(self, name: str, default: object = None) -> object:
        return self.tools.get(name.strip(), default)

    def resolve(self, name: str) -> object:
        if name.strip() not in self.tools:
            raise ToolError(f"unknown: {name}")
        return self.tools[name.strip()]

    def names(self) -> list[str]:
        return sorted(self.tools)


class Plugins(Registry):
    """Plug-ins are functions of the tool registry, run by ``activate``."""

    def activate(self, name: str, tools: Registry) -> list[str]:
        before = set(tools.names())
        self.resolve(name)(tools)
        return sorted(set(tools.names()) - before)

    def activate_all(self, tools: Registry) -> dict[str, list[str]]:
        return {n: self.activate(n, tools) for n in self.names()}


@dataclass
class Stage:
    name: str
    run: Callable[[DataFrame], DataFrame]
    may_be_empty: bool = False


class StageFailed(RuntimeError):
    pass


@dataclass
class Pipeline:
    """Ordered stages from table to table, checked for lost documents; planning is lazy, checks are not."""

    stages: list[Stage]
    key: str = "doc_id"
    events: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.stages or any(not s.name.strip() or not callable(s.run) for s in self.stages):
            raise ValueError("a pipeline needs named, callable stages")

    def run(self, df: DataFrame, check: bool = False) -> DataFrame:
        """With ``check``, each stage must keep every document."""
        for s in self.stages:
            began = time.time()
            self.events.append({"stage": s.name, "status": "started", "elapsed": None, "message": ""})
            try:
                new = s.run(df)
                if not isinstance(new, DataFrame):
                    raise StageFailed(f"{s.name} returned no table")
                if check and not s.may_be_empty and not df.select(self.key).join(new.select(self.key), self.key, "left_anti").isEmpty():
                    raise StageFailed(f"{s.name} lost documents")
            except Exception as e:
                self.events.append({"stage": s.name, "status": "failed", "elapsed": time.time() - began, "message": str(e)[:500]})
                raise
            self.events.append({"stage": s.name, "status": "succeeded", "elapsed": time.time() - began, "message": ""})
            df = new
        return df


def subtitle_pipeline(merge: bool = True, normalise: bool = True, strict: bool = False) -> Pipeline:
    """Nested segments to valid cues. Strict raises on any issue; else documents with issues are left out."""
    stages = [Stage("subtitle-builder", cues.build_cues)]
    if merge:
        stages.append(Stage("subtitle-merger", cues.merge_cues))
    if normalise:
        stages.append(Stage("readability-optimizer", cues.normalise_cues))

    def valid(df: DataFrame) -> DataFrame:
        bad = cues.cue_issues(df, order="index")
        if strict:
            first = bad.head(1)
            if first:
                raise StageFailed(f"{first[0]['code']} in {first[0]['doc_id']}")
            return df
        return df.join(bad.select("doc_id").distinct(), "doc_id", "left_anti")

    return Pipeline([*stages, Stage("subtitle-validator", valid, may_be_empty=True)])


def missing(documents: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without rows in a stage's table."""
    return documents.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti").withColumn("code", F.lit("missing_input"))
