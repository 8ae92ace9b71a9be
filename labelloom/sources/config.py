"""Run settings from YAML: a mapping, its relative paths resolved, and settings objects made of it."""

from __future__ import annotations

import dataclasses
from datetime import datetime
from pathlib import PurePosixPath
from typing import Any, TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """The mapping in a YAML file, from any store that Spark reads; an empty file is an empty mapping."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(text["value"] if text else "") or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def resolved(path: str, base: str) -> str:
    """path as it is if it is absolute or names a store (scheme:), else below base."""
    path = str(path)
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{PurePosixPath(path)}"


def with_paths(settings: dict[str, Any], base: str, *paths: str, output: str | None = None, made_of: str = "run_{now:%Y%m%d_%H%M%S}", now: datetime | None = None) -> dict[str, Any]:
    """A copy of settings with the named paths below base; those that are missing or blank are left so.

    output: a path that, where it is blank, is made of made_of, a format of the settings and now.
    """
    out = dict(settings)
    if output and not out.get(output):
        out[output] = made_of.format(**settings, now=now or datetime.now())
    for name in (*paths, *([output] if output else [])):
        if out.get(name):
            out[name] = resolved(out[name], base)
    return out


def made_from(kind: type[T], settings: dict[str, Any], strict: bool = True) -> T:
    """A settings dataclass from a mapping: lists become tuples, mappings are merged into the default, and a name that the class lacks is an error (strict) or left out."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(settings) - set(fields))
    if unknown and strict:
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    known = {}
    for name, value in settings.items():
        if name in fields:
            default = fields[name].default_factory() if fields[name].default_factory is not dataclasses.MISSING else fields[name].default
            known[name] = {**default, **value} if isinstance(value, dict) and isinstance(default, dict) else tuple(value) if isinstance(value, list) else value
    return kind(**known)
