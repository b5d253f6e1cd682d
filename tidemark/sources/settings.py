"""Configuration files and environment settings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import redacted

_VARIABLE = re.compile(r"\$\{([A-Z][A-Z0-9_]*)\}")


class ConfigError(ValueError):
    """All that is wrong, one line each."""


def expand(text: str, env: Mapping[str, str], errors: list[str], where: str) -> str:
    """${NAME} replaced before parsing; unknown names are errors."""

    def one(m: re.Match) -> str:
        if m[1] not in env:
            errors.append(f"{where}: {m[1]} is not set")
        return env.get(m[1], "")

    return _VARIABLE.sub(one, text)


def _said(e: Exception, env: Mapping[str, str]) -> str:
    """An error's first line, with values of variables that it may quote masked."""
    text = redacted((str(e).splitlines() or [type(e).__name__])[0])
    for name, value in env.items():
        if len(value) >= 6 and _VARIABLE.match("${" + name + "}"):
            text = text.replace(value, "***")
    return text


#: Rows of a configuration: a record as JSON, or what keeps a file or a record from being read.
CONFIG = "file string, ord int, record string, error string"


def config_rows(spark: SparkSession, folder: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """A folder's JSON and YAML files in the schema CONFIG, read where Spark reads; each file on its own, so that one which can't be
    read costs its own records only. ${NAME} stands for a variable; one that is not set is an error row, and values never show in errors."""
    env = dict(os.environ if env is None else env)
    used = {k: v for k, v in env.items() if _VARIABLE.match("${" + k + "}")}

    def rows_of(name: str, raw: bytes) -> Iterator[tuple]:
        errors: list[str] = []
        try:
            text = expand(raw.decode("utf-8"), used, errors, name)
            for e in dict.fromkeys(errors):
                yield (name, None, None, e.removeprefix(f"{name}: "))
            if errors:
                return
            if name.endswith(".json"):
                found = json.loads(text)
            else:
                import yaml  # not a requirement; JSON files need nothing

                found = yaml.safe_load(text)
        except ImportError:
            yield (name, None, None, "no YAML library is installed")
            return
        except Exception as e:  # no file's fault hides another's
            yield (name, None, None, _said(e, used))
            return
        for k, record in enumerate(found if isinstance(found, list) else [found]):
            if isinstance(record, dict):
                yield (name, k, json.dumps(record, default=str), None)
            else:
                yield (name, k, None, "not a record")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [r for f in part.itertuples(index=False) for r in rows_of(f.path.rsplit("/", 1)[-1], bytes(f.content))]
            yield pd.DataFrame(rows, columns=["file", "ord", "record", "error"]).astype({"ord": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,yaml,yml}").load(folder)
    return files.select("path", "content").mapInPandas(run, CONFIG)


def load_folder(folder: str, env: Mapping[str, str] | None = None) -> list[dict]:
    """All records of a folder's JSON and YAML files, in the files' name order, with every error collected."""
    env, errors, out = os.environ if env is None else env, [], []
    for path in sorted(Path(folder).glob("*")):
        if path.suffix not in (".json", ".yaml", ".yml"):
            continue
        text = expand(path.read_text(encoding="utf-8"), env, errors, path.name)
        try:
            if path.suffix == ".json":
                found = json.loads(text)
            else:
                import yaml  # not a requirement; JSON files need nothing

                found = yaml.safe_load(text)
        except ImportError:
            errors.append(f"{path.name}: no YAML library is installed")
            continue
        except Exception as e:  # YAML's errors are no ValueErrors; no file's fault hides another's
            errors.append(f"{path.name}: {_said(e, env)}")
            continue
        out += found if isinstance(found, list) else [found]
    if errors:
        raise ConfigError("\n".join(errors))
    return out


@dataclass(frozen=True)
class Settings:
    """Settings of a deployment; each comes from the variable of its name in capitals, within its bounds."""

    host_delay_ms: int = 2000
    host_concurrency: int = 4
    http_timeout_ms: int = 20_000
    max_new_items_per_source: int = 50
    recheck_per_source: int = 5
    max_content_chars: int = 6000
    retention_days: int = 90
    collect_budget_s: int = 1200
    classify_limit: int = 200
    dry_run: bool = True
    user_agent: str = "tidemark"
    broadcast_url: str = ""
    broadcast_token: str = ""
    notify_webhook_url: str = ""
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Settings:
        values, errors = {}, []
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or raw == "":
                continue
            if f.type in (bool, "bool"):
                if raw.lower() not in ("true", "false", "1", "0"):
                    errors.append(f"{f.name.upper()}: true or false")
                values[f.name] = raw.lower() in ("true", "1")
            elif f.type in (str, "str"):
                if f.name.endswith("_url") and not re.match(r"https://[^/\s]", raw):
                    errors.append(f"{f.name.upper()}: an https URL")
                values[f.name] = raw
            elif not re.fullmatch(r"\d{1,9}", raw) or int(raw) < (0 if f.name in ("host_delay_ms", "recheck_per_source", "classify_limit") else 1):
                errors.append(f"{f.name.upper()}: a number of 1 or more")
            else:
                values[f.name] = int(raw)
        if errors:
            raise ConfigError("\n".join(errors))
        return cls(**values)
