"""Settings from the environment, JSON logs, and paths that runs may read."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import PurePosixPath

#: Folders that hold labels, which a deciding run may not read.
LABEL_FOLDERS = ("evaluation-data", "labels")


@dataclass(frozen=True)
class Settings:
    root: str
    cache: str
    artifacts: str
    log_level: str = "INFO"


def load(environment: Mapping[str, str] | None = None) -> Settings:
    """Settings by THERMAL_LAKE_ROOT, _CACHE, _ARTIFACTS and _LOG_LEVEL; a relative path is under the root."""
    env = os.environ if environment is None else environment
    root = env.get("THERMAL_LAKE_ROOT", os.getcwd())
    under = lambda name, default: str(PurePosixPath(root) / env.get(name, default))
    level = env.get("THERMAL_LAKE_LOG_LEVEL", "INFO").upper()
    if level not in logging.getLevelNamesMapping():
        raise ValueError(f"{level} is no log level")
    return Settings(root, under("THERMAL_LAKE_CACHE", "cache"), under("THERMAL_LAKE_ARTIFACTS", "artifacts"), level)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, sort_keys=True)


def runtime_path(path: str) -> str:
    """The path, unless it leads to labels: then it raises."""
    parts = PurePosixPath(os.path.normpath(path)).parts
    if any(p in LABEL_FOLDERS for p in parts):
        raise PermissionError(f"{path} holds labels")
    return path


def tuning_path(path: str) -> str:
    """The path of a development manifest; those of test and stress raise."""
    name = PurePosixPath(path).name
    if not name.startswith("development"):
        raise PermissionError(f"{name}: only development cases may be tuned on")
    return runtime_path(path)
