"""Configuration in layers: defaults, then a JSON file, then the environment, then policy; a later layer wins."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from maskwright.operators.routing import AI_DOMAINS, AUTH_DOMAINS, AUTH_PATHS


@dataclass(frozen=True)
class Config:
    ai_endpoint: str = "http://localhost:11434"
    ai_model: str = "qwen2.5:3b"
    use_ai: bool = True
    ai_confidence: float = 0.7
    ai_max_concurrent: int = 1
    ai_cache: str = ""
    log_level: str = "info"
    ai_domains: tuple[str, ...] = AI_DOMAINS
    auth_domains: tuple[str, ...] = AUTH_DOMAINS
    auth_paths: tuple[str, ...] = AUTH_PATHS
    enabled_packs: tuple[str, ...] = ("SECRETS", "GLOBAL", "DE")
    pack_decay: float = 0.05
    instructions: tuple[tuple[str, str], ...] = ()


#: Names of settings in the JSON file and in the environment.
FILE_NAMES = {
    "ollamaEndpoint": "ai_endpoint", "ollamaModel": "ai_model", "useAIDetection": "use_ai", "aiConfidenceThreshold": "ai_confidence",
    "ollamaMaxConcurrent": "ai_max_concurrent", "ollamaCacheFile": "ai_cache", "logLevel": "log_level", "aiApiDomains": "ai_domains",
    "authDomains": "auth_domains", "authPaths": "auth_paths", "enabledPacks": "enabled_packs", "packDecayRate": "pack_decay", "piiInstructions": "instructions",
}
ENV_NAMES = {
    "OLLAMA_ENDPOINT": "ai_endpoint", "OLLAMA_MODEL": "ai_model", "USE_AI_DETECTION": "use_ai", "AI_CONFIDENCE_THRESHOLD": "ai_confidence",
    "OLLAMA_MAX_CONCURRENT": "ai_max_concurrent", "OLLAMA_CACHE_FILE": "ai_cache", "LOG_LEVEL": "log_level", "ENABLED_PACKS": "enabled_packs", "PACK_DECAY_RATE": "pack_decay",
}


def _layer(config: Config, values: Mapping[str, Any]) -> Config:
    known = {f.name for f in fields(Config)}
    clean = {k: tuple(v.items()) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known and v is not None}
    return replace(config, **clean)


def from_env(env: Mapping[str, str]) -> dict[str, Any]:
    """Settings of the environment; values that don't parse, and the empty string, leave a setting as it is."""
    out: dict[str, Any] = {}
    for name, key in ENV_NAMES.items():
        text = env.get(name, "")
        if not text:
            continue
        try:
            if key == "use_ai":
                out |= {key: False} if text == "false" else {}
            elif key == "enabled_packs":
                out[key] = [x.strip() for x in text.split(",") if x.strip()]
            elif key == "ai_max_concurrent":
                out |= {key: int(text)} if int(text) > 0 else {}
            elif key in ("ai_confidence", "pack_decay"):
                out[key] = float(text)
            else:
                out[key] = text
        except ValueError:
            continue
    return out


def load(path: str | None = None, env: Mapping[str, str] | None = None, policy: Mapping[str, Any] | None = None) -> Config:
    """The configuration; a file that is missing or no JSON is passed over. The decay is clamped to 0..1."""
    config = Config()
    if path and os.path.exists(path):
        try:
            with open(path) as f:
                config = _layer(config, {FILE_NAMES[k]: v for k, v in json.load(f).items() if k in FILE_NAMES})
        except ValueError:
            pass
    config = _layer(config, from_env(os.environ if env is None else env))
    config = _layer(config, policy or {})
    return replace(config, pack_decay=min(1.0, max(0.0, config.pack_decay)))


def parse_env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines: blank lines and # comments are skipped, one pair of equal quotes around a value is taken off.
    ValueError for a line without `=` or with an empty key."""
    out: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key:
            raise ValueError(f"line {n}: {'empty key' if equals else 'missing ='}")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out
