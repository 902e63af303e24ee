"""Settings as plain dataclasses: validation, presets, environment files, and derived values."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from urllib.parse import urlsplit

from versoflow.errors import ConfigError

LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def parse_page_range(value: str | list | tuple | None) -> tuple[int, int] | None:
    """``[a, b]``, ``a,b`` or ``a-b`` (1-based, inclusive) -> (a, b). Null and blank -> None."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                parts = json.loads(text)
            except ValueError as e:
                raise ConfigError("page range isn't a list", value=value) from e
        else:
            parts = re.split(r"[,-]", text)
    else:
        parts = list(value)
    try:
        start, end = (int(str(p).strip()) for p in parts)
    except ValueError as e:
        raise ConfigError("page range needs two whole numbers", value=value) from e
    if start < 0 or end < start:
        raise ConfigError("page range must not be negative or backward", value=value)
    return start, end


def parse_margins(value: str | None) -> tuple[float, float, float, float] | None:
    """Four shares of the page in [0, 1): left, top, right, bottom."""
    if value is None or not value.strip():
        return None
    try:
        parts = tuple(float(p) for p in re.split(r"[,\s]+", value.strip().strip("[]")))
    except ValueError as e:
        raise ConfigError("margins must be numbers", value=value) from e
    if len(parts) != 4 or any(not 0 <= p < 1 for p in parts):
        raise ConfigError("margins must be four shares in [0, 1)", value=value)
    return parts  # type: ignore[return-value]


def crop_box(width: float, height: float, margins: tuple[float, float, float, float] | None) -> tuple[float, float, float, float]:
    """The rectangle that the margins leave; the whole page if they leave none."""
    if margins is None:
        return 0.0, 0.0, width, height
    left, top, right, bottom = margins
    box = (width * left, height * top, width * (1 - right), height * (1 - bottom))
    return box if box[0] < box[2] and box[1] < box[3] else (0.0, 0.0, width, height)


# Characters a request may hold, characters of its frame, and the largest batch, by kind of service.
SERVICE_LIMITS = {"openai": (60_000, 2_000, 3), "gemini": (200_000, 2_000, 4), "other": (100_000, 500, None)}


def safe_batch_size(batch_size: int, max_chunk_size: int, service: str) -> int:
    """The largest batch up to the wanted one that a request to the service holds."""
    limit, frame, most = SERVICE_LIMITS.get(service, SERVICE_LIMITS["other"])
    size = min(batch_size, max(1, (limit - frame) // max(1, max_chunk_size)))
    return min(size, most) if most else size


def service_kind(base_url: str) -> str:
    """``local``, ``deepseek`` or ``openai`` from the host of a base URL."""
    host = urlsplit(base_url if "://" in base_url else "http://" + base_url).hostname or ""
    if host in ("localhost", "127.0.0.1", "0.0.0.0", "::1") or host.startswith("192.168.") or host.startswith("10."):
        return "local"
    return "deepseek" if "deepseek" in host else "openai"


def chat_endpoint(base_url: str) -> str:
    """The chat completion URL for a base URL given with or without scheme, trailing slash, or path."""
    url = base_url.strip().rstrip("/")
    if "://" not in url:
        url = ("http://" if service_kind(url) == "local" else "https://") + url
    if url.endswith("/chat/completions"):
        return url
    return url + ("/chat/completions" if re.search(r"/v\d+$", url) else "/v1/chat/completions")


@dataclass(frozen=True)
class Settings:
    """What the operators take from configuration."""

    document_path: str | None = None
    output_base_dir: str = "output"
    page_range: tuple[int, int] | None = None
    margins: tuple[float, float, float, float] | None = None
    service: str = "other"
    batch_size: int = 5
    max_chunk_size: int = 2000
    max_context_length: int = 2000
    glossary_ratio: float = 0.1
    glossary_min_terms: int = 50
    glossary_max_terms: int = 200
    glossary_stop_threshold: float = 0.3
    checkpoint_interval: int = 10
    async_threshold: int = 50
    async_max_workers: int = 10
    retain_original: bool = False
    use_breadcrumb: bool = True
    render_page_markers: bool = True
    log_level: str = "INFO"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 1 <= self.batch_size <= 20:
            raise ConfigError("batch_size must be from 1 to 20", value=self.batch_size)
        if self.max_chunk_size < 1:
            raise ConfigError("max_chunk_size must be positive", value=self.max_chunk_size)
        if not 0 <= self.glossary_ratio <= 1:
            raise ConfigError("glossary_ratio must be a share", value=self.glossary_ratio)
        if self.log_level.upper() not in LOG_LEVELS:
            raise ConfigError("unknown log level", value=self.log_level)
        object.__setattr__(self, "log_level", self.log_level.upper())
        object.__setattr__(self, "page_range", parse_page_range(self.page_range))
        if self.document_path and os.path.splitext(self.document_path)[1].lower() not in (".pdf", ".epub"):
            raise ConfigError("document must be .pdf or .epub", value=self.document_path)

    @property
    def page_markers(self) -> bool:
        """Page markers mean nothing in an EPUB."""
        return self.render_page_markers and not (self.document_path or "").lower().endswith(".epub")

    @property
    def effective_batch_size(self) -> int:
        return safe_batch_size(self.batch_size, self.max_chunk_size, self.service)

    def with_(self, **changes: object) -> Settings:
        """A changed copy, validated again; calls may be chained."""
        return replace(self, **changes)

    @classmethod
    def preset(cls, name: str, **changes: object) -> Settings:
        if name not in PRESETS:
            raise ConfigError("unknown preset", value=name)
        return cls(**(PRESETS[name] | changes))

    @classmethod
    def from_env_file(cls, path: str) -> Settings:
        """Settings from ``KEY=value`` lines; a nested ``GROUP__KEY`` counts by its last part, unknown keys are kept apart."""
        known = {f.name: f for f in fields(cls)}
        values: dict[str, object] = {}
        extra: dict[str, str] = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if not line or line.startswith("#") or "=" not in line:
                    continue
                key, _, value = line.partition("=")
                name, value = key.strip().rpartition("__")[2].lower(), value.strip().strip("\"'")
                if name not in known or name == "extra":
                    extra[key.strip()] = value
                elif name == "margins":
                    values[name] = parse_margins(value)
                elif known[name].type.startswith("bool"):
                    values[name] = value.lower() in ("1", "true", "yes", "on")
                elif known[name].type.startswith("int"):
                    values[name] = int(value)
                elif known[name].type.startswith("float"):
                    values[name] = float(value)
                else:
                    values[name] = value or None
        return cls(**values, extra=extra)


PRESETS: dict[str, dict[str, object]] = {
    "quick": {"batch_size": 8, "async_max_workers": 15},
    "balanced": {},
    "careful": {"batch_size": 3, "async_max_workers": 3, "checkpoint_interval": 2},
    "bilingual": {"retain_original": True},
    "large": {"batch_size": 10, "max_chunk_size": 4000, "checkpoint_interval": 50},
}
