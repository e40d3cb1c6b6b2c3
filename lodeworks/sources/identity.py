"""Source URLs: one spelling for each, and never a credential."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

_ALIASES = {"postgresql": "postgres", "clickhouse+https": "clickhouse", "mariadb": "mysql"}
_PORTS = {"postgres": 5432, "mysql": 3306}


def scheme_of(url: str) -> str:
    head = url.split(":", 1)[0].lower()
    return _ALIASES.get(head, head)


def canonical_table(scheme: str, table: str) -> str:
    """Postgres tables without a schema are in public."""
    return table if scheme != "postgres" or "." in table else f"public.{table}"


def source_identity(url: str, table: str) -> str:
    """scheme://host:port/database::table; equal for all spellings of one source."""
    scheme = scheme_of(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"{redacted(url)}::{table}"
    if not host and not parts.netloc:
        return f"{scheme}://{parts.path or url.split(':', 1)[-1]}::{table}"
    port = port or _PORTS.get(scheme, 0)
    return f"{scheme}://{host}:{port}/{parts.path.strip('/')}::{canonical_table(scheme, table)}"


def redacted(text: str) -> str:
    """text with the user part of any URL, and any password parameter, blotted out."""
    text = re.sub(r"(\w[\w+.-]*://)[^/@\s]*@", r"\1***@", text)
    return re.sub(r"(?i)((?:password|pwd|token|secret)=)[^&;\s]+", r"\1***", text)
