"""Settings, keys and token lists of a deployment: read once on the driver, and refused where they are unsafe."""

from __future__ import annotations

import os
import secrets
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Shorter group ids would be found inside of ordinary text.
LEAST_GROUP_ID = 16
LEAST_KEY_BYTES = 32


class SettingsError(ValueError):
    """A setting is missing or can't be used."""


def _set(default: Any, read: Callable[[str], Any] = str) -> Any:
    return field(default=default, metadata={"read": read})


def _names(text: str) -> tuple[str, ...]:
    return tuple(x for x in map(str.strip, text.split(",")) if x)


@dataclass(frozen=True)
class Settings:
    """Each field is read from the variable of its name in capitals behind the prefix; group_id has no default."""

    group_id: str = _set("")
    host: str = _set("localhost")
    port: int = _set(7583, int)
    cache_dir: str = _set("var", os.path.expanduser)
    var_dir: str = _set("var", os.path.expanduser)
    archive_dir: str | None = _set(None, lambda x: x.strip() or None)
    foreign_archive_dir: str | None = _set(None, lambda x: x.strip() or None)
    cache_key: str | None = _set(None, lambda x: x or None)
    hubs: tuple[str, ...] = _set((), _names)
    log_level: str = _set("INFO", str.upper)
    auto_handles: bool = _set(True, lambda x: x not in ("0", "false", "no"))
    notify: bool = _set(False, lambda x: x.lower() in ("1", "true", "yes"))
    max_tasks_per_window: int = _set(4, int)
    max_updates_per_window: int = _set(2, int)
    fetch_max_uses: int = _set(3, int)
    worth_threshold: float = _set(0.6, float)
    domain: str = _set("", str.strip)

    def __post_init__(self):
        if len(self.group_id) < LEAST_GROUP_ID:
            raise SettingsError(f"group_id has {len(self.group_id)} characters, at least {LEAST_GROUP_ID} are needed")

    def under_var(self, name: str) -> str:
        return f"{self.var_dir.rstrip('/')}/{name}"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TIDEWATER_") -> "Settings":
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is None:
                continue
            try:
                given[f.name] = f.metadata["read"](text)
            except ValueError as e:
                raise SettingsError(f"{prefix}{f.name.upper()} can't be read") from e
        return cls(**given)


def parse_key(text: str, where: str) -> bytes:
    """A key of 32 bytes or more from hex; messages never hold the key."""
    try:
        key = bytes.fromhex(text.strip())
    except ValueError:
        raise SettingsError(f"{where} isn't hex") from None
    if len(key) < LEAST_KEY_BYTES:
        raise SettingsError(f"{where} has fewer than {LEAST_KEY_BYTES} bytes")
    return key


def load_key(env: Mapping[str, str] | None = None, prefix: str = "TIDEWATER_", create: bool = True) -> bytes:
    """The pseudonym key: the variable KEY, else the file that KEY_FILE names, made on first use for its owner alone.

    With neither set there is no key, and none is made up: its pseudonyms would not come back.
    """
    env = os.environ if env is None else env
    if env.get(f"{prefix}KEY"):
        return parse_key(env[f"{prefix}KEY"], f"{prefix}KEY")
    name = env.get(f"{prefix}KEY_FILE", "").strip()
    if not name:
        raise SettingsError(f"neither {prefix}KEY nor {prefix}KEY_FILE is set")
    path = Path(name)
    if create and not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
                f.write(secrets.token_bytes(LEAST_KEY_BYTES).hex())
        except FileExistsError:  # another driver was first: its key counts
            pass
    if not path.exists():
        raise SettingsError(f"{path.name} isn't there")
    return parse_key(path.read_text(encoding="utf-8"), path.name)


def load_tokens(path: str | None = None, env: Mapping[str, str] | None = None, name: str = "TIDEWATER_TOKENS") -> tuple[list[str], list[str]]:
    """The literals that must not appear, and the phrases (lines with a leading `-`) in which they may.

    The variable beats the file; blank lines and those with `#` say nothing. Without a literal a scan would pass
    everything, so that is an error.
    """
    env = os.environ if env is None else env
    if env.get(name):
        lines = env[name].splitlines()
    elif path and os.path.exists(path):
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    else:
        raise SettingsError(f"no tokens: neither {name} nor a file")
    said = [x for x in (unicodedata.normalize("NFKC", x.strip()).replace("\\", "/") for x in lines) if x and not x.startswith("#")]
    exempt = [x[1:].strip() for x in said if x.startswith("-") and len(x) > 1]
    tokens = [x for x in said if not (x.startswith("-") and len(x) > 1)]
    if not tokens:
        raise SettingsError("the list has no tokens")
    return tokens, [x for x in exempt if x]
