"""Adapter definitions: declared vocabularies as data, validated, with failures as values."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from ledgerloom import fixed

KINDS = frozenset((*fixed.PRIORITY, "command", "ignored", "todo"))
_MISSING = object()


@dataclass(frozen=True)
class Definition:
    adapter: str = "generic"
    conversational: tuple[str, ...] = fixed.CONVERSATIONAL
    non_conversational: tuple[str, ...] = fixed.NON_CONVERSATIONAL
    tools: dict[str, str] = field(default_factory=lambda: dict(fixed.TOOL_KINDS))
    prefixes: tuple[tuple[str, str], ...] = fixed.TOOL_PREFIXES
    cues: tuple[str, ...] = fixed.CUES
    #: (path, sha256, shapes) of the recordings the definition was verified against
    fixtures: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: what is declared about context usage; None if nothing is
    usage: dict | None = None

    def shapes(self) -> list[str]:
        return sorted({f"record:{t}" for t in (*self.conversational, *self.non_conversational)})


# ---- the file format as a table: where a value stands, what it must be, how that is said

_object = (lambda v: isinstance(v, dict), "an object")
_list = (lambda v: isinstance(v, list), "an array")
_text = (lambda v: isinstance(v, str), "a string")
_texts = (lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), "an array of strings")
_maybe = (lambda v: v is None or v is _MISSING or isinstance(v, str), "a string or null")
_flag = (lambda v: isinstance(v, bool), "true or false")
_kind = (lambda v: isinstance(v, str) and v in KINDS, "a declared tool kind")
_source = (lambda v: isinstance(v, str) and re.fullmatch(r"(?:docs|observed):\S+", v) is not None, "a docs: or observed: source")
_tokens = (lambda v: _texts[0](v) and all(re.fullmatch(r"[A-Za-z0-9_-]{1,64}", x) for x in v), "an array of shape tokens")

#: ``[]`` stands for every element, ``*`` for every value; a place is looked at only inside sound ones
FORMAT = [
    ("schema_version", (lambda v: type(v) is int and v == 1, "1")),
    ("adapter", (lambda v: isinstance(v, str) and v in fixed.ADAPTERS, "a declared adapter")),
    ("display_name", _text),
    ("last_verified_version", _text),
    ("verified_at", (lambda v: isinstance(v, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v) is not None, "YYYY-MM-DD")),
    ("evidence", _object),
    ("evidence.*", _source),
    ("config_paths", _object),
    ("config_paths.user_settings", _text),
    ("config_paths.project_settings", _texts),
    ("config_paths.config_dir_env", _maybe),
    ("config_paths.transcript_directory", _text),
    ("version_probe", _object),
    ("version_probe.command", (lambda v: isinstance(v, str) and re.fullmatch(r"\S+", v) is not None, "the bare name of a program")),
    ("version_probe.args", _texts),
    ("hooks", _list),
    ("hooks[]", _object),
    ("hooks[].event", _text),
    ("hooks[].matcher", _maybe),
    ("hooks[].output", _maybe),
    ("hooks[].evidence", _source),
    ("event_map", _list),
    ("event_map[]", _object),
    ("event_map[].hook", _text),
    ("event_map[].match", _texts),
    ("event_map[].action", _text),
    ("event_map[].injects", _flag),
    ("event_map[].registered", _flag),
    ("event_map[].evidence", _source),
    ("transcript", _object),
    ("transcript.format", _text),
    ("transcript.records", _object),
    ("transcript.records.conversational", _tokens),
    ("transcript.records.non_conversational", _tokens),
    ("tools", _object),
    ("tools.exact", _object),
    ("tools.exact.*", _kind),
    ("tools.prefixes", _list),
    ("tools.prefixes[]", _object),
    ("tools.prefixes[].prefix", _text),
    ("tools.prefixes[].kind", _kind),
    ("decision_cues", (lambda v: _texts[0](v) and all(v), "an array of strings that are not empty")),
    ("fixtures", (lambda v: isinstance(v, list) and len(v) > 0, "an array of at least one fixture")),
    ("fixtures[]", _object),
    ("fixtures[].path", _text),
    ("fixtures[].sha256", (lambda v: isinstance(v, str) and re.fullmatch(r"sha256:[0-9a-f]{64}", v) is not None, "sha256: and 64 hex digits")),
    ("fixtures[].shape", _texts),
    ("context_watermark", (lambda v: v is _MISSING or isinstance(v, dict), "an object")),
    ("context_watermark.supported", _flag),
    ("context_watermark.used_tokens_field", _maybe),
    ("context_watermark.context_limit_tokens_field", _maybe),
    ("context_watermark.source_event", _maybe),
    ("context_watermark.evidence", _source),
]


def shown(name: str, most: int = 48) -> str:
    """A name from outside, fit for a report: no control characters, bounded."""
    s = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", name)
    return (s if len(s) <= most else s[:most] + "…") or "<empty>"


def _places(data, path: str, unsound: set[str]):
    """(where, value) of the places a path of the format names in ``data``."""
    found = [("", data)]
    for step in re.findall(r"\[\]|[^.\[\]]+", path):
        nxt = []
        for where, v in found:
            if where in unsound:
                continue
            if step == "[]" and isinstance(v, list):
                nxt += [(f"{where}[{i}]", x) for i, x in enumerate(v)]
            elif step == "*" and isinstance(v, dict):
                nxt += [(f"{where}.{shown(k)}", x) for k, x in v.items()]
            elif isinstance(v, dict):
                nxt.append((f"{where}.{step}" if where else step, v.get(step, _MISSING)))
        found = nxt
    return found


def validate(data) -> list[str]:
    """The problems of a definition read from JSON; none if it is usable."""
    if not isinstance(data, dict):
        return ["root: expected an object"]
    bad: list[str] = []
    unsound: set[str] = set()
    for path, (sound, what) in FORMAT:
        for where, v in _places(data, path, unsound):
            if not sound(v):
                unsound.add(where)
                bad.append(f"{where}: expected {what}")
    return bad


def parse(data) -> tuple[Definition | None, list[str]]:
    """(definition, no problems) or (None, problems)."""
    if bad := validate(data):
        return None, bad
    r, t = data["transcript"]["records"], data["tools"]
    fixtures = tuple((f["path"], f["sha256"], tuple(f["shape"])) for f in data["fixtures"])
    prefixes = tuple((p["prefix"], p["kind"]) for p in t["prefixes"])
    return Definition(data["adapter"], tuple(r["conversational"]), tuple(r["non_conversational"]), dict(t["exact"]), prefixes, tuple(data["decision_cues"]), fixtures, data.get("context_watermark")), []


def load_file(path: str) -> tuple[Definition | None, list[str]]:
    try:
        with open(path, encoding="utf-8") as fh:
            data = json.load(fh)
    except (OSError, ValueError, RecursionError) as e:
        return None, [f"unreadable: {type(e).__name__}"]
    return parse(data)


def load_directory(folder: str) -> tuple[dict[str, Definition], list[tuple[str, str]]]:
    """(definitions by adapter, failures): files in name order, the first of an adapter wins."""
    found: dict[str, Definition] = {}
    failed: list[tuple[str, str]] = []
    try:
        names = sorted(n for n in os.listdir(folder) if n.endswith(".json"))
    except OSError as e:
        return {}, [("", f"unreadable: {type(e).__name__}")]
    for name in names:
        d, problems = load_file(os.path.join(folder, name))
        if d is not None and d.adapter in found:
            problems = ["adapter: declared before"]
        if problems:
            failed.append((name, "; ".join(problems)))
        else:
            found[d.adapter] = d
    return found, failed


class Registry:
    """Definitions by adapter, beside the failures that must not take the sound ones down."""

    def __init__(self, folder: str):
        self._found, self.failures = load_directory(folder)

    def get(self, adapter: str) -> Definition | None:
        return self._found.get(adapter)

    def definitions(self) -> list[Definition]:
        return list(self._found.values())

    def degraded(self) -> list[str]:
        """The state of everything produced while a failure stands."""
        return ["schema-drift"] if self.failures else []


def usage_capability(adapter: str, d: Definition | None) -> dict:
    """Whether an adapter reports context usage, and in which fields; what is not declared is
    not supported."""
    names = ("used_tokens_field", "context_limit_tokens_field", "source_event", "evidence")
    told = (d.usage if d else None) or {}
    return {"adapter": adapter, "supported": told.get("supported", False)} | {n: told.get(n) for n in names}
