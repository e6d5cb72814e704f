"""Paths as keys: relative to a scope root, or an opaque id, or a bare URI.  Lexical only.

``Roots`` is one session's directories; ``key_of`` is pure.  Vectorised use is in
``operators.normalise``, where each session's roots are resolved once.
"""

from __future__ import annotations

import hashlib
import re

from ledgerloom.fixed import SCOPE_RANK

_DRIVE = re.compile(r"[A-Za-z]:[\\/]")
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.S)


class Unrepresentable(ValueError):
    """A path that has no key, such as a scope root itself."""


def split_uri(text: str) -> tuple[str, str, str] | None:
    """(scheme, path, query and fragment) of a URI, its authority dropped; a drive is none."""
    m = None if _DRIVE.match(text) else _URI.fullmatch(text)
    if not m:
        return None
    scheme, rest = m.groups()
    if rest.startswith("//"):
        tail = re.search(r"[/?#]", rest[2:])
        rest = rest[2 + tail.start() :] if tail else ""
    cut = re.search(r"[?#]", rest)
    return (scheme, rest[: cut.start()], rest[cut.start() :]) if cut else (scheme, rest, "")


def bare_uri(parts: tuple[str, str, str]) -> str:
    import unicodedata

    scheme, path, suffix = parts
    return f"{scheme.lower()}:{unicodedata.normalize('NFC', path)}{unicodedata.normalize('NFC', suffix)}"


def resolve(path: str) -> str:
    """``.`` and ``..`` resolved by text; forward slashes; no trailing slash."""
    p = path.replace("\\", "/")
    drive = p[:2] if re.match(r"[A-Za-z]:", p) else ""
    rooted = bool(drive) or p.startswith("/")
    stack: list[str] = []
    for part in p[len(drive) :].split("/"):
        if part == "..":
            if stack and stack[-1] != "..":
                stack.pop()
            elif not rooted:
                stack.append(part)
        elif part not in ("", "."):
            stack.append(part)
    body = "/".join(stack)
    if drive:
        return f"{drive}/{body}" if body else drive
    return f"/{body}" if rooted else body


def under(base: str, path: str) -> str:
    return resolve(path if re.match(r"[A-Za-z]:[\\/]|[\\/]", path) else f"{base}/{path}")


class Roots:
    """The directories that give paths their scope; the best one first."""

    def __init__(self, cwd: str, repo_root: str | None = None, granted: list[tuple[str, str]] = ()):
        self.cwd = cwd
        given = [*granted, *([(repo_root, "repo")] if repo_root else []), (cwd, "cwd")]
        best: dict[str, tuple[int, str, str]] = {}
        for root, scope in given:
            rank = (SCOPE_RANK[scope], root, scope)
            at = under(cwd, root)
            best[at] = min(best.get(at, rank), rank)
        self.roots = sorted(((r[0], -len(at), r[1], at, r[2]) for at, r in best.items()))

    def key_of(self, path: str) -> tuple[str, str]:
        """(key, scope)."""
        uri = split_uri(path)
        if uri and uri[0].lower() != "file":
            return bare_uri(uri), "uri"
        if uri:
            file = uri[1]
            if not file:
                raise Unrepresentable("a file URI without a path")
            return self._file_key(file[1:] if re.match(r"/[A-Za-z]:[\\/]", file) else file, path)
        return self._file_key(path, path)

    def _file_key(self, path: str, identity: str) -> tuple[str, str]:
        import unicodedata

        raw = path.replace("\\", "/")
        full = under(self.cwd, raw)
        for _, _, _, at, scope in self.roots:
            if full == at or full.startswith(at if at.endswith("/") else at + "/"):
                rest = full[len(at) if at.endswith("/") else len(at) + 1 :] if full != at else ""
                if not rest:
                    raise Unrepresentable("a scope root has no relative key")
                return unicodedata.normalize("NFC", rest), scope
        cut = max(identity.rfind("/"), identity.rfind("\\"))
        folder = "." if cut < 0 else identity[:cut] or (identity[:1] if identity[:1] in "/\\" else ".")
        name = resolve(raw).rpartition("/")[2] or "."
        digest = hashlib.sha256(folder.encode()).hexdigest()[:12]
        return f"{digest}:{unicodedata.normalize('NFC', name)}", "external"
