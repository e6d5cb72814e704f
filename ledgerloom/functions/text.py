"""Text of commands, errors and statements, made comparable and free of host paths."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.fixed import COMMAND_CHARS, ERROR_CLASSES, PLAIN_PREFIXES, SENTENCE_CHARS, SIGNATURE_CHARS, URI_SCHEMES
from ledgerloom.functions.paths import Roots, Unrepresentable

#: what counts as blank: the Unicode spaces, line ends and the byte order mark
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = BLANK + "\"'`(){}[],;|&<>"
_edge = re.escape(_EDGE)
# where a path-like token may start, and the forms it takes
_TOKEN = re.compile(
    rf"(?:(?<=[{_edge}=$:])|^)(?:"
    r"[A-Za-z]:[\\/]|\\\\|//|/|~(?:[A-Za-z0-9._-]+)?[\\/]|(?:[A-Za-z0-9._-]+@)?[A-Za-z0-9._-]+:[\\/]|[A-Za-z][A-Za-z0-9+.-]*://)"
)
_STOP = re.compile(f"[{_edge}]")
_HINT = re.compile(r"[/\\]")
_ANSI = re.compile(r"\x1b\][^\x07]*(?:\x07|\x1b\\)|\x1b\[[0-?]*[ -/]*[@-~]|\x1b[@-_]")


#: tokens that stand for a path other than themselves: a path on a host, and one under a home
_ON_HOST = re.compile(rf"(?![A-Za-z]:[\\/])(?!(?i:{'|'.join(sorted(URI_SCHEMES))}):/(?!/))(?!.*://)(?:[A-Za-z0-9._-]+@)?([A-Za-z0-9._-]+):(?=[\\/])", re.S)
_AT_HOME = re.compile(r"~([A-Za-z0-9._-]*)[\\/]")


def _host_path(token: str, m: re.Match) -> str:
    """What follows the host; a word before the colon must be one of those that are no host."""
    if "@" not in token and m[1].lower() not in PLAIN_PREFIXES:
        raise Unrepresentable("neither a host nor a known word before the path")
    return token[m.end() :]


def _home_path(token: str, m: re.Match) -> str:
    return "/" + token[1 if m[1] else 2 :]


_FORMS = ((_ON_HOST, _host_path), (_AT_HOME, _home_path))


def _replace(token: str, roots: Roots) -> str:
    """The key of a path-like token, by the first form it has; drives, URIs and plain paths are
    keyed as they are."""
    for form, path_of in _FORMS:
        if m := form.match(token):
            return roots.key_of(path_of(token, m))[0]
    return roots.key_of(token)[0]


def without_paths(text: str, roots: Roots) -> str | None:
    """``text`` with every path in it replaced by its key; None if one has no key."""
    text = unicodedata.normalize("NFC", text)
    if not _HINT.search(text):
        return text
    out, at = [], 0
    try:
        while m := _TOKEN.search(text, at):
            i = m.start()
            quote = text[i - 1] if i and text[i - 1] in "'\"" else None
            stop = text.find(quote, i) if quote else (s.start() if (s := _STOP.search(text, i)) else -1)
            end = len(text) if stop < 0 else stop
            out += [text[at:i], _replace(text[i:end], roots)]
            at = end
    except Unrepresentable:
        return None
    return "".join([*out, text[at:]])


def command_key(text: str, roots: Roots) -> str | None:
    """One spelling for a command: no escapes, no host paths, single blanks, bounded length."""
    safe = without_paths(_ANSI.sub("", text), roots)
    if safe is None:
        return None
    clean = re.sub(r"[ \t]+", " ", safe.strip(BLANK))
    if len(clean) <= COMMAND_CHARS:
        return clean or None
    head = clean[: COMMAND_CHARS - 1]
    cut = max(head.rfind(" "), head.rfind("\t"))
    return (head[:cut] if cut > 0 else head).rstrip(BLANK) + "…"


def error_class(message: str) -> str:
    low = message.lower().strip(BLANK)
    return next((name for name, starts in ERROR_CLASSES if low.startswith(starts)), "unknown")


_digits = lambda m: re.sub(r"[0-9]+", "N", m[0])
_ERROR_STEPS = [
    (re.compile(r"\b(?:0x)?[0-9a-f]{8,}\b", re.A | re.I), "<hex>"),
    (re.compile("([\"'\u201c\u201d\u2018\u2019])(?:(?!\\1)[^\n\r\u2028\u2029])*\\1"), '"\u2026"'),
    (re.compile(r"\b(?:line|column|col)\s*[:#]?\s*[0-9]+\b", re.A | re.I), _digits),
    (re.compile(r":[0-9]+(?::[0-9]+)?\b", re.A), _digits),
    (re.compile(r"[0-9]{2,}"), "N"),
    (re.compile(r"[ \t\r\n]+"), " "),
]


def error_signature(message: str, roots: Roots) -> str:
    """``class:message`` with what varies from run to run taken out."""
    text = without_paths(message, roots)
    if text is None:
        text = "<opaque>"
    else:
        for pattern, to in _ERROR_STEPS:
            text = pattern.sub(to, text)
        text = text.strip(BLANK)
    return f"{error_class(message)}:{text}"[:SIGNATURE_CHARS]


_SENTENCE = re.compile(rf".*?(?:[.!?](?:[{re.escape(BLANK)}]|$)|$)", re.S)


def first_sentence(text: str) -> str:
    return re.sub(r"[\t\r\n ]+", " ", _SENTENCE.match(text)[0]).strip(BLANK)


def decision(text: str, roots: Roots, cues: list[str]) -> tuple[str, str] | None:
    """(statement, cue) of a user's text whose first sentence holds a cue."""
    s = without_paths(first_sentence(text), roots)
    if s is None:
        return None
    s = s[:SENTENCE_CHARS]
    low = s.lower()
    return next(((s, c) for c in cues if c.lower() in low), None)


# ---- the parts that Spark expresses itself


def error_class_column(message: Column) -> Column:
    low = F.trim(F.lower(message))
    return F.coalesce(*[F.when(F.startswith(low, F.lit(s)), F.lit(name)) for name, starts in ERROR_CLASSES for s in starts], F.lit("unknown"))


def safe_token(c: Column) -> Column:
    """Text from outside, bounded to a token or ``<other>``."""
    return F.when(c.rlike("^[A-Za-z0-9_-]{1,64}$"), c).otherwise("<other>")


def score_text(c: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, single blanks."""
    blank = F.regexp_replace(F.regexp_replace(F.lower(c), "[\t\r\n ]+", " "), "[!\"#$%&'()*+,./:;<=>?@\\[\\\\\\]^_`{|}~-]+", " ")
    return F.trim(F.regexp_replace(blank, r"\s+", " "))
