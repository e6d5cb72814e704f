"""Text garbled by a wrong character encoding, found and restored (problem 10).

Every run of two or more non-ASCII characters is mapped back to bytes through each legacy
code page it may have been shown in: every single-byte page there is a table for, and the
double-byte pages of East Asia.  A byte-structure automaton (the UTF-8 grammar) marks the
maximal well-formed multibyte spans, and only these are decoded, again and again until nothing
changes (each round makes the text shorter).  A span counts only if every character it
decodes to is one that texts are written with, or two or more are letters of one other script,
and if what it shows is not as likely what was meant: that is what tells a garbled letter from
two correct ones.  Through a double-byte page only whole runs count.
Cyrillic shown through a Western code page has no multibyte structure; runs of accented
letters that read as Cyrillic words are taken for it.  U+FFFD marks text that was lost.

Defined results: null, empty and ASCII text is never garbled; a text with U+FFFD is garbled
but that place stays as it is.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame

from ledgerloom.runtime import ship_package, spread

#: code pages through which UTF-8 is misread most, the likelier first
CODE_PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "cp1254", "iso8859-2", "iso8859-15", "cp866")
#: the other single-byte pages
RARE_PAGES = (
    *("koi8_r", "koi8_u", "cp1253", "cp1255", "cp1256", "cp1257", "cp1258", "cp874", "cp852", "cp855", "cp857", "cp858", "cp737", "cp775"),
    *("cp860", "cp861", "cp862", "cp863", "cp864", "cp865", "cp869", "mac_latin2", "mac_cyrillic", "mac_greek", "mac_iceland", "mac_turkish"),
    *(f"iso8859-{i}" for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 16)),
)
#: double-byte pages
WIDE_PAGES = ("gbk", "cp932", "cp949", "big5", "euc_jp")
#: code pages of Cyrillic text misread as Western
CYRILLIC = ("cp1251", "koi8_r")

_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
# what a garbled span may decode to: letters of Latin, Greek, Cyrillic, kana, Han and Hangul,
# their punctuation, signs, arrows, boxes and emoji; a C1 control or blank only on the way
# to a second decoding
_WRITTEN = re.compile(
    "[\u0080-\u0131\u0134-\u0148\u014a-\u017f\u0192\u0218-\u021b\u02c6\u02c7\u02d8-\u02dd\u0386-\u03ce\u0400-\u045f\u0490\u0491\u1e00-\u1eff"
    "\u2010-\u2027\u2030-\u203a\u20ac\u2116\u2122\u2190-\u22ff\u2500-\u25ff\u2600-\u27bf\u3000-\u30ff\u4e00-\u9fff"
    "\uac00-\ud7a3\ufe0f\uff00-\uffef\U0001f300-\U0001faff]"
)
_DRAWING = re.compile("[\u2500\u2502\u250c\u2510\u2514\u2518\u251c\u2524\u252c\u2534\u253c]+")  # trees and tables
_RUSSIAN = re.compile("[\u0410-\u044f\u0401\u0451]+")
_CYR_VOWEL = re.compile("[\u0430\u0435\u0451\u0438\u043e\u0443\u044b\u044d\u044e\u044f]", re.I)


def _byte_tables() -> dict[str, dict[str, int]]:
    tables = {}
    for cp in (*CODE_PAGES, *RARE_PAGES):
        t = {}
        for b in range(0x80, 0x100):
            try:
                t[bytes([b]).decode(cp)] = b
            except UnicodeDecodeError:
                pass
        if cp.startswith("cp125"):  # decoders that pass on the C1 controls they have no sign for
            shown = set(t.values())
            t |= {chr(b): b for b in range(0x80, 0xA0) if b not in shown}
        tables[cp] = t
    return tables


_TABLES = _byte_tables()


def _natural(span: str, in_word: bool, after: str, rare: bool) -> bool:
    """Whether a span is as likely what was meant: Russian letters in ordinary case, a capital at
    the end of a quotation, line drawing that does not stand inside a word; where the page is
    rare, letters of any one script in ordinary case."""
    if _RUSSIAN.fullmatch(span):
        return span.islower() or span.isupper() or span.istitle()
    if len(span) == 2 and span[1] in "»”’“" and span[0].isupper() and after.isupper():
        return True
    if rare and all(unicodedata.category(c)[0] in "LM" for c in span):
        return len({_script(c) for c in span}) == 1 and (span.islower() or span.isupper() or span.istitle() or not (span.upper() != span.lower()))
    return not in_word and _DRAWING.fullmatch(span) is not None


def _spans(run: str, in_word: bool, known: str, before: str) -> list[tuple[int, int, str, str]]:
    """(start, end, decoded, code page) of the well-formed spans of one run that read as text.
    In a text that is known to be garbled through a code page, its natural spans count too, and
    through a rare page a letter that stands alone."""
    found = []
    for cp, table in _TABLES.items():
        raw = bytes([table.get(c, 0) for c in run])
        rare = cp in _RARE
        for m in _UTF8.finditer(raw):
            for s, e, text in _readable(m[0]):
                a, b = m.start() + s, m.start() + e
                if cp in known.split("+") or not (rare and len(text) < 2 or _natural(run[a:b], in_word, run[a - 1 : a] or before, rare)):
                    found.append((a, b, text, cp))
    if not found and len(run) >= 3:
        found = _wide(run)
    return found


_RARE = frozenset(RARE_PAGES)


def _wide(run: str) -> list[tuple[int, int, str, str]]:
    """The whole run through a double-byte page, if its bytes are East Asian text in UTF-8."""
    for cp in WIDE_PAGES:
        try:
            text = run.encode(cp).decode("utf-8")
        except UnicodeError:
            continue
        if len(text) >= 2 and all(ord(c) >= 0x800 and _WRITTEN.match(c) for c in text):
            return [(0, len(run), text, cp)]
    return []


def _script(c: str) -> str:
    """The first word of the name of a letter, mark, number or punctuation sign, '' for others."""
    return re.split("[ -]", unicodedata.name(c, ""))[0] if unicodedata.category(c)[0] in "LMNP" else ""


def _readable(raw: bytes) -> list[tuple[int, int, str]]:
    """The stretches of a span that decode to what texts are written with: the scripts of
    ``_WRITTEN``, and any other one of which two letters or more stand together."""
    text = raw.decode("utf-8")
    listed = [_WRITTEN.match(c) is not None for c in text]
    scripts = ["" if known else _script(c) for c, known in zip(text, listed)]
    i = 0
    while i < len(text):
        if not scripts[i]:
            i += 1
            continue
        j = i
        while j < len(text) and (scripts[j] == scripts[i] or not listed[j] and text[j] in "\u200c\u200d\u200e\u200f"):
            j += 1
        if sum(unicodedata.category(c)[0] == "L" for c in text[i:j]) >= 2:
            listed[i:j] = [True] * (j - i)
        i = j
    out, at, start, buf = [], 0, 0, []
    for c, good in zip(text, listed):
        n = len(c.encode())
        if good:
            buf.append(c)
        else:
            if buf:
                out.append((start, at, "".join(buf)))
                buf = []
            start = at + n
        at += n
    if buf:
        out.append((start, at, "".join(buf)))
    return out


_RANK = {cp: i for i, cp in enumerate((*CODE_PAGES, *RARE_PAGES, *WIDE_PAGES))}
_cache: dict[tuple, list] = {}


def _cached(run: str, in_word: bool, known: str, before: str) -> list[tuple[int, int, str, str]]:
    if len(run) > 200:
        return _spans(run, in_word, known, before)
    key = (run, in_word, known, before.isupper())
    hit = _cache.get(key)
    if hit is None:
        if len(_cache) > 100_000:
            _cache.clear()
        hit = _cache[key] = _spans(run, in_word, known, before)
    return hit


def _cover(spans) -> dict[str, int]:
    """How many characters each code page explains."""
    cover: dict[str, int] = {}
    for a, b, _, cp in spans:
        cover[cp] = cover.get(cp, 0) + b - a
    return cover


def _restore_run(run: str, spans, votes: dict[str, int]) -> tuple[str, str]:
    """(restored run, code page): the page that explains most of the run decides, on a tie the
    one that explains most of the text, then the likelier one."""
    order = {cp: (-n, -votes[cp], _RANK[cp]) for cp, n in _cover(spans).items()}
    taken, chosen, used = [False] * len(run), [], ""
    for a, b, text, cp in sorted(spans, key=lambda s: (order[s[3]], s[0])):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            chosen.append((a, b, text))
            used = used or cp
    for a, b, text in sorted(chosen, reverse=True):
        run = run[:a] + text + run[b:]
    return run, used


_WESTERN = re.compile("(?<![A-Za-z\u0080-\U0010ffff])[\u00c0-\u00ff\u00a8\u00b8]+(?![A-Za-z\u0080-\U0010ffff])")


def _cyrillic_word(w: str) -> str | None:
    """The Cyrillic word that a run of Western accented letters stands for, if it reads as one."""
    for cp in CYRILLIC:
        c = w.encode("latin-1").decode(cp)
        if _RUSSIAN.fullmatch(c) and (c[1:].islower() or c.islower() or len(c) > 3 and c.isupper()) and _CYR_VOWEL.search(c):
            return c
    return None


def _cyrillic(text: str) -> str:
    """Text with the lines restored that hold Cyrillic words shown in Western letters."""
    long = [m for m in _WESTERN.finditer(text) if m.end() - m.start() >= 3 and _cyrillic_word(m[0])]
    if not (len(long) >= 2 or any(m.end() - m.start() >= 4 and not m[0].isupper() for m in long)):
        return text
    out, at = [], 0
    for m in long:
        if m.start() < at:
            continue
        lo = max(at, text.rfind("\n", 0, m.start()) + 1)
        hi = text.find("\n", m.end())
        hi = len(text) if hi < 0 else hi
        line = _WESTERN.sub(lambda w: _cyrillic_word(w[0]) or w[0].encode("latin-1").decode("cp1251"), text[lo:hi])
        out += [text[at:lo], line]
        at = hi
    return "".join([*out, text[at:]])


def restore(text: str) -> tuple[str, str]:
    """(restored text, what was found: code pages, ``cyrillic``, ``lost``, or '' for correct text)."""
    if text is None or text.isascii():
        return text, ""
    kinds: list[str] = []
    if (new := _cyrillic(text)) != text:
        text = new
        kinds.append("cyrillic")
    while True:
        known = "+".join(kinds)
        runs, votes = [], {}
        for m in _RUN.finditer(text):
            a, b = m.span()
            inside = text[a - 1 : a].isalpha() or text[b : b + 1].isalpha()
            if spans := _cached(m[0], inside, known, text[a - 1 : a]):
                runs.append((a, b, spans))
                for cp, n in _cover(spans).items():
                    votes[cp] = votes.get(cp, 0) + n
        if not runs:
            break
        out, at = [], 0
        for a, b, spans in runs:
            new, cp = _restore_run(text[a:b], spans, votes)
            if cp not in kinds:
                kinds.append(cp)
            out += [text[at:a], new]
            at = b
        text = "".join([*out, text[at:]])
    if "\ufffd" in text:
        kinds.append("lost")
    return text, "+".join(kinds)


def restore_column(df: DataFrame, key: Column, text: Column, found_only: bool = True) -> DataFrame:
    """(key, found, restored): what was found and the text with those places restored."""
    ship_package(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        from ledgerloom.llm.garble import restore

        for b in batches:
            rows = [restore(s) if s else (s, "") for s in b.column(1).to_pylist()]
            at = [i for i, r in enumerate(rows) if r[1] or not found_only]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([rows[i][1] for i in at], pa.string()), pa.array([rows[i][0] for i in at], pa.string())],
                names=["k", "found", "restored"],
            )

    src = df.select(key.alias("k"), text.alias("t"))
    return spread(src, "k").mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, found string, restored string")
