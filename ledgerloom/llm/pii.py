"""Personal information inside free text (problem 3).

Generators propose spans with high recall, overlapping and of several kinds at once: every run
of capitalised words, every group of digits, everything with the mark of an e-mail address or
the shape of an address.  Each candidate is described by its format (digit groups, separators,
capitals, known name words, words that a public tokenizer's vocabulary has in lower case) and
its context (cue words before and after, place in a path); boosted trees, one model for each
kind, turn that into a calibrated probability, and the kind's threshold selects.  Of
overlapping selections the stronger kind wins, so a name inside an address or an e-mail
address is no name.

Defined results: null, empty and blank texts hold nothing; content that is no JSON is read
as plain text; blocks without a string of text are passed on as they are; the rest of each
text, and the JSON around it, stays as it was but for spacing between tokens.
"""

from __future__ import annotations

import functools
import json
import os
import re

from pyspark.sql import Column, DataFrame

from ledgerloom.runtime import ship_package, spread

#: a public tokenizer's vocabulary, read on the driver; what is used of it is broadcast (at most its 50,000 entries)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("email", "address", "phone", "idnum", "name")
PLACEHOLDER = {"email": "[EMAIL]", "address": "[ADDRESS]", "phone": "[PHONE]", "idnum": "[ID]", "name": "[NAME]"}

# ---------------------------------------------------------------- generators

_AT = r"(?:@|%40|＠|&#64;|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)"
_EMAILS = [
    re.compile(rf"[\w.+%'-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)*", re.I),
    re.compile(r"[\w.+-]*\w at [\w-]+(?: dot [\w-]+)+", re.I),
]
_EMAIL_TRIGGER = re.compile(r"@|%40|＠|&#64;|[\[({<]\s?at\s?[\])}>]| dot ", re.I)
_NUMBERS = [
    re.compile(r"\+\d[\d ().-]{6,17}\d(?:\s?(?:ext|x)\b\.?\s?\d{1,5})?"),
    re.compile(r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ .-]?\d{4}(?!\d)"),
    re.compile(r"\+\d{2}(?: \d{4} \d{6}| \d(?: \d{2}){4})(?!\d)"),
    re.compile(r"(?<![\w.])00\d{1,3}[ .-]\d[\d .-]{5,13}\d"),
    re.compile(r"\(\+?\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}"),
    re.compile(r"(?<![\w.-])(?:1[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\d)(?:\s?(?:ext|x)\b\.?\s?\d{1,5})?"),
    re.compile(r"(?<![\w.-])\d{3}[ -]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{6,8}-\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{2,3}(?: \d{2,4}){2,4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{2,8}(?:-\d{1,8}){1,4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{4,5}(?: \d{3,6}){1,3}(?![\w-])"),
    re.compile(r"(?<![\w.-])[A-Z]{1,3}[- ]?\d{5,10}(?:-?[A-Z0-9]{1,3})?(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{7,14}(?![\w-])"),
    re.compile(r"(?<![\w.+-])\d{2,4}(?:[/.-]\d{2,6}){1,3}(?![\w-])"),
    re.compile(r"(?<![\w.+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{2,4}(?![\w-])"),
    re.compile(r"(?<![\w.+-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![\w-])"),
    re.compile(r"(?<![\w.+-])(?:[A-Z]{3,6}\d{2,6}[A-Z0-9]{1,10}|\d{8}[A-Z]|[A-Z]\d{2}[A-Z]\d{5})(?![\w-])"),
    re.compile(r"\+\d{9,14}(?!\d)"),
]
_GROUP = re.compile(r" \d+")
_NUMBER_TRIGGER = re.compile(r"\d[\d ()/.-]{5,}\d|[A-Z][- ]?\d{2}")
_STREET = (
    r"Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Row|Bend|Way|Place|Pl|Square|Sq|Terrace|Close|Crescent|Boulevard|Blvd|"
    r"Hill|Walk|Gardens|Grove|Mews|Park|Parade|Quay|Alley|Yard|Path"
)
_CAP = r"[A-ZÀ-Þ][\w'’-]+"
_ADDRESSES = [
    re.compile(rf"(?:(?:Flat|Apt|Unit|Suite)\.? \w{{1,5}}, )?(?<!\d)\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{0,3}}(?:{_STREET})\b\.?(?: (?:Apt|Flat|Unit|Suite)\.? \w{{1,5}})?(?:,? \d{{4,6}} {_CAP}| *[,\n] *{_CAP}(?: {_CAP})?(?:, [A-Z]{{2}} \d{{4,6}})?)?"),
    re.compile(r"\b[A-Z]\w+(?:gasse|strasse|straße|weg|platz|allee|gata|laan|straat) \d{1,4}[a-z]?\b(?:, \d{4,6} [A-Z]\w+(?: [A-Z]\w+)?)?"),
    re.compile(r"(?<!\d)\d{1,4},? (?:rue|avenue|av\.|boulevard|place|chemin|via|calle|rua|plaza)(?: (?:de|des|du|la|le|del|da|do|di))* [A-Z]\w+(?: [A-Z]\w+)?(?:, \d{4,6} [A-Z]\w+(?: [A-Z]\w+)?)?"),
    re.compile(r"\b(?:P\.? ?O\.? ?Box|Postfach|Post Office Box) \d{1,6}\b(?:, [A-Z]\w+(?: [A-Z]\w+)?)?", re.I),
    re.compile(rf"{_CAP}(?: {_CAP})?, [A-Z]{{2}} \d{{5}}\b"),
    re.compile(rf"(?<![\d.-])\d{{1,5}} {_CAP}(?: {_CAP})?, \d{{4,6}} {_CAP}(?: {_CAP})?"),
    re.compile(rf"(?<!\d)\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_STREET})\b\.?,? {_CAP}(?: {_CAP})?,? [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}\b"),
    re.compile(rf"(?:{_CAP} |(?:den|der|dem|die|am|an|im|zum|zur|de|del|la) ){{1,4}}\d{{1,4}}[a-z]?, \d{{4,6}} {_CAP}(?: {_CAP})?"),
]
# what each of these patterns needs at least; a text without any of it holds no match
_ADDRESS_TRIGGER = re.compile(r"\d[A-Za-z]?,? (?:[A-ZÀ-Þ]|rue|av|boul|place|chemin|via|calle|rua|plaza)|(?i:box|postfach) \d|(?:gasse|strasse|straße|weg|platz|allee|gata|laan|straat) \d|, [A-Z]{2} \d{5}|\d[a-z]?, \d{4,6} [A-ZÀ-Þ]")
_WORD = r"[A-ZÀ-Þ][a-zß-ÿĀ-ſ'’]+|[A-ZÀ-Þ]{3,}"
_NAME = re.compile(rf"(?:(?:[A-Z]\. ){{1,2}})?(?:{_WORD})(?:-(?:{_WORD}))*(?:, (?:{_WORD})(?:-(?:{_WORD}))*| (?:[A-Z]\.(?![\w.])|(?:{_WORD})(?:-(?:{_WORD}))*)){{0,2}}")
_TITLE = re.compile(r"\b(?:dr|mr|mrs|ms|miss|prof|sir|madam|herr|frau|mme)\.? $", re.I)
_PERSON_CUE = re.compile(
    r"(?:\b(?:thanks to|thank|thanks,?|ask|asked|cc|cc:|by|blame:?|owner is|owner:?|manager:?|colleague|behalf of|author:?|assigned to|reviewer:?|contact:?|ping|told|met|meeting with|interview with|spoke to|according to"
    r"|from|dear|hi|hello|regards,?|cheers,?|signed,?|name is|i am|i'm|this is|patient,?|passenger|customer|client|employee|invite|contract with|note from|said|born)\s"
    r"|-by: ?|\bblame: )$",
    re.I,
)
_PERSON_AFTER = re.compile(r"\s(?:wrote|signed|asked|said|says|reviewed|approved|reported|will|has|is on|to look|and team|and the team|can|knows|called|joined|teaches|agreed|left|about it)\b|'s\b|,? (?:who|whose)\b", re.I)
_FIRST = re.compile(r"\S+\s+")
#: words that begin sentences; alone they are no candidates
_SMALL = frozenset(
    "the a an this that these those it its he she they we you i my your our their his her in on at by for from to of with without and or but if when while where what which who why how is are was were be been do does did "
    "not no yes so then than there here all any each some as please can could should would will may might must has have had let see use run add set get fix check update".split()
)
_LOWER = re.compile(r"(?<![\w./@-])[a-z][a-z'’-]+(?![\w@/.]\w|[\w@/])")
_SEGMENT = re.compile(r"[^/\\]+")

# ---------------------------------------------------------------- context

_PHONE_CUE = re.compile(r"\b(?:tel|phone|telephone|call|reach|reachable|reached|contact number|number is|pager|mobile|cell|fax|dial|sms|whatsapp|text me|ring|hotline|on-call)\b", re.I)
_ID_CUE = re.compile(r"\b(?:ssn|social security|passport|national id|national insurance|nino|tax id|tin|tax number|licen[cs]e|identity|id card|id number|personal number|citizen|soc\. sec\.|steuer|aadhaar|sin|nif|dni|cpf)\b", re.I)
_OTHER_CUE = re.compile(r"\b(?:ports?|checksum|part|run|build|row|column|epoch|ticket|version|commit|serial|order|invoice no|ref|sha|hash|line|took|port|sku|batch|uid|pid|offset|size|range|bytes|timestamp|job|release|model)\b", re.I)
_ADDRESS_CUE = re.compile(r"\b(?:address|lives? at|living at|lives on|ship|bill|billing|addr|parcel|deliveries|office|deliver|delivered|mail(?:ed)? to|send|residence|resides?|home|located|registered|moved to|return to|visit|at)\b", re.I)
_OTHER_AFTER = re.compile(r"^\W{0,3}(?:of|ms|differs|belong|is in|left|took|to \d|checks|kb|mb|seconds|bytes|rows|pass)\b|^:\d", re.I)
_EMAIL_CUE = re.compile(r"\b(?:contact|write|mail|e-?mail|mailto|user|account|login|invite|message|author|from|to|reply|address|reach|by)\b", re.I)
_SERVICE = re.compile(r"(?:^|[._+-])(?:no-?reply|do-?not-?reply|bots?|svc|service|ci|build|deploy|jenkins|admin|root|git|postmaster|daemon|notifications?|alerts?|support|runner|cron|webhook)(?:$|[._+-])", re.I)
_HOMES = frozenset("home homes users user files people staff export profiles mail personal accounts employees members documents".split())
_NOBODY = frozenset("shared public default guest admin root build runner agent deploy jenkins service svc ci user users all everyone common local work code src repo repos checkout tmp data var opt srv usr team staff ubuntu app apps builder developer dev deployer tester operator worker vagrant docker debian centos postgres www daemon nobody backup".split())

FEATURES = (
    "digits groups g1 g2 g3 g4 space dot hyphen paren plus zero2 zero1 ext letters_before letters_after "
    "phone_cue id_cue other_cue other_after address_cue email_cue in_path length capitals words at_sign obfuscated tld "
    "domain_digits service street postcode box flat given surname known initial comma upper hyphenated person_cue person_after "
    "sentence_start the_after home segment_last nobody camel lower near_number cue_at "
    "ordinary proper first_ordinary last_ordinary lower_twin title slash mixed_code postcode_uk"
).split()
_F = {n: i for i, n in enumerate(FEATURES)}


def candidates(text: str, path: bool, names: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that might be personal; spans may overlap."""
    out: list[tuple[int, int, str]] = []
    if _EMAIL_TRIGGER.search(text):
        for p in _EMAILS:
            out += [(m.start(), m.end(), "email") for m in p.finditer(text)]
    if _NUMBER_TRIGGER.search(text):
        seen = set()
        for p in _NUMBERS:
            for m in p.finditer(text):
                ends = [m.end()]
                if m[0].count(" ") > 2:  # the last groups may belong to what follows
                    ends += [m.start() + g.start() for g in list(_GROUP.finditer(m[0]))[-2:] if m[0][: g.start()].count(" ") > 1]
                for end in ends:
                    if (m.start(), end) not in seen:
                        seen.add((m.start(), end))
                        out += [(m.start(), end, "phone"), (m.start(), end, "idnum")]
    if path:
        for m in _SEGMENT.finditer(text):
            ws = _tokens(m[0])
            before = _SEGMENT.findall(text[: m.start()])
            if any(w in names for w in ws) or before and before[-1].lower() in _HOMES:
                out.append((m.start(), m.end(), "name"))
            if _ADDRESS_TRIGGER.search(m[0]):
                for p in _ADDRESSES:
                    out += [(m.start() + x.start(), m.start() + x.end(), "address") for x in p.finditer(m[0])]
        return out
    if _ADDRESS_TRIGGER.search(text):
        for p in _ADDRESSES:
            out += [(m.start(), m.end(), "address") for m in p.finditer(text)]
    for m in _NAME.finditer(text):
        a, b = m.span()
        span = m[0]
        ws = [w.lower() for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", span)]
        known = any(w in names or any(x in names for x in w.split("-")) for w in ws)
        if known or len(ws) > 1 or ws and ws[0] not in _SMALL:
            out.append((a, b, "name"))
            # a sentence's first word is not part of the name behind it
            if len(ws) > 2 or (len(ws) == 2 and ws[0] not in names):
                c = a + len(m2[0]) if (m2 := _FIRST.match(span)) else a
                if c > a:
                    out.append((c, b, "name"))
    last = None
    for m in _LOWER.finditer(text):
        if last and m.start() == last.end() + 1 and text[last.end()] == " ":
            if last[0] in names and m[0] in names or text[max(0, last.start() - 4) : last.start()].lower() in ("cc: ", " cc ", "cc ", "\ncc "):
                out.append((last.start(), m.end(), "name"))
        last = m
    return out


def _tokens(s: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[^\W\d_A-Z]+(?:-[A-Z][^\W\d_A-Z]+)?|[A-Z]+", s)] + ([s.lower()] if "-" in s else [])


def word_list(path: str = VOCABULARY) -> tuple[frozenset, frozenset]:
    """(ordinary, proper): the words that a public vocabulary has in lower case, and those it
    has with a capital only."""
    import base64

    lower, capital = set(), set()
    with open(path, "rb") as f:
        for line in f:
            w = base64.b64decode(line.split()[0])
            if w[:1] == b" " and len(w) > 3 and w[1:].isalpha():
                t = w[1:].decode("ascii", "ignore")
                if t.islower():
                    lower.add(t)
                elif t.istitle():
                    capital.add(t.lower())
    return frozenset(lower), frozenset(capital - lower)


@functools.lru_cache(maxsize=8)
def _lower_words(text: str) -> frozenset:
    """The words of a text that stand there in lower case."""
    return frozenset(w for w in _ANY_WORD.findall(text) if w.islower())


def features(text: str, a: int, b: int, kind: str, path: bool, names: dict[str, str], words: tuple[frozenset, frozenset]) -> list[float]:
    span = text[a:b]
    before, after = text[max(0, a - 32) : a], text[b : b + 16]
    cut = max(before.rfind(". "), before.rfind("; "), before.rfind("\n"))
    near = before[cut + 1 :] if cut >= 0 and not re.search(r"\b(?:no|dr|mr|ms|st|ext)\.$", before[: cut + 1], re.I) else before
    if (m := _NUMBER_BEFORE.search(near)) is not None:  # words before another number belong to that
        near = near[m.start() + 1 :]
    f = [0.0] * len(FEATURES)
    groups = re.findall(r"\d+", span) if kind != "email" else []
    f[0], f[1] = float(sum(map(len, groups))), float(len(groups))
    for i, g in enumerate(groups[:4]):
        f[2 + i] = float(len(g))
    f[6], f[7], f[8], f[9], f[10] = float(span.count(" ")), float(span.count(".")), float(span.count("-")), float("(" in span), float(span[:1] == "+" or span[:2] == "(+")
    f[11], f[12] = float(span[:2] == "00"), float(span.lstrip("(")[:1] == "0")
    f[13] = float(re.search(r"\b(?:ext|x)\b", span) is not None or after.lstrip()[:3] == "ext")
    if kind in ("phone", "idnum"):
        f[14] = float(len(_LETTERS_AT.match(span)[0]))
        f[15] = float(len(_LETTERS_END.search(span)[0]))
        f[_F["slash"]] = float(span.count("/"))
        f[_F["mixed_code"]] = float(_MIXED.search(span) is not None)
    # the cue nearest to the span decides between kinds
    at = {}
    for i, p in ((16, _PHONE_CUE), (17, _ID_CUE), (18, _OTHER_CUE), (20, _ADDRESS_CUE), (21, _EMAIL_CUE)):
        last = None
        for last in p.finditer(near):
            pass
        if last:
            at[i] = last.end()
            f[i] = 1.0
    if at:
        f[_F["cue_at"]] = float(max(at, key=at.get))
    f[19] = float(_OTHER_AFTER.search(after) is not None)
    f[22], f[23] = float(path), 0.0 if kind == "email" else float(b - a)
    ws = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", span)
    f[24], f[25] = float(sum(w[0].isupper() for w in ws)), float(len(ws))
    if kind == "email":
        f[26] = float("@" in span)
        f[27] = float("@" not in span)
        local, _, domain = re.sub(_AT, "@", span, count=1, flags=re.I).partition("@")
        domain = re.sub(_DOT, ".", domain, flags=re.I)
        tail = domain.rpartition(".")[2] if "." in domain or " dot " in span else ""
        f[28] = float(len(tail) >= 2 and tail.isalpha())
        f[29] = float(sum(c.isdigit() for c in domain))
        f[30] = float(_SERVICE.search(local.strip().partition("+")[0]) is not None)
    elif kind == "address":
        f[31] = float(re.search(rf"\b(?:{_STREET})\b|(?:gasse|strasse|straße|weg|platz|allee|gata|laan|straat) \d|\b(?:rue|avenue|boulevard|chemin|calle|rua|via|plaza)\b", span) is not None)
        f[32] = float(re.search(r"\b\d{4,6}\b", span[1:]) is not None)
        f[33] = float(re.search(r"box|postfach", span, re.I) is not None)
        f[34] = float(re.search(r"\b(?:flat|apt|unit|suite)\b", span, re.I) is not None)
        f[_F["postcode_uk"]] = float(_UK.search(span) is not None)
    elif kind == "name":
        low = _tokens(span) if path else [x for w in ws for x in ({w.lower(), *w.lower().split("-")})]
        kinds = [names.get(w) for w in low]
        f[35], f[36] = float(kinds.count("given")), float(kinds.count("surname"))
        f[37] = float(sum(k is not None for k in kinds)) / max(1, len(low))
        f[38] = float(re.search(r"\b[A-Z]\.(?!\w)", span) is not None)
        f[39], f[40], f[41] = float("," in span), float(span.isupper() or bool(ws) and ws[0].isupper() and len(ws[0]) > 2), float("-" in span)
        f[_F["title"]] = float(_TITLE.search(before) is not None)
        f[42] = float(_PERSON_CUE.search(before[-24:]) is not None)
        known, capital = words
        plain = [w.lower() in known for w in ws]
        f[_F["ordinary"]] = sum(plain) / max(1, len(ws))
        f[_F["proper"]] = sum(w.lower() in capital for w in ws) / max(1, len(ws))
        if ws:
            f[_F["first_ordinary"]], f[_F["last_ordinary"]] = float(plain[0]), float(plain[-1])
            if not path:
                twins = _lower_words(text)
                f[_F["lower_twin"]] = float(any(w.lower() in twins for w in ws if not w.islower()))
        f[43] = float(_PERSON_AFTER.match(after) is not None)
        f[44] = float(before.rstrip(" -") == "" or before.rstrip(" ")[-1:] in ".!?\n;:")
        f[45] = float(re.match(r"\s(?:the|a|an|access|keeps|and)\b", after) is not None)
        f[50] = float(span.islower())
        if path:
            seg = _SEGMENT.findall(text[:a])
            f[46] = float(bool(seg) and seg[-1].lower() in _HOMES)
            f[47] = float(not after.strip("/\\"))
            f[48] = float(any(w in _NOBODY for w in low))
            f[49] = float(re.search(r"[a-z][A-Z]", span) is not None)
        f[51] = float(re.match(r"(?:, [A-Z]{2})? \d{4,6}\b|,? [A-Z]{2} \d", after) is not None or re.search(r"\d[,\s]+$", before) is not None)
    return f


_NUMBER_BEFORE = re.compile(r"\d[^\d]*[A-Za-z]{2}[^\d]*$")
_ANY_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LETTERS_AT, _LETTERS_END = re.compile(r"[A-Za-z]*"), re.compile(r"[A-Za-z]*$")
_MIXED = re.compile(r"\d[A-Z]+\d|[A-Z]\d[A-Z]")
_UK = re.compile(r"\b[A-Z]{1,2}\d[\dA-Z]? \d[A-Z]{2}\b")

# ---------------------------------------------------------------- selection

_models: dict = {}


def models(path: str | None = None) -> dict:
    """The trained models, read once for each Python process."""
    if path not in _models:
        if path is None:
            from importlib.resources import files

            text = (files("ledgerloom.llm") / "pii_model.json").read_text()
        else:
            with open(path) as fh:
                text = fh.read()
        _models[path] = json.loads(text)
    return _models[path]


def score(texts: list[tuple[str, bool]], names: dict[str, str], model: dict, words: tuple[frozenset, frozenset]) -> list[list[tuple[int, int, str, float]]]:
    """For each (text, is it a path): the selected (start, end, kind, probability), in order."""
    import numpy as np

    from ledgerloom.llm.boosting import probability

    by: dict[str, list] = {k: [] for k in KINDS}
    for i, (t, path) in enumerate(texts):
        if t and not t.isspace():
            for a, b, kind in candidates(t, path, names):
                by[kind].append((i, a, b, features(t, a, b, kind, path, names, words)))
    hits: list[list] = [[] for _ in texts]
    for kind, rows in by.items():
        if rows:
            p = probability(model[kind], np.array([r[3] for r in rows]))
            for (i, a, b, _), q in zip(rows, p.tolist()):
                if q >= model[kind]["threshold"]:
                    hits[i].append((KINDS.index(kind), -q, a, b))
    out = []
    for h in hits:
        taken: list[tuple[int, int, str, float]] = []
        # of one kind, the longest of the about equally likely spans; an e-mail address or a street wins over what it contains; phone and number by probability
        h = [x for x in h if not any(y[0] == x[0] and y[2] <= x[2] and x[3] <= y[3] and y[3] - y[2] > x[3] - x[2] and y[1] <= x[1] + 0.01 for y in h)]
        for k, q, a, b in sorted(h, key=lambda x: (min(x[0], 2) if x[0] < 4 else 3, x[1], x[2])):
            if all(b <= c or a >= e for c, e, _, _ in taken):
                taken.append((a, b, KINDS[k], -q))
        text = texts[len(out)][0]
        out.append(sorted((a, _name_end(text, a, b, names) if k == "name" else b, k, q) for a, b, k, q in taken))
    return out


_LAST = re.compile(r"^(.*\S)\s+(\S+)$", re.S)


def _name_end(text: str, a: int, b: int, names: dict[str, str]) -> int:
    """Where a name of three words or more ends: before a last word that is no known name,
    follows one that is, and begins the sentence behind (a small word comes next)."""
    m = _LAST.match(text[a:b])
    if not m or len(m[1].split()) < 2 or m[2].lower() in names or not re.match(r" [a-z]", text[b : b + 2]):
        return b
    return a + m.end(1) if m[1].split()[-1].strip(",").lower() in names else b


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    for a, b, kind, _ in reversed(spans):
        text = text[:a] + PLACEHOLDER[kind] + text[b:]
    return text


def free_texts(content: str | None) -> tuple[object, list[tuple[str, object, object]]]:
    """(the parsed content, [(field, holder, key)]) of the free texts of a message."""
    if content is None:
        return None, []
    try:
        v = json.loads(content)
    except (ValueError, RecursionError):
        v = content
    root = [v]
    if isinstance(v, str):
        return root, [("content", root, 0)]
    out: list[tuple[str, object, object]] = []
    for x in v if isinstance(v, list) else [v]:
        if not isinstance(x, dict):
            continue
        if x.get("type") == "text" and isinstance(x.get("text"), str):
            out.append(("content", x, "text"))
        elif x.get("type") == "tool_result":
            c = x.get("content")
            if isinstance(c, str):
                out.append(("result", x, "content"))
            for y in c if isinstance(c, list) else [c] if isinstance(c, dict) else ():
                if isinstance(y, dict) and isinstance(y.get("text"), str):
                    out.append(("result", y, "text"))
    return root, out


def _scan(names: dict[str, str], shared, model_path: str | None, found: bool):
    def run(batches):
        import pyarrow as pa

        from ledgerloom.llm.pii import free_texts, models, redact, score

        model, words = models(model_path), shared.value
        clean = lambda s: s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()
        for b in batches:
            ids, cwds, contents = (b.column(i).to_pylist() for i in range(3))
            texts: list[tuple[str, bool]] = []
            where: list[tuple[int, str, object, object]] = []
            roots = []
            for i, (cwd, content) in enumerate(zip(cwds, contents)):
                if cwd:
                    texts.append((cwd, True))
                    where.append((i, "cwd", None, None))
                root, parts = free_texts(content)
                roots.append(root)
                for field, holder, key in parts:
                    texts.append((holder[key], False))
                    where.append((i, field, holder, key))
            once = list(dict.fromkeys(texts))  # folders and repeated texts are read once a batch
            known = dict(zip(once, score(once, names, model, words)))
            spans = [known[t] for t in texts]
            if found:
                rows = {(i, f, k): None for (i, f, _, _), s in zip(where, spans) for _, _, k, _ in s}
                at = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["rec_id", "field", "kind"],
                )
            else:
                n, changed = [0] * len(ids), [False] * len(ids)
                for (i, f, holder, key), (t, _), s in zip(where, texts, spans):
                    n[i] += len(s)
                    if s and f == "cwd":
                        cwds[i] = redact(t, s)
                    elif s:
                        holder[key] = redact(t, s)
                        changed[i] = True
                done = [json.dumps(roots[i][0], ensure_ascii=False, separators=(",", ":")) if c else contents[i] for i, c in enumerate(changed)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(map(clean, cwds), pa.string()), pa.array(map(clean, done), pa.string()), pa.array(n, pa.int32())],
                    names=["rec_id", "cwd", "content", "redactions"],
                )

    return run


def _lexicon(lexicon: DataFrame, max_words: int = 1_000_000) -> dict[str, str]:
    """The known name words; a list of names is bounded by ``max_words``, which is checked."""
    rows = lexicon.select("token", "kind").where("token is not null").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} name words")
    return {r.token.lower(): r.kind or "" for r in sorted(rows, key=lambda r: (r.token, r.kind or ""), reverse=True)}


def find(df: DataFrame, rec_id: Column, cwd: Column, content: Column, lexicon: DataFrame, model_path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(rec_id, field, kind): what each row holds."""
    ship_package(df.sparkSession)
    src = df.select(rec_id.alias("rec_id"), cwd.alias("cwd"), content.alias("content")).where("cwd is not null or content is not null")
    return spread(src, "rec_id").mapInArrow(_scan(_lexicon(lexicon), df.sparkSession.sparkContext.broadcast(word_list(vocabulary)), model_path, True), f"rec_id {src.schema['rec_id'].dataType.simpleString()}, field string, kind string")


def redacted(df: DataFrame, rec_id: Column, cwd: Column, content: Column, lexicon: DataFrame, model_path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(rec_id, cwd, content, redactions): the texts with typed placeholders, all rows."""
    ship_package(df.sparkSession)
    src = df.select(rec_id.alias("rec_id"), cwd.alias("cwd"), content.alias("content"))
    return spread(src, "rec_id").mapInArrow(_scan(_lexicon(lexicon), df.sparkSession.sparkContext.broadcast(word_list(vocabulary)), model_path, False), f"rec_id {src.schema['rec_id'].dataType.simpleString()}, cwd string, content string, redactions int")


MODEL_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_model.json")
