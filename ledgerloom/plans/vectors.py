"""Normalised events, byte for byte, and the hash their payload must have."""

from __future__ import annotations

import hashlib
import json

from ledgerloom.operators import extract
from ledgerloom.sources.definition import Definition
from ledgerloom.sources.lines import split_lines

TOOLS = {"write": "file.modified", "edit": "file.modified", "save": "file.modified", "read": "file.read", "bash": "command", "ignored": "ignored"}
CUES = ("we will", "must", "always", "never", "don't", "don’t")
_EDIT = '{"type":"tool","entry":0,"toolCallId":"edit-1","toolName":"write","path":"src/dispatch.ts","isError":false,"intent":"Update dispatch implementation","timestamp":null}'
_MERGE = '{{"type":"tool","entry":0,"toolCallId":"merge-{}","toolName":"{}","path":"src/shared.ts","isError":false,"intent":"{}","timestamp":null}}'
_WORDS = " ".join(f"word{i:03d}" for i in range(255))
# name: (transcript, hash)
VECTORS = {
    "empty": ("", "sha256:2c5acd200e147ebb7bde725fcd933bd6621dec38e11f391b39749d6863a90928"),
    "single-edit": (_EDIT, "sha256:b9cf32a31aaf1fe46efcb25be96cb302e95e08e25f09c86ae4b423440ab111fa"),
    "clock-env": (_EDIT, "sha256:b9cf32a31aaf1fe46efcb25be96cb302e95e08e25f09c86ae4b423440ab111fa"),
    "merge-order": (
        "\n".join(
            [
                _MERGE.format(1, "write", "write shared file"),
                _MERGE.format(2, "edit", "edit shared file"),
                _MERGE.format(3, "save", "save shared file"),
                _MERGE.format(4, "write", "write shared file again"),
                _MERGE.format(5, "edit", "edit shared file again"),
            ]
        ),
        "sha256:139a62efd219b1482da1920209ed2f55ccf715c266bcb58d7bc5689866323042",
    ),
    "unicode-nfc": (
        '{"type":"tool","entry":0,"toolCallId":"nfd","toolName":"write","path":"café.txt","isError":false,"timestamp":null}\n'
        '{"type":"tool","entry":1,"toolCallId":"nfc","toolName":"write","path":"café.txt","isError":false,"timestamp":null}',
        "sha256:f88faeef372c568263df02680913a22c0fc4abc43bc813c5ed6ec8b0f25c47f5",
    ),
    "paths-outside": (
        '{"type":"tool","entry":0,"toolCallId":"outside-1","toolName":"write","path":"/outside/private/report.md","isError":false,"timestamp":null}\n'
        '{"type":"tool","entry":1,"toolCallId":"inside-1","toolName":"write","path":"src/local.ts","isError":false,"timestamp":null}\n'
        '{"type":"tool","entry":2,"toolCallId":"outside-2","toolName":"write","path":"/other/private/notes.md","isError":false,"timestamp":null}',
        "sha256:34da1ce9fea0c50ab326be45b0cd31458819dff49346e8bcd4e3790da741e9e5",
    ),
    "error-cycle": (
        '{"type":"tool","entry":0,"toolCallId":"error-1","toolName":"bash","command":"npm test","isError":true,"errorMessage":"permission denied","timestamp":null}\n'
        '{"type":"tool","entry":1,"toolCallId":"error-2","toolName":"bash","command":" npm   test ","isError":false,"timestamp":null}',
        "sha256:076c2fbaab8ba9a6b25edc5a9eb9c5e9b88b3bb981402a4d0892cacd347cf5df",
    ),
    "unknown-tool": (
        '{"type":"tool","entry":0,"toolCallId":"unknown-1","toolName":"mystery-tool","command":"echo hidden","isError":false,"timestamp":null}',
        "sha256:7623ea6fd5a7bfb60e6faba3a51e4d6df95f397a40ebcea2aed27f9ff7155c8b",
    ),
    "crlf": (
        '{"type":"tool","entry":0,"toolCallId":"crlf-1","toolName":"write","path":"src/line-endings.ts","isError":false,"timestamp":null}\r\n'
        '{"type":"ignored","entry":1,"toolCallId":"crlf-ignored","reason":"line-ending twin sentinel","timestamp":null}',
        "sha256:09561ebcc80fccc744f8b3f42dfb3eb3482f20ddc991491ac89bb227bf60a40c",
    ),
    "huge-command": (
        f'{{"type":"tool","entry":0,"toolCallId":"huge-1","toolName":"bash","command":"printf {_WORDS} x","isError":false,"timestamp":null}}',
        "sha256:cfd3500d81f6a3385d0bbe1a670f89430e682a6e96c44d70d3927811ca03a94a",
    ),
}
_EVENTS = "session string, entry long, line long, block int, sub int, type string, ts string, name string, path string, command string, intent string, is_error boolean, error string"


def payloads(spark, parts: int = 3, flip: bool = False):
    """(session, hash, ...) of all vectors through the engine, in any layout."""
    events, config, lines = [], [], []
    for name, (raw, _) in VECTORS.items():
        inside = name != "paths-outside"
        cwd = "/workspace/repo" if inside else "/workspace/repo/work"
        config.append((name, cwd, cwd if inside else None, "repo" if inside else "cwd", [(cwd, "repo")] if inside else []))
        for i, line in enumerate(split_lines(raw.encode())):
            e = json.loads(line)
            lines.append((name, i + 1, "sha256:" + hashlib.sha256(line).hexdigest()))
            events.append((name, e["entry"], i + 1, 0, 0, e["type"], e["timestamp"], e.get("toolName"), e.get("path"), e.get("command"), e.get("intent"), e.get("isError"), e.get("errorMessage")))
    if flip:
        events.reverse()
        lines.reverse()
    d = Definition(tools=TOOLS, prefixes=(), cues=CUES)
    x = extract.Extraction(spark.createDataFrame(events, _EVENTS).repartition(parts), spark.createDataFrame(config, extract.CONFIG), d)
    return x.payloads(spark.createDataFrame(lines, "session string, line long, sha256 string"))
