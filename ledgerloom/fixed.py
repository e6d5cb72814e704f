"""Fixed values of the transcript format and the fact vocabulary."""

# fact kinds and their display order
PRIORITY = {
    "decision.stated": 5,
    "error.raised": 10,
    "error.fixed": 15,
    "file.created": 20,
    "file.deleted": 20,
    "file.modified": 30,
    "cmd.failed": 40,
    "cmd.run": 50,
    "file.read": 60,
    "todo.state": 70,
    "plan.state": 70,
    "git.state": 80,
    "note": 90,
}
TITLES = {
    5: "Decisions",
    10: "Errors",
    15: "Error fixes",
    20: "File lifecycle",
    30: "File changes",
    40: "Failed commands",
    50: "Commands",
    60: "Reads",
    70: "Todo and plan",
    80: "Git state",
    90: "Notes",
}
ADAPTERS = ("claude", "codex", "omp", "generic")
SCOPES = ("repo", "cwd", "granted", "external", "uri")
SCOPE_RANK = {"repo": 0, "cwd": 1, "granted": 2}

# error classes by the prefixes of the lower-case message, first match wins
ERROR_CLASSES = (
    ("permission", ("permission", "eacces", "eperm", "access denied", "not permitted")),
    ("not_found", ("not found", "enoent", "no such file", "cannot find")),
    ("timeout", ("timeout", "timed out", "deadline exceeded")),
    ("connection", ("connection", "connect", "econn", "network", "socket", "refused")),
    ("syntax", ("syntax", "parse error", "unexpected token")),
    ("type", ("typeerror", "type error", "invalid type")),
    ("assertion", ("assertion", "assert")),
    ("quota", ("quota", "rate limit", "too many requests")),
    ("conflict", ("conflict", "already exists", "eexist")),
    ("cancelled", ("cancel", "cancelled", "aborted", "abort", "interrupt")),
)
URI_SCHEMES = frozenset(("xd", "skill", "ssh", "http", "https", "ftp", "sftp", "git"))
PLAIN_PREFIXES = frozenset(("enoent", "error", "fatal", "warning", "permission"))

# record vocabulary and tool kinds of the agent's JSON lines
CONVERSATIONAL = ("user", "assistant", "system")
NON_CONVERSATIONAL = (
    "attachment",
    "queue-operation",
    "mode",
    "permission-mode",
    "last-prompt",
    "custom-title",
    "ai-title",
    "file-history-snapshot",
    "file-history-delta",
    "atis-latch",
    "summary",
    "compact-boundary",
)
TOOL_KINDS = {
    "Bash": "command",
    "Read": "file.read",
    "Write": "file.modified",
    "Edit": "file.modified",
    "TaskCreate": "todo",
    "TaskUpdate": "todo",
    "AskUserQuestion": "ignored",
    "ToolSearch": "ignored",
    "Agent": "ignored",
    "WebFetch": "ignored",
    "ListAgents": "ignored",
    "Artifact": "ignored",
    "TaskList": "ignored",
    "Skill": "ignored",
    "ScheduleWakeup": "ignored",
    "ExitPlanMode": "ignored",
}
TOOL_PREFIXES = (("mcp__", "ignored"),)
CUES = ("we will", "we must", "must", "always", "never", "don't", "do not", "instead")
DEGRADED = (
    "ok",
    "schema-drift",
    "extraction-empty",
    "provenance-broken",
    "budget-exceeded",
    "internal-error",
    "unavailable:agent-not-installed",
    "unavailable:store",
    "untrusted:hook-pending-review",
    "no-pre-compaction-hook",
)

# limits
PACK_BYTES = 16_384
KEEP_SNAPSHOTS = 15
KEEP_MS = 72 * 3_600_000
USAGE_PPM = 660_000
EVIDENCE = 5
COMMAND_CHARS = 512
SIGNATURE_CHARS = 200
SENTENCE_CHARS = 200
