"""Rule scans over text and recall scoring: counts of pattern hits, phrases against answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import score_text

# fixed values: what must not be published, as patterns
_A, _Z = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # word bounds that do not depend on the JVM
RULES = {
    "posix-home-path": r"(?:/Users|/home)/[A-Za-z0-9._-]+",
    "windows-user-path": _A + r"[A-Za-z]:\\+Users\\+[^\\\s\"'`]+",
    "session-uuid": r"(?i)" + _A + r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}" + _Z,
    "bearer-token": r"(?i)" + _A + r"Bearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "api-key": _A + r"(?:sk-|gsk_|hf_|pypi-|npm_|ghp_|gho_|ghu_|ghs_|github_pat_|glpat-|dckr_pat_|xox[abpros]-|AKIA|ASIA|AIza|ya29\.)[A-Za-z0-9_-]{16,}",
    "email-address": _A + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}" + _Z,
}


#: a host label shorter than this would match ordinary prose
LEAST_LABEL = 4


def identity_rules(account: str, host: str) -> dict[str, str]:
    """Rules for one account and host, only where the text around them names an identity."""
    import re

    label = host.partition(".")[0] if "." in host else ""
    edge, start = "(?![A-Za-z0-9._-])", "(?<![A-Za-z0-9._-])"
    q = lambda s: "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in s)
    rules = {}
    if account:
        rules["local-user-name"] = rf"(?i)(?:~|/Users/|/home/|[A-Za-z]:\\+Users\\+|\\){q(account)}{edge}|{_A}{q(account)}@"
    for name, value, least in (("local-host-name", host, 1), ("local-host-label", label, LEAST_LABEL)):
        if len(value) >= least:
            rules[name] = rf"(?i)(?:@|\\){q(value)}{edge}|{start}{q(value)}(?=[:/\\])"
    assert all(re.compile(r) for r in rules.values())
    return rules


# fixed values: what no file of a publication may hold
FILE_RULES = {
    "macOS home path": r"/Users/[A-Za-z0-9._-]+/",
    "Linux home path": r"/home/[A-Za-z0-9._-]+/",
    "Windows user path": r"[A-Za-z]:\\Users\\[^\\\s]+\\",
    "session UUID": r"(?i)" + _A + r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}" + _Z,
    "bearer token": r"(?i)" + _A + r"Bearer\s+[A-Za-z0-9._~+/=-]{8,}",
    "API token prefix": _A + r"(?:sk-|ghp_|github_pat_)[A-Za-z0-9_-]{8,}",
    "email address": r"(?i)" + _A + r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}" + _Z,
}


def file_findings(files: DataFrame, path: str, text: Column) -> DataFrame:
    """(path, label) of every rule that a whole file breaks."""
    t = files.where(text.isNotNull()).select(F.col(path).alias("path"), text.alias("t"))
    hits = F.array(*[F.when(F.regexp_like("t", F.lit(p)), F.lit(r)) for r, p in FILE_RULES.items()])
    return t.select("path", F.explode(F.array_compact(hits)).alias("label"))


def blank_allowed(c: Column, allowed: list[str]) -> Column:
    """Each allowed literal as blanks of its length, where it ends at a token boundary."""
    import re

    for a in allowed:
        c = F.regexp_replace(c, "".join("\\" + x if re.match(r"\W", x) and x.isascii() else x for x in a) + r"(?![A-Za-z0-9._-])", " " * len(a))
    return c


def findings(df: DataFrame, key: str, text: Column, rules: dict[str, str] = RULES, allowed: list[str] = ()) -> DataFrame:
    """(key, line, rule, hits) of every line that a rule hits."""
    lines = df.where(text.isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    t = blank_allowed(F.col("t"), list(allowed))
    # one pass over each line for all rules, then only the hits are kept
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), F.regexp_count(t, F.lit(p)).alias("hits")) for r, p in rules.items()])
    found = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(F.filter(hits, lambda x: x["hits"] > 0)).alias("f"))
    return found.select(key, "line", "f.rule", "f.hits")


def ordered_findings(found: DataFrame, key: str) -> DataFrame:
    """Findings as a report lists them: by file, line and rule."""
    return found.orderBy(key, "line", "rule")


def seeded_order(df: DataFrame, seed: str, item: Column, keys: list[str], out: str = "place") -> DataFrame:
    """Adds ``out``: each row's place, from 1, among its ``keys`` in the order of seeded hashes."""
    from ledgerloom.operators.ordered import running_sum_before

    hashed = df.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), item.cast("string")), 256)).withColumn("_one", F.lit(1).cast("long"))
    return running_sum_before(hashed, keys, ["_hash"], "_one", "_n").withColumn(out, (F.col("_n") + 1).cast("int")).drop("_hash", "_one", "_n")


def binary(content: Column) -> Column:
    """Whether the first 8,000 bytes hold a zero byte."""
    return F.regexp_count(F.hex(F.substring(content, 1, 8000)), F.lit("(?:^|\\G)(?:[0-9A-F]{2})*?00")) > 0


def score(atoms: DataFrame, answers: DataFrame, checkpoint: int) -> DataFrame:
    """``atoms(id, category, field, accepted, partial, contradictions, critical, available)`` against
    ``answers(answer, field, text)``: (answer, id, category, outcome, points, critical)."""
    text = answers.select("answer", "field", score_text(F.col("text")).alias("text"))
    a = atoms.where(F.col("available") <= checkpoint)
    j = a.join(text, "field", "left")
    t = F.coalesce("text", F.lit(""))
    holds = lambda p: F.contains(t, score_text(p))
    none = lambda c: F.coalesce(c, F.lit(False))
    outcome = (
        F.when(none(F.exists("contradictions", holds)), "contradiction")
        .when(none(F.exists("accepted", lambda alt: F.forall(alt, holds))), "exact")
        .when(none(F.exists("partial", holds)), "partial")
        .otherwise("missing")
    )
    half = F.when(F.col("outcome") == "exact", 2).when(F.col("outcome") == "partial", 1).otherwise(0)
    return j.select("answer", "id", "category", outcome.alias("outcome"), "critical").withColumn("half_points", half)


def recall(scored: DataFrame) -> DataFrame:
    """Per answer: points in halves, recall in parts per million, outcomes, and whether every
    critical atom was exact."""
    from ledgerloom.functions.canon import ppm

    o = F.col("outcome")
    agg = scored.groupBy("answer").agg(
        F.sum("half_points").alias("half_points"), F.count("*").alias("atoms"), *[F.count_if(o == x).alias(x) for x in ("exact", "partial", "missing", "contradiction")],
        F.bool_and(~F.col("critical") | (o == "exact")).alias("critical_exact"),
    )
    return agg.withColumn("recall_ppm", ppm(F.col("half_points"), 2 * F.col("atoms")))
