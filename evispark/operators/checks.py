"""Content checks over a text column (C). Rules are data: pass a longer list to add to them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name, pattern, severity, action. Patterns mean the same in Java's and Python's dialect (ASCII classes).
LEAK_PATTERNS = (
    ("openai_api_key", r"sk-(?:proj-)?[a-zA-Z0-9]{20,}(?:T3BlbkFJ[a-zA-Z0-9_-]*)?", "critical", "block"),
    ("anthropic_api_key", r"sk-ant-api[a-zA-Z0-9_-]{90,}", "critical", "block"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", "critical", "block"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}", "critical", "block"),
    ("github_fine_grained_pat", r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}", "critical", "block"),
    ("stripe_api_key", r"sk_(?:live|test)_[a-zA-Z0-9]{24,}", "critical", "block"),
    ("nearai_session", r"sess_[a-zA-Z0-9]{32,}", "critical", "block"),
    ("pem_private_key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "critical", "block"),
    ("ssh_private_key", r"-----BEGIN\s+(?:OPENSSH|EC|DSA)\s+PRIVATE\s+KEY-----", "critical", "block"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}", "high", "block"),
    ("slack_token", r"xox[baprs]-[0-9a-zA-Z-]{10,}", "high", "block"),
    ("twilio_api_key", r"SK[a-fA-F0-9]{32}", "high", "block"),
    ("sendgrid_api_key", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "high", "block"),
    ("bearer_token", r"Bearer\s+[a-zA-Z0-9_-]{20,}", "high", "redact"),
    ("auth_header", r"(?i)authorization:\s*[a-zA-Z]+\s+[a-zA-Z0-9_-]{20,}", "high", "redact"),
    ("high_entropy_hex", r"\b[a-fA-F0-9]{64}\b", "medium", "warn"),
)
#: phrase, severity; matched ignoring case.
INJECTION_PHRASES = (
    ("ignore previous", "high"), ("ignore all previous", "critical"), ("disregard", "medium"), ("forget everything", "high"), ("you are now", "high"), ("act as", "medium"),
    ("pretend to be", "medium"), ("system:", "critical"), ("assistant:", "high"), ("user:", "high"), ("<|", "critical"), ("|>", "critical"), ("[INST]", "critical"), ("[/INST]", "critical"),
    ("new instructions", "high"), ("updated instructions", "high"), ("```system", "high"), ("```bash\nsudo", "medium"),
)
INJECTION_PATTERNS = (("base64_payload", r"(?i)base64[:\s]+[A-Za-z0-9+/=]{50,}", "medium"), ("eval_call", r"(?i)eval\s*\(", "high"), ("exec_call", r"(?i)exec\s*\(", "high"), ("null_byte", r"\x00", "critical"))
#: name, pattern, severity, action.
POLICY_RULES = (
    ("system_file_access", r"(?i)(/etc/passwd|/etc/shadow|\.ssh/|\.aws/credentials)", "critical", "block"),
    ("crypto_private_key", r"(?i)(private.?key|seed.?phrase|mnemonic).{0,20}[0-9a-f]{64}", "critical", "block"),
    ("sql_pattern", r"(?i)(DROP\s+TABLE|DELETE\s+FROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET)", "medium", "warn"),
    ("shell_injection", r"(?i)(;\s*rm\s+-rf|;\s*curl\s+.*\|\s*sh)", "critical", "block"),
    ("excessive_urls", r"(https?://[^\s]+\s*){10,}", "low", "warn"),
    ("encoded_exploit", r"(?i)(base64_decode|eval\s*\(\s*base64|atob\s*\()", "high", "sanitize"),
    ("obfuscated_string", r"[^\s]{500,}", "medium", "warn"),
)
SEVERITIES = ("low", "medium", "high", "critical")


def _worst(hits: list[tuple[Column, str]]) -> Column:
    """The highest severity of what holds; null for none."""
    level = F.greatest(*(F.when(c, SEVERITIES.index(s)).otherwise(-1) for c, s in hits), F.lit(-1))
    return F.when(level >= 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), level + 1))


def scan_leaks(df: DataFrame, text: str = "text", patterns=LEAK_PATTERNS) -> DataFrame:
    """Df with leaks (names found, in order of patterns), n_leaks, max_severity, blocked. A null text has none."""
    # Each pattern runs once: its count tells whether it is found.
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_counts", F.array(*(F.regexp_count(t, F.lit(p)) for _, p, _, _ in patterns)))
    found = [(F.element_at("_counts", i + 1) > 0, s, a, n) for i, (n, _, s, a) in enumerate(patterns)]
    out = out.withColumn("leaks", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, _, _, n in found))))
    out = out.withColumn("n_leaks", F.aggregate("_counts", F.lit(0), lambda total, n: total + n))
    blocked = F.lit(False)
    for c, _, a, _ in found:
        blocked = blocked | (c if a == "block" else F.lit(False))
    return out.withColumn("max_severity", _worst([(c, s) for c, s, _, _ in found])).withColumn("blocked", blocked).drop("_counts")


def mask(secret: str) -> str:
    """The first and last four characters of a long secret, else stars only."""
    return f"{secret[:4]}{'*' * min(8, len(secret) - 8)}{secret[-4:]}" if len(secret) > 8 else "*" * len(secret)


def leak_matches(df: DataFrame, id_col: str, text: str = "text", patterns=LEAK_PATTERNS) -> DataFrame:
    """(id, name, start, end, preview) for each match; offsets in characters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        rules = [(n, re.compile(p, re.A)) for n, p, _, _ in patterns]
        for batch in batches:
            rows = [(i, n, m.start(), m.end(), mask(m[0])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for n, r in rules for m in r.finditer(t)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [id_col, "name", "start", "end", "preview"]
    any_hit = F.lit(False)
    for _, p, _, _ in patterns:
        any_hit = any_hit | F.col(text).rlike(p)
    kind = df.schema[id_col].dataType.simpleString()
    return df.where(any_hit).select(id_col, F.col(text).cast("string")).mapInArrow(work, f"`{id_col}` {kind}, name string, start bigint, end bigint, preview string")


def clean_leaks(df: DataFrame, texts: list[str], patterns=LEAK_PATTERNS) -> DataFrame:
    """Df with matches of redact patterns in texts replaced, and status: blocked (texts as they were), redacted or clean."""
    blocked, redacted, out = F.lit(False), F.lit(False), df
    for text in texts:
        t = F.coalesce(F.col(text), F.lit(""))
        for _, p, _, action in patterns:
            blocked = blocked | (t.rlike(p) if action == "block" else F.lit(False))
            redacted = redacted | (t.rlike(p) if action == "redact" else F.lit(False))
    out = df.withColumn("status", F.when(blocked, "blocked").when(redacted, "redacted").otherwise("clean"))
    for text in texts:
        cleaned = F.col(text)
        for _, p, _, action in patterns:
            if action == "redact":
                cleaned = F.regexp_replace(cleaned, p, r"[REDACTED]")
        out = out.withColumn(text, F.when(F.col("status") == "blocked", F.col(text)).otherwise(cleaned))
    return out


def scan_injections(df: DataFrame, text: str = "text", phrases=INJECTION_PHRASES, patterns=INJECTION_PATTERNS) -> DataFrame:
    """Df with warnings (phrases and names found), max_severity and safe_text, in which markup of critical texts is escaped."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    found = [(low.contains(p.lower()), s, p) for p, s in phrases] + [(t.rlike(p), s, n) for n, p, s in patterns]
    out = df.withColumn("warnings", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, _, n in found))))
    out = out.withColumn("max_severity", _worst([(c, s) for c, s, _ in found]))
    escaped = t
    for a, b in (("<|", "\\\\<|"), ("|>", "|\\\\>"), ("[INST]", "\\\\[INST]"), ("[/INST]", "\\\\[/INST]"), ("\x00", "")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b.replace("\\\\", "\\")))
    return out.withColumn("safe_text", F.when(F.col("max_severity") == "critical", escaped).otherwise(F.col(text)))


def check_policy(df: DataFrame, text: str = "text", rules=POLICY_RULES) -> DataFrame:
    """Df with violations (names of rules) and policy_blocked."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("violations", F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p, _, _ in rules))))
    return out.withColumn("policy_blocked", F.arrays_overlap("violations", F.array(*(F.lit(n) for n, _, _, a in rules if a == "block"))))


def validate_text(df: DataFrame, text: str = "text", least: int = 1, most: int = 100_000, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Df with errors: empty, too_short, too_long (bytes), null_bytes, forbidden:<phrase>, whitespace, repetition; the last two for 50 bytes or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.octet_length(t)
    spaces = F.length(t) - F.length(F.regexp_replace(t, r"\s", ""))
    return df.withColumn("errors", F.array_compact(F.array(
        F.when(n == 0, "empty"), F.when((n > 0) & (n < least), "too_short"), F.when(n > most, "too_long"), F.when(t.contains("\x00"), "null_bytes"), *(F.when(F.lower(t).contains(p.lower()), f"forbidden:{p}") for p in forbidden),
        F.when((n >= 50) & (spaces / F.greatest(F.length(t), F.lit(1)) > 0.9), "whitespace"), F.when((n >= 50) & t.rlike(r"(?s)(.)\1{20,}"), "repetition"),
    )))


#: Bytes of a table of rules, which all workers hold.
RULE_BYTES = 32 << 20


def required_literal(pattern: str) -> str:
    """The longest text, in lower case, that every match of the pattern holds at one place; empty if there is none."""
    from re import _constants as kind, _parser

    best, run = "", ""
    todo = list(_parser.parse(pattern))
    while todo:
        op, value = todo.pop(0)
        if op is kind.LITERAL and value < 128:
            run += chr(value).lower()
        elif op is kind.SUBPATTERN:
            todo = [*value[3], *todo] if len(value[3]) and not any(o is kind.BRANCH for o, _ in value[3]) else [(None, None), *todo]
            continue
        elif op is kind.AT:
            continue
        else:
            best, run = max(best, run, key=len), ""
            if op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and value[0] > 0 and all(o is kind.LITERAL and v < 128 for o, v in value[2]):
                best = max(best, "".join(chr(v).lower() for _, v in value[2]), key=len)
    return max(best, run, key=len)


def scan_rules(df: DataFrame, rules: DataFrame, id_col: str, text: str = "text", max_bytes: int = RULE_BYTES) -> DataFrame:
    """(id, names, n, max_severity, blocked) of texts by a table of rules (name, pattern, severity, action), any number of them.

    The table, of a checked size, goes to all workers, and each compiles it once, in Python's dialect with
    ASCII classes. One automaton finds which of the literal texts that patterns require stand in a text;
    only rules whose literal does, and those that require none, are tried. names are sorted; of equal rules
    each counts; a null text has none.
    """
    own = rules.select("name", "pattern", "severity", "action").where("name IS NOT NULL AND pattern IS NOT NULL")
    size = own.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("name") + 64), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the rules have {size} bytes, more than {max_bytes}; split them")
    shared = df.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in own.collect()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import ahocorasick

        automaton, always = ahocorasick.Automaton(), []
        by_literal: dict[str, list[int]] = {}
        compiled = [re.compile(p, re.A) for _, p, _, _ in shared.value]
        for i, (_, p, _, _) in enumerate(shared.value):
            literal = required_literal(p)
            by_literal.setdefault(literal, []).append(i) if len(literal) > 1 else always.append(i)
        for literal, which in by_literal.items():
            automaton.add_word(literal, which)
        automaton.make_automaton()
        for batch in batches:
            names, worst, blocked = [], [], []
            for t in batch.column(1).to_pylist():
                likely = set(always if t else ())
                for _, which in automaton.iter(t.lower()) if t and by_literal else ():
                    likely.update(which)
                hit = [shared.value[i] for i in sorted(likely) if compiled[i].search(t)]
                names.append([r[0] for r in hit])
                level = max((SEVERITIES.index(r[2]) for r in hit if r[2] in SEVERITIES), default=-1)
                worst.append(SEVERITIES[level] if level >= 0 else None)
                blocked.append(any(r[3] == "block" for r in hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array([len(x) for x in names], pa.int32()), pa.array(worst, pa.string()), pa.array(blocked, pa.bool_())], [id_col, "names", "n", "max_severity", "blocked"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).cast("string")).mapInArrow(work, f"`{id_col}` {kind}, names array<string>, n int, max_severity string, blocked boolean")
