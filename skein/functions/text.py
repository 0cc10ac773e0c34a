"""Text and URL functions as column expressions (no Python workers, but for ``unescape``).

Patterns run with ``(?U)``: word boundaries, digits and spaces are Unicode's, as in the event sources' own tools.
"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies and limits below are part of the data model.
COORDINATION_KEYS = ["task_id", "task-id", "job_id", "worker_id", "run_id", "message_id", "correlation_id", "nonce", "checkpoint", "resume_token", "continuation_token", "state_id", "lease_id"]
PLACEHOLDERS = ["example", "placeholder", "your-token-here", "xxxxxxxx", "00000000", "12345678", "task-1234"]
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
COMMON_URL_HOSTS = ["github.com", "www.github.com", "docs.github.com"]
REFERENCE_STOPWORDS = ["complete", "completed", "finished", "accepted", "result", "the", "this"]
URL = r"https?://[^\s<>'\")\]]+"
FENCED_CODE = r"(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"
KEYED_VALUE = r"(?iU)\b(" + "|".join(COORDINATION_KEYS) + r")\b\s*[:=#]\s*[`\"']?([A-Za-z0-9][A-Za-z0-9._:/+=-]{5,127})"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HASH = r"(?i)^[0-9a-f]{7,64}$"
TRAILING = "[.,;)\\]}`\"']+$"
OPAQUE = r"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{28,}={0,2})(?![A-Za-z0-9+/=])"
CREDENTIAL = r"(?iU)\b(?:sk|token|relay|session|credential)[-_][A-Za-z0-9][A-Za-z0-9_-]{15,}\b"
MARKDOWN_STRUCTURE = r"(?mU)^(?:#{1,4}\s|[-*+]\s|\d+[.)]\s|```|>\s)"
PUBLIC_KEY = r"(?U)\b(?:ssh-ed25519|ssh-rsa)\s+[A-Za-z0-9+/=]{20,}"
FINGERPRINT = r"(?iU)\b(?:fingerprint|key_id)\s*[:=]\s*([A-Za-z0-9:_-]{8,})"
BOT_NAME = r"(?i)(?:\[bot\]$|(?:^|[-_])(?:bot|ci)(?:$|[-_])|(?:automation|renovate|dependabot))"
ROUTINE_EVENT_TYPES = ["CheckRunEvent", "CheckSuiteEvent", "DeploymentEvent", "DeploymentStatusEvent", "ReleaseEvent"]
ROUTINE = [
    r"(?iU)\b(?:bump|update)\s+(?:dependency|dependencies|lockfile)\b",
    r"(?iU)\b(?:all checks? (?:passed|failed)|coverage (?:report|changed))\b",
    r"(?iU)\b(?:generated by|auto[- ]generated|do not edit|automated (?:release|update|merge))\b",
    r"(?iU)\b(?:release notes?|changelog)\b.*\bv?\d+\.\d+\.\d+\b",
]
GENERATED_DOMAIN = r"(?i)(?:noreply|users\.noreply\.github\.com|localdomain|localhost|invalid)$"
COMMIT_VARIABLE = r"(?iU)\b(?:[0-9a-f]{7,40}|\d+(?:\.\d+)*|#[0-9]+)\b"
PROTOCOL = {
    "task_identifier": r"(?iU)\b(?:task|job|work)[-_ ]?(?:id)?\s*[:=#]\s*[A-Za-z0-9._-]{4,}\b",
    "acknowledgement": r"(?iU)\b(?:ACK|NACK|acknowledged|received\s+task|task\s+accepted)\b",
    "heartbeat": r"(?iU)\b(?:heartbeat|healthcheck|lease\s+renewal|worker\s+alive)\b",
    "ttl_sequence": r"(?iU)\b(?:ttl|seq(?:uence)?|retry[_ -]?count|attempt)\s*[:=]\s*\d+\b",
    "coordination_queue": r"(?iU)\b(?:inbox|outbox|queue|worker|delegate|claim\s+task|coordinator)\b",
    "checkpoint": r"(?iU)\b(?:checkpoint|resume[_ -]?token|state[_ -]?id|continuation[_ -]?token)\b",
    "integrity": r"(?iU)\b(?:sha256|signature|public\s+key|fingerprint|nonce)\s*[:=]\s*[A-Za-z0-9+/=_:-]{8,}\b",
    "machine_envelope": r"(?iU)[\{,]\s*[\"']?(?:task_id|worker_id|status|result|nonce|sequence)[\"']?\s*:",
}
ACTS = {
    "ack": r"(?iU)\b(?:ack|acknowledged|accepted|claiming|received (?:the )?task|starting task)\b",
    "delegation": r"(?iU)\b(?:delegate|assign(?:ed)?|you handle|take (?:this|the) task|please (?:run|check|do))\b",
    "result": r"(?iU)\b(?:task (?:is )?(?:complete|completed|finished)|returning (?:the )?result|report(?:ing)? back|result\s*[:=])\b",
    "state_in": r"(?iU)\b(?:resume from|resuming (?:from|with)|continue from|loaded checkpoint)\b",
    "state_out": r"(?iU)\b(?:checkpoint (?:saved|created)|saved state|state transfer|continuation token)\b",
}
NEGATION = r"(?iU)\b(?:do not|don't|not|never|no)\b[^.!?]{0,24}$"
NEGATION_REACH = 32
#: A text without it holds no negation, wherever a stretch of it is cut.
NEGATING = r"(?iU)no|don't|never"
REFERENCE = r"(?iU)\b(?:task(?:_id|-id| id)?|job_id|run_id|correlation_id|checkpoint|resume_token|continuation_token|state_id)\s*[:=#-]?\s*[`\"']?([A-Za-z0-9][A-Za-z0-9._-]{3,63})"
DERIVED_MARKUP = r"(?isU)<(?:details|blockquote)\b[^>]*>.*?</(?:details|blockquote)>"
ANY_FENCE = r"(?s)```.*?```"
CANDIDATE = r"(?i)(?:task[_ -]?id|worker[_ -]?id|resume[_ -]?token|continuation[_ -]?token|checkpoint|nonce|delegate|coordinator|heartbeat)"
# What reports must not show.
SECRETS = [
    r"(?iU)(api[_ -]?key|access[_ -]?token|bearer|password|passwd)\s*[:=]\s*\S+",
    r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?U)\bgh[opurs]_[A-Za-z0-9_]{20,}\b",
    r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b",
]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
QUOTE_OR_BREAK = r"[>\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACES = r"(?U)[\s\x1c-\x1f]+"

#: Entropy of an opaque payload is measured against this many bits.
OPAQUE_BITS, OPAQUE_QUALITY = 5.2, 0.72


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def extract_urls(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, URL)))


def extract_code_blocks(text: Column) -> Column:
    return F.filter(F.transform(_all(text, FENCED_CODE, 1), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")


def strip_quoted_lines(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, LINE_BREAK), lambda x: ~x.rlike(r"(?U)^\s*>"))
    # Most texts have neither a quote nor another line break than the one that lines are joined by.
    return F.when(whole.rlike(QUOTE_OR_BREAK), F.array_join(lines, "\n")).otherwise(whole)


def clean_text(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DERIVED_MARKUP, ""), ANY_FENCE, "")
    return strip_quoted_lines(bare)


def distinct_characters(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, "")))


def canonical_code(code: Column) -> Column:
    """The digest of a code block of some size and variety, its lines' ends trimmed; else null."""
    whole = F.regexp_replace(code, r"(?U)^\s+|\s+$", "")
    lines = F.array_join(F.transform(F.split(whole, LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.when((F.length(lines) >= 120) & (distinct_characters(lines) >= 12), F.sha2(lines, 256))


def _quoted(value: Column) -> Column:
    """Form encoding, with ``~`` plain and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquoted(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def normalize_url(url: Column) -> Column:
    """Web URLs outside code hosts, without tracking parameters and fragment; else null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(netloc, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+$"))
    named = F.transform(pairs, lambda p: F.struct(_unquoted(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"), _unquoted(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMETERS))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), netloc, path, F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & (host != "") & ~host.isin(COMMON_URL_HOSTS), whole)


def valid_marker_value(value: Column) -> Column:
    lowered = F.lower(value)
    return ~lowered.isin(PLACEHOLDERS) & (distinct_characters(lowered) >= 4) & ~lowered.rlike("^[0-9]+$")


def keyed_markers(text: Column, context: Column) -> Column:
    """array<struct<kind, value>> of coordination markers; ``context``: lower-cased ids the event itself explains."""
    pairs = F.arrays_zip(_all(text, KEYED_VALUE, 1).alias("k"), _all(text, KEYED_VALUE, 2).alias("v"))
    trimmed = F.transform(pairs, lambda p: F.struct(F.replace(F.lower(p["k"]), F.lit("-"), F.lit("_")).alias("k"), F.regexp_replace(p["v"], TRAILING, "").alias("v")))
    good = F.filter(trimmed, lambda p: valid_marker_value(p["v"]) & ~F.array_contains(context, F.lower(p["v"])))
    return F.transform(good, lambda p: F.struct(F.concat(F.lit("marker:"), p["k"]).alias("kind"), F.lower(p["v"]).alias("value")))


def artifacts(text: Column, urls: Column, code_blocks: Column, context: Column) -> Column:
    """Distinct typed artifacts: external URLs, code digests and markers outside quoted lines."""
    empty = F.array().cast("array<string>")
    of_urls = F.transform(F.filter(F.transform(F.coalesce(urls, empty), normalize_url), lambda u: u.isNotNull()), lambda u: F.struct(F.lit("external_url").alias("kind"), u.alias("value")))
    of_code = F.transform(F.filter(F.transform(F.coalesce(code_blocks, empty), canonical_code), lambda c: c.isNotNull()), lambda c: F.struct(F.lit("code").alias("kind"), c.alias("value")))
    return F.array_sort(F.array_distinct(F.concat(of_urls, of_code, keyed_markers(strip_quoted_lines(text), context))))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def opaque_quality(payload: Column) -> Column:
    bare = F.regexp_replace(payload, "=+$", "")
    enough = (F.length(payload) >= 28) & (distinct_characters(bare) >= 14)
    return F.when(enough, F.least(F.lit(1.0), entropy(bare) / OPAQUE_BITS)).otherwise(F.lit(0.0))


def opaque_payloads(text: Column) -> Column:
    return F.filter(_all(text, OPAQUE, 1), lambda v: opaque_quality(v) >= OPAQUE_QUALITY)


def opaque_scaffold(text: Column) -> Column:
    masked = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OPAQUE, "<opaque>"), r"(?U)\d+", "<number>")
    return collapsed(masked)


def credentials(text: Column) -> Column:
    return F.transform(_all(text, CREDENTIAL), F.lower)


def identity_markers(text: Column) -> Column:
    bare = strip_quoted_lines(text)
    return F.concat(_all(bare, PUBLIC_KEY), _all(bare, FINGERPRINT, 1))


def normalize_text(text: Column) -> Column:
    return F.array_join(_all(F.lower(text), "[A-Za-z0-9]+"), " ")


def normalize_template(text: Column) -> Column:
    x = F.regexp_replace(F.lower(text), r"(?U)https?://\S+", "<url>")
    x = F.regexp_replace(x, r"(?U)\b[0-9a-f]{7,64}\b", "<hash>")
    return F.substring(collapsed(F.regexp_replace(x, r"(?U)\b\d+(?:\.\d+)*\b", "<number>")), 1, 500)


def commit_template(message: Column) -> Column:
    return F.regexp_replace(collapsed(F.lower(message)), COMMIT_VARIABLE, "<var>")


def references(text: Column) -> Column:
    found = F.transform(_all(text, REFERENCE, 1), lambda v: F.regexp_replace(F.lower(v), TRAILING, ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: ~v.isin(REFERENCE_STOPWORDS))))


def unnegated(text: Column, pattern: str) -> Column:
    """Whether a match stands that no negation precedes within reach.

    The text between matches and the matches themselves are walked in order, so that each match is judged by the
    characters before it in the whole text, and a void match does not hide a later one.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))

    def step(state: Column, x: Column) -> Column:
        before = F.concat(state["tail"], x["gap"])
        reach = F.substring(before, F.greatest(F.length(before) - NEGATION_REACH + 1, F.lit(1)), F.lit(NEGATION_REACH))
        after = F.concat(reach, x["hit"])
        return F.struct(after.alias("tail"), (state["stands"] | ~reach.rlike(NEGATION)).alias("stands"))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("stands"))
    # Most texts hold no match; they are looked through once and not split.
    return F.when(text.rlike(pattern), ~text.rlike(NEGATING) | F.aggregate(steps, start, step, lambda s: s["stands"])).otherwise(F.lit(False))


def speech_acts(cleaned: Column) -> Column:
    """Sorted names of the acts in cleaned text."""
    return F.array_compact(F.array(*[F.when(unnegated(cleaned, p), F.lit(name)) for name, p in ACTS.items()]))


def protocol_hits(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(text, p), F.lit(name)) for name, p in PROTOCOL.items()]))


def bot_identity(actor: Column, actor_type: Column, app_slug: Column) -> Column:
    return (F.lower(F.coalesce(actor_type, F.lit(""))) == "bot") | (F.coalesce(app_slug, F.lit("")) != "") | F.coalesce(actor, F.lit("")).rlike(BOT_NAME)


def routine(event_type: Column, text: Column) -> Column:
    out = event_type.isin(ROUTINE_EVENT_TYPES)
    for pattern in ROUTINE:
        out = out | has(text, pattern)
    return out


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def snippet_text(source: Column) -> Column:
    """Text of a search snippet: tags dropped, the common entities and numeric ones resolved."""
    x = F.regexp_replace(source, "<[^>]+>", "")
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(mark))
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unescape(text: Column) -> Column:
    """All character references of HTML resolved: in Arrow batches, since the standard names over two thousand."""

    @F.arrow_udf("string")
    def resolved(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html.unescape(x) for x in texts.to_pylist()], pa.string())

    return resolved(text)


def hash_sample(key: Column, rate: float) -> Column:
    """The first 64 bits of the key's digest lie below the rate: fixed-width hex compares as numbers do."""
    rate = min(1.0, max(0.0, rate))
    if rate >= 1.0:
        return F.lit(True)
    return F.substring(F.sha2(key, 256), 1, 16) < F.lit(f"{int(rate * 2**64):016x}")
