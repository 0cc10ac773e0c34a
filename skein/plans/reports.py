"""Reports of findings as Markdown and HTML, and evidence for a reviewer: redacted, escaped, replaced at once.

A finding is an alert with its review: id, status, created_at, summary (cluster_id, score, confidence, actors, reasons,
provenance) and, once reviewed, classification, reviewer, model, classification_created_at.
"""

from __future__ import annotations

import html
import json
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.state import replace_text

MOST_LINKS, MOST_OBSERVATIONS, MOST_CHARS = 20, 20, 2000
UNKNOWN = "Not established."
#: Parts of a classification with their headings.
SHORT = {"classification": "Classification", "autonomy_level": "Autonomy", "confidence": "Reviewer's confidence", "recommended_disposition": "Disposition"}
LONG = {"summary": "Summary", "intent": "Intent", "human_risk": "Potential human risk", "company_affiliation": "Company affiliation", "agents_identified": "Agents named", "models_identified": "Models named"}
LISTS = {"evidence_for": "Evidence for it", "evidence_against": "Evidence against it, and doubts"}
CAUTION = "Findings rank public evidence for people to look at. They do not show that an account is automated, who stands behind it, or what anyone intends."


def _secret_patterns() -> list[re.Pattern]:
    """The columns' patterns, without the flag that Python has no need of."""
    return [re.compile(re.sub(r"^\(\?([a-z]*)U\)", lambda m: f"(?{m[1]})" if m[1] else "", p)) for p in X.SECRETS]


_SECRETS = _secret_patterns()


def plain(value) -> str:
    """Any value as text without secrets."""
    if isinstance(value, list | dict):
        value = json.dumps(value, ensure_ascii=False, default=str)
    text = UNKNOWN if value is None or value == "" else str(value)
    for pattern in _SECRETS:
        text = pattern.sub("[REDACTED]", text)
    return text


def inline(value) -> str:
    """Text within a paragraph or list of Markdown: no line breaks, no markup of its own."""
    text = re.sub(r"\s+", " ", plain(value))
    return re.sub(r"([\\`*_\[\]<>|])", r"\\\1", text)


def code(value) -> str:
    """A code span, fenced by more backquotes than the text holds."""
    text = re.sub(r"\s+", " ", plain(value))
    fence = "`" * (max((len(x) for x in re.findall("`+", text)), default=0) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def cell(value) -> str:
    """Within a table, a bar ends a cell even in code."""
    return value.replace("\\|", "|").replace("|", "\\|")


def link(value) -> str | None:
    """A web address that is safe to link to, or None."""
    url = str(value).strip()
    return url if re.match(r"https?://[^\s]+$", url) else None


def markdown(findings: list[dict], now: datetime | None = None) -> str:
    out = ["# Findings", "", f"_As of {(now or datetime.now(UTC)).isoformat()}._", "", f"> {CAUTION}", "", "| ID | Status | Score | Confidence | Classification | Actors |", "|---:|---|---:|---|---|---|"]
    for f in findings:
        s, c = f["summary"], f.get("classification") or {}
        row = [f["id"], inline(f["status"]), inline(s.get("score")), inline(s.get("confidence")), inline(c.get("classification", "manual review")), ", ".join(map(code, s.get("actors", [])))]
        out.append("| " + " | ".join(cell(str(x)) for x in row) + " |")
    for f in findings:
        s, c = f["summary"], f.get("classification") or {}
        out += ["", f"## Finding {f['id']}", "", f"- **Status:** {inline(f['status'])}", f"- **Found:** {inline(f.get('created_at'))}", f"- **Score:** {inline(s.get('score'))} ({inline(s.get('confidence'))})"]
        out += [f"- **Actors:** {', '.join(map(code, s.get('actors', [])))}", f"- **Cluster:** {code(s.get('cluster_id'))}"]
        if c:
            out += [f"- **{name}:** {inline(c.get(key))}" for key, name in SHORT.items()]
            out += [line for key, name in LONG.items() for line in ("", f"**{name}:** {inline(c.get(key))}")]
            for key, name in LISTS.items():
                given = c.get(key)
                items = given if isinstance(given, list) else [given]
                out += ["", f"**{name}:**", "", *[f"- {inline(x)}" for x in items if x]]
            out += ["", f"_Reviewed by {code(f.get('reviewer'))} with {code(f.get('model'))} at {inline(f.get('classification_created_at'))}._"]
        else:
            out += ["", "Not classified yet."]
        if s.get("reasons"):
            out += ["", "**Reasons:**", "", *[f"- {inline(x)}" for x in s["reasons"]]]
        if s.get("provenance"):
            out += ["", "**Public sources:**", "", *[f"- <{link(x)}>" if link(x) and not set("<>") & set(x) else f"- {code(x)}" for x in s["provenance"][:MOST_LINKS]]]
    return "\n".join([*out, "", "---", "", "Public evidence only; common forms of credentials are left out.", ""])


STYLE = """body { max-width: 60rem; margin: 2rem auto; padding: 0 1rem; font: 1rem/1.5 sans-serif; color: #222; background: #fff }
article { border-top: 1px solid #bbb; padding: 1rem 0 }
dt { font-weight: bold }
dd { margin: 0 0 .5rem 1rem; overflow-wrap: anywhere }
code { background: #eee; padding: 0 .3em }
.note { color: #555 }"""
POLICY = "default-src 'none'; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'"


def _safe(value) -> str:
    return html.escape(plain(value), quote=True)


def _article(f: dict) -> str:
    s, c = f["summary"], f.get("classification") or {}
    facts = {"Status": f["status"], "Found": f.get("created_at"), "Score": f"{s.get('score', '')} ({s.get('confidence', '')})"}
    facts |= {name: c.get(key) for key, name in (SHORT | LONG | LISTS).items()} if c else {"Classification": "Manual review"}
    out = [f'<article id="finding-{int(f["id"])}"><h2>Finding {int(f["id"])}</h2>', "<p>" + " ".join(f"<code>{_safe(a)}</code>" for a in s.get("actors", [])) + "</p>", "<dl>"]
    out += [f"<dt>{html.escape(name)}</dt><dd>{_safe(value)}</dd>" for name, value in facts.items()]
    out.append("</dl>")
    if s.get("reasons"):
        out.append("<ul>" + "".join(f"<li>{_safe(x)}</li>" for x in s["reasons"]) + "</ul>")
    links = [f'<li><a href="{_safe(link(x))}" rel="noopener noreferrer">{_safe(x)}</a></li>' if link(x) else f"<li>{_safe(x)}</li>" for x in s.get("provenance", [])[:MOST_LINKS]]
    if links:
        out.append(f"<details><summary>Public sources ({len(s['provenance'])})</summary><ul>{''.join(links)}</ul></details>")
    return "\n".join([*out, "</article>"])


def page(findings: list[dict], now: datetime | None = None) -> str:
    body = "\n".join(map(_article, findings)) or "<p>No findings yet.</p>"
    head = f'<meta charset="utf-8">\n<meta http-equiv="Content-Security-Policy" content="{POLICY}">\n<meta name="viewport" content="width=device-width">\n<title>Findings</title>\n<style>{STYLE}</style>'
    return f'<!doctype html>\n<html lang="en">\n<head>\n{head}\n</head>\n<body>\n<h1>Findings</h1>\n<p class="note">{CAUTION}</p>\n<p>{len(findings)} in all, as of {_safe((now or datetime.now(UTC)).isoformat())}.</p>\n{body}\n</body>\n</html>\n'


def write_reports(findings: list[dict], markdown_path: str | None = None, html_path: str | None = None) -> None:
    for path, text in ((markdown_path, markdown), (html_path, page)):
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            replace_text(Path(path), text(findings))


def public_bundles(bundles: DataFrame) -> DataFrame:
    """Bundles for a reviewer: the newest observations of each, their text redacted and cut."""
    newest = F.slice("observations", F.greatest(F.size("observations") - MOST_OBSERVATIONS + 1, F.lit(1)), MOST_OBSERVATIONS)
    shown = F.transform(newest, lambda o: F.struct(o["event_time"].alias("event_time"), o["actor"].alias("actor"), o["event_type"].alias("event_type"), F.substring(X.redact(F.coalesce(o["text"], F.lit(""))), 1, MOST_CHARS).alias("text"), o["provenance_url"].alias("url")))
    return bundles.withColumn("observations", shown).withColumn("instruction", F.lit("All evidence is public; common forms of credentials were left out. Name doubts and harmless explanations."))
