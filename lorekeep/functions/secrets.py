"""Secrets in text: which kinds a text holds, and the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a value as a stand-in, and the mark that takes a secret's place.
SAFE_MARKERS = r"redacted|example|placeholder|your_|your-|changeme|xxxx|\*\*\*\*|\$\{|\{\{"
REDACTED = "[REDACTED]"
KEYS = "password|passwd|pwd|client[_-]?secret|access[_-]?token|refresh[_-]?token|api[_-]?key|secret[_-]?key"


def _unsafe(chars: str, length: str) -> str:
    """A value of some characters that holds no mark of a stand-in."""
    return rf"(?!\.\.\.)(?!{chars}*(?i:{SAFE_MARKERS})){chars}{length}"


# The shapes of secrets, in the order in which they are replaced.
PATTERNS = {
    "credential_assignment": (rf"(?iU)(?<![A-Za-z0-9])({KEYS})\b(\s*[:=]\s*)([\"']?)" + _unsafe(r"[^\s\"'&,;}\]]", "{6,}") + r"\3", f"$1$2$3{REDACTED}$3"),
    "bearer_token": (r"(?iU)(\bBearer\s+)" + _unsafe("[A-Za-z0-9._~+/-]", "{12,}=*"), f"$1{REDACTED}"),
    "url_userinfo": (r"(?iU)(\b[a-z][a-z0-9+.-]*://[^\s/@:]+:)" + _unsafe(r"[^\s/@]", "{6,}@"), f"$1{REDACTED}@"),
    "opaque_token": (
        "(?<![A-Za-z0-9_])(?:" + "|".join(head + _unsafe(chars, length) for head, chars, length in (("gh[pousr]_", "[A-Za-z0-9]", "{20,}"), ("github_pat_", "[A-Za-z0-9_]", "{30,}"), ("sk-", "[A-Za-z0-9_-]", "{20,}"), ("(?:AKIA|ASIA)", "[A-Z0-9]", "{16}"))) + ")(?![A-Za-z0-9_])",
        REDACTED,
    ),
    "private_key": (r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{REDACTED}\n-----END PRIVATE KEY-----"),
}

# What each secret can't do without, in lower case; case-insensitive patterns take some characters for ASCII letters.
_KEY_PARTS, _HEADS = ("passw", "pwd", "secret", "token", "key"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "akia", "asia")
_FOLDED = str.maketrans("\u017f\u212a\u0130\u0131", "skii")


def may_hold(text: str) -> bool:
    """Whether a text holds the fixed parts of some secret; without them none of the patterns matches, before or after a replacement."""
    low = (text.translate(_FOLDED) if not text.isascii() and any(chr(c) in text for c in _FOLDED) else text).lower()
    return (
        ((":" in low or "=" in low) and any(k in low for k in _KEY_PARTS))
        or "bearer" in low
        or ("://" in low and "@" in low)
        or any(h in low for h in _HEADS)
        or "-----begin " in low
    )


def redact(text: Column) -> Column:
    """The text with every secret replaced; null stays null."""
    for pattern, mark in PATTERNS.values():
        text = F.regexp_replace(text, pattern, mark)
    return text


def sensitive_findings(text: Column) -> Column:
    """The sorted kinds of secrets that a text holds, each sought after those before it are replaced; null holds none."""
    found = []
    for name, (pattern, mark) in PATTERNS.items():
        found.append(F.when(F.coalesce(text.rlike(pattern), F.lit(False)), name))
        text = F.regexp_replace(text, pattern, mark)
    return F.sort_array(F.array_compact(F.array(*found)))
