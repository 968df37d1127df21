"""Scalar functions as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Mask templates as (id, kind of match, pattern, label, contexts) by priority.
MASKS = [
    ("mask-agents-md-instructions", "regex", r"# AGENTS\.md instructions[^\n]*\n\n<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>", "Agent Instructions", "user_message system_message"),
    ("mask-standalone-instructions-block", "regex", r"<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>", "Instructions", "user_message system_message"),
    ("mask-environment-context-block", "regex", r"<environment_context>[\s\S]*?</environment_context>", "Environment Context", "user_message system_message"),
    ("mask-system-reminder-block", "regex", r"<system-reminder>[\s\S]*?</system-reminder>", "System Reminder", "user_message system_message"),
    ("mask-system-prompt-prefix", "prefix", "You are", "System Prompt", "system_message assistant_reply"),
    ("mask-openai-key", "regex", r"sk-[A-Za-z0-9]{20,}", "API Key", "user_message system_message assistant_reply tool_input tool_output"),
    ("mask-private-key", "regex", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "Private Key", "user_message system_message assistant_reply tool_input tool_output"),
    ("mask-bearer-token", "regex", r"Bearer\s+[A-Za-z0-9._\-]{16,}", "Bearer Token", "user_message system_message assistant_reply tool_input tool_output"),
]
# What ends a masked prefix, else so many characters.
PREFIX_ENDS, PREFIX_CHARS = ["\n\n====", "\n\n---", "\n\nUser:", "\n\nHuman:", "\n\n# "], 4000
# Spellings of stop reasons.
STOP_REASONS = {
    "end_turn": "end_turn end stop completed complete finished",
    "tool_use": "tool_use tool_call tool_calls function_call function_calls",
    "max_tokens": "max_tokens length token_limit",
    "error": "error failed failure abort aborted cancelled canceled interrupted",
}
# The bound of searched text in bytes, and what marks a cut.
SEARCH_BYTES, SEARCH_CUT = 16 * 1024, "...[truncated]"


# The characters that count as white space, Unicode's and the byte order mark among them.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE))


def optional(text: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(trimmed(text), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by ``::``, null parts being empty."""
    return F.sha1(F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def composite_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "-")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 1)), F.lit("...")))


def decode_uri(text: Column) -> Column:
    """Percent-decoded; a text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "\\+", "%2B")), text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def git_remote(text: Column) -> Column:
    """Without .git at the end, then without closing slashes; the user@host:path form as an ssh address; blank is null."""
    out = F.regexp_replace(F.regexp_replace(optional(text), "(?i)\\.git$", ""), "/+$", "")
    return F.regexp_replace(out, "^([^@]+@[^:]+):(.+)$", "ssh://$1/$2")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def masked_regions(text: str, context: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, template id, label) of what masks claim in a text, in order; what a template of higher priority has claimed stays its own."""
    found: list[tuple[int, int, str, str]] = []
    for name, kind, pattern, label, contexts in MASKS:
        if context not in contexts.split():
            continue
        if kind == "regex":
            spans = [m.span() for m in re.finditer(pattern, text)]
        else:
            ends = (text.find(e) for e in PREFIX_ENDS)
            spans = [(0, next((e for e in ends if e >= 0), min(len(text), PREFIX_CHARS)))] if text.startswith(pattern) else []
        found += [(a, b, name, label) for a, b in spans if all(b <= c or d <= a for c, d, *_ in found)]
    return sorted(found)


SEGMENTS = "array<struct<type:string,content:string,mask_label:string,mask_char_count:int,mask_template_id:string,original_content:string>>"


def segments(text: Column, context: str = "user_message", injected: bool = False) -> Column:
    """A text as plain stretches and masked ones, in order; null as an empty text."""
    plain = "injected" if injected else "text"

    @F.pandas_udf(SEGMENTS)
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for own in texts.fillna(""):
            parts, at = [], 0
            for a, b, name, label in masked_regions(own, context):
                if a > at:
                    parts.append((plain, own[at:a], None, None, None, None))
                parts.append(("masked", f"[MASKED: {label}]", label, b - a, name, own[a:b]))
                at = b
            if at < len(own) or not parts:
                parts.append((plain, own[at:], None, None, None, None))
            keys = ["type", "content", "mask_label", "mask_char_count", "mask_template_id", "original_content"]
            out.append([dict(zip(keys, p, strict=True)) for p in parts])
        return pd.Series(out)

    return cut(text)


def tidy(text: Column) -> Column:
    """Lines without trailing blanks, at most one empty line in a row, nothing at the ends."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def canonical(text: Column, context: str = "user_message") -> Column:
    """What masks leave of a text, tidied."""
    kept = F.filter(segments(text, context), lambda s: ~s["type"].isin("masked", "injected"))
    return tidy(F.array_join(F.transform(kept, lambda s: s["content"]), ""))


def bound(value: Column, f) -> Column:
    """``f`` of a value that it reads several times: the value stands in the expression once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _unfiled(raw: Column) -> Column:
    """Without the scheme of a file address."""
    host = F.regexp_extract(raw, "(?i)^file://([^/]*)", 1)
    rest = F.regexp_replace(raw, "(?i)^file://[^/]*", "")
    bare = (
        F.when(raw.rlike("(?i)^file://localhost/"), rest)
        .when(raw.rlike("(?i)^file://") & host.rlike("^[A-Za-z]:$"), F.concat(host, rest))
        .when(raw.rlike("(?i)^file://") & (host != ""), F.concat(F.lit("//"), host, rest))
        .when(raw.rlike("(?i)^file://"), rest)
        .otherwise(raw)
    )
    return F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("/")), "^/([A-Za-z]:)", "$1")


def path_identity(path: Column) -> Column:
    """A path's one form: escapes and file addresses decoded, drive letters lower, slashes single, dots resolved; blank is null."""
    decoded = bound(optional(path), lambda x: F.when(x.rlike("(?i)%[0-9a-f]{2}"), decode_uri(x)).otherwise(x))
    return bound(bound(decoded, _unfiled), _resolved)


def _resolved(raw: Column) -> Column:
    share = raw.startswith("//") & ~raw.rlike("^//[A-Za-z]:")
    single = F.regexp_replace(raw, "/+", "/")
    drive = single.rlike("^[A-Za-z]:") & ~share
    body = F.when(share, F.substring(raw, 2, 1 << 30)).when(drive, F.concat(F.lit("/"), F.substring(single, 3, 1 << 30))).otherwise(single)
    rooted = body.startswith("/")
    parts = F.filter(F.split(body, "/+"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        back = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        up = F.when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.concat(acc, F.array(x)))
        return F.when(x != "..", F.concat(acc, F.array(x))).otherwise(up)

    kept = F.array_join(F.aggregate(parts, empty, step), "/")
    before = F.when(share, "//").when(drive, F.concat(F.lower(F.left(single, F.lit(1))), F.lit(":/"))).when(rooted, "/").otherwise("")
    whole = F.concat(before, kept)
    return F.when(raw.isNotNull(), F.when(whole == "", ".").otherwise(whole))


def stop_reason(text: Column) -> Column:
    """One of four stop reasons from its many spellings; others are null."""
    spelt = F.regexp_replace(F.lower(trimmed(text)), f"[{SPACE}-]+", "_")
    out = F.lit(None).cast("string")
    for reason, words in STOP_REASONS.items():
        out = F.when(spelt.isin(*words.split()), reason).otherwise(out)
    return out


def coerce_iso(text: Column) -> Column:
    """A time in UTC with milliseconds; what is no time is null."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_of_millis(number: Column) -> Column:
    """Milliseconds since 1970 as a time in UTC; null where that is no time."""
    fits = number.between(-8.64e15, 8.64e15)
    return F.date_format(F.timestamp_millis(F.when(fits, number).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def min_iso(a: Column, b: Column) -> Column:
    return F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def max_iso(a: Column, b: Column) -> Column:
    return F.greatest(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def compact(text: Column, n: int) -> Column:
    """Squeezed; longer than n characters, its first n-1 and an ellipsis."""
    own = squeezed(text)
    return F.when(F.length(own) <= n, own).otherwise(F.concat(F.left(own, F.lit(max(n - 1, 1))), F.lit("\u2026")))


def without_markup(text: Column) -> Column:
    """Without command markup: the name of a command stays, its caveat, message and arguments go."""
    out = text
    for tag in ("local-command-caveat", "command-message", "command-args"):
        out = F.regexp_replace(out, f"(?i)<{tag}>[\\s\\S]*?</{tag}>", " ")
    out = F.regexp_replace(out, "(?i)<command-name>([\\s\\S]*?)</command-name>", "$1 ")
    return squeezed(F.regexp_replace(out, "(?i)</?command-(?:name|message|args)>", " "))


def loop_text(text: Column) -> Column:
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def is_control_phrase(text: Column) -> Column:
    return loop_text(text).isin("continue", "/loop")


def bounded(text: Column) -> Column:
    """A text of at most SEARCH_BYTES bytes; a cut one ends in SEARCH_CUT, and a character cut through goes."""
    room = SEARCH_BYTES - len(SEARCH_CUT)
    held = F.substring(F.encode(text, "UTF-8"), 1, room + 1)
    # A character's later bytes begin with the bits 10: cut before the one that the next byte belongs to.
    byte = [F.conv(F.hex(F.substring(held, room + 1 - k, 1)), 16, 10).cast("int") for k in range(4)]
    inside = [b.bitwiseAND(0xC0) == 0x80 for b in byte]
    n = F.when(~inside[0], room).when(~inside[1], room - 1).when(~inside[2], room - 2).otherwise(room - 3)
    short = F.decode(F.substring(held, F.lit(1), n), "UTF-8")
    return F.when(F.octet_length(text) <= SEARCH_BYTES, text).otherwise(F.concat(short, F.lit(SEARCH_CUT)))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits over UTF-16 code units, as eight hex digits."""

    @F.pandas_udf(StringType())
    def digest(parts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            h, raw = 0x811C9DC5, x.encode("utf-16-le", "surrogatepass")
            for i in range(0, len(raw), 2):
                h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
            return f"{h:08x}"

        return parts.map(one)

    return digest(text)


def similar_prompts(a: Column, b: Column) -> Column:
    """Enough words in common: four, six tenths of the smaller and 45 hundredths of the larger set; or one text of 24 characters inside the other."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), "[^\\p{L}\\p{N}]+"), lambda w: w != "")) for t in (a, b))
    both = F.size(F.array_intersect(x, y))
    words = (both >= 4) & (both >= 0.6 * F.least(F.size(x), F.size(y))) & (both >= 0.45 * F.greatest(F.size(x), F.size(y)))
    inside = (F.length(a) >= 24) & F.contains(F.lower(b), F.lower(a)) | (F.length(b) >= 24) & F.contains(F.lower(a), F.lower(b))
    return words | inside
