"""What a message in a user's name is made of: the user's own words, and what tools put around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import text as T

# How texts begin that no user wrote.
DELEGATED = ["[Subagent Context]", "You are running as a subagent"]
AUTOMATION = ["[cron:"]
ENVELOPES = ["<command-name>", "<command-message>", "<command-args>"]
INJECTED = ["[Assistant Rules", "# AGENTS.md instructions", "<environment_context>", "<system-reminder>", "<INSTRUCTIONS>"]
SYNTHETIC = [
    "<user_action>", "<task-notification>", "<turn_aborted>", "<local-command-caveat>", "<local-command-stdout>", "<bash-input>", "<bash-stdout>",
    "This session is being continued from a previous conversation",
]
REQUEST = "[User Request]"
# Blocks that may lead a text, and the folder that delegated sessions lie in.
BLOCKS = [
    r"# AGENTS\.md instructions[^\n]*\n\n<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>",
    r"<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>",
    r"<environment_context>[\s\S]*?</environment_context>",
    r"<system-reminder>[\s\S]*?</system-reminder>",
]
SUBAGENTS = r"(^|[\\/])subagents([\\/]|$)"

CHUNKS = "array<struct<origin_kind:string,text:string,display_policy:string>>"


def _bare(text: Column) -> Column:
    return T.trimmed(text)


def _starts(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def _chunk(origin: str, text: Column, policy: str | None = None) -> Column:
    return F.struct(F.lit(origin).alias("origin_kind"), text.alias("text"), F.lit(policy).cast("string").alias("display_policy"))


def _injected(text: Column) -> Column:
    return _chunk("injected_user_shaped", text, "collapse")


def _said(*chunks: Column) -> Column:
    """The chunks that have a text."""
    return F.filter(F.array(*chunks), lambda c: F.length(c["text"]) > 0).cast(CHUNKS)


def split_user_text(text: Column, platform: Column | None = None, path: Column | None = None) -> Column:
    """CHUNKS of a text, null and blank ones having none: delegated or automatic as a whole, a command with the words that it carries,
    what stands before and after a request's mark, leading injected blocks and the rest, synthetic as a whole, or the user's own."""
    own = _bare(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    delegated = _starts(own, DELEGATED)
    if platform is not None and path is not None:
        delegated |= F.coalesce((platform == "claude_code") & path.rlike(SUBAGENTS), F.lit(False))

    # A command and nothing else.
    emptied = F.regexp_replace(own, r"<command-(name|message|args)>[\s\S]*?</command-\1>", "")
    command = _starts(own, ENVELOPES) & (_bare(emptied) == "")
    name, message, args = (_bare(F.regexp_extract(own, f"<command-{f}>([\\s\\S]*?)</command-{f}>", 1)) for f in ("name", "message", "args"))
    bare_name, bare_message = (_bare(F.regexp_replace(x, "^/+", "")) for x in (name, message))
    key = F.lower(F.when(bare_name != "", bare_name).otherwise(bare_message))
    words = F.when((key == "clear") & (args == ""), "").otherwise(F.coalesce(F.nullif(args, F.lit("")), F.nullif(message, F.lit("")), bare_name))

    at = F.instr(own, REQUEST)
    asked = F.array(_injected(_bare(F.substring(own, F.lit(1), at - 1))), _chunk("user_authored", _bare(F.substring(own, at + len(REQUEST), F.length(own)))))

    any_block = "(?:" + "|".join(BLOCKS) + ")"
    lead = F.regexp_extract(own, f"^(?:{any_block}[{T.SPACE}]*)+", 0)
    led = F.transform(F.regexp_extract_all(lead, F.lit(f"({any_block})"), 1), _injected)
    rest = _chunk("user_authored", _bare(F.substring(own, F.length(lead) + 1, F.length(own))))

    return (
        F.when(own == "", F.array().cast(CHUNKS))
        .when(delegated, _said(_chunk("delegated_instruction", own)))
        .when(_starts(own, AUTOMATION), _said(_chunk("automation_trigger", own)))
        .when(command, _said(_injected(own), _chunk("user_authored", words)))
        .when(at > 0, F.filter(asked, lambda c: F.length(c["text"]) > 0).cast(CHUNKS))
        .when(lead != "", F.concat(led.cast(CHUNKS), _said(rest)))
        .when(_starts(own, INJECTED + SYNTHETIC), _said(_injected(own)))
        .otherwise(_said(_chunk("user_authored", own)))
    )
