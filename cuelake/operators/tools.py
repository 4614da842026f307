"""What a language model is asked for a window of cues, and what its answers mean: prompts, tools, requests, calls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .refine import CHANGE, KEEP

# Names of the tools' parameters.
ID, FIRST, SECOND = "id", "first_lang_text", "second_lang_text"
ANSWER = f"array<struct<name:string,arguments:struct<{ID}:bigint,{FIRST}:string,{SECOND}:string>>>"
RETRY = "No tool was called. Answer with tool calls only: one for each cue of the window that is still open (○)."


def _tool(name: str, about: str, **texts: str) -> dict[str, Any]:
    fields = {ID: {"type": "number", "description": "position of the cue"}} | {k: {"type": "string", "description": v} for k, v in texts.items()}
    return {"name": name, "description": about, "parameters": {"type": "object", "properties": fields, "required": list(fields)}}


def tools(style: str = "function") -> list[dict[str, Any]]:
    """The two tools, as functions ("function") or as names with an input schema ("schema")."""
    both = [_tool(KEEP, "The cue stays as it is."), _tool(CHANGE, "The cue gets better texts.", **{FIRST: "text in the source language", SECOND: "text in the target language"})]
    if style == "function":
        return [{"type": "function", "function": t} for t in both]
    if style == "schema":
        return [{"name": t["name"], "description": t["description"], "input_schema": t["parameters"]} for t in both]
    raise ValueError(f"unknown style {style!r}")


def system_prompt(source: str | None = None, target: str | None = None) -> str:
    """Instructions for the model; the languages are named if both are known."""
    known = f"{FIRST} is in {source}, {SECOND} in {target}." if source and target else f"{FIRST} is in the source language, {SECOND} in the target language."
    return (
        f"You revise bilingual subtitles. Each cue marked ○ needs exactly one tool call: {KEEP} if it reads well, else {CHANGE} with both texts. "
        f"Look at meaning, grammar, punctuation and length. Cues marked ✓ are done and only give context. Call for all open cues at once. {known} "
        "Subtitles show the target language above the source language."
    )


def user_prompt(window: Column, retry: bool = False) -> Column:
    """The request for one window's text."""
    parts = [F.lit("Cues of this window:\n\n"), window, F.lit("\n\nCall a tool for every open cue.")]
    return F.concat(*parts, F.lit(f"\n\n{RETRY}")) if retry else F.concat(*parts)


def messages(system: str, window: str, retry: bool = False) -> list[dict[str, str]]:
    """A conversation of its own per window. A retry repeats the request and adds a reminder, as the first answer held no call."""
    start = [{"role": "system", "content": system}, {"role": "user", "content": f"Cues of this window:\n\n{window}\n\nCall a tool for every open cue."}]
    return [*start, {"role": "user", "content": RETRY}] if retry else start


def calls_of(answers: DataFrame) -> DataFrame:
    """track, call_seq, name, pos, first_text, second_text of answers (track, round, answer: a JSON list of name and arguments).

    Calls of a track are ordered by round and place. An answer that is no such list gives no call; unknown names
    and missing parts stay, for valid_calls to drop.
    """
    rows = answers.select("track", "round", F.posexplode(F.from_json("answer", ANSWER)).alias("i", "c")).where("c is not null")
    seq = F.col("round").cast("bigint") * (1 << 32) + F.col("i")
    a = F.col("c.arguments")
    return rows.select("track", seq.alias("call_seq"), F.col("c.name").alias("name"), a[ID].alias("pos"), a[FIRST].alias("first_text"), a[SECOND].alias("second_text"))
