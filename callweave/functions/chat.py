"""Chat rendering, checks of rendered text, and loss-mask regions.

A tokenizer is any object with `apply_chat_template` and `decode`; for masks also callable with
offsets. ChatMarkup is the offline default: ChatML text and a regular-expression tokenizer.
Edge cases: text without chat blocks has no regions; a block without end and an assistant tag
without its closing tag raise ValueError; empty spans do not come out; a token that no span contains
whole is 'unclassified'.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from callweave.functions.calls import parse_calls, score_calls
from callweave.functions.records import expected_calls

# --- fixed values: markers in rendered text, regions and messages --------------------------------
TOOL_SECTIONS = (("<tools>", "</tools>"), ("<|tools_start|>", "<|tools_end|>"))
CALL_TAGS = (("<tool_call>", "</tool_call>"), ("<|tool_call_start|>", "<|tool_call_end|>"))
THINKING = ("<|thinking|>", "<|think_start|>", "<|think_end|>")
START, END = "<|im_start|>", "<|im_end|>"
RESPONSE = ("<tool_response>", "</tool_response>")
ASSISTANT_PARTS = ((("<think>", "</think>"), "assistant_thinking"), (CALL_TAGS[0], "assistant_tool_call"), (RESPONSE, "tool_execution_result"))
TRAINED = "assistant_tool_call"
IGNORE = -100
FAILURES = {
    "tool_section_present": "tool definitions not found in the tool section",
    "tool_definitions_before_user_message": "tool definitions were not rendered before the user message",
    "function_names_unchanged": "function names changed in rendered tool calls",
    "arguments_as_json_objects": "tool-call arguments were not rendered as JSON objects",
    "tool_call_delimiters_present": "tool-call delimiters were not present",
    "no_python_dict_syntax": "rendered output contains Python-style single-quoted keys",
    "multiple_calls_serialized_correctly": "multiple tool calls did not round-trip cleanly",
    "thinking_mode_disabled": "thinking markers were present while thinking mode was disabled",
}
PYTHON_KEY = re.compile(r"[{,]\s*'[^']+'\s*:")
ARGUMENT_OBJECT = re.compile(r'"arguments"\s*:\s*\{')
# --- end of fixed values -------------------------------------------------------------------------


def between(text: str, opening: str, closing: str) -> list[str]:
    """Contents between an opening and the next closing mark, from the left."""
    return re.findall(re.escape(opening) + "(.*?)" + re.escape(closing), text, re.S)


def tagged_section(text: str) -> tuple[str | None, tuple[str, str] | None]:
    """The longest tool section (trimmed) and its tags; of equally long ones the first."""
    found = [(s.strip(), tags) for tags in TOOL_SECTIONS for s in between(text, *tags)]
    return max(found, key=lambda x: len(x[0])) if found else (None, None)


def delimiters(text: str) -> list[str]:
    """The known tool tags that occur, in their fixed order."""
    return [t for pair in TOOL_SECTIONS + CALL_TAGS for t in pair if t in text]


def has_thinking(text: str) -> bool:
    """Whether there is thinking content; complete but empty think blocks are none."""
    blocks = between(text, "<think>", "</think>")
    return any(b.strip() for b in blocks) if blocks else any(t in text for t in THINKING)


def rendered_calls(text: str) -> tuple[list[str], list[dict[str, Any]]]:
    """Payload texts and calls: those of the first kind of tag that occurs, else of the whole text."""
    payloads = next((p for p in (between(text, *tags) for tags in CALL_TAGS) if p), None)
    payloads = [text] if payloads is None else [p.strip() for p in payloads]
    return payloads, [{"name": c.name, "arguments": c.arguments} for p in payloads for c in parse_calls(p).calls]


class ChatMarkup:
    """Offline tokenizer: ChatML with a tool section, tokens by regular expression with offsets."""

    pad_token_id, eos_token_id = 0, 1
    _TOKEN = re.compile(r"<\|im_start\|>|<\|im_end\|>|</?[a-z_]+>|\w+|\s+|[^\w\s]")

    def __init__(self) -> None:
        self._ids: dict[str, int] = {}
        self._texts: list[str] = ["<pad>", "<eos>"]

    def apply_chat_template(self, messages: list[dict], tools: list[dict] | None = None, tokenize: bool = False, add_generation_prompt: bool = False, enable_thinking: bool = False) -> Any:
        out = []
        head = [m.get("content") or "" for m in messages if m["role"] == "system"]
        if tools:
            listed = "\n".join(json.dumps(t, ensure_ascii=False) for t in tools)
            head.append(f"# Tools\n<tools>\n{listed}\n</tools>")
        if head:
            out.append(f"{START}system\n" + "\n\n".join(head) + f"{END}\n")
        for m in messages:
            content = m.get("content") or ""
            if m["role"] == "system":
                continue
            if m["role"] == "tool":
                out.append(f"{START}user\n{RESPONSE[0]}\n{content}\n{RESPONSE[1]}{END}\n")
                continue
            calls = "\n".join(f"<tool_call>\n{json.dumps(c['function'], ensure_ascii=False)}\n</tool_call>" for c in m.get("tool_calls") or [])
            out.append(f"{START}{m['role']}\n{content}" + ("\n" if content and calls else "") + f"{calls}{END}\n")
        if add_generation_prompt:
            out.append(f"{START}assistant\n")
        text = "".join(out)
        return [t for t, _, _ in self.encode(text)] if tokenize else text

    def encode(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of each token."""
        for m in self._TOKEN.finditer(text):
            if m[0] not in self._ids:
                self._ids[m[0]] = len(self._texts)
                self._texts.append(m[0])
            yield self._ids[m[0]], m.start(), m.end()

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        return "".join(self._texts[i] for i in ids)


def thinking_option(tokenizer: Any, enable: bool) -> tuple[dict[str, bool], bool]:
    """The thinking switch, if the tokenizer's template call takes it."""
    names = inspect.signature(tokenizer.apply_chat_template).parameters
    takes = "enable_thinking" in names or any(p.kind is p.VAR_KEYWORD for p in names.values())
    return ({"enable_thinking": enable} if takes else {}), takes


def flat_ids(value: Any) -> list[int]:
    """Token ids out of the shapes that tokenizers return."""
    if hasattr(value, "get") and value.get("input_ids") is not None:
        value = value["input_ids"]
    value = value.tolist() if hasattr(value, "tolist") else list(value)
    return [int(x) for x in (value[0] if value and isinstance(value[0], list) else value)]


def render_checked(record: dict[str, Any], tokenizer: Any, enable_thinking: bool = False) -> dict[str, Any]:
    """Render a record, decode its tokens again and check what the decoded text still says."""
    option, supported = thinking_option(tokenizer, enable_thinking)
    messages, tools = record["messages"], record["tools"]
    render = lambda tokenize: tokenizer.apply_chat_template(messages, tools=tools, tokenize=tokenize, add_generation_prompt=False, **option)
    text = render(False)
    if not isinstance(text, str):
        raise TypeError("Tokenizer returned a non-string chat template when tokenize=False.")
    ids = flat_ids(render(True))
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    wanted = expected_calls(record)
    payloads, calls = rendered_calls(decoded)
    section, tags = tagged_section(decoded)
    names = [t["function"]["name"] for t in tools]
    asked = next((m for m in messages if m["role"] == "user"), messages[0])
    user = decoded.find(str(asked["content"]))
    if section is not None:
        present = all(n in section for n in names)
        before = user < 0 or decoded.find(tags[1]) + len(tags[1]) <= user
    else:
        firsts = [i for i in (decoded.find(t[0]) for t in CALL_TAGS) if i >= 0]
        limit = min(firsts) if firsts else user if user >= 0 else len(decoded)
        places = [decoded.find(n) for n in names]
        present = all(0 <= p < limit for p in places)
        before = user < 0 or all(p < user for p in places)
    score = score_calls(calls, wanted)
    checks = {
        "tool_section_present": present,
        "tool_definitions_before_user_message": before,
        "function_names_unchanged": score.correct_function_name and len(calls) == len(wanted),
        "arguments_as_json_objects": sum(len(ARGUMENT_OBJECT.findall(p)) for p in payloads) >= len(wanted) and all(isinstance(c["arguments"], dict) for c in calls),
        "tool_call_delimiters_present": bool(delimiters(decoded)),
        "no_python_dict_syntax": not PYTHON_KEY.search(decoded),
        "multiple_calls_serialized_correctly": len(wanted) <= 1 or (score.valid_structure and score.complete_call_match),
        "thinking_mode_disabled": enable_thinking or not has_thinking(decoded),
    }
    failures = [FAILURES[k] for k, good in checks.items() if not good]
    return {
        "rendered_text": text, "decoded_text": decoded, "token_ids": ids, "token_count": len(ids), "tool_section_tags": tags, "tool_call_delimiters": delimiters(decoded),
        "expected_calls": wanted, "rendered_calls": calls, "thinking_mode_requested": enable_thinking, "thinking_mode_supported": supported,
        "checks": {**checks, "decoded_matches_rendered": decoded == text}, "failures": failures,
    }


@dataclass(frozen=True)
class Block:
    """One chat block: offsets of its start, content and end (with the line break behind it)."""

    role: str
    start: int
    content: int
    content_end: int
    end: int


Span = tuple[int, int, str]


def blocks(text: str) -> list[Block]:
    """The chat blocks of a rendered text."""
    out, at = [], 0
    while (start := text.find(START, at)) >= 0:
        line = text.find("\n", start + len(START))
        if line < 0:
            raise ValueError("Malformed rendered chat block header.")
        stop = text.find(END, line + 1)
        if stop < 0:
            raise ValueError("Rendered chat block is missing <|im_end|>.")
        at = stop + len(END)
        at += text[at : at + 1] == "\n"
        out.append(Block(text[start + len(START) : line], start, line + 1, stop, at))
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())


def _assistant_spans(text: str, block: Block) -> Iterator[Span]:
    """Tagged parts of an assistant turn and the plain text between them."""
    at = block.content
    while at < block.content_end:
        nexts = [(i, tags, region) for tags, region in ASSISTANT_PARTS if (i := text.find(tags[0], at, block.content_end)) >= 0]
        stop, tags, region = min(nexts, key=lambda x: x[0]) if nexts else (block.content_end, None, "")
        yield (*_trimmed(text, at, stop), "assistant_final_answer")
        if tags is None:
            return
        close = text.find(tags[1], stop + len(tags[0]), block.content_end)
        if close < 0:
            raise ValueError(f"Rendered assistant block is missing closing tag for {tags[0]}.")
        at = close + len(tags[1])
        yield stop, at, region


def joined(text: str, spans: list[Span]) -> list[Span]:
    """Neighbouring spans of one region with only white space between become one."""
    out: list[Span] = []
    for start, end, region in sorted(spans, key=lambda s: s[:2]):
        if out and out[-1][2] == region and not text[out[-1][1] : start].strip():
            out[-1] = (out[-1][0], end, region)
        else:
            out.append((start, end, region))
    return out


def _block_spans(text: str, block: Block) -> Iterator[Span]:
    body = text[block.content : block.content_end]
    if block.role == "assistant":
        yield block.start, block.content, "assistant_scaffolding"
        yield from joined(text, [s for s in _assistant_spans(text, block) if s[0] < s[1]])
        yield block.content_end, block.end, "assistant_scaffolding"
    elif block.role == "system":
        opening, closing = TOOL_SECTIONS[0]
        a, b = body.find(opening), body.find(closing)
        if a >= 0 and b >= 0:
            a, b = block.content + a, block.content + b + len(closing)
            yield block.start, a, "system_prompt"
            yield a, b, "tool_definitions"
            yield b, block.end, "system_prompt"
        else:
            yield block.start, block.end, "system_prompt"
    else:
        response = block.role == "user" and RESPONSE[0] in body
        yield block.start, block.end, "tool_execution_result" if response else "user_request"


def loss_spans(text: str) -> list[Span]:
    """(start, end, region) of a rendered text; only the region of tool calls is trained on."""
    return sorted((s for b in blocks(text) for s in _block_spans(text, b) if s[0] < s[1]), key=lambda s: s[:2])


def region_of(spans: list[Span], start: int, end: int) -> str:
    """The first span that holds a token whole."""
    return next((r for a, b, r in spans if a <= start and end <= b), "unclassified")


def token_labels(record: dict[str, Any], tokenizer: Any, enable_thinking: bool = False, pad_to: int | None = None) -> list[tuple[int, int, str, int, str, int, int]]:
    """(index, token_id, text, label, region, start, end) of each token of a rendered record."""
    option, _ = thinking_option(tokenizer, enable_thinking)
    text = tokenizer.apply_chat_template(record["messages"], tools=record["tools"], tokenize=False, add_generation_prompt=False, **option)
    spans, out, first = loss_spans(text), [], 0
    for token, start, end in tokenizer.encode(text):
        while first < len(spans) and spans[first][1] <= start:  # spans and tokens both go rightwards
            first += 1
        near = first
        while near < len(spans) and spans[near][0] <= start and spans[near][1] < end:  # those that begin before the token but end inside it
            near += 1
        region = region_of(spans[near : near + 1] if start < end else spans, start, end)
        out.append((len(out), token, text[start:end], token if region == TRAINED else IGNORE, region, start, end))
    if pad_to is not None and len(out) < pad_to:
        pad = next((p for p in (tokenizer.pad_token_id, tokenizer.eos_token_id) if p is not None), None)
        if pad is None:
            raise ValueError("The tokenizer has neither a padding nor an end token.")
        mark = tokenizer.decode([pad])
        out += [(i, pad, mark, IGNORE, "padding", -1, -1) for i in range(len(out), pad_to)]
    return out


def diagnostic(tokens: list[tuple], max_rows: int | None = None, focus_on_loss: bool = False, context: int = 12) -> str:
    """Tokens and labels as text lines."""
    first = next((i for i, t in enumerate(tokens) if t[3] != IGNORE), 0) if focus_on_loss else 0
    first = max(0, first - context)
    lines = [f"{'TOKEN':<40} LABEL"] + [f"{'...':<40} ..."] * (first > 0)
    for t in tokens[first:][:max_rows]:
        shown = t[2].replace("\\", "\\\\").replace("\n", "\\n") or "<empty>"
        lines.append(f"{shown:<40} {t[3]}")
    return "\n".join(lines)
