import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from callweave.functions import chat
from callweave.functions.calls import Call, assign, fragments, parse_calls, score_call, score_calls
from callweave.functions.records import canonical_record
from tests.test_records import row


def test_parsing():
    one = parse_calls('Sure: {"name": " f ", "arguments": "{\\"a\\": 1}"} ok')
    assert one.calls == (Call("f", {"a": 1}),) and one.valid_structure and one.had_extra_prose
    many = parse_calls({"tool_calls": [{"type": "function", "function": {"name": "f", "arguments": {}}}, {"name": "g", "arguments": {}}]})
    assert [c.name for c in many.calls] == ["f", "g"] and many.valid_structure
    assert parse_calls("  ").errors == ("Model output is empty.",)
    assert parse_calls("no json [").errors == ("No JSON object or array found in model output.",)
    assert parse_calls('{"name": "f"}').errors == ("fragment[0].arguments is missing.",)
    assert parse_calls('{"name": "", "arguments": null}').errors == ("fragment[0].name must be a non-empty string.", "fragment[0].arguments must be a JSON object.")
    assert parse_calls('{"name": "f", "arguments": "{"}').errors == ("fragment[0].arguments contains invalid JSON.",)
    assert parse_calls(None).errors == ("root must be a JSON object or list.",)
    assert [v for _, _, v in fragments("[1] x {bad [2]")] == [[1], [2]]
    assert not parse_calls("[" * 100_000).calls


def test_scores():
    a, b = {"name": "f", "arguments": {"x": 1, "y": 2}}, {"name": "g", "arguments": {}}
    assert score_call(a, {"name": "f", "arguments": {"y": 2, "x": True}}).complete_call_match
    assert score_call(a, b).parse_errors == () and not score_call(a, b).correct_function_name
    assert "exactly one" in score_call([a, b], a).parse_errors[-1]
    assert score_calls([b, a], [a, b]).complete_call_match
    ordered = score_calls([b, a], [a, b], order_matters=True)
    assert ordered.valid_structure and not ordered.complete_call_match
    short = score_calls([a], [a, b], order_matters=True)
    assert short.valid_structure and short.call_scores == () and not short.correct_function_name
    assert score_calls([a], [a, b]).call_scores[1].parse_errors == ("Expected call has no predicted match.",)
    assert not score_calls("junk", [a]).valid_structure


@given(st.integers(1, 4).flatmap(lambda m: st.lists(st.lists(st.sampled_from([0, 1, 10, 11, 1111]), min_size=m, max_size=m), min_size=1, max_size=4)))
def test_assignment_is_the_first_best_one(weights):
    options = [None, *range(len(weights[0]))]
    valid = [a for a in itertools.product(options, repeat=len(weights)) if len({x for x in a if x is not None}) == sum(x is not None for x in a)]
    total = lambda a: sum(weights[i][x] for i, x in enumerate(a) if x is not None)
    assert assign(weights) == list(max(valid, key=total))


def conversation():
    r = canonical_record(row(), "train")
    r["messages"] += [{"role": "tool", "content": "confirmed"}, {"role": "assistant", "content": " Your table is confirmed. "}]
    return r


def test_rendered_record_passes_its_checks():
    out = chat.render_checked(canonical_record(row(), "train"), chat.ChatMarkup())
    assert out["failures"] == [] and all(out["checks"].values()) and out["tool_section_tags"] == ("<tools>", "</tools>")


def test_python_style_and_thinking_are_noticed():
    class Odd(chat.ChatMarkup):
        def apply_chat_template(self, messages, tools=None, tokenize=False, **kwargs):
            text = "user: x <|think_start|> {'name': 'book_table'}"
            return [i for i, _, _ in self.encode(text)] if tokenize else text

    out = chat.render_checked(canonical_record(row(), "train"), Odd())
    assert out["thinking_mode_supported"]
    assert {chat.FAILURES[k] for k in ("no_python_dict_syntax", "thinking_mode_disabled", "tool_call_delimiters_present")} <= set(out["failures"])
    assert not chat.has_thinking("<think>\n</think> <|thinking|>") and chat.has_thinking("<think>a</think>")


def test_only_call_tokens_are_trained_on():
    tokens = chat.token_labels(conversation(), chat.ChatMarkup(), pad_to=2000)
    trained = "".join(t[2] for t in tokens if t[3] != chat.IGNORE)
    assert trained.startswith("<tool_call>") and trained.endswith("</tool_call>") and "confirmed" not in trained
    assert len(tokens) == 2000 and tokens[-1][4] == "padding"
    assert {t[4] for t in tokens} >= {"system_prompt", "tool_definitions", "user_request", "assistant_scaffolding", "tool_execution_result", "assistant_final_answer"}
    assert chat.diagnostic(tokens, 3, True, 1).splitlines()[1].startswith("...")


def test_broken_markup_raises():
    with pytest.raises(ValueError, match="header"):
        chat.blocks("<|im_start|>user")
    with pytest.raises(ValueError, match="missing"):
        chat.blocks("<|im_start|>user\nhi")
    with pytest.raises(ValueError, match="closing tag"):
        chat.loss_spans("<|im_start|>assistant\n<tool_call>{}<|im_end|>\n")
    assert chat.blocks("plain") == [] and chat.loss_spans("") == []
    assert chat.region_of([(0, 3, "a")], 2, 4) == "unclassified"
