"""Chat formatting: spans, reading back, templates that rewrite history, conversations that go wrong."""

import hashlib

from wirelark.llm import chat

ROWS = [
    (1, 0, "system", "be \\ brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<|end|>\n<|turn|>user<|text|>\\<s>"),
    (2, 1, None, None), (2, None, "assistant", ""), (None, 0, "user", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"),
    (4, 0, "a<|text|>\nb", "role with marks"), (4, 1, "assistant", "A" * 300_000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], "conv_id long, turn long, role string, text string, part string, spans int")


def test_escape_is_reversible_and_hides_control():
    for text in [r[3] or "" for r in ROWS] + ["\\", "\\\\", "<\\s>", "<s>\\", "[INST][INST]", "<<s>>", "<<SYS>>", "<|im_start|><|end|>"]:
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def expected(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.turn_template(turns)))
    return out


def test_read_back(spark):
    made = chat.read_back(chat.format_conversations(frame(spark)))
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == expected(ROWS)
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0


def test_long_conversation_in_parts(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3 * chat.PART_TURNS + 1)]
    parts = chat.format_conversations(frame(spark, rows))
    assert sorted(r["part"] for r in parts.collect()) == [0, 1, 2, 3]
    assert {r[0]: tuple(r[1:]) for r in chat.read_back(parts).collect()} == expected(rows)


def test_spans_of_any_template():
    def other(turns):
        return "<s>" + "".join(f"[{role}]{text}[{role}]" if role != "system" else f"!{text}" for role, text in turns)

    turns = [("system", "[["), ("user", "]"), ("assistant", "[assistant]")]
    output, spans, rewritten = chat.render(turns, other)
    assert not rewritten and [output[s[2] : s[3]] for s in spans] == [t for _, t in turns]
    assert [output[s[0] : s[1]] for s in spans] == ["![[", "[user]][user]", "[assistant][assistant][assistant]"]


def test_rewritten_history_is_found():
    def last_thought_only(turns):
        return "".join(f"<{role}>{text if i == len(turns) - 1 or role == 'user' else ''}</>" for i, (role, text) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "thought"), ("user", "b"), ("assistant", "more")]
    output, spans, rewritten = chat.render(turns, last_thought_only)
    assert rewritten == [2]
    assert spans[1] is None and output[spans[0][2] : spans[0][3]] == "a" and output[spans[3][2] : spans[3][3]] == "more"


def test_long_conversation_of_any_template_is_whole(spark):
    """200 turns: a preamble once, rules for the last turn only, history rewritten beyond the size of a part."""
    turns = [("assistant" if i % 2 else "user", f"turn {i}") for i in range(200)]
    rows = [(5, i, *t) for i, t in enumerate(turns)]

    def preamble(turns):
        return "<s>" + "".join(f"[{role}]{text}\n" for role, text in turns)

    def last_thought_only(turns):
        return "".join(f"<{role}>{text if i == len(turns) - 1 or role == 'user' else ''}</>" for i, (role, text) in enumerate(turns))

    for template in (preamble, last_thought_only):
        (made,) = chat.format_conversations(frame(spark, rows), template, None).collect()
        output, spans, rewritten = chat.render(turns, template)
        assert made["part"] == 0 and made["formatted"] == output == template(turns) and made["rewritten"] == rewritten
        assert [s and tuple(s)[1:] for s in made["spans"]] == spans
    assert rewritten == list(range(2, 200, 2)) and spans[197] is None and output[spans[196][2] : spans[196][3]] == "turn 196"
