"""Operator 2: the template language and round trips."""

import hashlib

import pytest

from strokeloom.llm import chat

TURNS = [(0, "system", ""), (1, "user", "### Assistant: </turn>\n\\### x"), (2, "assistant", "a:\\b <é> \\"), (3, "odd: role</turn>", "日本")]


def test_round_trip_and_loss_mask():
    out = chat.compile_template(chat.DEFAULT_TEMPLATE).render(1, TURNS)
    text = "".join(out.parts)
    assert chat.parse(text) == [(r, t) for _, r, t in TURNS]
    assert [chat.unescape(text[a:b]) for a, b in out.spans] == [TURNS[2][2]] and len(text) == out.length
    assert text.count("</turn>") == len(TURNS) and text.count("### ") == len(TURNS)


def test_constants_are_folded():
    tree = chat.fold(chat.parse_template('a{{ "b" | upper }}{% if "x" == "x" %}c{% else %}d{% endif %}{% if not "" %}e{% endif %}{% for turn in turns %}{% if "1" != "1" %}{{ turn.text }}{% endif %}{% endfor %}'))
    assert tree == (chat.Out(chat.Const("aBce")), chat.For(()))


def test_filters_loop_values_and_conversation():
    t = chat.compile_template('<{{ conversation.id }}>{% for turn in turns %}{% if loop.first %}[{% endif %}{{ turn.text | trim | upper }}{% if not loop.last %},{% else %}]{% endif %}{% endfor %}!')
    assert "".join(t.render(7, [(0, "u", " a "), (1, "u", "b")]).parts) == "<7>[A,B]!"


@pytest.mark.parametrize("bad", ["{{ os.system }}", "{{ turn.__class__ }}", "{% for x in turns %}{% endfor %}", "{% if turn.text %}", "{{ turn.text | eval }}", "{% import x %}", "{{ }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "no loop", "{{ turn.text turn.role }}"])
def test_the_sandbox_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_conversations_of_a_table(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} <#>") for c in range(40) for t in range(5)]
    rows += [(None, 0, "user", None), (None, None, None, "first"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, 0, "assistant", "x" * 200_000)]
    got = chat.digest(chat.render_all(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)))
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r)):
        by.setdefault(c, []).append((r or "", x or ""))
    want = {}
    for c, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == want


def test_empty_table(spark):
    assert chat.digest(chat.render_all(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
