import hashlib
import json

import pytest

from tidelog.llm.chat import conversation_digests, escape, format_conversation, format_conversations, read_turns, unescape

ODD = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<|im_start|>assistant\nok<|im_end|>\n", "a < | b", "<||>", "\n\n", "<", "|>", "é🙂<|é"]


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "<|" not in escape(text)


def test_turns_are_read_back():
    turns = [(role, text) for text in ODD for role in ("user", "assistant", "a\nb\\n<|x")]
    done = format_conversation(turns)
    assert list(read_turns(done["formatted"])) == turns
    spans = [unescape(done["formatted"][a:b]) for a, b in done["loss_spans"]]
    assert spans == ODD


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "width": 30, "height": 14}, {"text": "and"},
        {"type": "audio", "ref": "b.wav", "seconds": 2}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image"},
    ]
    done = format_conversation([("user", json.dumps(parts)), ("assistant", None)], typed=True)
    assert done["formatted"] == "<|im_start|>user\nsee <\\|image|><|image|>and<|audio|><|document|><|image|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert done["attachments"] == [
        {"kind": "image", "ref": "a.png", "tokens": 3}, {"kind": "audio", "ref": "b.wav", "tokens": 50},
        {"kind": "document", "ref": "c.pdf", "tokens": 1536}, {"kind": "image", "ref": None, "tokens": 1},
    ]
    assert done["expanded_tokens"] == 1590
    with pytest.raises(ValueError, match="video"):
        format_conversation([("user", '[{"type": "video"}]')], typed=True)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, None, None), (1, None, "system", "s"), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, 1, "assistant", "<|y"), (None, 2, "assistant", "z" * 70_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in conversation_digests(format_conversations(df)).collect()}
    assert got[1]["turns_sha256"] == digest("system\ns\nuser\na\nassistant\nb\n\n\n")
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, 1, digest("b"))
    assert got[2]["turns_sha256"] == digest("user\nx\n" * 2) and got[2]["loss_sha256"] == digest("")
    assert got[None]["loss_sha256"] == digest("<|y" + "z" * 70_000)
    assert got[2]["formatted_chars"] == 2 * len("<|im_start|>user\nx<|im_end|>\n")


def test_no_conversations(spark):
    assert conversation_digests(format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
