import hashlib
import random

from cairn.llm import chat


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(["<", "|", "\\", ">", "\n", "n", "<|im_end|>", "<|im_start|>", "assistant", "<|image:0|>"], k=rng.randint(0, 12)))
        role = "".join(rng.choices(["user", "\n", "\\", "n", "<|", "|>"], k=rng.randint(0, 4)))
        parts = [{"kind": "text", "text": x, "ref": None, "units": None} for x in (text[:3], text[3:])]
        block, *_ = chat.format_turn(role, parts)
        assert list(chat.parse_turns(block * 2)) == [(role, text)] * 2
        assert "<|" not in chat.escape(text)


def test_parts_become_placeholders():
    parts = [{"kind": k, "text": t, "ref": r, "units": u} for k, t, r, u in (("text", "see ", None, None), ("image", None, "a.png", 64), ("text", " and ", None, None), ("audio", None, "b.wav", 3), ("document", None, None, None), ("text", "<|image:0|>", None, None))]
    block, start, end, used = chat.format_turn("assistant", parts)
    assert block[start:end] == "see <|image:0|> and <|audio:1|><|document:2|><\\|image:0|>"
    assert [(a[0], a[1], a[2], block[a[3] : a[4]], a[5]) for a in used] == [(0, "image", "a.png", "<|image:0|>", 64), (1, "audio", "b.wav", "<|audio:1|>", 75), (2, "document", None, "<|document:2|>", 0)]
    assert list(chat.parse_turns(block)) == [("assistant", "see  and <|image:0|>")]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b|>"), (1, 0, "user", "a\nb"), (1, 0, "user", "a\nb"), (2, None, None, None), (None, 3, "assistant", "x"), (1, 2, "assistant", "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string").withColumn("parts", chat.text_parts())
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hexed("user\na\nb\nuser\na\nb\nassistant\nb|>\nassistant\né\n") and got[1]["n_turns"] == 4
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, hexed("b|>é"))
    assert got[2]["turns_sha256"] == hexed("\n\n") and got[2]["loss_sha256"] == hexed("") and got[None]["n_turns"] == 1
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
