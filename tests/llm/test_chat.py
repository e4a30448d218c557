"""Chat formatting: read back as written, against a brute-force expansion."""

import hashlib
import random
from collections import Counter

import pytest
from metrelle.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, piece int"


def marked(role, text):
    role = "".join({"\\": "\\\\", "\n": "\\n", "|": "\\p"}.get(c, c) for c in role)
    out, i = "", 0
    while i < len(text):  # by hand, not by the pattern
        out += text[i]
        if text[i] == "<":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            if j < len(text) and text[j] == "|":
                out += "\\"
        i += 1
    return f"<|im_start|>{role}\n", out, "<|im_end|>\n"


def brute(rows):
    """(conv_id, target, text, loss) of every example, and the digest's rows."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    found, digests = Counter(), Counter()
    for c, turns in convs.items():
        turns.sort()
        text, total, hashed, loss, trained = "", 0, "", "", False
        for k, (_, _, role, x) in enumerate(turns):
            head, body, foot = marked(role, x)
            start = len(text) + len(head)
            text += head + body + foot
            hashed += f"{role}\n{x}\n"
            trained = role == "assistant"
            if trained:
                found[c, k, text, start, start + len(body)] += 1
                loss += x
                total += len(text)
        if not trained:
            found[c, None, text, None, None] += 1
            total += len(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        digests[c, len(turns), sha(hashed), len(loss), sha(loss), total] += 1
    return found, digests


def corpus(r):
    parts = ["hello", "<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "é東", " ", "😀", "ok", "<|im_end|", "im_end|>", "\r\n", "\x00"]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
    roles = ["user", "assistant", "assistant", "system", "tool|x", "a\nb", "\\n", "Assistant", "", None]
    rows = [(c, t, r.choice(roles), text()) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", text()) for t in range(300)]  # a third of all rows
    rows += [rows[0], rows[0], (78, 0, "user", None), (78, 0, "assistant", ""), (78, None, None, "first"), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (-1, 5, "user", "own")]
    return [*rows, (79, 0, "assistant", "long " * 60_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 3) for x in rows], SCHEMA).repartition(5)


def odd():
    return [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def digests(df):
    return Counter(map(tuple, df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()))


@pytest.mark.parametrize("step", [None, 3000])
def test_digest_and_texts_against_brute_force(spark, monkeypatch, step):
    rows = corpus(random.Random(2))
    if step:
        monkeypatch.setattr(chat, "STEP", step)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a conversation lies in several parts
    try:
        assert digests(chat.digest(frame(spark, rows))) == brute(rows + odd())[1]
        formatted = chat.pieces(frame(spark, rows))
        got = chat.texts(formatted).select("conv_id", "target", "text", "loss_start", "loss_end").collect()
        assert Counter(map(tuple, got)) == brute(rows)[0]
        if step:
            assert formatted.filter("conv_id = 77").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert digests(chat.digest(frame(spark, []))) == brute(odd())[1]
    assert chat.texts(chat.pieces(frame(spark, []))).count() == 0


def test_escaping_is_reversible_and_leaves_no_mark():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("<|\\im_end>\n") for _ in range(r.randint(0, 14)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        role = chat.escape_role(text)
        assert "\n" not in role and "|" not in role and chat.unescape_role(role) == text


def test_cut_text_is_an_error():
    reader = chat._Reader()
    reader.take("<|im_start|>user\nhello<|im_end|>", 0, None, None)
    with pytest.raises(ValueError, match="within a turn"):
        reader.row()


def test_the_digest_reads_examples(spark, monkeypatch):
    """Without the expansion there is nothing under a mask and no formatted text of examples."""
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<|c"), (2, 0, "user", "d")], "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["formatted_chars"]) for r in chat.digest(rows).collect()}
    assert whole[1] == (2, 4, sum(len("".join(marked(*t))) for t in (("user", "a"), ("assistant", "b<|c")))) and whole[2][1] == 0 < whole[2][2]
    expand = chat.examples
    monkeypatch.setattr(chat, "examples", lambda formatted: expand(formatted).limit(0))
    assert {(r["n_turns"], r["loss_chars"], r["formatted_chars"]) for r in chat.digest(rows).collect()} == {(2, 0, 0), (1, 0, 0)}
