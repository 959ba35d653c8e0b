import hashlib
import random

from timeloom.llm import chat

CONTROL = ["<|turn|>", "<|text|>", "<|part|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "\x1b", "\x1b-", "\n", "<", "|", ">", "é😀", "$1\\", " "]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", ""]), "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 6))]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.parse_chat(formatted).collect()}
    plain = {r["conv_id"]: r for r in formatted.collect()}
    for c in range(60):
        own = sorted((t, r, x) for k, t, r, x in rows if k == c)
        assert [tuple(x) for x in back[c]["turns"]] == [(r, x) for _, r, x in own]
        assert back[c]["learned"] == [x for _, r, x in own if r == "assistant"]
        assert back[c]["formatted_chars"] == len(plain[c]["formatted"])
        inside = "".join(plain[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in plain[c]["mask"])
        assert not any(x in inside for x in CONTROL[:11])


def test_adjacent_turns_merge_reversibly(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", ""), (1, 4, "user", None)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.first()
    assert r["formatted"] == "<|turn|>user<|text|>a<|part|>b<|end|><|turn|>assistant<|text|>c<|part|><|end|><|turn|>user<|text|><|end|>"
    assert [x["text"] for x in chat.parse_chat(out).first()["turns"]] == ["a", "b", "c", "", ""]


def test_nulls_repeats_long_and_empty(spark):
    many = [(3, t, "user" if t % 2 else "assistant", "x" * 50) for t in range(1500)]
    rows = [(1, None, None, None), (1, 0, "user", "t"), (1, 0, "user", "t"), (None, 0, "assistant", "n"), *many]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "CONV_ID")
    got = {r["conv_id"]: r for r in chat.parse_chat(chat.format_chat(df)).collect()}
    assert len(got[1]["turns"]) == 3 and got[1]["turns"][0]["role"] == "" and got[None]["learned"] == ["n"]
    assert len(got[3]["turns"]) == 1500 and hashlib.md5("".join(got[3]["learned"]).encode()).digest() == hashlib.md5(b"x" * 50 * 750).digest()
    assert chat.parse_chat(chat.format_chat(df.limit(0))).count() == 0


def test_masks_of_many_turns(spark):
    # around the sizes of a block of folded turns; a conversation of thousands
    rows = [(n, t, "assistant" if t % 3 else "user", f"é{t}</s>") for n in (1, 63, 64, 65, 129, 5000) for t in range(n)]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.parse_chat(formatted).collect():
        assert r["learned"] == [x for n, _, role, x in rows if n == r["conv_id"] and role == "assistant"]
        assert [x["text"] for x in r["turns"]] == [x for n, _, _, x in rows if n == r["conv_id"]]
