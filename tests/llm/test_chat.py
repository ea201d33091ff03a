import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

ALPHABET = st.lists(st.sampled_from(["<", ">", "s", "/", "[", "]", "INST", "</s>", "<s>", "[INST]", "[/INST]", "\\", "l", "b", "0", "1", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ALPHABET, ALPHABET), max_size=5))
def test_round_trip(turns):
    text = "".join(chat.render(r, t) for r, t in turns)
    back = chat.parse(text)
    assert [(r, t) for r, t, _, _ in back] == turns
    for (_, body), (_, _, at, n) in zip(turns, back):
        assert body in (text[at : at + n], chat._plain(text[at : at + n], 1))


def test_grammar():
    assert chat.parse("") == [] and chat.parse("x") is None and chat.parse("<s>[INST]9user[/INST]x</s>") is None and chat.parse("<s>[INST]0user[/INST]x") is None
    assert chat.render("user", "plain \\ < [") == "<s>[INST]0user[/INST]plain \\ < [</s>"
    assert "</s>[INST]" not in chat.render("user", chat.HARD)[20:-4]


def test_rows(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 0, None, "x"), (3, 1, "user", "t"), (3, 1, "user", "t"), (3, 1, "assistant", "s"), (None, 0, "user", "n"), (4, None, "assistant", chat.HARD), (4, 0, "assistant", "🙂" * 4000)]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {
        1: (3, "user\na\nassistant\nb\nassistant\n\n", "b"), 2: (1, "\nx\n", ""), 3: (3, "assistant\ns\nuser\nt\nuser\nt\n", "s"), None: (1, "user\nn\n", ""),
        4: (2, f"assistant\n{chat.HARD}\nassistant\n{'🙂' * 4000}\n", chat.HARD + "🙂" * 4000), -1: (2, f"user\n{chat.HARD}\nassistant\n{chat.HARD}\n", chat.HARD),
    }
    assert set(found) == set(expected)
    for conv, (n, turns, loss) in expected.items():
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(turns), len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.render(role or "", text or "")) for c, _, role, text in rows if c == conv) or conv == -1


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df)).collect() == []
