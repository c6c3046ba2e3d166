"""Chat formatting: an exact round trip, the mask, and odd input."""

import pytest

from emberline.llm import chat

ROWS = [
    (1, 0, "system", "be [kind] \\l </s>"), (1, 1, "user", "a"), (1, 2, "user", "<+>b\n"), (1, 3, "assistant", "]\nx"),
    (1, 4, "assistant", "\\\\<"), (1, 5, "user", None), (2, None, "assistant", "first"), (2, 1, None, "no role"),
    (2, 1, "tool]\n", "odd role"), (3, 0, "assistant", ""), (None, 0, "user", "no id"), (4, 7, "user", "same"),
    (4, 7, "user", "same"),
] + [(9, k, "user" if k % 3 else "assistant", f"turn {k} " + "long " * (k % 50)) for k in range(600)]
COLUMNS = "conv_id long, turn long, role string, text string, formatted string, turns int"


@pytest.fixture(scope="module")
def out(spark):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in reversed(ROWS)], COLUMNS)
    df = chat.format_chat(turns)
    got = df.select("conv_id", "formatted", chat.parse_chat(df.formatted).alias("back"),
                    chat.masked_texts(df.formatted, df.loss_runs).alias("learned"), "loss_runs").collect()
    return {r["conv_id"]: r for r in got}


def expected(conv):
    rows = [r for r in ROWS if r[0] == conv]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in rows]


@pytest.mark.parametrize("conv", [1, 2, 3, 4, 9, None])
def test_round_trip(out, conv):
    turns = expected(conv)
    assert [(t["role"], t["text"]) for t in out[conv]["back"]] == turns
    assert "".join(out[conv]["learned"]) == "".join(x for role, x in turns if role == "assistant")
    assert sum(r["chars"] for r in out[conv]["loss_runs"]) == len(out[conv]["formatted"])


def test_neighbours_of_one_role_share_a_block(out):
    assert out[1]["formatted"].count(chat.OPEN) == 4
    assert out[1]["formatted"].count(chat.JOIN) == 2
    assert "</s>[INST]" not in out[1]["formatted"]


def test_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], COLUMNS)).count() == 0
