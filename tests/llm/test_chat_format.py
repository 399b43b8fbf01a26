import hashlib
import random

import pytest

from palisade.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    "", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|x|>", "<", "|", "a<", "\\", "<|<|", "\n\n", "<|im_end|>\n<|im_start|>user\nhi",
    "\U0001f600 é <|", None,
]
ODD_ROLES = ["user", "assistant", "system", "", None, "us\ner", "a\\n", "\\", "<|im_start|>", "tool"]


def rows_of(seed, n=300):
    draw = random.Random(seed)
    return [
        (draw.choice([1, 2, 3, None]), draw.choice([*range(-3, 140), None]), draw.choice(ODD_ROLES), draw.choice(ODD) if draw.random() < 0.9 else "x" * 200_000)
        for _ in range(n)
    ]


def brute(rows, template=cf.CHAT):
    """The contract over plain Python lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv),
        )
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        states = ["start", *[r for _, _, r, _ in turns]]
        bad = sum(s not in template.steps for s in zip(states, states[1:]))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(said), len(loss), digest(loss), bad, bad == 0 and states[-1] in template.final)
    return out


def found(df):
    return {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["n_illegal"], r["valid"])
        for r in df.collect()
    }


def test_equals_brute_force(spark):
    rows = rows_of(1)
    assert found(cf.format_and_read_back(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_legal_and_illegal_orders(spark):
    talk = {
        1: ["system", "user", "assistant", "user", "assistant"], 2: ["user", "assistant"], 3: ["user"],
        4: ["assistant", "user"], 5: ["user", "user", "assistant"], 6: ["user", "assistant"] * 200, 7: ["system"] * 130,
    }
    rows = [(c, t, r, f"{t}") for c, roles in talk.items() for t, r in enumerate(roles)]
    verdicts = {r["conv_id"]: (r["n_illegal"], r["valid"]) for r in cf.turn_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert verdicts == {1: (0, True), 2: (0, True), 3: (0, False), 4: (1, False), 5: (1, False), 6: (0, True), 7: (129, False)}


def test_segments_carry_loss_only_on_trained_texts(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", "b")]
    first, second = cf.format_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert "".join(s["text"] for s in first["segments"]) == "<|im_start|>user\na<\\|im_end|><|im_end|>\n"
    assert not any(s["loss"] for s in first["segments"])
    assert [s["text"] for s in second["segments"] if s["loss"]] == ["b"]


def test_escapes_restore_every_text_and_role(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("<|\\\nnx") for _ in range(draw.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text, role = cf.escape_text(df["t"]), cf.escape_role(df["t"])
    rows = df.select("t", text.alias("e"), cf.unescape_text(text).alias("u"), role.alias("r"), cf.unescape_role(role).alias("v")).collect()
    assert all(r["u"] == r["t"] == r["v"] and "<|" not in r["e"] and "<|" not in r["r"] and "\n" not in r["r"] for r in rows)
    assert len({r["e"] for r in rows}) == len({r["r"] for r in rows}) == len(set(texts))


def test_another_template(spark):
    template = cf.Template(layout=("<|turn|>", cf.ROLE, "\n", cf.TEXT, "<|stop|>"), loss_roles=("assistant", "tool"))
    rows = rows_of(3, 60)
    got = cf.read_turns(cf.format_turns(spark.createDataFrame(rows, SCHEMA), template), template).collect()
    expected = sorted((r or "", x or "", (x or "") if r in template.loss_roles else "") for _, _, r, x in rows)
    assert sorted((r["role"], r["text"], r["loss_text"]) for r in got) == expected
    with pytest.raises(ValueError):
        cf.Template(layout=("<|turn|>", cf.ROLE, cf.TEXT, "<|stop|>"))


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cf.format_and_read_back(empty).count() == 0
    rows = rows_of(4, 40)
    names = ["segments", "rows", "stretch", "n", "bad", "judged_id", "whole", "masked", "loss_text", "chars", "node", "_llm_file", "_llm_row"]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names))
    assert found(cf.format_and_read_back(wide)) == brute(rows)
