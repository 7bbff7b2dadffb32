from tempograin.llm.preferences import format_preferences, swapped_last_reply

KIND = "conv_id long, turn long, role string, text string, chunk string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], KIND)


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def said(text, mask):
    return [text[int(a):int(b)] for a, b in (s.split("-") for s in mask.split(",") if s)]


def test_common_prefix_is_rendered_once_and_replies_are_unmasked(spark):
    chosen = [(1, 0, "system", "be é"), (1, 1, "user", "hi"), (1, 2, "assistant", "good"), (1, 3, "user", "and?"), (1, 4, "assistant", "")]
    rejected = [*chosen[:2], (1, 2, "assistant", "bad"), (1, 3, "user", "and?")]
    row, = format_preferences(table(spark, chosen), table(spark, rejected)).collect()
    assert row.prompt == show([("system", "be é"), ("user", "hi")])
    assert row.chosen == show([("assistant", "good"), ("user", "and?"), ("assistant", "")])
    assert row.rejected == show([("assistant", "bad"), ("user", "and?")])
    assert said(row.chosen, row.chosen_mask) == ["good<|im_end|>", "<|im_end|>"]
    assert said(row.rejected, row.rejected_mask) == ["bad<|im_end|>"]
    assert (row.first_difference, row.n_prompt_turns, row.n_chosen_turns, row.n_rejected_turns) == (2, 2, 3, 2)


def test_chunks_joined_are_the_whole(spark):
    chosen = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(25)]
    rejected = [*chosen[:13], (1, 13, "assistant", "other")]
    rows = format_preferences(table(spark, chosen), table(spark, rejected), chunk=4).orderBy("chunk").collect()
    assert len(rows) == 7
    assert "".join(r.prompt for r in rows) == show([(r[2], r[3]) for r in chosen[:13]])
    assert "".join(r.chosen for r in rows) == show([(r[2], r[3]) for r in chosen[13:]])
    assert "".join(r.rejected for r in rows) == show([("assistant", "other")])
    assert [x for r in rows for x in said(r.chosen, r.chosen_mask)] == [f"t{i}<|im_end|>" for i in range(13, 25) if i % 2]


def test_nulls_repeats_ties_one_side_and_empty(spark):
    chosen = [(None, 0, "user", "a"), (2, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, 1, "assistant", "c"), (3, 0, "user", "only")]
    rejected = [(None, 0, "user", "a"), (2, 1, "user", "b"), (2, None, "", "")]
    rows = {r.conv_id: r for r in format_preferences(table(spark, chosen), table(spark, rejected)).collect()}
    assert rows[None].prompt == show([("user", "a")]) and rows[None].chosen == rows[None].rejected == "" and rows[None].first_difference is None
    parts = format_preferences(table(spark, chosen), table(spark, rejected)).filter("conv_id = 2").orderBy("chunk").collect()
    assert [p.chunk for p in parts] == [-1, 0]
    assert parts[0].prompt == show([("", "")])
    assert parts[1].chosen == show([("assistant", "c"), ("user", "b")]) and parts[1].rejected == show([("user", "b")])
    assert rows[3].prompt == "" and rows[3].chosen == show([("user", "only")])
    assert format_preferences(table(spark, chosen).limit(0), table(spark, chosen).limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "q"), (1, 3, "assistant", "last"),
            (2, 0, "assistant", "alone"), (3, 0, "user", "none")]
    got = {(r.conv_id, r.turn): r.text for r in swapped_last_reply(table(spark, rows)).collect()}
    assert got == {(1, 0): "q", (1, 1): "first", (1, 2): "q", (1, 3): "first", (2, 0): "", (3, 0): "none"}
