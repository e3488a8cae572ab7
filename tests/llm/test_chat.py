from nearfield.llm import chat

ROWS = "conv_id long, turn long, role string, text string, mask string"


def by_hand(rows, block_turns=chat.BLOCK_TURNS):
    out, rows = {}, [r for r in rows if r[0] is not None]
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else None, r or "unknown", x or "") for c, t, r, x, _ in rows if c == conv),
                     key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
        for who in {r for _, r, _ in own} - {"system"}:
            for block in {-1 if t is None else t // block_turns for t, _, _ in own}:
                text, mask = "", []
                turns = [r for r in own if (-1 if r[0] is None else r[0] // block_turns) == block]
                for _, role, said in turns:
                    name = "assistant" if role == who else role if role == "system" else f"user name={role}"
                    head = f"<|im_start|>{name}\n"
                    text += head + said + "<|im_end|>\n"
                    mask += [f"{len(head)}:0", f"{len(said) + 11}:{int(role == who)}"]
                trained = sum(r == who for _, r, _ in turns)
                out[conv, who, block] = (len(turns), trained, text, ",".join(mask))
    return out


def check(spark, rows, **kind):
    table = spark.createDataFrame(rows, ROWS)
    got = chat.rotate(table, **kind).collect()
    found = {(r.conv_id, r.speaker, r.block): (r.n_turns, r.n_trained, r.text, r["mask"]) for r in got}
    assert len(found) == len(got) and found == by_hand(rows, **kind)
    return got


def test_every_participant_speaks(spark):
    rows = [(1, 0, "system", "be kind", None), (1, 1, "ann", "hi", None), (1, 2, "bob", "hé\nllo", None), (1, 3, "cy", "", None),
            (1, 4, "ann", "bye", None), (2, 0, "user", "alone", None), (3, 0, "system", "nobody", None)]
    got = check(spark, rows)
    ann = next(r for r in got if r.speaker == "ann")
    assert [(m.role, m.name, m.trained) for m in ann.messages] == [
        ("system", None, False), ("assistant", None, True), ("user", "bob", False), ("user", "cy", False), ("assistant", None, True)]
    for r in got:
        runs = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",")]
        assert sum(n for n, _ in runs) == len(r.text)


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, 5, "a", "x", None), (1, 5, "a", "x", None), (1, 5, "b", "y", None), (None, 1, "a", "lost", None),
            (1, -3, "b", "early", None), (2, 1, "a", "word " * 50_000, None)]
    check(spark, rows)
    assert chat.rotate(spark.createDataFrame([], ROWS)).collect() == []


def test_long_dialogue_in_blocks(spark):
    rows = [(1, i, f"p{i % 3}", f"turn {i}", None) for i in range(100)]
    got = check(spark, rows, block_turns=8)
    assert max(r.n_turns for r in got) == 8 and len(got) == 39
    plan = chat.rotate(spark.createDataFrame(rows, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
