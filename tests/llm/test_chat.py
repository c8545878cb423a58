import random

from tessera.llm import chat


def brute(rows, size, most):
    """(conv, perspective, section, part) -> (rendered, masks, learned texts)."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "unknown", text or ""))
    out = {}
    for conv, turns in convs.items():
        for who in {r for _, r, _ in turns if r != "system"}:
            sections = {}
            for t in sorted(turns, key=lambda t: (t[0] or 0, t[1], t[2])):
                sections.setdefault(None if t[0] is None else t[0] // size, []).append(t)
            parts = {(s, k // most): turns[k : k + most] for s, turns in sections.items() for k in range(0, len(turns), most)}
            for (section, number), part in parts.items():
                text, masks, learned = "", [], []
                for _, role, body in part:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                    text += body + "<|end|>\n"
                    masks.append(int(role == who))
                    if role == who:
                        learned.append(body + "<|end|>")
                out[conv, who, section, number] = (text, masks, learned)
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["ann", "bob", "système", "system", None]), rng.choice(["hi", "", None, "a\nb 😀", "z" * 3000])) for c in range(12) for t in range(rng.randint(1, 12))]
    rows += [(60, None, "ann", f"t{k}") for k in range(9)] + [(61, 2, "bob", "again")] * 11 + [(61, 2, "ann", "between")]
    rows += rows[:5] + [(None, 0, "x", "y"), (None, None, "x", "q"), (99, 0, "system", "only"), (50, 3, "ann", "late"), (50, -1, "bob", "early")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rendered int")
    want = brute(rows, 4, 3)
    got = chat.rotate(frame, 4, 3).collect()
    assert len(got) == len(want)
    for r in got:
        text, masks, learned = want[r.conv_id, r.perspective, r.section, r.part]
        assert (r.rendered, r.masks, r.n_turns) == (text, masks, len(masks))
        assert [r.rendered[s.start : s.end] for s in r.mask_spans] == learned
    assert chat.rotate(frame.limit(0)).count() == 0


def test_native(spark):
    frame = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.report(chat.rotate(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
