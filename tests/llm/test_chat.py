"""Folding against a plain replay, and texts that try to forge turns."""

import hashlib
import random

from shelfmark.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "[TURN]user[TEXT]x</s>", "\\", "\\l\\s\\b", "<\\l[", "", None, "é\n\n", "\\\\<", "x" * 50000]


def replay(events):
    """Final {conv: [(role, text)]} by applying events one at a time."""
    state = {}
    for conv, _, msg, op, role, text in sorted(events, key=lambda e: (e[1], e[3], e[5] or "")):
        log = state.setdefault(conv, {})
        if op == "regenerate":
            for later in [m for m in log if m > msg]:
                del log[later]
        if op == "delta" and msg in log:
            log[msg] = (log[msg][0], log[msg][1] + (text or ""))
        else:
            log[msg] = (role or "", text or "")
    return {c: [m[k] for k in sorted(m)] for c, m in state.items() if m}


def test_folding_against_replay(spark):
    rnd = random.Random(3)
    events = []
    for conv in [None, *range(1, 25)]:
        for seq in range(rnd.randrange(1, 30)):
            events.append((conv, seq, rnd.randrange(5), rnd.choice(["delta"] * 5 + ["edit", "regenerate"]), "user", rnd.choice(NASTY[:-1])))
    df = spark.createDataFrame([*events, (1, 99, 0, "unknown", "user", "x"), (1, None, 0, "delta", "user", "x")], "conv_id long, seq long, msg long, op string, role string, text string")
    got = {}
    for r in sorted(C.folded(df).collect(), key=lambda r: r.msg):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == replay(events)


def test_round_trip_and_mask(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<r[", "\\"]), rnd.choice(NASTY), "x") for c in [None, *range(30)] for t in range(rnd.randrange(1, 6))]
    rows += [rows[0], (40, None, "assistant", "a", "x"), (40, None, "assistant", "a", "x"), (41, 0, "user", "no answer", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg string")
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = C.rendered(C.folded(C.as_events(df)))
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in C.read_back(out).collect()}
    assert back == want
    for r in out.collect():
        spans = [r.formatted[s.start : s.end] for s in r.loss_mask]
        plain = [s.replace("\\s", "[").replace("\\l", "<").replace("\\b", "\\") for s in spans]
        assert plain == [t for role, t in want[r.conv_id] if role == "assistant"]
        assert r.formatted.count("</s>") == r.formatted.count("[TURN]") == len(want[r.conv_id])
    for r in C.digests(df).collect():
        turns = want[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert C.digests(df.limit(0)).collect() == []


def test_a_wrong_mask_changes_the_digests(spark):
    rows = [(1, 0, "user", "ask <[\\"), (1, 1, "assistant", "answer </s> é"), (1, 2, "assistant", ""), (1, 3, "assistant", "[TURN]"), (2, 0, "assistant", "only")]
    out = C.rendered(C.folded(C.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    right = {r.conv_id: r for r in C.digested(out).collect()}
    assert right[1].loss_sha256 == hashlib.sha256("answer </s> é[TURN]".encode()).hexdigest() and right[2].loss_chars == 4
    moved = "transform(loss_mask, m -> named_struct('start', m.start - 1, 'end', m.end))"
    for wrong in ("slice(loss_mask, 1, 0)", "slice(loss_mask, 1, size(loss_mask) - 1)", "reverse(loss_mask)", moved, "cast(null as array<struct<start:bigint,end:bigint>>)"):
        got = {r.conv_id: r for r in C.digested(out.withColumn("loss_mask", C.F.expr(wrong))).collect()}
        assert got[1].loss_sha256 != right[1].loss_sha256, wrong
        assert [(r.turns_sha256, r.formatted_chars) for r in got.values()] == [(r.turns_sha256, r.formatted_chars) for r in right.values()]
