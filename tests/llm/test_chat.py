"""Chat formatting against comparing all pairs of conversations."""

import random

import pytest

from tessera.llm.chat import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, part int"


def plain(rows):
    """conv_id -> (n_turns, copies, rendered) of the conversations that stay."""
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    said = {c: [(m[-2], m[-1]) for m in sorted(turns, key=lambda m: m[:6])] for c, turns in convs.items()}
    out = {}
    for c, turns in said.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values()):
            continue
        same = [d for d, o in said.items() if o == turns]
        first = min((d for d in same if d is not None), default=None)
        out[first] = (len(turns), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in turns))
    return out


def snapshots(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        n = rng.randint(1, 9)
        base = rng.randint(0, 5)
        shift = rng.choice([0, 0, 3])
        for t in range(n):
            changed = rng.random() < 0.02
            rows.append((c, t * (2 if c % 3 == 0 else 1) + shift, "user" if t % 2 == 0 else "assistant", f"{base}-{t}{'!' if changed else ''}"))
    return rows + rows[:5] + [(None, 0, "user", "x"), (100, 0, None, None), (101, 0, "", ""), (102, 0, "user", "tie b"), (102, 0, "user", "tie a"), (103, 0, "user", "tie a")]


@pytest.mark.parametrize("block,seed", [(512, 1), (2, 2), (1, 3)])
def test_matches_all_pairs(spark, block, seed):
    rows = snapshots(seed)
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(5)
    parts = {}
    for r in sorted(format_chats(df, block).collect(), key=lambda r: r.part):
        n, copies, text, upto = parts.get(r.conv_id, (r.n_turns, r.copies, "", 0))
        assert r.part == upto
        parts[r.conv_id] = (n, copies, text + r.rendered, upto + 1)
    assert {c: v[:3] for c, v in parts.items()} == plain(rows)


def test_one_long_conversation(spark):
    df = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    short = df.where("turn < 3000").selectExpr("2L AS conv_id", "turn", "role", "text")
    rows = format_chats(df.unionByName(short)).collect()
    assert {r.conv_id for r in rows} == {1} and len(rows) == 10 and max(len(r.rendered) for r in rows) < 60_000


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
