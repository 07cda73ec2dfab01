from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from funnelcast.llm import chat_tree, host_rules, mixing
from .conftest import ODD


def test_host_rules_shrink_and_reject_a_bad_host(frame, odd, none):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good + f" {i}", "en", "good") for i in range(40)] + [(100 + i, "too short", "en", "bad") for i in range(40)]
    rows += [(200, good, "en", "bad"), (201, good, "en", "new"), (202, "x", "en", None)]
    got = {r.doc_id: r for r in host_rules.judge(frame(rows)).collect()}
    assert all(got[i].kept for i in range(40)) and got[201].kept
    assert not got[200].base_failed and not got[200].kept and got[200].host_rate > 0.5
    assert got[202].base_failed and not got[202].kept
    assert 0 < got[0].host_rate < 0.2
    assert host_rules.judge(odd).count() == len(ODD) and host_rules.judge(none).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [100_000, 7])
def test_mix_meets_targets(frame, odd, none, rows_per_bucket):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 5}") for i in range(600)] + [(i, "w " * 3, "en", None) for i in range(600, 640)]
    docs = frame(rows)
    plan = mixing.plan(docs, rows_per_bucket=rows_per_bucket).collect()
    again = mixing.plan(docs.repartition(5), rows_per_bucket=rows_per_bucket).collect()
    assert sorted((r.doc_id, r.taken) for r in plan) == sorted((r.doc_id, r.taken) for r in again) and len(plan) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in plan:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        assert target[s] == pytest.approx(2 * sizes[s] if s in capped else level * weight[s])
        assert abs(taken[s] - target[s]) <= 9
    mixed = mixing.mix(docs, rows_per_bucket=rows_per_bucket)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    assert mixing.plan(odd).count() == len(ODD) and mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(odd).agg(F.count("*")).first()[0] == mixing.plan(odd).agg(F.sum("copies")).first()[0]


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\n<|x|>\n", "<<SYS>><\\|<|end|>", "<s>[\\INST]", ""]


def test_escaping_is_reversible_and_complete():
    for text in CONTROL + ["".join(CONTROL) * 2]:
        segment, a, b = chat_tree.turn_segment(text, text)
        assert chat_tree.parse_segment(segment) == (text, text) and chat_tree.unescape(segment[a:b]) == text
        assert not chat_tree._CONTROL.search(segment[a:b])


def test_forest_shares_prefixes_and_reads_back(spark, frame):
    turns = []
    for c in range(12):
        n = 2 + c % 4
        turns += [(c, t, ["user", "assistant"][t % 2], f"turn {t if t < c % 3 + 1 else (t, c)} {CONTROL[t % 6]}", "x") for t in range(n)]
    turns += [(20, t, "user", "same", "x") for t in range(3)] + [(21, t, "user", "same", "x") for t in range(3)]
    turns += [(None, 0, None, None, "x"), (30, None, "assistant", "first", "x"), (30, 1, "user", "b", "x"), (30, 1, "user", "b", "x"), (31, 0, "assistant", "long " * 50_000, "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, owner string").repartition(5)
    forest = chat_tree.build(df)
    got = {r.conv_id: r for r in chat_tree.read_back(forest).collect()}
    convs = {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    stream = forest["stream"].orderBy("stream_start").collect()
    text = "".join(r.segment for r in stream)
    prefixes = {tuple(v[: i + 1]) for v in convs.values() for i in range(len(v))}
    assert len(stream) == len(prefixes)  # shared tokens once
    at, places, stack = 0, {}, []
    for r in stream:
        assert r.stream_start == at and r.length == len(r.segment)
        at += r.length
        while stack and stack[-1].node != r.parent:
            stack.pop()
        assert r.depth == len(stack) and r.position == sum(x.length for x in stack)  # depth-first, positions below ancestors
        stack.append(r)
        places[r.node] = r
    intervals = {r.conv_id: r.intervals for r in forest["attention"].collect()}
    for c, turns_ in convs.items():
        formatted = "".join(chat_tree.turn_segment(*x)[0] for x in turns_)
        assert "".join(text[i.start : i.end] for i in intervals[c]) == formatted
        loss = "".join(x for role, x in turns_ if role == "assistant")
        assert (got[c].n_turns, got[c].formatted_chars, got[c].loss_chars) == (len(turns_), len(formatted), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_tree.read_back(chat_tree.build(df.limit(0))).count() == 0
