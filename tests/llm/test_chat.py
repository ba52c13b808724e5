"""Role repair against an exhaustive search."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

import cohortgrid.llm.chat as chat
from cohortgrid.llm.chat import repaired


def cheapest(roles):
    """Least cost over every labelling of the turns, with every choice to merge with an equal neighbour."""
    best = None
    for labels in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            cost, last, legal = 0, None, True
            for role, label, merge in zip(roles, labels, merges):
                cost += 2 * (role != label) + merge
                if merge:
                    legal &= label == last
                elif label == "system":
                    legal &= last is None
                else:
                    cost += 2 * (last == label or (label == "assistant" and last != "user" and last != label))
                last = label
            cost += {"system": 4, "user": 2, "assistant": 0}[last]
            if legal and (best is None or cost < best):
                best = cost
    return best


def test_repair_is_cheapest_and_legal(spark):
    names = ("system", "user", "assistant", "tool", None)
    cases = [c for n in (1, 2, 3) for c in itertools.product(names, repeat=n)]
    cases += [("user",) * 5, ("tool", "assistant", "assistant", "user", "system"), (None,) * 5]
    rows = [(i, t, r, f"t{t}") for i, case in enumerate(cases) for t, r in enumerate(case)]
    df = spark.createDataFrame(rows, "conv_id LONG, turn INT, role STRING, text STRING")
    out = {}
    for r in repaired(df.withColumn("piece", F.lit(9))).orderBy("conv_id", "piece").collect():
        out.setdefault(r["conv_id"], []).append(r)
    assert len(out) == len(cases)
    for i, case in enumerate(cases):
        assert sum(r["cost"] for r in out[i]) == cheapest(case), case
        said = [r["role"] for r in out[i] if r["action"] not in ("merge", "close")]
        body = said[1:] if said[0] == "system" else said
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert [r["turn"] for r in out[i] if r["turn"] is not None] == list(range(len(case)))


def test_nulls_repeats_and_no_rows(spark):
    schema = "conv_id LONG, turn INT, role STRING, text STRING"
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], schema)
    text = {}
    for r in repaired(df).orderBy("piece").collect():
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["rendered"]
    assert text[1] == "<|im_start|>user\na\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert set(text) == {None, 1}
    assert repaired(df.limit(0)).count() == 0


def plain_cost(roles):
    """Cheapest cost by dynamic programming over whole conversations."""
    costs = {0: 0}
    for role in roles:
        table = chat.turn_costs(chat.name_of(role))
        costs = {b: min(c + table[a, b] for a, c in costs.items()) for b in range(1, 4)}
    return min(c + chat.INSERT * len(chat.ENDINGS[s]) for s, c in costs.items())


@pytest.mark.parametrize("block", [1, 3, 10])
def test_cut_conversations_cost_as_much(spark, monkeypatch, block):
    """Blocks of a few turns: as cheap as uncut, legal across the cuts, and spread over tasks."""
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    cases = [[rng.choice(("system", "user", "assistant", "tool", None)) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    cases += [[None] * 50, ["tool"] * 41, ["user", "assistant"] * 20, ["assistant"] * 33]
    rows = [(None if i == 3 else i, t, r, f"t{t}") for i, case in enumerate(cases) for t, r in enumerate(case)]
    rows += [(500, 7, "user", "same")] * 30 + [(500, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id LONG, turn INT, role STRING, text STRING").repartition(5)
    out = {}
    for r in repaired(df).orderBy("conv_id", "piece").collect():
        out.setdefault(r["conv_id"], []).append(r)
    assert len(out) == len(cases) + 1 and max(r["piece"] for r in out[31]) > chat.PIECES
    assert [r["turn"] for r in out[500] if r["action"] != "insert"][:-1] == [7] * 30 + [None]
    for i, case in enumerate(cases):
        pieces = out[None if i == 3 else i]
        assert sum(r["cost"] for r in pieces) == plain_cost(case), case
        said = [r["role"] for r in pieces if r["action"] not in ("merge", "close")]
        body = said[1:] if said[0] == "system" else said
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert [r["turn"] for r in pieces if r["turn"] is not None] == list(range(len(case)))
        text = "".join(r["rendered"] for r in pieces)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(said)


def test_unknown_roles_take_linear_time():
    state, began = chat._Repair(), time.time()
    rows = [r for i in range(100_000) for r in state.add(i, None, "x")]
    rows += state.end()
    assert len([r for r in rows if r[1] is not None]) == 100_000 and time.time() - began < 20
