"""Chat formatting: conversations become legal by the cheapest merges, relabels and empty insertions.

Legal is an optional system message, then user and assistant in turn, ending with the assistant.

A conversation of very many turns is cut into blocks by turn. What a block costs from any state to any other is a small
matrix, and the product of the matrices, with minimum for sum and sum for product, fixes the states at the cuts of a
cheapest path; then each block is repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

ROLES = ("start", "system", "user", "assistant")
RELABEL, MERGE, INSERT = 2, 1, 2
BLOCK = 50_000  # turns of a block, about; conversations of up to twice as many are one
PIECES = 1 << 40  # numbers that the pieces of a block may take
SCHEMA = "conv_id {kind}, piece LONG, turn {turn}, role STRING, action STRING, cost INT, rendered STRING"


def _moves() -> list[tuple[int, int, tuple[int, ...], bool, int]]:
    """(state before, state after, inserted states, merged, cost) of a turn, relabelling apart."""
    plain = [(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)]
    moves = [(s, q, (), False, 0) for s, q in plain]
    moves += [(s, s, (), True, MERGE) for s in (1, 2, 3)]
    moves += [(s, 3, (2,), False, INSERT) for s in (0, 1, 3)] + [(2, 2, (3,), False, INSERT)]
    return moves


MOVES = _moves()
ENDINGS = {1: (2, 3), 2: (3,), 3: ()}


def name_of(role) -> str | None:
    return role.strip().lower() if isinstance(role, str) else None


def turn_costs(name: str | None) -> np.ndarray:
    """Cheapest cost of a turn of this role from each state to each."""
    out = np.full((len(ROLES), len(ROLES)), np.inf)
    for before, after, _, _, price in MOVES:
        out[before, after] = min(out[before, after], price + (0 if ROLES[after] == name else RELABEL))
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs of a, then b."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def states_at_cuts(blocks: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first state, last state) of each block on a cheapest path through all."""
    reached = [np.array([0.0, np.inf, np.inf, np.inf])]
    for block in blocks:
        reached.append((reached[-1][:, None] + block).min(axis=0))
    state = min(ENDINGS, key=lambda s: (reached[-1][s] + INSERT * len(ENDINGS[s]), -s))
    out = []
    for costs, block in zip(reached[-2::-1], blocks[::-1]):
        first = int(np.argmin(costs + block[:, state]))
        out.append((first, state))
        state = first
    return out[::-1]


class _Repair:
    """One block as it streams by, from a state: turns are released once all surviving paths agree on them. The paths
    are followed back when the waiting turns have doubled, so that each turn costs the same on average."""

    def __init__(self, first: int = 0, number: int = 0):
        self.costs, self.pending, self.look = {first: 0}, [], 2
        self.pieces, self.open = number * PIECES, first != 0

    def add(self, turn, role, text) -> list[tuple]:
        name = name_of(role)
        best = {}
        for move in MOVES:
            before, after, _, _, price = move
            if before in self.costs:
                cost = self.costs[before] + price + (0 if ROLES[after] == name else RELABEL)
                if after not in best or cost < best[after][0]:
                    best[after] = (cost, move)
        self.costs = {state: cost for state, (cost, _) in best.items()}
        self.pending.append(({s: m for s, (_, m) in best.items()}, turn, name, text if isinstance(text, str) else ""))
        if len(self.pending) < self.look:
            return []
        states, rows = set(best), []
        for at in range(len(self.pending) - 1, -1, -1):
            if len(states) == 1:
                rows = self._release(at + 1, states.pop())
                break
            states = {self.pending[at][0][s][0] for s in states}
        self.look = 2 * len(self.pending) + 2
        return rows

    def end(self, last: int | None = None) -> list[tuple]:
        """The rows that wait; last: the state that the next block goes on from, if there is one."""
        if last is not None:
            return self._release(len(self.pending), last)
        state = min(self.costs, key=lambda s: (self.costs[s] + INSERT * len(ENDINGS[s]), -s))
        rows = self._release(len(self.pending), state)
        return rows + [self._row(None, q, "insert", INSERT, "") for q in ENDINGS[state]] + [
            self._row(None, 3, "close", 0, None)
        ]

    def _release(self, count, state) -> list[tuple]:
        path = []
        for moves, turn, name, text in reversed(self.pending[:count]):
            path.append((moves[state], turn, name, text))
            state = moves[state][0]
        del self.pending[:count]
        rows = []
        for (_, after, inserted, merged, _), turn, name, text in reversed(path):
            rows += [self._row(None, q, "insert", INSERT, "") for q in inserted]
            relabel = 0 if ROLES[after] == name else RELABEL
            action = "merge" if merged else "relabel" if relabel else "keep"
            rows.append(self._row(turn, after, action, relabel + (MERGE if merged else 0), text))
        return rows

    def _row(self, turn, state, action, cost, text) -> tuple:
        if action == "close":
            rendered = "<|im_end|>\n"
        elif action == "merge":
            rendered = "\n" + text
        else:
            rendered = ("<|im_end|>\n" if self.open else "") + f"<|im_start|>{ROLES[state]}\n{text}"
            self.open = True
        self.pieces += 1
        return self.pieces - 1, turn, ROLES[state], action, cost, rendered


def _block_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv_id, block, costs) of rows that come by conversation, block and turn."""
    key, total, tables = None, None, {}

    def row(key, total) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "block": [key[1]], "costs": [total.ravel().tolist()]})

    for batch in batches:
        for conv, block, role in zip(batch["conv_id"].astype(object), batch["block"], batch["role"].astype(object)):
            conv, name = None if pd.isna(conv) else conv, name_of(role)
            if key != (conv, block):
                if key is not None:
                    yield row(key, total)
                key, total = (conv, block), None
            name = name if name in ROLES[1:] else None
            if name not in tables:
                tables[name] = turn_costs(name)
            total = tables[name] if total is None else joined(total, tables[name])
    if key is not None:
        yield row(key, total)


def _cuts(turns: DataFrame) -> DataFrame | None:
    """(long_id, cuts): turns at which long conversations are cut; None if there are none. A conversation is as long as
    its turns are many, so there are few of them."""
    if not isinstance(turns.schema["turn"].dataType, NumericType):
        return None
    long = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK)
    found = long.collect()
    if not found:
        return None
    most = -(-max(r["n"] for r in found) // BLOCK)
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    names = turns.sparkSession.createDataFrame([(r["conv_id"],) for r in found], f"long_id {dict(turns.dtypes)['conv_id']}")
    hot = turns.select("conv_id", "turn").join(F.broadcast(names), F.col("conv_id").eqNullSafe(F.col("long_id")))
    return hot.groupBy("long_id").agg(F.array_distinct(F.percentile_approx("turn", shares, 100 * most)).alias("cuts"))


def _plans(turns: DataFrame) -> DataFrame:
    """(conv_id, block, first, last): the states at the cuts, from the costs of the blocks; two numbers a block."""
    kind = dict(turns.dtypes)["conv_id"]
    laid = turns.select("conv_id", "block", "turn", "role").where("long")
    laid = laid.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.asc_nulls_last("turn"), "role")
    costs = laid.select("conv_id", "block", "role").mapInPandas(_block_costs, f"conv_id {kind}, block INT, costs ARRAY<DOUBLE>")
    by_conversation: dict = {}
    for r in costs.collect():
        by_conversation.setdefault(r["conv_id"], []).append((r["block"], np.reshape(r["costs"], (len(ROLES), len(ROLES)))))
    rows = []
    for conv, blocks in by_conversation.items():
        blocks.sort(key=lambda b: b[0])
        ends = states_at_cuts([m for _, m in blocks])
        rows += [(conv, number, first, last if i + 1 < len(blocks) else None) for i, ((number, _), (first, last)) in enumerate(zip(blocks, ends))]
    return turns.sparkSession.createDataFrame(rows, f"conv_id {kind}, block INT, first INT, last INT")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, turn, role, action, cost, rendered): the pieces of a conversation, joined by piece,
    are its rendered text; a merged turn continues the message before it.

    Turns go by turn, role and text; repeated rows are turns of their own. A null role is relabelled, a null
    text is empty, a null conv_id is one conversation, an empty table gives no rows, other columns are
    ignored. Pieces ascend; their numbers leap from one block of a very long conversation to the next. Turns wait while
    the surviving paths differ, for a block at most. Rows of one conversation with one and the same turn, or
    with turns that are no numbers, are never cut.
    """
    kinds = dict(conversations.dtypes)
    turns = conversations.select("conv_id", "turn", "role", "text")
    cuts = _cuts(turns)
    if cuts is None:
        blocked = turns.withColumns({"block": F.lit(0), "first": F.lit(0), "last": F.lit(None).cast("int")})
    else:
        cut = turns.join(F.broadcast(cuts), F.col("conv_id").eqNullSafe(F.col("long_id")) & F.col("cuts").isNotNull(), "left")
        number = F.size(F.filter("cuts", lambda c: F.coalesce(c < F.col("turn"), F.lit(True))))
        number = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(number)
        cut = cut.select("conv_id", "turn", "role", "text", number.alias("block"), F.col("cuts").isNotNull().alias("long"))
        plans = _plans(cut).withColumnsRenamed({"conv_id": "plan_id", "block": "plan_block"})
        same = F.col("conv_id").eqNullSafe(F.col("plan_id")) & (F.col("block") == F.col("plan_block"))
        blocked = cut.join(F.broadcast(plans), same, "left").withColumn("first", F.coalesce("first", F.lit(0)))
    laid = blocked.select("conv_id", "block", "first", "last", "turn", "role", "text").repartition("conv_id", "block")
    laid = laid.sortWithinPartitions("conv_id", "block", F.asc_nulls_last("turn"), "role", "text")
    names = ["conv_id", "piece", "turn", "role", "action", "cost", "rendered"]

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, ending = None, None, None
        for batch in batches:
            rows = []
            columns = [batch[c].astype(object) for c in ("conv_id", "block", "first", "last", "turn", "role", "text")]
            for conv, block, first, last, turn, role, text in zip(*columns):
                conv, turn = None if pd.isna(conv) else conv, None if pd.isna(turn) else turn
                if state is None or (conv, block) != current:
                    if state is not None:
                        rows += [(current[0], *r) for r in state.end(ending)]
                    current, state = (conv, block), _Repair(int(first), int(block))
                    ending = None if pd.isna(last) else int(last)
                rows += [(conv, *r) for r in state.add(turn, role, text)]
            yield frame(rows)
        if state is not None:
            yield frame([(current[0], *r) for r in state.end(ending)])

    return laid.mapInPandas(run, SCHEMA.format(kind=kinds["conv_id"], turn=kinds["turn"]))
