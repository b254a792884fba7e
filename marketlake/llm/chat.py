"""Chat formatting by minimum-cost role repair.

A legal conversation is a path of the automaton  start -> system -> user, start -> user,
user -> assistant, assistant -> user  that ends after a user or an assistant turn. Every given
turn can be kept, relabelled to another role, merged into the turn before it, or preceded by one
empty turn that is inserted. Dynamic programming finds the cheapest repair of the whole
conversation; ties go to keeping, then merging, relabelling, inserting.

A conversation can hold a third of all rows, so none is one task. Equal turns become one row with
their number; rows are sorted by ranges of conversation and order, and the numbers of a conversation
in earlier ranges are added up, which gives every turn its place. Places are cut into chunks of
CHUNK turns, whatever their turn numbers. The effect of a chunk on the automaton is a matrix of
least costs between its four states; these matrices (one small row per chunk) are combined per
conversation, which gives the states at the borders of every chunk on the cheapest path. Then each
chunk is solved for itself between its border states.

The result has one row per given turn with its action, final role and the piece of text it adds to
the rendered conversation; pieces joined in order (conv_id, turn, piece_no) are that rendering.

Edge cases: turns are ordered by turn, then role and text; a NULL turn comes last. NULL, unknown or
misspelt roles (after trimming and lower-casing, with a few synonyms) can only be relabelled or
merged. A NULL or empty text is an empty turn. Rows with a NULL conv_id form one conversation.
Repeated rows are turns like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import materialize, table

CHUNK = 512
#: Ranges are drawn by so many characters of a text, so that their borders stay small.
PREFIX = 256
ROLES = ("system", "user", "assistant")
#: States: before the first turn, and the role of the last turn.
STATES = 4
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (2, 3)
SYNONYMS = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant"}
MERGE, RELABEL, INSERT = 1.0, 2.0, 2.5
#: A turn whose role is unknown must be given one anyway.
NAME = 0.5
NEVER = 1e18


def role_number(role: str | None) -> int:
    """0 for an unknown role, else the state after such a turn."""
    known = (role or "").strip().lower()
    known = SYNONYMS.get(known, known)
    return ROLES.index(known) + 1 if known in ROLES else 0


def options(role: int) -> list[tuple[float, int, str, int, int]]:
    """(cost, order, action, from, to) of every way to consume a turn; inserted turns are named in the action."""
    out = []
    for s in range(STATES):
        for t in range(1, STATES):
            named = 0.0 if t == role else NAME if role == 0 else RELABEL
            change = "keep" if t == role else "relabel"
            if t == s:
                out.append((MERGE + named, 1, "merge", s, t))
            if t in NEXT[s]:
                out.append((named, 0 if t == role else 2, change, s, t))
            for x in NEXT[s]:
                if t in NEXT[x]:
                    out.append((INSERT + named, 3, f"insert {ROLES[x - 1]}, {change}", s, t))
    return out


def best(role: int) -> dict[tuple[int, int], tuple[float, int, str]]:
    found: dict[tuple[int, int], tuple[float, int, str]] = {}
    for cost, order, action, s, t in options(role):
        if (s, t) not in found or (cost, order) < found[(s, t)][:2]:
            found[(s, t)] = (cost, order, action)
    return found


BEST = [best(r) for r in range(STATES)]
COST = np.full((STATES, STATES, STATES), NEVER)
for _role, _found in enumerate(BEST):
    for (_s, _t), (_cost, _, _) in _found.items():
        COST[_role, _s, _t] = _cost


def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of a followed by b."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def summary(roles: list[int]) -> np.ndarray:
    """Least costs between states over a run of turns."""
    total = np.where(np.eye(STATES) > 0, 0.0, NEVER)
    for r in roles:
        total = then(total, COST[r])
    return np.minimum(total, NEVER)


def borders(matrices: list[np.ndarray]) -> tuple[list[int], float]:
    """States before the first, between and after the chunks on the cheapest path; its cost."""
    rest = [np.array([NEVER] * STATES)]
    for s in FINAL:
        rest[0][s] = 0.0
    for m in reversed(matrices):
        rest.append((m + rest[-1][None, :]).min(axis=1))
    rest.reverse()
    states = [0]
    for m, after in zip(matrices, rest[1:]):
        states.append(int(np.argmin(m[states[-1]] + after)))
    return states, float(rest[0][0])


def solve(roles: list[int], start: int, end: int) -> list[tuple[str, int]]:
    """(action, state after) of every turn on the cheapest path from start to end."""
    rest = np.full((len(roles) + 1, STATES), NEVER)
    rest[len(roles), end] = 0.0
    for i in range(len(roles) - 1, -1, -1):
        rest[i] = np.minimum((COST[roles[i]] + rest[i + 1][None, :]).min(axis=1), NEVER)
    out, s = [], start
    for i, r in enumerate(roles):
        t = min(
            (t for t in range(1, STATES) if (s, t) in BEST[r]), key=lambda t: (BEST[r][(s, t)][0] + rest[i + 1, t], BEST[r][(s, t)][1], t)
        )
        out.append((BEST[r][(s, t)][2], t))
        s = t
    return out


def head(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


END = "<|end|>\n"


def pieces(texts: list[str], roles: list[int], start: int, end: int, closes: bool) -> list[tuple[str, str, str]]:
    """(action, role, piece) of every turn; closes: these are the last of their conversation."""
    out, open_turn = [], start > 0
    for text, (action, state) in zip(texts, solve(roles, start, end)):
        piece = ""
        if action == "merge":
            piece = "\n" + text
        else:
            piece += END if open_turn else ""
            if action.startswith("insert "):
                piece += f"<|{action[7:].split(',')[0]}|>\n{END}"
            piece += head(state) + text
        open_turn = True
        out.append((action, ROLES[state - 1], piece + END if closes and len(out) + 1 == len(roles) else piece))
    return out


def groups(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first `keys` columns; rows are sorted by them."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = [batch[c].to_numpy() for c in batch.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        n = len(columns[0])
        if not n:
            continue
        changed = np.zeros(n, bool)
        for c in columns[:keys]:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed)]
        for x, y in zip(cuts, cuts[1:]):
            yield [c[x:y] for c in columns]
        held = [c[cuts[-1] :] for c in columns]
    if held:
        yield held


def in_blocks(rows: Iterator[tuple], names: str, size: int = 4096) -> Iterator[pd.DataFrame]:
    """Frames of so many rows."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pd.DataFrame(block, columns=names.split())
            block = []
    yield pd.DataFrame(block, columns=names.split())


CONV = ("conv_key", "no_conv")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns and their number n, with keys that are never NULL; no_conv and no_turn mark what was."""
    return (
        conversations.select(
            F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_key"),
            F.col("conv_id").isNull().alias("no_conv"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn_key"),
            F.col("turn").isNull().alias("no_turn"),
            "role",
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .groupBy(*CONV, "no_turn", "turn_key", "role", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def placed(turns: DataFrame) -> DataFrame:
    """Turns with place: how many turns of their conversation come before them."""
    order = [*CONV, "no_turn", "turn_key", "role"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, passed = None, 0  # the conversation at the end of the last batch, and its turns so far
        for batch in batches:
            if batch.empty:
                continue
            conv, none, n = (batch[c].to_numpy() for c in (*CONV, "n"))
            first = np.ones(len(n), bool)
            first[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])
            before = n.cumsum() - n
            starts = np.flatnonzero(first)
            place = before - before[starts][first.cumsum() - 1]
            if last == (conv[0], none[0]):
                place[: starts[1] if len(starts) > 1 else len(n)] += passed
            last, passed = (conv[-1], none[-1]), int(place[-1] + n[-1])
            yield batch.assign(place=place)

    ranges = turns.repartitionByRange(*order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    ranges = ranges.withColumn("part", F.spark_partition_id())
    numbered = materialize(
        ranges.mapInPandas(
            number,
            "conv_key long, no_conv boolean, no_turn boolean, turn_key long, role string, text string, n long, part int, place long",
        )
    )
    earlier = Window.partitionBy(*CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # few rows: of two neighbouring ranges, at most one conversation lies in both
    offsets = (
        numbered.groupBy(*CONV, "part")
        .agg(F.sum("n").alias("n"))
        .select(*CONV, "part", F.sum("n").over(earlier).alias("offset"))
        .where("offset > 0")
    )
    place = F.col("place") + F.coalesce("offset", F.lit(0).cast("long"))
    return numbered.join(F.broadcast(offsets), [*CONV, "part"], "left").withColumn("place", place).drop("part", "offset")


def in_chunks(rows: DataFrame) -> DataFrame:
    """Turns by chunk; equal turns whose places lie in several chunks enter each of them."""
    last = F.col("place") + F.col("n") - 1
    chunks = F.sequence(F.floor(F.col("place") / CHUNK), F.floor(last / CHUNK))
    return rows.select("*", F.explode(chunks).alias("chunk"))


def ordered(rows: DataFrame) -> DataFrame:
    """One row per turn, at its place, in order within its chunk."""
    start, end = F.greatest("place", F.col("chunk") * CHUNK), F.least(F.col("place") + F.col("n"), (F.col("chunk") + 1) * CHUNK)
    rows = rows.repartition(*CONV, "chunk").withColumn("place", F.explode(F.sequence(start, end - 1))).drop("n")
    return rows.sortWithinPartitions(*CONV, "chunk", "place")


def border_states(turns: DataFrame) -> DataFrame:
    """(conv_key, no_conv, chunk, before, after, closes, cost) of every chunk on its conversation's cheapest path."""

    def summaries(batches):
        for conv, none, chunk, role in groups(batches, 3):
            yield conv[0], none[0], chunk[0], summary([role_number(r) for r in role]).ravel().tolist()

    def places(batches):
        for conv, none, chunk, costs in groups(batches, 2):
            states, cost = borders([np.array(c).reshape(STATES, STATES) for c in costs])
            n = len(chunk)
            yield from zip(conv, none, chunk, states[:-1], states[1:], [i + 1 == n for i in range(n)], [cost] * n)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_blocks(summaries(batches), "conv_key no_conv chunk costs")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_blocks(places(batches), "conv_key no_conv chunk before after closes cost")

    keys = "conv_key long, no_conv boolean, chunk long"
    rows = ordered(in_chunks(turns.select(*CONV, "place", "n", "role")))
    costs = rows.select(*CONV, "chunk", "role").mapInPandas(summarise, f"{keys}, costs array<double>")
    chunks = costs.repartition(*CONV).sortWithinPartitions(*CONV, "chunk")
    return chunks.mapInPandas(place, f"{keys}, before int, after int, closes boolean, cost double")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, piece_no, given_role, action, role, piece, conv_cost of every given turn.

    piece_no numbers the turns of a conversation and orders its pieces.
    """
    turns = placed(turns_of(conversations))
    found = materialize(border_states(turns))
    rows = in_chunks(turns).join(found, [*CONV, "chunk"])
    rows = rows.select(
        *CONV, "chunk", "place", "n", "turn_key", "no_turn", "role", "text", "before", "after", "closes", "cost"
    )

    def rendered(batches):
        for conv, none, _, turn, no_turn, role, text, before, after, closes, cost, place in groups(batches, 3):
            made = pieces(list(text), [role_number(r) for r in role], int(before[0]), int(after[0]), bool(closes[0]))
            for i, (action, final, piece) in enumerate(made):
                yield conv[i], none[i], turn[i], no_turn[i], place[i], role[i], action, final, piece, cost[i]

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_blocks(rendered(batches), "conv_key no_conv turn_key no_turn piece_no given_role action role piece conv_cost")

    names = (*CONV, "chunk", "turn_key", "no_turn", "role", "text", "before", "after", "closes", "cost", "place")
    out = ordered(rows).select(*names).mapInPandas(
        render,
        "conv_key long, no_conv boolean, turn_key long, no_turn boolean, piece_no long, given_role string, action string, "
        "role string, piece string, conv_cost double",
    )
    return out.select(
        F.when(~F.col("no_conv"), F.col("conv_key")).alias("conv_id"),
        F.when(~F.col("no_turn"), F.col("turn_key")).alias("turn"),
        "piece_no", "given_role", "action", "role", "piece", "conv_cost",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
