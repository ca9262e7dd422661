"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A conversation is legal if it has an optional system turn, then user and
assistant turns in alternation, beginning with the user and ending with the
assistant. A turn may be kept, given another role, or merged into the turn before
it; an empty turn may be inserted. Each change has a cost. The least total is found by dynamic programming over the automaton
of legal sequences, whose states are the role that came last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of the automaton: nothing yet, or the last turn's role.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Roles that may follow each state, and the states in which a conversation may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
#: Other names of the roles.
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: Costs of the changes; ties are settled in the order keep, merge, relabel, insert.
KEEP, MERGE, RELABEL, INSERT = 0, 2, 3, 4
#: Relabelling a turn whose role is no role at all.
UNKNOWN = 1
#: Template of a rendered turn.
TURN = "<|{role}|>\n{text}\n<|end|>\n"


def role_of(name: str | None) -> int | None:
    name = name.strip().lower() if isinstance(name, str) else ""
    return NAMES.index(name) if name in NAMES[1:] else ALIASES.get(name)


def _closure(costs: list[tuple]) -> list[tuple]:
    """Empty turns inserted where that makes a state cheaper to reach."""
    for _ in range(3):
        for state, after in NEXT.items():
            cost, path = costs[state]
            for role in after if cost < float("inf") else ():
                if cost + INSERT < costs[role][0]:
                    costs[role] = (cost + INSERT, (path, ("insert", role, -1)))
    return costs


def repair(roles: list[int | None]) -> tuple[int, list[tuple[str, int, int]]]:
    """Cost, and steps (keep, merge, relabel or insert; role; index of the turn or -1).

    An empty conversation stays empty at no cost.
    """
    if not roles:
        return 0, []
    none = (float("inf"), None)
    costs = _closure([(0, None), none, none, none])
    for i, role in enumerate(roles):
        after = [none] * 4
        for state in range(4):
            cost, path = costs[state]
            if cost == float("inf"):
                continue
            options = [(KEEP if role == r else RELABEL if role is not None else UNKNOWN, "keep" if role == r else "relabel", r) for r in NEXT[state]]
            if state != START:
                options.append((MERGE if role in (state, None) else MERGE + RELABEL, "merge", state))
            for more, step, to in sorted(options, key=lambda x: (x[0], ("keep", "merge", "relabel").index(x[1]))):
                if cost + more < after[to][0]:
                    after[to] = (cost + more, (path, (step, to, i)))
        costs = _closure(after)
    cost, path = min((costs[s] for s in FINAL), key=lambda x: x[0])
    steps = []
    while path is not None:
        path, step = path
        steps.append(step)
    return int(cost), steps[::-1]


def render(steps: list[tuple[str, int, int]], texts: list[str | None]) -> str:
    turns: list[tuple[int, list[str]]] = []
    for step, role, i in steps:
        text = texts[i] if i >= 0 and isinstance(texts[i], str) else ""
        if step == "merge":
            turns[-1][1].append(text)
        else:
            turns.append((role, [text]))
    return "".join(TURN.format(role=NAMES[r], text="\n\n".join(x for x in t if x)) for r, t in turns)


SCHEMA = "conv_id long, n_turns long, cost long, n_merged long, n_relabelled long, n_inserted long, roles string, rendered string, rendered_sha256 string"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: what the repair changed, and the rendered conversation.

    Turns go by number, then role, then text, nulls first; exact repeats of a turn
    count once. Rows without a conv_id belong to no conversation and are left out.
    A null role is of no known kind; a null or empty text renders as nothing. The
    merged texts are joined by an empty line. Extra columns aren't read.

    Turns are dealt by a hash of the conversation, then sorted with spilling, which
    brings exact repeats together; a conversation streams through its task turn by
    turn, and only its own turns, that its rendered row must hold anyway, are in
    memory, however many or long they are.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def done(conv: int, roles: list, texts: list) -> tuple:
        cost, steps = repair([role_of(r) for r in roles])
        out = render(steps, texts)
        count = lambda kind: sum(s[0] == kind for s in steps)
        kept = "".join(NAMES[r][0] for step, r, _ in steps if step != "merge")
        return conv, len(roles), cost, count("merge"), count("relabel"), count("insert"), kept, out, hashlib.sha256(out.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, roles, texts, last = None, [], [], None
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            out = []
            for c, turn, role, text in zip(b["conv_id"].tolist(), b["turn"].tolist(), b["role"].tolist(), b["text"].tolist()):
                same, last = last, (c, None if turn != turn else turn, role, text)
                if same == last:
                    continue
                if c != conv:
                    if conv is not None:
                        out.append(done(conv, roles, texts))
                    conv, roles, texts = c, [], []
                roles.append(role), texts.append(text)
            yield pd.DataFrame(out, columns=names)
        if conv is not None:
            yield pd.DataFrame([done(conv, roles, texts)], columns=names)

    return rows.mapInPandas(run, SCHEMA)
