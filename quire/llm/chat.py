"""Chat formatting with the cheapest repair of the roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Other names of the roles, taken as the role itself.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: The automaton of legal conversations: from the last role, what may follow.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("user", "assistant")
MERGE, INSERT, RELABEL, UNNAMED = 1, 3, 2, 1
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

SCHEMA = "n_turns int, n_out int, cost int, merged int, relabelled int, inserted int, text string"


def role_of(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    return r if r in ROLES else ALIASES.get(r)


def _bridge(state: str, role: str) -> list[str] | None:
    """The fewest empty turns that lead from state to where role may follow."""
    paths = [(state, [])]
    seen = {state}
    for at, way in paths:
        if role in NEXT[at]:
            return way
        for r in NEXT[at]:
            if r not in seen:
                seen.add(r)
                paths.append((r, [*way, r]))
    return None


def _choices(state: str, role: str | None) -> list[tuple[int, str, bool, list[str]]]:
    """(cost, role it gets, merged, empty turns before), the preferred of equal costs first."""
    out = []
    for as_ in ROLES:
        relabel = 0 if as_ == role else UNNAMED if role is None else RELABEL
        if as_ == state:
            out.append((relabel + MERGE, as_, True, []))
        if (way := _bridge(state, as_)) is not None:
            out.append((relabel + INSERT * len(way), as_, False, way))
    return sorted(out, key=lambda c: (c[0], c[1] != role, not c[2], len(c[3]), ROLES.index(c[1])))


CHOICES = {(s, r): _choices(s, r) for s in NEXT for r in (*ROLES, None)}
#: What an unfinished conversation still needs: empty turns up to a final role.
ENDING = {s: [] if s in FINAL or s == "" else [*_bridge(s, "user"), "user"] for s in NEXT}


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, bool, list[str]]], list[str]]:
    """(cost, for each turn its role, whether it is merged, and the empty turns before it; empty
    turns at the end) of the cheapest legal reading, by dynamic programming from the end.

    Among equal costs the first turn that differs decides: a kept role before a new one, a merge
    before an insertion, then the order of ROLES.
    """
    best = {s: INSERT * len(w) for s, w in ENDING.items()}
    plan: list[dict[str, tuple]] = []
    for role in reversed(roles):
        step = {s: min(CHOICES[s, role], key=lambda c: c[0] + best[c[1]]) for s in NEXT}
        best = {s: c[0] + best[c[1]] for s, c in step.items()}
        plan.append(step)
    state, out = "", []
    for step in reversed(plan):
        _, role, merged, way = step[state]
        out.append((role, merged, way))
        state = role
    return best[""], out, ENDING[state]


def render(turns: list[tuple[str, str]]) -> str:
    """Turns with their marks; marks in a text are broken by a blank."""
    return "".join(f"{OPEN}{role}\n{text.replace('<|', '< |')}{CLOSE}\n" for role, text in turns)


def format_turns(roles: list[str | None], texts: list[str | None]) -> tuple:
    known = [role_of(r) for r in roles]
    cost, steps, ending = repair(known)
    turns: list[list] = []
    for (role, merged, way), text in zip(steps, texts):
        turns += [[r, []] for r in way]
        if merged:
            turns[-1][1].append(text or "")
        else:
            turns.append([role, [text or ""]])
    turns += [[r, []] for r in ending]
    merged = sum(m for _, m, _ in steps)
    relabelled = sum(s[0] != r for s, r in zip(steps, known))
    inserted = sum(len(s[2]) for s in steps) + len(ending)
    return len(roles), len(turns), cost, merged, relabelled, inserted, render([(r, "\n".join(t)) for r, t in turns])


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, SCHEMA's counts, and the repaired, rendered text.

    Legal is: a system turn or none, then user and assistant by turns, the user first. Where the
    roles aren't, turns are merged with the one before (joined by a line feed), relabelled, or
    empty turns are put in, at the least total cost.

    * Turns are in the order of turn (null first), then role, then text (null first). Rows alike
      in all four columns count once.
    * Nothing tells which rows with a null conv_id belong together: each different one is a conversation
      of its own, with the null id. So no task has to hold all of them.
    * A null, unknown or blank role is one that must be relabelled, cheaply; a null text is empty.
    * Very long texts are rendered whole. Other columns aren't read.
    * An empty table gives an empty table.
    """
    each = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.md5(F.to_json(each)))
    convs = turns.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), each.alias("t")).groupBy("conv_id", "alone").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("t"))

    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [format_turns(list(r), list(t)) for r, t in zip(roles, texts)]
        return pd.DataFrame(rows, columns=["n_turns", "n_out", "cost", "merged", "relabelled", "inserted", "text"])

    udf = F.pandas_udf(run, SCHEMA)
    return convs.select("conv_id", udf("t.role", "t.text").alias("f")).select("conv_id", "f.*")


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """The same in SQL: a recursion from the end for the least costs from each state, one from the start for the choices."""
    states = list(NEXT)
    at = {s: i for i, s in enumerate(states, 1)}
    roles = [*ROLES, None]
    flat = [(s, r, *c) for s in states for r in roles for c in CHOICES[s, r]]
    number = {(s, r, i): k for k, (s, r, i) in enumerate(((s, r, i) for s in states for r in roles for i in range(len(CHOICES[s, r]))), 1)}
    said = lambda r: "'?'" if r is None else f"'{r}'"
    mark = lambda r: f"'{OPEN}{r}' || chr(10) || '{CLOSE}' || chr(10)"
    empty = lambda way: " || ".join(map(mark, way)) or "''"
    least = "CASE t.role " + " ".join(f"WHEN {said(r)} THEN [{', '.join('least(' + ', '.join(f'{c[0]} + b.b[{at[c[1]]}]' for c in CHOICES[s, r]) + ')' for s in states)}]" for r in roles) + " END"
    pick = "CASE t.role " + " ".join(
        f"WHEN {said(r)} THEN CASE w.state " + " ".join(f"WHEN {at[s]} THEN CASE " + " ".join(f"WHEN {c[0]} + b.b[{at[c[1]]}] = a.b[{at[s]}] THEN {number[s, r, i]}" for i, c in enumerate(CHOICES[s, r])) + " END" for s in states) + " END" for r in roles
    ) + " END"
    choices = ", ".join(f"({k}, {at[c[3]]}, '{c[3]}', {c[4]}, {c[3] != c[1]}, {len(c[5])}, {empty(c[5])})" for k, c in enumerate(flat, 1))
    known = ", ".join(f"('{k}', '{v}')" for k, v in {**{r: r for r in ROLES}, **ALIASES}.items())
    return f"""
WITH RECURSIVE known(name, role) AS (VALUES {known}
), choices(id, to_state, as_role, merged, relabelled, n_way, way) AS (VALUES {choices}
), ending(state, n, way) AS (VALUES {", ".join(f"({at[s]}, {len(w)}, {empty(w)})" for s, w in ENDING.items())}
), rows AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN '?' || row_number() OVER () ELSE conv_id::VARCHAR END AS k FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), turns AS (
  SELECT k, conv_id, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, r.role NULLS FIRST, text NULLS FIRST) AS i, coalesce(known.role, '?') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY k) AS n
  FROM rows r LEFT JOIN known ON known.name = lower(trim(r.role, ' ' || chr(9) || chr(10) || chr(13)))
), costs(k, i, b) AS (
  SELECT DISTINCT k, n + 1, [{", ".join(str(INSERT * len(ENDING[s])) for s in states)}] FROM turns
  UNION ALL SELECT b.k, b.i - 1, {least} FROM costs b JOIN turns t ON t.k = b.k AND t.i = b.i - 1
), way(k, i, state, choice) AS (
  SELECT DISTINCT k, 0::BIGINT, 1, 0 FROM turns
  UNION ALL SELECT w.k, t.i, c.to_state, c.id FROM way w JOIN turns t ON t.k = w.k AND t.i = w.i + 1 JOIN costs a ON a.k = w.k AND a.i = t.i JOIN costs b ON b.k = w.k AND b.i = t.i + 1 JOIN choices c ON c.id = {pick}
), steps AS (
  SELECT t.*, c.*, w.state, sum((NOT c.merged)::INTEGER) OVER (PARTITION BY t.k ORDER BY t.i) AS g FROM turns t JOIN way w ON w.k = t.k AND w.i = t.i JOIN choices c ON c.id = w.choice
), made AS (
  SELECT k, g, string_agg(way, '' ORDER BY i) || '{OPEN}' || min(as_role) || chr(10) || replace(string_agg(text, chr(10) ORDER BY i), '<|', '< |') || '{CLOSE}' || chr(10) AS text FROM steps GROUP BY k, g
), whole AS (
  SELECT k, string_agg(text, '' ORDER BY g) AS text FROM made GROUP BY k
), counts AS (
  SELECT k, any_value(conv_id) AS conv_id, max(i) AS n, max(g) AS groups, sum(merged::INTEGER) AS merged, sum(relabelled::INTEGER) AS relabelled, sum(n_way) AS inserted, arg_max(state, i) AS state FROM steps GROUP BY k
)
SELECT c.conv_id, c.n::INTEGER AS n_turns, (c.groups + c.inserted + e.n)::INTEGER AS n_out, costs.b[1]::INTEGER AS cost, c.merged::INTEGER AS merged, c.relabelled::INTEGER AS relabelled, (c.inserted + e.n)::INTEGER AS inserted, w.text || e.way AS text
FROM counts c JOIN whole w ON w.k = c.k JOIN ending e ON e.state = c.state JOIN costs ON costs.k = c.k AND costs.i = 1
"""


SQL = _sql()
