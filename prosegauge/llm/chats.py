"""Operator 4: transcript parsing by a hidden Markov model, and canonical turns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: States: a line that opens a turn of a role, and one that goes on with it.
STATES = [(r, k) for r in ROLES for k in ("open", "on")]
#: Words that mark speakers.
MARKERS = {
    "system": "system|instructions?|context", "user": "user|human|q|question|customer|me|prompter",
    "assistant": "assistant|bot|ai|a|answer|agent|model",
}
_MARKED = {r: re.compile(rf"^\s*(?:#+\s*|\*\*|\[|<\|?)?(?:{w})(?:\*\*|\]|\|?>)?\s*(?:[:>\-]|$|(?<=[\]>]))\s*", re.IGNORECASE)
           for r, w in MARKERS.items()}


def features(line: str) -> tuple[int, int, int]:
    """Speaker marker (0: none, else the role's place from 1), kind of length, and kind of ending."""
    marker = next((i + 1 for i, r in enumerate(ROLES) if _MARKED[r].match(line)), 0)
    length = min(len(line) // 80, 5)
    end = line.rstrip()[-1:]
    return marker, length, 0 if not end else 1 if end == "?" else 2 if end in ".!" else 3


def without_marker(line: str, role: str) -> str:
    """A turn's first line without its marker: that of its role or, if the line is marked for another, that one."""
    for one in (role, *ROLES):
        bare = _MARKED[one].sub("", line, count=1)
        if bare != line:
            return bare
    return line


class Model:
    """Log chances of the first state, of state after state, and of each feature in a state; counts smoothed by one."""

    def __init__(self, counts: dict[tuple[str, int, int], int]) -> None:
        n = len(STATES)
        first, step = np.ones(n), np.ones((n, n))
        self.seen = [np.ones((n, size)) for size in (4, 6, 4)]
        for (kind, a, b), times in counts.items():
            if kind == "first":
                first[a] += times
            elif kind == "step":
                step[a, b] += times
            else:
                self.seen[int(kind)][a, b] += times
        # a transcript opens with an opening line, and a turn only goes on with its own role
        for i, (_, k) in enumerate(STATES):
            if k == "on":
                first[i] = 1e-12
                for j, (r, _) in enumerate(STATES):
                    if r != STATES[i][0]:
                        step[j, i] = 1e-12
        self.first = np.log(first / first.sum())
        self.step = np.log(step / step.sum(1, keepdims=True))
        self.seen = [np.log(s / s.sum(1, keepdims=True)) for s in self.seen]

    def roles(self, lines: list[str]) -> list[int]:
        """States of the lines by Viterbi."""
        if not lines:
            return []
        chance = np.array([sum(self.seen[k][:, v] for k, v in enumerate(features(x))) for x in lines])
        best, back = self.first + chance[0], []
        for row in chance[1:]:
            reach = best[:, None] + self.step
            back.append(reach.argmax(0))
            best = reach.max(0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def turns_of(model: Model, transcript: str) -> list[tuple[str, str]]:
    """Roles and texts of a transcript's turns; blank lines belong to the turn before, markers go. Blank lines before the
    first turn belong to none."""
    lines = transcript.split("\n")
    states = iter(model.roles([x for x in lines if x.strip()]))
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        if not line.strip():
            if out:
                out[-1][1].append(line)
            continue
        role, kind = STATES[next(states)]
        if kind == "open" or not out:
            out.append((role, [without_marker(line, role)]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text)) for role, text in out]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical text. A text's own ``<|`` is written ``<\\|``, and ``<\\`` is written ``<\\\\``, so that no text can open or
    end a turn and each can be read back."""
    safe = lambda text: text.replace("<\\", "<\\\\").replace("<|", "<\\|")
    return "".join(f"<|{role}|>\n{safe(text)}\n<|end|>\n" for role, text in turns)


def _labelled(turns: list[dict]) -> Iterator[tuple[str, int]]:
    """Lines of a conversation with their states."""
    for turn in turns:
        role = turn["role"] if turn["role"] in ROLES else "user"
        for i, line in enumerate(x for x in (turn["line"] or "").split("\n") if x.strip()):
            yield line, STATES.index((role, "on" if i else "open"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """A transcript for each conversation: turns in order, most with a speaker marker in one of several styles, one in
    eight without any, as pasted chats have them. Also the labelled turns. A row without conv_id is a conversation of its
    own, as nothing says what it belongs to."""
    role = F.coalesce("role", F.lit("user"))
    code = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    upper = F.initcap(role)
    mark = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0, "").when(code == 0, F.concat(upper, F.lit(": "))).when(
        code == 1, F.concat(F.lit("["), role, F.lit("] "))).when(code == 2, F.concat(F.lit("**"), upper, F.lit("** - "))).otherwise(
        F.concat(F.lit("### "), upper, F.lit(": ")))
    turn = F.struct("turn", role.alias("role"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("line"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return conversations.select("conv_id", "turn", "role", "text", alone.alias("_alone")).groupBy("conv_id", "_alone").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")).drop("_alone")


def fit(chats: DataFrame) -> Model:
    """Count states, their order and features over all conversations; at most 126 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for turns in batch.column("turns").to_pylist():
                last = None
                for line, state in _labelled(turns):
                    found["first" if last is None else "step", state if last is None else last, state] += 1
                    for k, v in enumerate(features(line)):
                        found[str(k), state, v] += 1
                    last = state
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                + [pa.array(list(found.values()), pa.int64())], ["kind", "a", "b", "n"])

    rows = chats.select("turns").mapInArrow(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in rows.collect()})


def parse(chats: DataFrame, model: Model) -> DataFrame:
    """Canonical turns of each conversation's transcript.

    One row for each conv_id, and for each row without one, with a null conv_id: n_lines, n_turns, roles (comma-joined), right_lines (lines
    whose recovered role is the labelled one), rendered (canonical text) and rendered_sha256. Null or empty texts add no
    lines; unknown or null roles count as user; repeated rows are repeated turns. An empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for turns in batch.column("turns").to_pylist():
                truth = [STATES[s][0] for _, s in _labelled(turns)]
                whole = "\n".join(t["line"] for t in turns if t["line"])
                lines = [x for x in whole.split("\n") if x.strip()]
                found = model.roles(lines)
                chat = turns_of(model, whole)
                text = render(chat)
                right = sum(STATES[s][0] == r for s, r in zip(found, truth, strict=True))
                out.append((len(lines), len(chat), ",".join(r for r, _ in chat), right, text, hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["conv_id", "n_lines", "n_turns", "roles", "right_lines", "rendered", "rendered_sha256"])

    return chats.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(
        read, "conv_id long, n_lines long, n_turns long, roles string, right_lines long, rendered string, rendered_sha256 string")
