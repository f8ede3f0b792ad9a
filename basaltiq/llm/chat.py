"""Transcript parsing: a hidden Markov model over speaker markers and line features, then canonical rendering.

Hidden states are (role, place in the turn): a line begins a turn of a role or continues it. A line emits features: what
kind of marker it bears, how long it is, how it ends, and whether it follows an empty line. Start, transition and
emission probabilities are counted on transcripts whose roles are known, with add-one smoothing; counts have a fixed
number of cells. Viterbi recovers the roles, and turns are rendered in one form.

A conversation of more than ``SEGMENT_TURNS`` turns is cut into segments by turn number, and still gets the path of the
whole transcript: every segment gives the best scores from each state before it to each state at its end (max-plus, 6 x 6),
one stream over these carries the scores forward, a second one goes back and fixes each segment's first and last state, and
then the segments are decoded apart. The streams see a row of 78 numbers for each segment.

Defined results: a null text is an empty line; a turn without a number or a conversation has no order, so each such turn is a transcript of its
own, without segment; null or unknown roles are taken for ``user`` when counting; repeated rows are turns of their own; an
empty transcript has no turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import BROADCAST_ROWS, written

ROLES = ("system", "user", "assistant")
STATES = [(r, new) for r in ROLES for new in (True, False)]
SEGMENT_TURNS = 256

#: Markers that speakers bear in transcripts, by role.
MARKERS = {
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "gpt"),
    "system": ("system", "instruction", "instructions", "context"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|?|>\s*)?([A-Za-z]{1,14})(?:\s*\d{0,3})(?:\*\*|\]|\|?>)?\s*(?::|\]:|-\s)\s?")
FEATURES = ("marker", "length", "ending", "gap")


def marker_of(line: str) -> tuple[str, str]:
    """The role that a marker at the line's start names (``none``: no marker), and the line without it."""
    m = _MARKER.match(line)
    role = _ROLE_OF.get(m[1].lower()) if m else None
    return (role, line[m.end() :]) if role else ("none", line)


def observe(lines: list[str], gap: str = "start") -> list[tuple[str, str, str, str]]:
    """The features of each line; empty lines are the next line's gap, and ``gap`` is the first one's."""
    out = []
    for line in lines:
        role, rest = marker_of(line)
        n = len(rest)
        ending = "?" if rest.rstrip().endswith("?") else ":" if rest.rstrip().endswith(":") else "code" if rest.startswith(("    ", "\t", "```")) else "."
        out.append((role, "short" if n < 40 else "middle" if n < 200 else "long", ending, gap))
        gap = "near" if rest.strip() else "far"
    return out


#: All values of each feature, so that tables have the same cells whatever was seen.
VALUES = (("none", *ROLES), ("short", "middle", "long"), ("?", ":", "code", "."), ("start", "near", "far"))


class Hmm:
    """Log probabilities; ``counts`` maps ``start|state``, ``move|state|state`` and ``emit|state|feature|value`` to numbers."""

    def __init__(self, counts: dict[str, int]) -> None:
        log = lambda rows: np.log(np.array(rows, float) / np.array(rows, float).sum(axis=-1, keepdims=True))
        key = lambda s: f"{s[0]}{'+' if s[1] else '-'}"
        names = [key(s) for s in STATES]
        self.start = log([counts.get(f"start|{s}", 0) + (1 if s.endswith("+") else 0.001) for s in names])
        # A line cannot continue the turn of another role.
        moves = np.array([[counts.get(f"move|{s}|{t}", 0) + (1 if t.endswith("+") or s[:-1] == t[:-1] else 1e-6) for t in names] for s in names], float)
        self.move = log(moves)
        self.emit = [log([[counts.get(f"emit|{s}|{f}|{v}", 0) + 1 for v in VALUES[k]] for s in names]) for k, f in enumerate(FEATURES)]
        self._at = [{v: i for i, v in enumerate(values)} for values in VALUES]

    def _scores(self, seen: list[tuple[str, ...]]) -> np.ndarray:
        return np.sum([emit[:, [at[o[k]] for o in seen]] for k, (emit, at) in enumerate(zip(self.emit, self._at, strict=True))], axis=0).T

    def transfer(self, seen: list[tuple[str, ...]], first: np.ndarray) -> np.ndarray:
        """Best scores of paths over the lines, by their last state, and by row of ``first``, the scores of entering each state."""
        scores = self._scores(seen)
        best = first + scores[0]
        for row in scores[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + row
        return best

    def decode(self, seen: list[tuple[str, ...]], entry: int | None = None, end: int | None = None) -> list[tuple[str, bool]]:
        """Viterbi: the most probable states, the first in the order of STATES on ties. ``entry``: the state before the first line; ``end``: that of the last."""
        if not seen:
            return []
        scores = self._scores(seen)
        best, back = (self.start if entry is None else self.move[entry]) + scores[0], []
        for row in scores[1:]:
            via = best[:, None] + self.move
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        path = [int(best.argmax()) if end is None else end]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [STATES[i] for i in reversed(path)]


def turns_of(lines: list[str], path: list[tuple[str, bool]], before: str | None = None) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn; ``before``: the role of a turn that a first line may continue, which then has an empty role."""
    turns: list[tuple[str, list[str]]] = [("", [])] if before is not None else []
    role_now = before
    for line, (role, new) in zip(lines, path, strict=True):
        marked, rest = marker_of(line)
        if new or role_now != role:
            turns.append((role, [rest if marked != "none" else line]))
            role_now = role
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(own).strip("\n")) for role, own in turns]


def parse(text: str, model: Hmm) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn."""
    lines = text.split("\n") if text else []
    return turns_of(lines, model.decode(observe(lines)))


def render(turns: list[tuple[str, str]], *, last: bool = True) -> str:
    """The canonical form. Delimiters in a text are broken by a zero-width joiner, so that no text forges a turn. A first turn
    without role continues that of the segment before; a segment that is not the last leaves its turn open, so that the
    segments' forms in a row are the conversation's."""
    safe = lambda t: t.replace("<|", "<‍|")
    out, open_ = "", bool(turns) and not turns[0][0]
    for role, text in turns:
        if not role:
            out += f"\n{safe(text)}" if text else ""
        else:
            out += ("\n<|end|>\n" if open_ else "") + f"<|{role}|>\n{safe(text)}"
            open_ = True
    return out + ("\n<|end|>\n" if open_ and last else "")


def known_counts(turns: DataFrame) -> dict[str, int]:
    """Counts for the model from turns ``(conv, seg, pos, role, lines)``, in the shape in which they are written.

    Every cell is one of a fixed set, so what reaches the driver does not grow.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for role, before, text in zip(*(b.column(c).to_pylist() for c in ("role", "before", "text")), strict=True):
                role = role if role in ROLES else "user"
                lines = (text or "").split("\n")
                prior = None if before is None else f"{before if before in ROLES else 'user'}"
                for i, seen in enumerate(observe(lines)):
                    state = f"{role}{'+' if i == 0 else '-'}"
                    if i == 0:
                        if prior is None:
                            keys = [f"start|{state}"]
                        else:  # the turn before ended in its first line or in a later one
                            keys = [f"move|{prior}+|{state}", f"move|{prior}-|{state}"]
                            seen = (*seen[:3], "near")
                    else:
                        keys = [f"move|{role}{'+' if i == 1 else '-'}|{state}"]
                    for key in keys + [f"emit|{state}|{f}|{v}" for f, v in zip(FEATURES, seen, strict=True)]:
                        total[key] = total.get(key, 0) + 1
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    return {r["key"]: r["n"] for r in turns.select("role", "before", "text").mapInArrow(rows, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


#: Forms in which transcripts mark their speakers.
STYLES = (("User: ", "Assistant: "), ("### Human: ", "### AI: "), ("Q: ", "A: "), ("[user]: ", "[bot]: "), ("**User**: ", "**Assistant**: "))


def _styled(conv: Column, role: Column, turn: Column, text: Column) -> Column:
    """A turn as a raw transcript has it: the conversation's style, and no marker at each third turn."""
    style = F.pmod(F.xxhash64(conv), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, (user, assistant) in enumerate(STYLES):
        own = F.when(role == "system", F.lit("System: ")).when(role == "assistant", F.lit(assistant)).otherwise(F.lit(user))
        mark = F.when(style == k, own).otherwise(mark)
    return F.concat(F.when(F.pmod(turn, F.lit(3)) == 2, F.lit("")).otherwise(mark), F.coalesce(text, F.lit("")))


#: What a segment hands to the streams: best scores from the start, and from each state after a line, or after an empty one.
SIZE = len(STATES)


def _borders(rows: DataFrame, hmm: Hmm) -> DataFrame:
    """``conv, segment, entry, end, gap`` of conversations of several segments: the states of the whole transcript's best path
    before and at the end of each; ``entry`` is null at the beginning."""

    def score(own: pd.DataFrame) -> pd.DataFrame:
        lines = "\n".join(own.sort_values(["turn", "role", "text"], kind="stable")["text"]).split("\n")
        made = [hmm.transfer(observe(lines, gap), first) for gap, first in (("start", hmm.start[None]), ("near", hmm.move), ("far", hmm.move))]
        blank = not marker_of(lines[-1])[1].strip()
        return pd.DataFrame({"conv": [own["conv"].iloc[0]], "segment": [own["segment"].iloc[0]], "scores": [np.concatenate([m.ravel() for m in made])], "blank": [blank]})

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, best, blank = None, None, False
        for b in batches:
            out = []
            for c, segment, scores, now in zip(b["conv"], b["segment"], b["scores"], b["blank"], strict=True):
                m, gap = np.asarray(scores), "start"
                if c != conv:
                    best, back = m[:SIZE], [-1] * SIZE
                else:
                    gap = "far" if blank else "near"
                    via = best[:, None] + m[SIZE + (SIZE * SIZE if blank else 0) :][: SIZE * SIZE].reshape(SIZE, SIZE)
                    best, back = via.max(axis=0), via.argmax(axis=0).tolist()
                conv, blank = c, now
                out.append((c, segment, back, int(best.argmax()), gap))
            yield pd.DataFrame(out, columns=["conv", "segment", "back", "best", "gap"])

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, end = None, 0
        for b in batches:
            out = []
            for c, segment, back, best, gap in zip(b["conv"], b["segment"], b["back"], b["best"], b["gap"], strict=True):
                last = c != conv
                conv, end = c, best if last else end
                out.append((c, segment, int(back[end]), end, gap, last))
                end = int(back[end])
            yield pd.DataFrame(out, columns=["conv", "segment", "entry", "end", "gap", "last"])

    scored = written(rows.select("conv", "segment", "turn", "role", "text").groupBy("conv", "segment").applyInPandas(score, "conv string, segment long, scores array<double>, blank boolean"), "chat-scores")
    ahead = scored.repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(forward, "conv string, segment long, back array<int>, best int, gap string")
    back = written(ahead, "chat-forward").repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
    return written(back.mapInPandas(backward, "conv string, segment long, entry int, end int, gap string, last boolean"), "chat-borders")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, held_out, n_lines, n_turns, roles, n_role_errors, rendered`` for each segment of a conversation.

    The turns are first written as raw transcripts without roles; those are parsed, and compared with the roles. The model
    is counted on conversations whose crc32(conv_id as text) mod 5 is not 0; the others are held out.
    """
    # Turns without a conversation are told apart like those without a number, or all of them would be one transcript.
    turn = F.when(F.col("conv_id").isNotNull(), F.col("turn").cast("long"))
    number, role = F.coalesce(turn, F.lit(0)), F.coalesce("role", F.lit("user"))
    text = _styled(F.col("conv_id"), role, number, F.col("text"))
    own = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.floor(turn / SEGMENT_TURNS).alias("segment"), number.alias("turn"), role.alias("role"),
        text.alias("text"), F.when(turn.isNull(), F.xxhash64(role, text)).otherwise(0).alias("alone"),
    )
    learn = own.where("alone = 0 and segment is not null").where(F.crc32(F.col("conv").cast("binary")) % 5 != 0)
    # The role before: by key, since a window over a hot conversation would gather it; segments end such runs.
    firsts = learn.groupBy("conv", "segment", "turn").agg(F.min("role").alias("before")).withColumn("turn", F.col("turn") + 1)
    hmm = Hmm(known_counts(learn.join(firsts, ["conv", "segment", "turn"], "left")))

    ends = own.groupBy("conv").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high").select("conv")
    several = written(ends, "long-chats")
    count = several.count()
    long = _borders(own.where("segment is not null").join(F.broadcast(several) if count <= BROADCAST_ROWS else several, "conv", "left_semi"), hmm) if count else None
    if long is None:
        own = own.select("*", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("end"), F.lit("start").alias("gap"), F.lit(True).alias("last"))
    else:
        own = own.join(F.broadcast(long) if long.count() <= BROADCAST_ROWS else long, ["conv", "segment"], "left").na.fill({"gap": "start", "last": True})

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "role", "text"], kind="stable")
        lines = "\n".join(rows["text"]).split("\n")
        entry, end = (None if pd.isna(x) or x < 0 else int(x) for x in (rows["entry"].iloc[0], rows["end"].iloc[0]))
        path = hmm.decode(observe(lines, rows["gap"].iloc[0]), entry, end)
        truth = [r if r in ROLES else "user" for r, t in zip(rows["role"], rows["text"], strict=True) for _ in range(t.count("\n") + 1)]
        turns = turns_of(lines, path, None if entry is None else STATES[entry][0])
        begun = [r for r, _ in turns if r]
        return pd.DataFrame({
            "conv": [rows["conv"].iloc[0]], "segment": [rows["segment"].iloc[0]], "n_lines": [len(lines)], "n_turns": [len(begun)],
            "roles": [",".join(begun)], "n_role_errors": [sum(a != b for (a, _), b in zip(path, truth, strict=True))], "rendered": [render(turns, last=bool(rows["last"].iloc[0]))],
        }).astype({"segment": "Int64"})

    made = own.groupBy("conv", "segment", "alone").applyInPandas(one, "conv string, segment long, n_lines long, n_turns long, roles string, n_role_errors long, rendered string")
    out = F.crc32(F.col("conv").cast("binary")) % 5 == 0
    return made.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "segment", out.alias("held_out"), "n_lines", "n_turns", "roles", "n_role_errors", "rendered")
