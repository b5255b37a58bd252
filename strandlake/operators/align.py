"""Alignment kernels on two walks.

A walk is a string read away from a seed: the part of a sequence to be aligned
in the direction of extension, complemented where strands differ. So every
kernel reads left to right, whatever the strands and directions; ``walks``
makes the two strings. N agrees with nothing.

What an extension does depends on the last square it aligned, so an extension
is a generator that asks for squares. ``together`` runs many of them and aligns
all squares asked for at a time in one set of array operations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np

from strandlake.config import CompressOptions

#: Scores and the greatest size of the dynamic-programming square.
MATCH, MISMATCH, GAP, SQUARE = 1, -3, -3, 25
#: Bases that a comparison looks at first; it looks at twice as many each time it goes on.
NEAR = 64
#: Comparison without gaps goes so many bases at a time, and stops this far below its best in mismatches.
STEP, MISMATCHES = 256, 2
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


@dataclass(frozen=True)
class Scores:
    match: int = MATCH
    mismatch: int = MISMATCH
    gap: int = GAP


DEFAULT = Scores()


def walks(coarse: str, at: int, coarse_step: int, org: str, pos: int, org_step: int) -> tuple[str, str]:
    """What lies beyond coarse[at] and org[pos] in the given directions, in the coarse strand's letters."""
    c = coarse[at + 1 :] if coarse_step > 0 else coarse[:at][::-1] if at > 0 else ""
    o = org[pos + 1 :] if org_step > 0 else org[:pos][::-1] if pos > 0 else ""
    return c, o if coarse_step == org_step else o.translate(_COMPLEMENT)


def agreement(c: str, o: str) -> np.ndarray:
    n = min(len(c), len(o))
    a, b = np.frombuffer(c[:n].encode(), np.uint8), np.frombuffer(o[:n].encode(), np.uint8)
    return (a == b) & (a != ord("N"))


def cheap_extension(c: str, o: str, opts: CompressOptions) -> int:
    """Bases passed before max_consec_mismatch mismatches in a row, at most min_progress + 1."""
    same = agreement(c[: opts.min_progress + 1], o[: opts.min_progress + 1])
    run = 0
    for i, ok in enumerate(same.tolist()):
        run = 0 if ok else run + 1
        if run == opts.max_consec_mismatch:
            return i + 1
    return len(same)


class History:
    """The last gapped_window_size comparisons; before the first all count as matches."""

    def __init__(self, opts: CompressOptions):
        self.least = opts.window_ident_thresh
        self.recent = deque([True] * opts.gapped_window_size, opts.gapped_window_size)
        self.matches = opts.gapped_window_size

    def take(self, outcomes: list[bool], more: int = 0) -> int:
        """Adds outcomes, and after them so many matches, until the window is bad; how many were good."""
        for i, ok in enumerate(outcomes):
            self.matches += ok - self.recent[0]
            self.recent.append(ok)
            if self.matches < self.least:
                return i
        if more:
            # A match makes no window worse.
            if self.matches < self.least:
                return len(outcomes)
            fresh = min(more, self.recent.maxlen)
            self.matches += fresh - sum(islice(self.recent, fresh))
            self.recent.extend([True] * fresh)
        return len(outcomes) + more


def mismatches(c: str, o: str) -> Iterator[int]:
    """Places at which the walks disagree, then where the shorter one ends; later ones are compared when they are asked for."""
    n, at, step = min(len(c), len(o)), 0, NEAR
    while at < n:
        yield from (np.flatnonzero(~agreement(c[at : at + step], o[at : at + step])) + at).tolist()
        at, step = at + step, 2 * step
    yield n


def ungapped(c: str, o: str, history: History, opts: CompressOptions) -> tuple[int, bool]:
    """(bases accepted, whether a bad window ended it) of comparison without gaps.

    Runs of consec_match_clump_size matches accept all before them. The walk is
    given up where, btwn_match_min_dist_check or more bases after the last
    accepted one, a mismatch leaves under half of them matching.
    """
    clump, n = opts.consec_match_clump_size, min(len(c), len(o))
    accepted, run, loose, pending, at = 0, clump, 0, [], 0
    for end in mismatches(c, o):
        # A run of matches, then a mismatch, or a walk's end.
        if run + end - at >= clump and end > at:
            good = history.take(pending, end - at)
            accepted += good
            if good < len(pending) + end - at:
                return accepted, True
            pending, loose = [], 0
        else:
            loose += end - at
            pending += [True] * (end - at)
        if end == n:
            break
        pending.append(False)
        run, at, since = 0, end + 1, end + 1 - accepted
        if since >= opts.btwn_match_min_dist_check and 2 * loose < since:
            return accepted, False
    return n, False


Squares = Generator[tuple[str, str], "tuple[str, str, list[bool]] | None", Any]


def squares(walks_: list[tuple[str, str]], scores: Scores = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Scores and moves (0 both, 1 coarse only, 2 original only) of global alignment of pairs of short walks.

    Both are arrays (pairs, 1 + longest coarse, 1 + longest original); a tie
    prefers both, then the original's move. Cells beyond a walk's end mean nothing.
    """
    cs, os_ = (np.array([len(w[k]) for w in walks_]) for k in (0, 1))
    rows, columns = int(cs.max(initial=0)), int(os_.max(initial=0))
    c, o = (np.frombuffer("".join(w[k].ljust(n, "N") for w in walks_).encode(), np.uint8).reshape(len(walks_), n) for k, n in ((0, rows), (1, columns)))
    gain = np.where((c[:, :, None] == o[:, None, :]) & (c != ord("N"))[:, :, None], scores.match, scores.mismatch).astype(np.int32)
    n = len(walks_)
    score, move = np.zeros((n, rows + 1, columns + 1), np.int32), np.zeros((n, rows + 1, columns + 1), np.uint8)
    score[:, 0], score[:, :, 0] = scores.gap * np.arange(columns + 1), scores.gap * np.arange(rows + 1)
    move[:, 0, 1:], move[:, 1:, 0] = 2, 1
    # A row at a time: the best way into each cell from the row above, then along the row, where each step costs a gap.
    steps = scores.gap * np.arange(columns + 1, dtype=np.int32)
    for i in range(1, rows + 1):
        above, row = score[:, i - 1], score[:, i]
        np.maximum(above[:, :-1] + gain[:, i - 1], above[:, 1:] + scores.gap, out=row[:, 1:])
        row -= steps
        np.maximum.accumulate(row, axis=1, out=row)
        row += steps
    best = score[:, 1:, 1:]
    move[:, 1:, 1:] = np.where(score[:, :-1, :-1] + gain == best, 0, np.where(score[:, 1:, :-1] + scores.gap == best, 2, 1))
    return score, move


def square(c: str, o: str) -> tuple[np.ndarray, np.ndarray]:
    score, move = squares([(c, o)])
    return score[0], move[0]


def all_gapped(walks_: list[tuple[str, str]], clump: int, scores: Scores = DEFAULT) -> Iterator[tuple[str, str, list[bool]] | None]:
    """For each pair the aligned strings and outcomes of the best path to the far edge, cut back to its last run of ``clump`` matches."""
    walks_ = [(c[:SQUARE], o[:SQUARE]) for c, o in walks_]
    if not walks_:
        return
    score, move = squares(walks_, scores)
    n, last_row, last_column = np.arange(len(walks_)), *(np.array([len(w[k]) for w in walks_]) for k in (0, 1))
    # The far edge: the last row, then the last column; of equal ones the last.
    lowest = np.iinfo(np.int32).min
    bottom = np.where(np.arange(score.shape[2]) <= last_column[:, None], score[n, last_row], lowest)
    side = np.where(np.arange(score.shape[1]) <= last_row[:, None], score[n, :, last_column], lowest)
    edge = np.concatenate([bottom, side], axis=1)
    ends = (edge.shape[1] - 1 - np.argmax(edge[:, ::-1], axis=1)).tolist()
    wide = move.shape[2]
    for k, (c, o) in enumerate(walks_):
        i, j = (len(c), ends[k]) if ends[k] < wide else (ends[k] - wide, len(o))
        moves, columns = move[k].tobytes(), []
        while i or j:
            kind = moves[i * wide + j]
            a, b = c[i - 1] if kind != 2 else "-", o[j - 1] if kind != 1 else "-"
            columns.append((a, b, kind == 0 and a == b != "N"))
            i, j = i - (kind != 2), j - (kind != 1)
        columns.reverse()
        end = run = 0
        for at in range(len(columns) - 1, -1, -1):
            run = run + 1 if columns[at][2] else 0
            if run == clump:
                end = at + clump
                break
        columns = columns[:end]
        yield ("".join(x[0] for x in columns), "".join(x[1] for x in columns), [x[2] for x in columns]) if columns else None


def gapped(c: str, o: str, clump: int) -> tuple[str, str, list[bool]] | None:
    return next(all_gapped([(c, o)], clump))


def together(tasks: Iterable[Squares], clump: int, at_once: int = 2000, scores: Scores = DEFAULT) -> Iterator[Any]:
    """What each task returns, in order; at most ``at_once`` tasks run at a time, and three times as many results wait for an earlier one at most.

    Another task begins as soon as one ends, so that squares are many at a time, however long single tasks take.
    """
    tasks = enumerate(tasks)
    running: dict[int, Squares] = {}
    results: dict[int, Any] = {}
    answers: dict[int, Any] = {}
    begun = given = 0
    while True:
        for k, task in islice(tasks, min(at_once - len(running), given + 4 * at_once - begun)):
            running[k], answers[k], begun = task, None, k + 1
        if not running:
            return
        asked = {}
        for k, answer in answers.items():
            try:
                asked[k] = running[k].send(answer)
            except StopIteration as stop:
                del running[k]
                results[k] = stop.value
        answers = dict(zip(asked, all_gapped(list(asked.values()), clump, scores), strict=True))
        while given in results:
            yield results.pop(given)
            given += 1


@dataclass
class Extension:
    """Aligned strings, in walking order; the bases they use of each walk."""

    coarse: str = ""
    org: str = ""
    coarse_used: int = 0
    org_used: int = 0


def extension(c: str, o: str, opts: CompressOptions) -> Squares:
    """Alternates comparison without gaps and small gapped squares until a window is bad or a walk ends."""
    history, out, parts = History(opts), Extension(), []
    columns = 0
    while columns < min(len(c), len(o)):
        rest_c, rest_o = c[out.coarse_used :], o[out.org_used :]
        n, bad = ungapped(rest_c, rest_o, history, opts)
        parts.append((rest_c[:n], rest_o[:n]))
        columns += n
        out.coarse_used += n
        out.org_used += n
        if bad:
            break
        found = yield rest_c[n : n + SQUARE], rest_o[n : n + SQUARE]
        if found is None or history.take(found[2]) < len(found[2]):
            break
        parts.append(found[:2])
        columns += len(found[0])
        out.coarse_used += len(found[0]) - found[0].count("-")
        out.org_used += len(found[1]) - found[1].count("-")
    out.coarse, out.org = "".join(p[0] for p in parts), "".join(p[1] for p in parts)
    return out


@dataclass
class Scored(Extension):
    score: int = 0


def dropping(c: str, o: str, scores: Scores, drop: int) -> Squares:
    """The best-scoring extension until the score falls ``drop`` below its best: comparison without gaps, and squares where that fails."""
    out, parts, score, columns, kept = Scored(), [], 0, 0, 0

    def take(a: str, b: str, gains: np.ndarray) -> None:
        nonlocal score, columns, kept
        reached = score + np.cumsum(gains)
        top = int(np.argmax(reached))
        if reached[top] > out.score:
            out.score, kept = int(reached[top]), columns + top + 1
        parts.append((a, b))
        score, columns = int(reached[-1]), columns + len(a)

    i = j = 0
    while i < len(c) and j < len(o):
        same = agreement(c[i : i + STEP], o[j : j + STEP])
        gains = np.where(same, scores.match, scores.mismatch)
        reached = np.cumsum(gains)
        # The highest place yet, the start among them, and where comparison has fallen too far below it.
        highest = np.maximum.accumulate(np.concatenate([[0], reached]))
        low = np.flatnonzero(reached <= highest[:-1] + MISMATCHES * scores.mismatch)
        n = len(same) if not len(low) else int(np.argmax(np.concatenate([[0], reached[: low[0]]])))
        if n:
            take(c[i : i + n], o[j : j + n], gains[:n])
            i, j = i + n, j + n
        if not len(low):
            continue
        found = yield c[i : i + SQUARE], o[j : j + SQUARE]
        if found is None:
            break
        a, b, ok = found
        take(a, b, np.array([scores.match if fits else scores.gap if "-" in pair else scores.mismatch for fits, *pair in zip(ok, a, b, strict=True)]))
        i, j = i + len(a) - a.count("-"), j + len(b) - b.count("-")
        if score < out.score - drop:
            break
    out.coarse, out.org = ("".join(p[k] for p in parts)[:kept] for k in (0, 1))
    out.coarse_used, out.org_used = len(out.coarse) - out.coarse.count("-"), len(out.org) - out.org.count("-")
    return out


def extend(c: str, o: str, opts: CompressOptions) -> Extension:
    return next(together([extension(c, o, opts)], opts.consec_match_clump_size))


@dataclass
class Match:
    """Inclusive ends on both sequences, strand, and the aligned strings in coarse orientation."""

    coarse_start: int
    coarse_end: int
    original_start: int
    original_end: int
    forward: bool
    coarse: str
    org: str


def match_at(coarse: str, at: int, org: str, pos: int, forward: bool, opts: CompressOptions, org_from: int = 0, org_to: int | None = None) -> Squares:
    """Gives the Match around the k-mer at coarse[at] and org[pos], or None if it is not long enough; org is used within [org_from, org_to)."""
    k = opts.map_seed_size
    org_to = len(org) if org_to is None else org_to
    section, pos = org[org_from:org_to], pos - org_from
    step = 1 if forward else -1
    # Towards higher coarse positions, and towards lower ones.
    up = walks(coarse, at + k - 1, 1, section, pos + k - 1 if forward else pos, step)
    down = walks(coarse, at, -1, section, pos if forward else pos + k - 1, -step)
    if cheap_extension(*up, opts) + cheap_extension(*down, opts) <= opts.min_progress:
        return None
    high = yield from extension(*up, opts)
    low = yield from extension(*down, opts)
    if high.org_used + low.org_used + k - 1 < opts.min_match_len:
        return None
    seed = coarse[at : at + k]
    before, after = (low, high) if forward else (high, low)
    start = org_from + pos - before.org_used
    return Match(at - low.coarse_used, at + k - 1 + high.coarse_used, start, org_from + pos + k - 1 + after.org_used, forward, low.coarse[::-1] + seed + high.coarse, low.org[::-1] + seed + high.org)
