"""A minimal acyclic transducer: words in, a number each out, as flat arrays that are mapped from one file."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np

#: Longer words than this aren't put in; bytes.
LONGEST = 32


def automaton(words: Sequence[bytes], outputs: Sequence[Sequence[int]]) -> bytes:
    """The file of distinct words and each one's output, a list of ids.

    States are shared between all words with equal sets of endings, as words come in order: a state that no later word
    can change is looked up among those kept. An arc's number is how many words the state before it accepts by way of
    its earlier arcs (and of its own end), so the numbers along a word's path add up to its place in the order: the
    sum picks the word's ids.
    """
    if any(len(w) > LONGEST or not w for w in words):
        raise ValueError(f"words have 1 to {LONGEST} bytes")
    order = sorted(range(len(words)), key=words.__getitem__)
    kept: dict[tuple, int] = {}
    final, arcs, below = [], [], []

    def keep(node: list) -> int:
        sign = (node[0], tuple(node[1]))
        if (at := kept.get(sign)) is None:
            kept[sign] = at = len(final)
            final.append(node[0])
            arcs.append(node[1])
            below.append(node[0] + sum(below[to] for _, to in node[1]))
        return at

    # The path of the last word: nodes as [is an end, arcs that are kept]; its own arcs wait for their targets.
    path_nodes, last = [[0, []]], b""

    def close(down_to: int) -> None:
        while len(path_nodes) - 1 > down_to:
            at = keep(path_nodes.pop())
            path_nodes[-1][1].append((last[len(path_nodes) - 1], at))

    for k in order:
        w = words[k]
        same = next((i for i, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))  # noqa: B905
        close(same)
        path_nodes += [[0, []] for _ in w[same:]]
        path_nodes[-1][0] = 1
        last = w
    close(0)
    root = keep(path_nodes[0])

    keys, to, skip = [], [], []
    for state, out in enumerate(arcs):
        before = final[state]
        for label, target in out:
            keys.append(state << 8 | label)
            to.append(target)
            skip.append(before)
            before += below[target]
    ids = [outputs[k] for k in order]
    parts = {
        "keys": np.array(keys, np.int64), "to": np.array(to, np.int32), "skip": np.array(skip, np.int32), "final": np.array(final, np.int32),
        "starts": np.cumsum([0, *map(len, ids)], dtype=np.int32), "ids": np.array([i for x in ids for i in x], np.uint32),
    }
    head = json.dumps({"root": root, "parts": [[k, str(v.dtype), len(v)] for k, v in parts.items()]}).encode()
    out = len(head).to_bytes(8, "little") + head
    for v in parts.values():
        out += b"\0" * (-len(out) % 8) + v.tobytes()
    return out


def compile_lexicon(words: Sequence[bytes], outputs: Sequence[Sequence[int]], path: str | Path) -> None:
    Path(path).write_bytes(automaton(words, outputs))


class Lexicon:
    """The automaton, mapped from its file: workers of one machine share its pages."""

    def __init__(self, path: str | Path):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        at = 8 + n
        self.root = head["root"]
        for name, kind, count in head["parts"]:
            at += -at % 8
            size = count * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words take a step down the automaton at once."""
        out = np.full(len(words), -1, np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.keys):
            return out
        at = np.flatnonzero((lens <= LONGEST) & (lens > 0))
        if len(at) < len(words):
            words, lens = [words[i] for i in at], lens[at]
        text = np.frombuffer(b"".join(w.ljust(LONGEST, b"\0") for w in words), np.uint8).reshape(len(words), LONGEST)
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for k in range(LONGEST):
            done = live[lens[live] == k]
            ends = done[self.final[state[done]] == 1]
            out[at[ends]] = number[ends]
            live = live[lens[live] > k]
            if not len(live):
                break
            key = state[live] << 8 | text[live, k]
            arc = np.searchsorted(self.keys, key).clip(0, len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.to[arc]
            number[live] += self.skip[arc]
        done = live[lens[live] == LONGEST]
        ends = done[self.final[state[done]] == 1]
        out[at[ends]] = number[ends]
        return out

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]
