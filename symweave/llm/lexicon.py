"""A minimal acyclic automaton over byte strings that numbers its words, kept in arrays for memory mapping."""

from __future__ import annotations

import numpy as np


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Compile distinct non-empty words into a minimal acyclic automaton whose suffixes are shared.

    The words are added in byte order; a state that no later word can change is replaced by an equal registered one.
    Every transition holds how many words come before those behind it, so a word's number is the sum along its path. Returns
    ``key`` (state * 256 + byte, sorted), ``to``, ``skip`` (of each transition) and ``final`` (of each state).
    """
    register: dict = {}
    states: list[tuple[dict, bool]] = []

    def freeze(node: list) -> int:
        same = (node[1], tuple(node[0].items()))
        if same not in register:
            register[same] = len(states)
            states.append((node[0], node[1]))
        return register[same]

    path: list[list] = [[{}, False]]
    before = b""
    for word in sorted(words):
        common = 0
        for a, b in zip(before, word):
            if a != b:
                break
            common += 1
        for depth in range(len(before), common, -1):
            path[depth - 1][0][before[depth - 1]] = freeze(path.pop())
        path += [[{}, False] for _ in range(len(word) - common)]
        path[-1][1] = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][0][before[depth - 1]] = freeze(path.pop())
    root = freeze(path[0])

    behind = np.zeros(len(states), np.int64)  # frozen after what they lead to, so one pass does
    key, to, skip = [], [], []
    for state, (moves, final) in enumerate(states):
        count = int(final)
        for byte in sorted(moves):
            key.append(state * 256 + byte)
            to.append(moves[byte])
            skip.append(count)
            count += int(behind[moves[byte]])
        behind[state] = count
    return {"key": np.array(key, np.int64), "to": np.array(to, np.int32), "skip": np.array(skip, np.int64), "final": np.array([f for _, f in states] or [False]), "root": np.array([root])}


def numbers(automaton: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in byte order of the lexicon, -1 for a word it lacks; all words step together."""
    out = np.full(len(words), -1, np.int64)
    key = automaton["key"]
    if not words or not len(key):
        return out
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    live = np.flatnonzero(length > 0)
    state = np.full(len(live), automaton["root"][0], np.int64)
    total = np.zeros(len(live), np.int64)
    step = 0
    while len(live):
        want = state * 256 + data[start[live] + step]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        live, at = live[hit], at[hit]
        total = total[hit] + automaton["skip"][at]
        state = automaton["to"][at].astype(np.int64)
        step += 1
        over = length[live] == step
        good = over & automaton["final"][state]
        out[live[good]] = total[good]
        live, state, total = live[~over], state[~over], total[~over]
    return out
