"""Suffix automata of byte strings."""

from __future__ import annotations

from array import array


class SuffixAutomaton:
    """All substrings of a set of byte strings; each whole string ends in a state of its own."""

    def __init__(self, strings: list[bytes]) -> None:
        self.length, self.link, self.next = array("i", [0]), array("i", [-1]), {}
        edges: list[list[int]] = [[]]  # bytes on which a state goes on, for copies
        nxt, length, link = self.next, self.length, self.link

        def copy_of(p: int, c: int, q: int) -> int:
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            edges.append(edges[q][:])
            for e in edges[q]:
                nxt[twin << 8 | e] = nxt[q << 8 | e]
            link[q] = twin
            while p >= 0 and nxt.get(p << 8 | c) == q:
                nxt[p << 8 | c] = twin
                p = link[p]
            return twin

        self.ends = []
        for s in strings:
            last = 0
            for c in s:
                q = nxt.get(last << 8 | c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else copy_of(last, c, q)
                    continue
                cur, p = len(length), last
                length.append(length[last] + 1)
                link.append(0)
                edges.append([])
                while p >= 0 and p << 8 | c not in nxt:
                    nxt[p << 8 | c] = cur
                    edges[p].append(c)
                    p = link[p]
                if p >= 0:
                    q = nxt[p << 8 | c]
                    link[cur] = q if length[q] == length[p] + 1 else copy_of(p, c, q)
                last = cur
            self.ends.append(last)
