"""Subword lattices: forward and backward recursion in log space, for single words and for many words of one length at once."""

from __future__ import annotations

import math

import numpy as np

_MARK = "▁"


class Lattice:
    """Pieces with natural log weights; ``bytes`` are the log weights of the 256 byte pieces."""

    def __init__(self, weights: dict[str, float], octets: list[float], end: float) -> None:
        self.weights, self.bytes, self.end = weights, octets, end
        self.longest = max(map(len, weights), default=1)

    def spelled(self, char: str) -> float:
        return sum(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def edges(self, text: str) -> list[list[tuple[int, float, str | None]]]:
        """For each end position: (start, log weight, piece, None for spelled characters)."""
        n, get, into = len(text), self.weights.get, [[] for _ in range(len(text) + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = get(text[i:j])
                if w is not None:
                    into[j].append((i, w, text[i:j]))
                elif j == i + 1:
                    into[j].append((i, self.spelled(text[i]), None))
        return into

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of a word (forward recursion)."""
        return self._forward(self.edges(_MARK + word))[-1]

    @staticmethod
    def _forward(into: list) -> list[float]:
        alpha, exp, log = [0.0], math.exp, math.log
        for own in into[1:]:
            if len(own) == 1:
                alpha.append(alpha[own[0][0]] + own[0][1])
            else:
                terms = [alpha[i] + w for i, w, _ in own]
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        return alpha

    def expected(self, word: str, count: float, into_counts: dict[str, float], octets: np.ndarray) -> None:
        """Adds the word's expected numbers of pieces (forward-backward), times its count."""
        text = _MARK + word
        into = self.edges(text)
        alpha = self._forward(into)
        beta = [-math.inf] * len(into)
        beta[-1] = 0.0
        for j in range(len(into) - 1, 0, -1):
            right = beta[j]
            for i, w, piece in into[j]:
                path = w + right
                share = count * math.exp(alpha[i] + path - alpha[-1])
                if piece is None:
                    for b in text[i].encode("utf-8", "surrogatepass"):
                        octets[b] += share
                else:
                    into_counts[piece] = into_counts.get(piece, 0.0) + share
                old = beta[i]
                beta[i] = path if old == -math.inf else max(old, path) + math.log1p(math.exp(-abs(old - path)))


class Trie:
    """The pieces' prefixes as numbered nodes; a step from a node along a character is a lookup in a hash table of exact keys."""

    SLOTS, FACTOR, NONE = 20, np.uint64(0x9E3779B97F4A7C15), -1

    def __init__(self, pieces: list[str]) -> None:
        children: dict[int, int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = children.setdefault(node << 21 | ord(c), len(children) + 1)
            ends[node] = number
        self.bits = max(self.SLOTS, (4 * len(children)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, self.NONE, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.fromiter(children, np.int64, len(children))
        for key, slot, node in zip(children, self._slot(keys).tolist(), children.values(), strict=True):
            while self.keys[slot] != self.NONE:
                slot = slot + 1 & len(self.keys) - 1
            self.keys[slot], self.to[slot] = key, node
        self.piece = np.full(len(children) + 1, self.NONE, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node along its character, or NONE."""
        keys = nodes << 21 | chars
        slots = self._slot(keys)
        found = self.keys[slots]
        asked = np.flatnonzero((found != keys) & (found != self.NONE))
        while len(asked):  # the slot holds another key: on to the next
            slots[asked] = slots[asked] + 1 & len(self.keys) - 1
            found[asked] = self.keys[slots[asked]]
            asked = asked[(found[asked] != keys[asked]) & (found[asked] != self.NONE)]
        return np.where(found == keys, self.to[slots], self.NONE)


SPAN_CHARS, BATCH_CELLS = 48, 1 << 15


class Batch:
    """The recursions over many words of one length at once, words along the last axis; words longer than SPAN_CHARS go one by one."""

    def __init__(self, model: Lattice) -> None:
        self.model, self.names = model, list(model.weights)
        self.number = {p: k for k, p in enumerate(self.names)}
        self.logs, self.trie = np.array(list(model.weights.values())), Trie(self.names)

    def _spans(self, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, list[str]]]:
        """Log weights of the pieces at (start, length - 1, word), the flat positions and numbers of pieces there, and of the characters
        that are spelled the flat positions, numbers, and what the numbers stand for."""
        width = len(texts)
        chars = np.ascontiguousarray(np.array(texts, f"U{n}").view(np.uint32).reshape(width, n).T).astype(np.int64).ravel()
        live, nodes, where, number = np.arange(n * width), np.zeros(n * width, np.int64), [], []
        for k in range(n):
            nodes = self.trie.step(nodes, chars[live + k * width])
            on = np.flatnonzero(nodes != Trie.NONE)
            live, nodes = live[on], nodes[on].astype(np.int64)
            pieces = self.trie.piece[nodes]
            hit = np.flatnonzero(pieces != Trie.NONE)
            where.append(live[hit])
            number.append(pieces[hit])
            on = np.flatnonzero(live < (n - k - 1) * width)  # one more character follows
            live, nodes = live[on], nodes[on]
            if not len(live):
                break
        wide = max((k + 1 for k, w in enumerate(where) if len(w)), default=1)
        flat = np.concatenate([(w // width * wide + k) * width + w % width for k, w in enumerate(where[:wide])])
        ids, logs = np.concatenate(number[:wide]), np.full((n, wide, width), -np.inf)
        logs.ravel()[flat] = self.logs[ids]
        at = np.flatnonzero(logs[:, 0] == -np.inf)
        codes, kind = np.unique(chars[at], return_inverse=True)
        spelled, at = [chr(c) for c in codes.tolist()], at // width * wide * width + at % width
        logs.ravel()[at] = np.array([self.model.spelled(c) for c in spelled])[kind] if spelled else 0.0
        return logs, flat, ids, (at, kind, spelled)

    @staticmethod
    def _sum(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest terms, the terms' ratios to them, and log sums; each column has a finite term, as every character is a step."""
        top = terms.max(axis=0)
        terms -= top
        np.exp(terms, out=terms)
        return top, terms, top + np.log(terms.sum(axis=0))

    def _forward(self, logs: np.ndarray) -> np.ndarray:
        n, wide, width = logs.shape
        alpha, (by_start, by_length, by_word) = np.zeros((n + 1, width)), logs.strides
        for j in range(1, n + 1):
            k = min(j, wide)  # pieces that end at j: start j - 1 - k, length - 1 = k
            ending = np.lib.stride_tricks.as_strided(logs[j - 1 :], (k, width), (by_length - by_start, by_word))
            alpha[j] = self._sum(ending + alpha[j - k : j][::-1])[2]
        return alpha

    def _groups(self, words: list[str]):  # noqa: ANN202
        """(length, numbers of words) of manageable size; length 0 for those that are too long."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1 if len(w) < SPAN_CHARS else 0, []).append(k)
        for n, at in by.items():
            step = max(1, BATCH_CELLS // max(1, n))
            for lo in range(0, len(at), step):
                yield n, at[lo : lo + step]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for n, at in self._groups(words):
            if n:
                out[at] = self._forward(self._spans([_MARK + words[k] for k in at], n)[0])[-1]
            else:
                out[at] = [self.model.log_probability(words[k]) for k in at]
        return out

    def expected(self, words: list[str], counts: list[int], pieces: np.ndarray, octets: np.ndarray) -> None:
        """Adds expected numbers of pieces, by piece number, and of bytes."""
        for n, at in self._groups(words):
            if not n:
                found: dict[str, float] = {}
                for k in at:
                    self.model.expected(words[k], counts[k], found, octets)
                for p, x in found.items():
                    pieces[self.number[p]] += x
                continue
            logs, flat, ids, (bare, kind, spelled) = self._spans([_MARK + words[k] for k in at], n)
            alpha, wide = self._forward(logs), logs.shape[1]
            beta, share, times = np.zeros(alpha.shape), np.zeros(logs.shape), np.array([counts[k] for k in at], float)
            for i in range(n - 1, -1, -1):
                k = min(n - i, wide)
                top, ratio, beta[i] = self._sum(logs[i, :k] + beta[i + 1 : i + 1 + k])
                share[i, :k] = ratio * (np.exp(alpha[i] + top - alpha[-1]) * times)
            for c, x in zip(spelled, np.bincount(kind, share.ravel()[bare], len(spelled)).tolist(), strict=True):
                for b in c.encode("utf-8", "surrogatepass"):
                    octets[b] += x
            pieces += np.bincount(ids, share.ravel()[flat], len(self.names))


def vocabulary(path: str) -> Lattice:
    """The pieces of a SentencePiece model. Scores that are log-probabilities become weights as they are; scores of merges are ranks
    (0, -1, -2, ...) and become weights by Zipf's law. Byte pieces share a hundredth of all weight, the end a thousandth."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8}
    ranks = all(s == int(s) for s in scores.values())
    raw = {p: 1.0 / (2.7 - s) if ranks else math.exp(s) for p, s in scores.items()}
    whole = sum(raw.values())
    return Lattice({p: math.log(0.989 * w / whole) for p, w in raw.items()}, [math.log(0.01 / 256)] * 256, math.log(0.001))
