"""A fixed public vocabulary of word pieces as a flat trie, and dynamic programs over many words at once.

The programs walk the trie of the words themselves level by level: words are sorted, so that
words that begin alike are neighbours, and each distinct prefix is one row of the level's arrays.
Whatever a prefix determines - the states of the pieces that end here, the best or summed score
of its segmentations - is computed once for all words that share it.
"""

from __future__ import annotations

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words longer than this take the plain program for a single word.
LONG = 64
#: Cells of a block of words.
CELLS = 1 << 19
MARK = "▁"


def load_pieces(path: str = DEFAULT_MODEL) -> list[str]:
    """The ordinary pieces of a sentencepiece model in the order of their ids; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class PieceTrie:
    """Transitions (node, character) -> node in two sorted arrays; node 0 is the root, -1 none."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        step: dict[tuple[int, str], int] = {}
        self.piece_at = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                if (at, c) not in step:
                    step[at, c] = len(self.piece_at)
                    self.piece_at.append(-1)
                at = step[at, c]
            self.piece_at[at] = k
        self.piece_at = np.array(self.piece_at)
        keys = np.array([(node << 21) | ord(c) for node, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(step.values()), np.int64)[order]
        self.longest = max(map(len, pieces))
        self.number = {p: k for k, p in enumerate(pieces)}

    def next(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes reached; -1 where there is none."""
        out = np.full(nodes.shape, -1, np.int64)
        live = np.flatnonzero(nodes >= 0)
        keys = (nodes[live] << 21) | chars[live]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[live] = np.where(self.keys[at] == keys, self.to[at], -1)
        return out


def as_codes(words: list[str]) -> np.ndarray:
    """A row of code points for each word, filled with 0."""
    width = max(map(len, words))
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)


def blocks(words: list[str], longest: int) -> list[list[str]]:
    """Words up to LONG in sorted blocks of similar length whose arrays stay small."""
    sizes: dict[int, list[str]] = {}
    for w in sorted(words):
        sizes.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(w)
    out = []
    for width, some in sizes.items():
        each = max(64, CELLS // (longest + width))
        out += [some[k : k + each] for k in range(0, len(some), each)]
    return out


def prefix_levels(codes: np.ndarray):
    """For each level: the rows' node, the nodes' parents, and the nodes' characters (0: the word is over)."""
    n = len(codes)
    fresh = np.zeros(n, bool)
    fresh[0] = True
    above = np.zeros(n, np.int64)
    for d in range(codes.shape[1]):
        c = codes[:, d]
        fresh = fresh.copy()
        fresh[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(fresh)
        row_node = np.cumsum(fresh) - 1
        yield row_node, above[first], c[first]
        above = row_node


def forward(words: list[str], trie: PieceTrie, weights: np.ndarray, unknown: np.ndarray, boost: float = 20.0) -> np.ndarray:
    """Log of the sum over all segmentations of the product of the pieces' weights, [words, columns].

    weights: [pieces, columns]. A character that no piece of one character covers has the weight
    `unknown`. Up to LONG characters `boost` per character keeps the products within floats.
    """
    columns = weights.shape[1]
    out = np.empty((len(words), columns))
    place = {w: k for k, w in enumerate(words)}
    at_node = np.zeros((len(trie.piece_at), columns))
    ends = trie.piece_at >= 0
    at_node[ends] = weights[trie.piece_at[ends]]
    for some in blocks([w for w in words if 0 < len(w) <= LONG], trie.longest * columns):
        codes = as_codes(some)
        lengths = np.array([len(w) for w in some])
        rows = np.array([place[w] for w in some])
        states = np.full((1, trie.longest), -1, np.int64)  # [:, l]: of the last l characters; 0: none yet
        states[0, 0] = 0
        sums = np.zeros((1, trie.longest, columns))  # [:, l]: of the prefix without the last l characters
        sums[0, 0] = 1.0
        for d, (row_node, parent, c) in enumerate(prefix_levels(codes), 1):
            before_states, before = states[parent], sums[parent]
            new = np.full_like(before_states, -1)
            here = np.zeros((len(c), columns))
            for k in range(min(d, trie.longest)):
                reached = trie.next(before_states[:, k], c)
                ok = np.flatnonzero(reached >= 0)
                here[ok] += before[ok, k] * at_node[reached[ok]] * boost ** (k + 1)
                if k == 0:
                    lone = (reached < 0) | ~ends[np.maximum(reached, 0)]
                    here[lone] += before[lone, 0] * unknown * boost
                if k + 1 < trie.longest:
                    new[:, k + 1] = reached
            new[:, 0] = 0
            states = new
            sums = np.empty_like(before)
            sums[:, 1:], sums[:, 0] = before[:, :-1], here
            done = lengths == d
            if done.any():
                out[rows[done]] = np.log(here[row_node[done]]) - d * np.log(boost)
    for w in words:
        if len(w) > LONG:
            out[place[w]] = forward_one(w, trie, weights, unknown)
        elif not w:
            out[place[w]] = 0.0
    return out


def forward_one(word: str, trie: PieceTrie, weights: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """The same for one word of any length, position by position, rescaled as it goes."""
    width = trie.longest
    ring = [np.ones(weights.shape[1])]  # sums of the last prefixes, all divided by exp(scale)
    scale = np.zeros(weights.shape[1])
    for end in range(1, len(word) + 1):
        total = np.zeros(weights.shape[1])
        for k in range(1, min(end, width) + 1):
            piece = trie.number.get(word[end - k : end])
            if piece is not None:
                total = total + ring[-k] * weights[piece]
            elif k == 1:
                total = total + ring[-1] * unknown
        ring = [*ring[-width + 1 :], total]
        top = np.maximum(total, 1e-300)
        ring = [r / top for r in ring]
        scale += np.log(top)
    return np.log(np.maximum(ring[-1], 1e-300)) + scale


def best_counts(words: list[str], trie: PieceTrie, scores: np.ndarray, byte_score: float) -> np.ndarray:
    """Number of pieces in each word's segmentation of the highest score; of equal ones the fewest.

    A character without a piece of its own falls back to its UTF-8 bytes, each a token.
    """
    out = np.zeros(len(words), np.int64)
    place = {w: k for k, w in enumerate(words)}
    ends = trie.piece_at >= 0
    at_node = np.full(len(ends), -np.inf)
    at_node[ends] = scores[trie.piece_at[ends]]
    for some in blocks([w for w in words if 0 < len(w) <= LONG], trie.longest):
        codes = as_codes(some)
        lengths = np.array([len(w) for w in some])
        rows = np.array([place[w] for w in some])
        states = np.full((1, trie.longest), -1, np.int64)
        states[0, 0] = 0
        best = np.full((1, trie.longest), -np.inf)
        best[0, 0] = 0.0
        counts = np.zeros((1, trie.longest), np.int64)
        for d, (row_node, parent, c) in enumerate(prefix_levels(codes), 1):
            before_states, before, before_counts = states[parent], best[parent], counts[parent]
            new = np.full_like(before_states, -1)
            here, count = np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
            for k in range(min(d, trie.longest)):
                reached = trie.next(before_states[:, k], c)
                offer = before[:, k] + np.where(reached >= 0, at_node[np.maximum(reached, 0)], -np.inf)
                pieces = before_counts[:, k] + 1
                if k == 0:
                    lone = (reached < 0) | ~ends[np.maximum(reached, 0)]
                    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                    offer = np.where(lone, before[:, 0] + size * byte_score, offer)
                    pieces = np.where(lone, before_counts[:, 0] + size, pieces)
                better = (offer > here) | ((offer == here) & (pieces < count))
                here, count = np.where(better, offer, here), np.where(better, pieces, count)
                if k + 1 < trie.longest:
                    new[:, k + 1] = reached
            new[:, 0] = 0
            states = new
            best, counts = np.empty_like(before), np.empty_like(before_counts)
            best[:, 1:], best[:, 0] = before[:, :-1], here
            counts[:, 1:], counts[:, 0] = before_counts[:, :-1], count
            done = lengths == d
            if done.any():
                out[rows[done]] = count[row_node[done]]
    for w in words:
        if len(w) > LONG:
            out[place[w]] = best_count_one(w, trie, scores, byte_score)
    return out


def best_count_one(word: str, trie: PieceTrie, scores: np.ndarray, byte_score: float) -> int:
    """The same for one word of any length."""
    best, counts = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, least = -np.inf, 0
        for k in range(1, min(end, trie.longest) + 1):
            piece = trie.number.get(word[end - k : end])
            if piece is None and k > 1:
                continue
            size = 1 if piece is not None else len(word[end - 1].encode("utf-8", "surrogatepass"))
            offer = best[end - k] + (float(scores[piece]) if piece is not None else size * byte_score)
            pieces = counts[end - k] + size
            if offer > top or (offer == top and pieces < least):
                top, least = offer, pieces
        best.append(top)
        counts.append(least)
    return counts[-1]
