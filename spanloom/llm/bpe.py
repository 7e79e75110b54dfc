"""Byte-pair encoding and decoding with a public word-end vocabulary: speculate, verify, and merge only what fails.

A text is cut at the literal special tokens, brought to NFC, its white space made single spaces, lower-cased letter by
letter, and cut into words. For each new word, greedy longest matches propose tokens. A proposal is the true encoding
exactly if no neighbouring two tokens would have been merged across their border before their own last merges; that
check runs on arrays of all neighbouring pairs of a batch's new words. Words with a failing pair are merged exactly.

Null text is empty and has no ids; very long texts and words are encoded whole; equal texts have equal ids; every row is
encoded alone, so ties, repeated rows and order play no part. An empty table gives an empty result. Other columns are
kept, but n_tokens, ids and decoded are ours.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, arrow_map

VOCABULARY = "word_bpe_49k.json"
#: Words that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
_END = "</w>"
#: The vocabulary's own pattern for words. A fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Letters and numbers that the tokenizer's Unicode tables don't hold yet, but the pattern library's do. Fixed values.
_NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals that the tokenizer lower-cases, but this Python does not. Fixed values.
_NEWER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class Encoder:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        size = max(*self.ids.values(), *self.special.values()) + 1
        self.tokens = [""] * size
        for token, i in (*self.ids.items(), *self.special.items()):
            self.tokens[i] = token
        # rank[i]: which merge makes token i (letters: none, below all); halves of i; and pairs -> rank, as sorted keys.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.by_pair: dict[tuple[int, int], int] = {}
        pairs = np.empty((len(merges), 2), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            pairs[r] = x, y
            self.by_pair.setdefault((x, y), r)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        self.made = [self.ids[a + b] for a, b in merges]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        # Tokens that exact merging does not give back for their own letters can't be proposed.
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(_END)}
        self.final = {t.removesuffix(_END): i for t, i in self.ids.items() if t.endswith(_END)}
        for t, d, last in [*((t, self.inner, False) for t in [*self.inner]), *((t, self.final, True) for t in [*self.final])]:
            if len(t) > 1 and self.merge(t, last) != [d[t]]:
                del d[t]
        # The longest token that begins with each two letters.
        self.reach: dict[str, int] = {}
        for t in (*self.inner, *self.final):
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.cut = regex.compile(_WORDS)
        self.ascii_cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\v\fa-z0-9]+")
        self.rare = regex.compile(f"[{_NEWER}{''.join(map(chr, _NEWER_CAPITALS))}]")
        newer = _WORDS.replace(r"[\p{L}]", rf"[\p{{L}}--[{_NEWER}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{_NEWER}]]")
        newer = newer.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_NEWER}]]")
        self.rare_cut = regex.compile(newer, regex.V1)
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str | int, tuple[int, ...]] = self.fresh()
        self.failed = self.seen = 0

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b; a number above all ranks where there is no such merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys) + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each a[i], b[i] stay two tokens when their letters are merged together.

        Goes back in time from the finished tokens: the later made of the two is split to its half at the border. While
        two parts stand at the border, they are merged if that ranks before the merge that uses one of them up
        (in a tie, the place further left goes first: the border against a right part, the part on the left itself).
        """
        out = np.ones(len(a), bool)
        open_, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), len(self.keys) + 1)
        while len(open_):
            clash = self.pair_rank(x, y) < limit
            out[open_[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & (np.maximum(rx, ry) >= 0)
            open_, x, y, rx, ry = open_[go], x[go], y[go], rx[go], ry[go]
            later_left = rx > ry
            limit = np.where(later_left, rx, ry + 1)
            x, y = np.where(later_left, self.right[x], x), np.where(later_left, y, self.left[y])
        return out

    def propose(self, word: str) -> list[int] | None:
        out, i, n = [], 0, len(word)
        inner, final, reach = self.inner.get, self.final.get, self.reach.get
        while i < n:
            longest = i + reach(word[i : i + 2], 1)
            if n <= longest and (t := final(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, longest), i, -1):
                if (t := inner(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def merge(self, word: str, last: bool = True) -> list[int]:
        """Exact merging: again and again the pair of lowest rank, the leftmost of equals. Heap and links, so long words do too."""
        import heapq

        if len(word) <= 24:
            return self._merge_short(word, last)
        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + _END * last]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.by_pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (q := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, word: str, last: bool) -> list[int]:
        ids, get, never = [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + _END * last]], self.by_pair.get, len(self.made)
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            ids[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def learn(self, words: list[str]) -> None:
        """Encodes new words: proposals, one check of all their neighbouring pairs, exact merging of what fails."""
        shown = ["".join(map(self.letters.__getitem__, w.encode())) if not w.isascii() or not w.isprintable() else w for w in words]
        proposals = [self.propose(s) for s in shown]
        sizes = np.array([len(p) if p else 0 for p in proposals])
        flat = np.array([t for p in proposals if p for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        bad = np.zeros(len(words), bool)
        bad[owner[inside[~fine]]] = True
        self.seen, self.failed = self.seen + len(words), self.failed + int(bad.sum())
        for word, s, p, b in zip(words, shown, proposals, bad.tolist(), strict=True):
            self.known[word] = tuple(self.merge(s) if b or p is None else p)

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of special tokens that it spells out."""
        if text.isascii() and "<|" not in text:
            return self.ascii_cut.findall(text.lower())
        out: list[str | int] = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                # Letter by letter: str.lower() would treat a final sigma by its place.
                clean = self.spaces.sub(" ", unicodedata.normalize("NFC", part))
                lower = clean.lower() if "Σ" not in clean else "".join(c.lower() for c in clean)
                if not _latin(lower) and self.rare.search(lower):
                    out.extend(self.rare_cut.findall(lower.translate(_NEWER_CAPITALS)))
                else:
                    out.extend(self.cut.findall(lower))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = self.fresh()
        if new := list(set(chain.from_iterable(cut)).difference(self.known)):
            self.learn(new)
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, ws))) for ws in cut]

    def fresh(self) -> dict:
        """What is known from the start: a special token is itself."""
        return {i: (i,) for i in self.special.values()}

    def decode(self, ids: list[int]) -> str:
        """The tokens as they are spelled, joined by spaces; ids outside the vocabulary spell nothing."""
        return " ".join([self.tokens[i] for i in ids if 0 <= i < len(self.tokens)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded. ``path``: the vocabulary on every worker; default: the installed public one."""
    made = ("n_tokens", "ids", "decoded")
    own = [c for c in docs.columns if c not in made]
    df = docs.select(*[f"`{c}`" for c in own])

    def kernel(t: pa.Table):
        e = encoder(path or vocabulary_path())
        ids = e.encode(t.column("text").to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
        text = pa.array([e.decode(x) for x in ids], pa.string())
        yield t.append_column("n_tokens", pa.array(sizes)).append_column("ids", lists).append_column("decoded", text)

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "n_tokens bigint, ids array<int>, decoded string"])
    # The vocabulary and what was learnt go with the task: the next one, perhaps of another stage, has the worker's memory.
    return arrow_map(df, kernel, schema, chunk=CHUNK_BYTES << 2, after=lambda: encoder.cache_clear())
