"""Word-level BPE with an end-of-word suffix: pre-tokenising, and bulk encoding by speculate-and-verify.

A word is a string of symbols: its UTF-8 bytes as characters 0-255, the last one raised by 256
(the end-of-word form). A greedy longest-match pass proposes tokens for many words at once; a
vectorised test then asks for every adjacent token pair whether BPE, run over both, would ever
have merged across their border. A word all of whose pairs pass *is* its BPE encoding; the
others are merged exactly, step by step.
"""

from __future__ import annotations

import json
import re
import unicodedata

import ahocorasick
import numpy as np

SUFFIX = "</w>"


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies (printable bytes stand for themselves)."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _char_class(test) -> str:
    """A regular-expression class of the characters of the quick range that pass ``test``."""
    out = []
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]):
        if test(c):
            out.append(re.escape(c))
    return "".join(out)


#: Texts of these characters only are normalised and split here; NFC leaves them alone and their
#: lower case is one character. Any other text goes through the library's normaliser and splitter.
_ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞€]")
_L = _char_class(lambda c: unicodedata.category(c)[0] == "L")
_N = _char_class(lambda c: unicodedata.category(c)[0] == "N")
_PIECE = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\s{_L}{_N}]+")


class WordBpe:
    """Vocabulary, merge tree and pre-tokeniser of a BPE file with end-of-word suffix."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != SUFFIX or spec.get("decoder"):
            raise ValueError("a BPE file with end-of-word suffix and no decoder is needed")
        self.file = file
        vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.strings = dict(zip(vocab.values(), vocab, strict=True)) | {i: s for s, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        back = {c: chr(b) for b, c in enumerate(_byte_chars())}

        def symbols(token: str) -> str:
            if token.endswith(SUFFIX):
                body = "".join(back[c] for c in token[: -len(SUFFIX)])
                return body[:-1] + chr(ord(body[-1]) + 256)
            return "".join(back[c] for c in token)

        n = max(vocab.values()) + 1
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.size = np.zeros(n, np.int64)
        self.base = {}
        text = {}
        for token, i in vocab.items():
            text[i] = s = symbols(token)
            self.size[i] = len(s)
            if len(s) == 1:
                self.base[s] = i
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        for r, (a, b, ab) in enumerate(pairs):
            self.left[ab], self.right[ab], self.rank[ab] = a, b, r
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.key_token = np.array([ab for _, _, ab in pairs], np.int64)[order]
        self.base_ids = np.full(512, -1, np.int64)
        for s, i in self.base.items():
            self.base_ids[ord(s)] = i
        self.ends = np.zeros(n, bool)
        for i, s in text.items():
            self.ends[i] = ord(s[-1]) >= 256
        # a merged token is usable if no merge crosses its parts earlier, and both parts are usable
        usable = np.ones(n, bool)
        made = np.array([ab for _, _, ab in pairs], np.int64)
        usable[made] = self.apart(self.left[made], self.right[made], own=True)
        for _, (a, b, ab) in enumerate(pairs):
            usable[ab] &= usable[a] and usable[b]
        self.automaton = ahocorasick.Automaton()
        for i, s in text.items():
            if usable[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._library = None

    # -- text to words ---------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The normalised pre-tokens of ``text``; a special token stands as its own string preceded by a space."""
        if self.special_split is not None and "<|" in text and self.special_split.search(text):
            out: list[str] = []
            for part in self.special_split.split(text):
                out += [" " + part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return self._odd(text) if _ODD.search(text) else _PIECE.findall(text.lower())

    def _odd(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.file)
            self._back = {c: b for b, c in enumerate(_byte_chars())}
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._back[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    @property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, token) of every pair; built when a long word first needs it."""
        if not self._merge:
            for k, r, ab in zip(self.keys.tolist(), self.key_rank.tolist(), self.key_token.tolist(), strict=True):
                self._merge[k >> 32, k & 0xFFFFFFFF] = (r, ab)
        return self._merge

    # -- words to tokens -------------------------------------------------------------------------

    def apart(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """For token pairs: whether BPE never merges across the border.

        Walks back in time from the finished tokens: of the piece left of the border and the piece
        right of it, the one formed last is undone. At each moment both exist, a merge of the two
        would have won if its rank comes before the merge that consumed either (on a tie the
        leftmost place wins, so the left neighbour's merge is first and the right one's is not).
        ``own``: the pair's own merge, as tokens, is allowed.
        """
        n = len(a)
        ok = np.ones(n, bool)
        at = np.arange(n)
        x, y = a.astype(np.int64), b.astype(np.int64)
        far = np.int64(1) << 40
        end_x, end_y = np.full(n, far), np.full(n, far)
        first = True
        while len(at):
            key = x << 32 | y
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            r = np.where(self.keys[i] == key, self.key_rank[i], far)
            crossed = (r < end_x) & (r <= end_y) & (r < far)
            if first and own:
                crossed[:] = False
            first = False
            ok[at[crossed]] = False
            fx, fy = self.rank[x], self.rank[y]
            on = ~crossed & ((fx >= 0) | (fy >= 0))
            at, x, y, end_x, end_y, fx, fy = at[on], x[on], y[on], end_x[on], end_y[on], fx[on], fy[on]
            undo_x = fx > fy
            end_x, end_y = np.where(undo_x, fx, end_x), np.where(undo_x, end_y, fy)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def exact(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain BPE of many words side by side; ids in order, and the count of ids of each word.

        Each round merges, in every unfinished word, its lowest-ranked adjacent pair (the leftmost
        on a tie) and looks up the ranks of the two new pairs only.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.base_ids[np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)]
        word = np.repeat(np.arange(len(words)), sizes)
        far = np.int64(1) << 30

        def rank_of(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and token of the pairs that begin at places i; far where there is none."""
            j = np.minimum(i + 1, len(ids) - 1)
            key = ids[i] << 32 | ids[j]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[k] == key) & (i + 1 < len(ids)) & (word[i] == word[j])
            return np.where(hit, self.key_rank[k], far), self.key_token[k]

        rank, token = rank_of(np.arange(len(ids)))
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            live = best >> 32 < far
            if not live.all():
                over = np.repeat(~live, np.diff(np.r_[starts, len(ids)]))
                done_ids.append(ids[over])
                done_word.append(word[over])
                at = np.cumsum(~over) - 1
                ids, word, rank, token = ids[~over], word[~over], rank[~over], token[~over]
                place = at[best[live] & 0xFFFFFFFF]
            else:
                place = best & 0xFFFFFFFF
            if not len(ids):
                break
            ids[place] = token[place]
            gone = np.zeros(len(ids), bool)
            gone[place + 1] = True
            place = place - (np.cumsum(gone) - gone)[place]
            ids, word, rank, token = ids[~gone], word[~gone], rank[~gone], token[~gone]
            near = np.r_[place, place[place > 0] - 1]
            rank[near], token[near] = rank_of(near)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def exact_long(self, symbols: str) -> list[int]:
        """The same by a heap, for words of great length."""
        import heapq

        ids = [self.base[c] for c in symbols]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = ab, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct words in bulk: all ids in order, and the count of ids of each word."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        forms = []
        for w in words:
            s = w.encode("utf-8").decode("latin-1")
            forms.append(s[:-1] + chr(ord(s[-1]) + 256))
        joined = "".join(forms)
        sizes = np.fromiter(map(len, forms), np.int64, len(forms))
        stops = np.cumsum(sizes)
        # speculate: greedy longest match over all words at once; a token never spans two words,
        # since only the last symbol of a word has the end-of-word form
        found = np.array(list(self.automaton.iter_long(joined)), np.int64).reshape(-1, 2)
        end, ids = found[:, 0] + 1, found[:, 1]
        begin = end - self.size[ids]
        word = np.searchsorted(stops, begin, side="right")
        failing = np.zeros(len(words), bool)
        # verify: the tokens tile each word, and no adjacent pair inside a word would have merged
        covered = np.bincount(word, weights=self.size[ids], minlength=len(words)).astype(np.int64)
        failing |= covered != sizes
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            pairs, where = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
            ok = self.apart(pairs >> 32, pairs & 0xFFFFFFFF)
            failing[word[inner[~ok[where]]]] = True
        counts = np.bincount(word, minlength=len(words))
        if failing.any():
            # only failing words: exact merging
            kept = ~failing[word]
            ids, word = ids[kept], word[kept]
            redo = np.flatnonzero(failing)
            short = redo[sizes[redo] <= 64]
            again, more = self.exact([forms[k] for k in short]) if len(short) else (ids[:0], sizes[:0])
            counts[short] = more
            long = redo[sizes[redo] > 64]
            heaped = [self.exact_long(forms[k]) for k in long]
            counts[long] = [len(x) for x in heaped]
            redo, more = np.r_[short, long], np.r_[more, counts[long]]
            again = np.r_[again, np.array([i for x in heaped for i in x], np.int64)]
            word = np.concatenate([word, np.repeat(redo, more)])
            ids = np.concatenate([ids, again])
            ids = ids[np.argsort(word, kind="stable")]
        return ids.astype(np.uint32), counts.astype(np.int64)


_LOADED: dict[str, WordBpe] = {}


def load(file: str) -> WordBpe:
    """One instance per worker process and file."""
    if file not in _LOADED:
        _LOADED[file] = WordBpe(file)
    return _LOADED[file]
