"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word the encoding ends in one certain token. It is the
token that (a) is a suffix of the prefix, which an automaton over all tokens
finds, and (b) may follow the last token of the prefix it leaves: the pair is
compatible if no merge across the seam would have come first. The last token of
each prefix is stored, and following it back from the word's end gives the ids.
The work per word is the number of automaton matches; no merge queue is run.

Words are independent, so they are cached per worker (bounded). A very long
word is linear in its length times the longest token. Null texts are empty;
empty texts have no ids and decode to the empty string.
"""

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from .common import batches, map_texts
from .tokens import byte_letters, definition, encoder, unpack, word_bpe_path


class PrefixBpe:
    """Encoder of single words for one vocabulary."""

    def __init__(self, path: str):
        model = definition(path)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        # A final letter is a symbol of its own: it takes the mark \0 behind it.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair, token = (vocab[left], vocab[right]), vocab[left + right]
            self.merged.setdefault(pair, (rank, token))
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, rank
        self.seams: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            if self._reachable(token):
                symbols = text.removesuffix(self.end) + "\0" if self._final(text) else text
                # The mark is one more letter, yet no more symbols than without.
                self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()

    def _final(self, text: str) -> bool:
        return bool(self.end) and text.endswith(self.end) and text != self.end

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text encodes to it."""
        pair = self.parts.get(token)
        if pair is None:
            return True
        return (
            self._reachable(pair[0])
            and self._reachable(pair[1])
            and self._untouched(*pair, before=self.rank[token])
        )

    def _untouched(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge across the seam precedes those inside both tokens.

        The merges are undone from the last to the first. While ``left`` and
        ``right`` stand at the seam, a merge of the two is due unless the merge
        that made a wider neighbour of one of them came first. Equal merges run
        from the left, so one inside ``left`` precedes an equal one at the seam,
        which in turn precedes an equal one inside ``right``.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = before if before is not None else len(self.merged) + 1
        while True:
            found = merged.get((left, right))
            if found is not None and found[0] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) >= 2_000_000:
                self.seams.clear()
            known = self.seams[key] = self._untouched(left, right)
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word of normalised text."""
        letters = self.letters
        symbols = "".join([letters[b] for b in word.encode("utf-8")])
        size = len(symbols)
        if not size:
            return []
        # Prefixes end before the mark, but for the whole word, which ends after it.
        marked = symbols + "\0" if self.end else symbols
        last: list[int] = [-1] * (len(marked) + 1)
        back: list[int] = [0] * (len(marked) + 1)
        whole, seams, untouched = len(marked), self.seams, self._untouched
        for stop, (token, length) in self.automaton.iter(marked):
            end = stop + 1
            if last[end] >= 0 or (self.end and end == size):
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = seams.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end], back[end] = token, start
        out, at = [], whole
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out


@lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def dp_words(path: str):
    encode = prefix_bpe(path).encode
    return lambda words: [encode(word) for word in words]


@lru_cache(maxsize=2)
def token_texts(path: str) -> dict[int, str]:
    spec = definition(path)
    texts = {token: text for text, token in spec["model"]["vocab"].items()}
    return texts | {t["id"]: t["content"] for t in spec["added_tokens"]}


def decode(ids: Iterable[int], path: str) -> str:
    """The tokens' texts, a space between them: the file names no decoder."""
    texts = token_texts(path)
    return " ".join([texts[i] for i in ids if i in texts])


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded), one row per row of ``docs`` (doc_id, text).

    ``ids`` holds the ids as little-endian unsigned 32-bit integers, ``decoded``
    the text that the ids decode to. Other columns are not read.
    """
    path = path or word_bpe_path()
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows):
        for doc_id, ids in encoded(rows, path):
            yield doc_id, ids, decode(unpack(ids), path)

    return map_texts(docs, work, f"doc_id {kind}, ids binary, decoded string", rows=500)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_texts``.

    The digests are taken where the ids are made, so that neither ids nor
    decoded texts travel back.
    """
    path = path or word_bpe_path()
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows):
        for doc_id, ids in encoded(rows, path):
            text = hashlib.sha256(decode(unpack(ids), path).encode("utf-8")).hexdigest()
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), text

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, work, schema)


def encoded(rows, path: str):
    """(doc_id, packed ids) of (doc_id, UTF-8 text); texts are encoded some at a time."""
    encode = encoder(path, "prefix", dp_words).encode
    for some in batches(rows, texts=4096):
        yield from zip([r[0] for r in some], encode([r[1] for r in some]))
