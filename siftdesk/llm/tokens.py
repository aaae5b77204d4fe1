"""Token ids of whole texts, chunk by chunk, with bounded caches.

The vocabulary's normaliser, word pattern and special tokens never look across
ASCII white space: composition and lower-casing stop there, the word pattern
has no white space in it and neither have the special tokens. So the ids of a
text are those of its white-space-delimited chunks one after the other, and a
chunk that a task has met before needs no second look.
"""

import gc
import json
import string
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The word pattern of the vocabulary file, `\s` spelled out as
#: the Unicode property that the tokenizers library takes it for.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def definition(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


#: Longer chunks and words are not cached: text without spaces repeats little.
LONGEST = 64


class Cache:
    """A dictionary of some twice ``limit`` short entries; old ones leave first."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > LONGEST:
            return
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def missing(self, keys: set) -> set:
        """Those of a batch's keys that are not here; the others are in ``young`` now.

        The caller puts the missing ones into ``young`` itself, past the limit if need
        be, reads all of the batch there and lets go of the long ones by ``shorten``.
        """
        if len(self.young) >= self.limit:
            # What one very large batch has blown up is not kept.
            self.old, self.young = self.young if len(self.young) < 2 * self.limit else {}, {}
        young, old = self.young, self.old
        new = keys.difference(young)
        if old:
            young.update([(key, old[key]) for key in new if key in old])
            new = new.difference(old)
        return new

    def shorten(self, keys: set) -> None:
        for key in keys:
            if len(key) > LONGEST:
                del self.young[key]


#: Letters below this point lower-case one by one and are composed already.
_PLAIN = "\u0180"
#: Of these one run is one word, whatever stands before or behind it.
_TAIL = ".,;:!?*%$&#)\"|/-"
#: Latin-1 letters whose lower case is one letter; a run of them is one word.
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(192, 256) if c not in (215, 247))


class ChunkEncoder:
    """Ids of texts; ``encode_words`` gives the ids of words not met before.

    Words are what the pattern finds in normalised chunks; special tokens are
    cut out of the raw chunk first, as the library does. Ids are kept and given
    as packed little-endian unsigned 32-bit integers.

    The distinct chunks of some texts are found and put back in place by Arrow.
    Most are one word of plain letters with punctuation behind it, and Arrow takes
    them apart, too; Python sees their distinct words and the other chunks alone.
    """

    def __init__(
        self,
        path: str,
        encode_words: Callable[[list[str]], list],
        chunks: int = 100_000,
        words: int = 300_000,
    ):
        tokenizer = load(path)
        self.normalize = tokenizer.normalizer.normalize_str
        specials = {t["content"]: t["id"] for t in definition(path)["added_tokens"]}
        self.specials = {text: pack([token]) for text, token in specials.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")
        self.words_of = regex.compile(WORD_PATTERN).findall
        self.encode_words = encode_words
        self.chunks, self.words = Cache(chunks), Cache(words)

    def _words(self, text: str) -> list[str]:
        plain = text.lower() if max(text) < _PLAIN else self.normalize(text)
        return [plain] if plain.isalpha() else self.words_of(plain)

    def _pieces(self, text: str) -> list:
        """Words as strings, special tokens as packed ids."""
        if "<|" not in text:
            return self._words(text)
        pieces: list = []
        for part in self.cut.split(text):
            if part in self.specials:
                pieces.append(self.specials[part])
            elif part:
                pieces += self._words(part)
        return pieces

    def _meet(self, pieces: set) -> set:
        """Put the ids of words that are not in the cache there; ``shorten`` takes the result."""
        unseen = self.words.missing(pieces)
        ids = self.words.young
        words = [word for word in unseen if word and type(word) is str]
        if len(words) < len(unseen):
            ids.update([(packed, packed) for packed in unseen if type(packed) is bytes])
            if "" in unseen:
                ids[""] = b""
        made = self.encode_words(words)
        ids.update(zip(words, [x if type(x) is bytes else pack(x) for x in made]))
        return unseen

    def _learn(self, new: set[str]) -> None:
        """Put the ids of chunks that are not in the cache there."""
        pieces = list(map(self._pieces, new))
        unseen = self._meet(set().union(*pieces))
        ids_of = self.words.young.__getitem__
        self.chunks.young.update(zip(new, [b"".join(map(ids_of, many)) for many in pieces]))
        self.words.shorten(unseen)

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The packed ids of each word."""
        coded = words.dictionary_encode()
        distinct = _strings(coded.dictionary)
        unseen = self._meet(set(distinct))
        ids = pa.array(list(map(self.words.young.__getitem__, distinct)), pa.large_binary())
        self.words.shorten(unseen)
        return ids.take(coded.indices)

    def _of_odd(self, chunks: list[str]) -> pa.Array:
        """The packed ids of each chunk, whatever it holds."""
        new = self.chunks.missing(set(chunks))
        if new:
            self._learn(new)
        ids = pa.array(list(map(self.chunks.young.__getitem__, chunks)), pa.large_binary())
        self.chunks.shorten(new)
        return ids

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The packed ids of each of some distinct chunks."""
        tails = pc.utf8_ltrim(chunks, _LETTERS)
        plain = pc.equal(pc.ascii_rtrim(tails, _TAIL), "")
        words = pc.utf8_lower(pc.ascii_rtrim(chunks.filter(plain), _TAIL))
        nothing = pa.scalar(b"", pa.large_binary())
        made = pc.binary_join_element_wise(
            self._of_words(words), self._of_words(tails.filter(plain)), nothing
        )
        odd = pc.invert(plain)
        made = pa.concat_arrays([made, self._of_odd(_strings(chunks.filter(odd)))])
        # Where each chunk has gone: the plain ones first, then the others.
        return made.take(pc.sort_indices(pa.concat_arrays([pc.indices_nonzero(x) for x in (plain, odd)])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each UTF-8 text."""
        # Very many small objects are made here and none in cycles.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        try:
            column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        except pa.ArrowInvalid:  # not UTF-8
            column = pa.array([text.decode("utf-8", "replace") for text in texts], pa.large_string())
        split = pc.ascii_split_whitespace(column)
        coded = split.values.dictionary_encode()
        ids = self._of_chunks(coded.dictionary).take(coded.indices)
        # The chunks' ids lie one after the other, so a text's are one stretch of them.
        _, ends, data = ids.buffers()
        ends = pa.Array.from_buffers(pa.int64(), len(ids) + 1, [None, ends])
        places = [None, ends.take(split.offsets).buffers()[1], data]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), places).to_pylist()


def _strings(column: pa.Array) -> list[str]:
    """What to_pylist() gives, much faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def unpack(ids: bytes) -> array:
    made = array("I")
    made.frombytes(ids)
    return made


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters
    from U+0100 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


def library_words(path: str) -> Callable[[list[str]], list[bytes]]:
    """Packed ids of words by the tokenizers library.

    Words go one by one to the library's model, past its normaliser and word
    pattern, which have done their work by then. Printable ASCII stands for itself in
    a byte-level vocabulary.
    """
    tokenize = load(path).model.tokenize
    letters = dict(enumerate(byte_letters()))

    def words(new: list[str]) -> list[bytes]:
        spelled = [
            word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(letters)
            for word in new
        ]
        return [pack([token.id for token in tokenize(word)]) for word in spelled]

    return words


_encoders: dict = {}


def encoder(path: str, kind: str, encode_words: Callable) -> ChunkEncoder:
    """One encoder per Python worker, so its caches outlive a task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = ChunkEncoder(path, encode_words(path))
    return _encoders[path, kind]
