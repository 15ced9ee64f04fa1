"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no token of the vocabulary can never be bridged by a merge, so the
place between them is a certain cut. Words (the pre-tokenizer's pieces) are cut there, the fragments are encoded each
on its own, and their ids are concatenated. Ids are cached by word and by chunk of text, in bounded caches.

White space ends words, so a text is processed by its chunks between ASCII white space: the normalizer's and the
pre-tokenizer's work on one chunk doesn't depend on the others.

Null texts count as empty; an empty text has no ids and decodes to an empty string. Texts of any length are handled
whole: merging takes n log n steps for long fragments. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from treefold.llm.common import held, only

#: Characters whose normal form, lower case and class are plain, so the library's normalizer isn't needed.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[^a-zß-öø-įı-ſ0-9]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible, else the next free character from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Cache(dict):
    """Made on demand. When it is full its older half goes, which only costs time."""

    def __init__(self, make, room: int):
        self.make, self.room = make, room

    def __missing__(self, key):
        if len(self) >= self.room:
            for old in list(islice(self, self.room // 2)):
                del self[old]
        self[key] = out = self.make(key)
        return out


class WordBPE:
    def __init__(self, path: str, room: int = 800_000, library: bool = False):
        """With library, words are merged by the library itself instead of fragment by fragment."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_alphabet()
        self.inside = set()
        for token in self.vocab:
            symbols = self.symbols(token[: -len(self.end)]) if self.end and token.endswith(self.end) and token != self.end else list(token)
            self.inside.update(zip(symbols, symbols[1:]))
        self.by_library = library
        # ids by chunk of text; a word of the pre-tokenizer is looked up as the chunk that it would be
        self.chunks = Cache(self.encode_chunk, room)

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end] if word else []

    def visible(self, word: str) -> str:
        """A word in the byte alphabet."""
        return word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))

    def fragments(self, word: str) -> list[list[str]]:
        """The word's symbols, split at every certain cut."""
        symbols = self.symbols(word)
        pairs = list(zip(symbols, symbols[1:]))
        if self.inside.issuperset(pairs):
            return [symbols]
        cuts = [i + 1 for i, pair in enumerate(pairs) if pair not in self.inside]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def encode_word(self, word: str) -> bytes:
        """Ids of one piece, given in the byte alphabet."""
        if self.by_library:
            return array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()
        return array("I", [self.vocab[s] for f in self.fragments(word) for s in self.merge(f)]).tobytes()

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        if len(symbols) > 48:
            return self.merge_long(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge_long(self, fragment: list[str]) -> list[str]:
        symbols, n = list(fragment), len(fragment)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := self.rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s]

    def encode_text(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join([self.encode_word(w) for w, _ in pieces])
        words = PLAIN_WORDS.findall(lower := text.lower())
        if len(words) == 1 and lower == text:
            return self.encode_word(self.visible(text))
        return b"".join([self.chunks[w.encode()] for w in words])

    def encode_chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and chunk.islower():
            return self.encode_word(chunk.decode())
        text = chunk.decode("utf-8", "surrogatepass")
        if self.cut_special is None or "<" not in text:
            return self.encode_text(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.encode_text(x) for x in self.cut_special.split(text) if x)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.chunks.__getitem__, (text or "").encode().split()))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the library joins the tokens with spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def load(path: str, library: bool = False) -> WordBPE:
    """One encoder a worker process."""
    return held((path, library), lambda: WordBPE(path, library=library))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """One row a document: the key, n_tokens, and as asked ids (array<int>), decoded (string), and the SHA-256 of the ids
    (decimal, joined by one space) and of the decoded text. No shuffle."""
    key_type = df.schema[key].dataType.simpleString()
    columns = [f"`{key}` {key_type}", "n_tokens long"] + ["ids array<int>"] * ids + ["decoded string"] * decoded + ["ids_sha256 string", "decoded_sha256 string"] * digests
    decimal = digests and [str(i) for i in range(1 << 16)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            out = {c.split()[0].strip("`"): [] for c in columns[1:]}
            for x in batch.column(1):
                got = array("I", bpe.encode(x.as_py())).tolist()
                out["n_tokens"].append(len(got))
                if ids:
                    out["ids"].append(got)
                back = bpe.decode(got) if decoded or digests else None
                if decoded:
                    out["decoded"].append(back)
                if digests:
                    shown = " ".join(decimal[i] if i < 65536 else str(i) for i in got) if max(got, default=0) > 65535 else " ".join(map(decimal.__getitem__, got))
                    out["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()]], names=[key, *out])

    return only(df, key, text).mapInArrow(run, ", ".join(columns))
