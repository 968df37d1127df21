"""Whole texts to ids with the tokenizers library, one distinct chunk at a time.

The word vocabulary lower-cases, drops white space and never merges across it, so
the ids of a text are the ids of its chunks between ASCII white space, in order.
Each worker encodes a chunk when it first meets it and then copies the ids; when it
has met too many, it forgets those that it met once. ASCII capitals are lowered
before chunks are told apart, unless the text holds a mark that may join the letter
before it, or an added token. A tokenizer file with other settings may see white space or case, so its texts are
encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one worker remembers before it forgets the rare ones; bounds its memory, not the result.
REMEMBERED = 1_000_000

#: One word of Latin letters, each a letter by itself in any normal form. Behind it may stand ``STOPS``, which no word or contraction begins with there.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
STOPS = string.punctuation
#: First bytes of U+0300 to U+036F, the marks that compose with ASCII letters; some only with the small letter, as U+0331 with "h".
MARKS = (b"\xcc", b"\xcd")


def forgets_white_space(settings: dict) -> bool:
    """Whether a tokenizer's settings are those of the word vocabulary: lower case, white space dropped, words of their own."""
    steps = (settings.get("normalizer") or {}).get("normalizers", [])
    cuts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"]) == ("Removed", True, False)
        and settings["model"].get("end_of_word_suffix") == "</w>"
        and settings.get("post_processor") is None
    )


class ChunkMemo:
    """Ids of chunks already met, in flat arrays, so that a whole batch is put together by array operations."""

    def _start(self) -> None:
        self.number: dict = {}
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.n = 0

    def _add(self, chunks: list, ids: list[list[int]]) -> None:
        n = self.n
        self._hold(ids)
        self.number.update(zip(chunks, range(n, self.n), strict=True))

    def _hold(self, ids: list[list[int]]) -> None:
        """The ids of the next numbers."""
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        n, k, total = self.n, len(ids), int(lens.sum())
        while n + k > len(self.lens):
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.lens[n : n + k] = lens
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.n += k

    def _gather(self, number: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered chunks in a row, and how many fall to each text of so many chunks."""
        lens = self.lens[number]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.starts[number] - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class Numbers(dict):
    """Numbers of chunks, in the order in which they were first met; ``new`` are those whose ids aren't held yet."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class ChunkEncoder(ChunkMemo):
    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end_id = end_id
        self.by_chunk = forgets_white_space(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.added = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: to_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self._start()
        # Chunk 0 ends a document. No text has this key: chunks hold no white space.
        self.number = Numbers({b" ": 0})
        self.met = np.zeros(1, np.int64)
        self._hold([[] if self.end_id is None else [self.end_id]])
        self.stops: dict[str, list[int]] = {"": []}

    def _forget(self) -> None:
        """Keep the chunks met more than once since they were learned or last kept, at most a half of all that may be remembered."""
        met, least = self.met[: self.n], 2
        while np.count_nonzero(met >= least) > REMEMBERED // 2:
            least *= 2
        kept = np.flatnonzero(met >= least)
        kept = np.concatenate([[0], kept[kept > 0]])
        flat, lens = self._gather(kept, np.ones(len(kept), np.int64))
        chunks = list(self.number)
        self._start()
        self.number = Numbers(zip(map(chunks.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.flat, self.lens, self.starts, self.used, self.n = flat, lens, np.cumsum(lens) - lens, len(flat), len(kept)
        # Kept ones stay if they are met once more.
        self.met = np.ones(len(kept), np.int64)
        self.stops = {"": []}

    def _one_by_one(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of a plain word in lower case: normalizing and splitting leave it as it is."""
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        words = [t.rstrip(STOPS) for t in texts]
        plain = {w: [] for w in words if (w.isalpha() if w.isascii() else PLAIN.fullmatch(w))}
        of_low: dict[str, list[int]] = {}
        for word in plain:
            low = word.lower()
            if low not in of_low:
                of_low[low] = self._word(low)
            plain[word] = of_low[low]
        of_odd = iter(self._one_by_one([t for t, w in zip(texts, words, strict=True) if w not in plain]))
        stops = list({t[len(w) :] for t, w in zip(texts, words, strict=True) if w in plain} - self.stops.keys())
        self.stops.update(zip(stops, self._one_by_one(stops), strict=True))
        self._hold([plain[w] + self.stops[t[len(w) :]] if w in plain else next(of_odd) for t, w in zip(texts, words, strict=True)])

    def _folded(self, text: bytes) -> bytes:
        """The text with its ASCII capitals lowered, where its ids stay the same."""
        low = text.lower()
        return text if any(x in low for x in MARKS) or any(x in low for x in self.added) else low

    def _whole(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, without chunks."""
        end = [] if self.end_id is None else [self.end_id]
        ids = [own + end for own in self._one_by_one([(t or b"").decode() for t in texts])]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text (its end id included)."""
        if not self.by_chunk:
            return self._whole(texts)
        if self.n > REMEMBERED:
            self._forget()
        chunks: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._folded(text).split() if text else []
            chunks += own
            chunks.append(b" ")
            counts[i] = len(own) + 1
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        new, self.number.new = self.number.new, []
        for at in range(0, len(new), 32_768):
            self._learn(new[at : at + 32_768])
        met = np.bincount(number, minlength=self.n)
        met[: len(self.met)] += self.met[: self.n]
        self.met = met
        return self._gather(number, counts)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> ChunkEncoder:
    """This worker's encoder."""
    return ChunkEncoder(path, end_id)


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column's UTF-8 bytes."""
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Parts of a batch with about ``most_bytes`` of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
