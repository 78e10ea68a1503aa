"""Token ids of whole texts with a public tokenizer file, one distinct word at a time."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words that a process remembers (and an eighth of the ids); beyond it the memory starts afresh.
MEMORY = 1_000_000
# Words of a joint call to the tokenizer.
JOINT = 1_000
# Signs of which the first that is one token stands between the words of a joint call;
# words that hold it go alone.
BETWEEN = "\u2022\u2020\u00a7\u00ae\u2122"
# After a letter each of these is a token of its own: words so ended are stem and sign.
SIGNS = frozenset(b".,!?:;|")


class Encoder:
    """Encodes whole texts; results equal the tokenizer's own on each text.

    For tokenizers that ignore case and whose rules never look across white space
    (word-end BPE that drops it): a text's ids are those of its words in turn, so each
    distinct word is encoded once and the rest is array gathering. Only ASCII white space
    splits and only A-Z is lowered here; the tokenizer handles all else itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cluster deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.sign, self.between = next(((s, ids[0]) for s in BETWEEN if len(ids := self._plain(s)) == 1), (BETWEEN[0], None))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _remember(self, words: list[bytes], parts: list[np.ndarray], lengths: np.ndarray) -> None:
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, *parts))

    def _learn(self, words: list[bytes]) -> None:
        ended = [w for w in words if len(w) > 1 and w[-1] in SIGNS and 97 <= w[-2] <= 122]
        whole = set(words).difference(ended)
        whole.update(w[:-1] for w in ended)
        whole.update(w[-1:] for w in ended)
        fresh = [w for w in whole if w not in self.slots]
        sign = self.sign.encode()
        alone = [w for w in fresh if self.between is None or sign in w or b"<|" in w]
        known, parts, sizes = [], [], []
        letters = [w for w in fresh if self.ends is not None and w.decode().isalpha()]
        joint = list(set(fresh).difference(alone, letters))
        for words, sep in ((letters, " "), (joint, f" {self.sign} ")):
            for at in range(0, len(words), JOINT):
                part = words[at : at + JOINT]
                ids = np.array(self._plain(sep.join(w.decode() for w in part)), np.uint32)
                # A word of letters is one piece, and only a piece's last token ends a word.
                cuts = np.flatnonzero(self.ends[ids])[:-1] + 1 if sep == " " else np.flatnonzero(ids == self.between)
                if len(cuts) != len(part) - 1:
                    alone += part
                    continue
                known += part
                parts.append(ids if sep == " " else ids[ids != self.between])
                sizes.append(np.diff(cuts, prepend=-(sep != " "), append=len(ids)) - (sep != " "))
        for word in alone:
            ids = np.array(self._plain(word.decode()), np.uint32)
            known.append(word)
            parts.append(ids)
            sizes.append(np.array([len(ids)]))
        if known:
            self._remember(known, parts, np.concatenate(sizes))
        if ended:
            pairs = np.array([self.slots[p] for w in ended for p in (w[:-1], w[-1:])], np.int64)
            self._remember(ended, [self._gather(pairs)], self.lengths[pairs].reshape(-1, 2).sum(1))

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def one(self, text: bytes | None) -> np.ndarray:
        """The ids of one whole text (null: none) as unsigned 32-bit integers."""
        return self.many([text])[0]

    def each(self, texts: Iterable[bytes | None], size: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each whole text in turn; texts of about ``size`` bytes are encoded together."""
        held, total = [], 0
        for text in texts:
            held.append(text)
            total += len(text or b"")
            if total >= size:
                yield from self.many(held)
                held, total = [], 0
        yield from self.many(held)

    def many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if not texts:
            return []
        column = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
        # Special tokens are told by their case, so texts that may hold one stay as they are.
        lowered = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_pylist()
        missing = [w for w in words if w not in self.slots]
        if len(self.slots) + 2 * len(missing) > MEMORY or len(self.pool) > 8 * MEMORY:
            self._forget()
            missing = words
        if missing:
            self._learn(missing)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        rows = slots[coded.indices.to_numpy(zero_copy_only=False)]
        flat = self._gather(rows)
        ends = np.concatenate(([0], np.cumsum(self.lengths[rows])))[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        return np.split(flat, ends[:-1])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
