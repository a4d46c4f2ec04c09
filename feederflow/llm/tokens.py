"""Token ids of whole texts, with one call of the tokenizer for each new word."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feederflow.llm.shared import Words

#: Punctuation that the vocabulary's own rule splits from letters before it.
TAIL = ".,;:!?#*$%&"
#: Pieces that a worker remembers before it forgets those it met least.
REMEMBERED = 500_000
#: What the vocabulary's last token of a word ends with.
WORD_END = "</w>"


class Encoder:
    """Encodes batches of texts; equal to encoding each text by itself.

    The vocabulary drops white space and never merges across it, so a text's ids are its
    words' ids in a row. A word of letters and trailing punctuation is in turn its letters'
    ids and its punctuation's. Each piece is encoded once by a worker and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for words of letters that its normaliser would leave as they are
        self.lettered = Tokenizer.from_file(path)
        self.lettered.normalizer = None
        self.lettered.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True
        # words of letters, and the other pieces: far fewer, and looked up apart
        self.known = {True: pa.array([], pa.string()), False: pa.array([], pa.string())}
        self.at = {True: np.zeros(0, np.int64), False: np.zeros(0, np.int64)}
        self.met = {True: np.zeros(0, np.int64), False: np.zeros(0, np.int64)}
        self.flat, self.used, self.pieces = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def forget(self, most: int) -> None:
        """Keep at most ``most`` pieces, those met in the most batches (and in two or more); older meetings count half from then on."""
        met, least = np.concatenate((self.met[True], self.met[False])), 2
        while (met >= least).sum() > most:
            least += 1
        starts, lengths = [], []
        self.pieces = 0
        for letters in (True, False):
            keep = self.met[letters] >= least
            self.known[letters] = self.known[letters].filter(pa.array(keep))
            starts.append(self.start[self.at[letters][keep]])
            lengths.append(self.length[self.at[letters][keep]])
            self.met[letters] = self.met[letters][keep] // 2
            self.at[letters] = np.arange(self.pieces, self.pieces + len(starts[-1]))
            self.pieces += len(starts[-1])
        start, length = np.concatenate(starts), np.concatenate(lengths)
        flat = self.flat[gather(start, length)]
        self.pieces = self.used = 0
        self._add(flat, length)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(lengths), self.pieces
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + n] = lengths
        self.used += len(ids)
        self.pieces += n

    def _each(self, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._add(np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _letters(self, pieces: list[str]) -> None:
        """Words of letters only, encoded as a text of many words; each one's last id tells where it ends."""
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            text = " ".join(part)
            same = text.lower() == text and unicodedata.is_normalized("NFC", text)
            (e,) = (self.lettered if same else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._add(ids, np.diff(ends, prepend=0))
            else:  # a letter that normalisation takes apart, or that the vocabulary lacks
                self._each(part)

    def _places(self, pieces: pa.Array, letters: bool) -> np.ndarray:
        """Where each of the distinct pieces is remembered; new ones are encoded first."""
        found = pc.index_in(pieces, value_set=self.known[letters])
        missing = found.is_null()
        if found.null_count:
            new, at = pieces.filter(missing), self.pieces
            # words with capitals last, so that few parts hold any
            order = np.argsort(pc.not_equal(pc.utf8_lower(new), new).to_numpy(zero_copy_only=False), kind="stable")
            place = np.empty(len(new), np.int32)
            place[order] = np.arange(len(new), dtype=np.int32) + len(self.known[letters])
            new = new.take(pa.array(order))
            (self._letters if letters else self._each)(new.to_pylist())
            found = pc.replace_with_mask(found, missing, pa.array(place))
            self.known[letters] = pa.concat_arrays((self.known[letters], new))
            self.at[letters] = np.concatenate((self.at[letters], np.arange(at, self.pieces)))
            self.met[letters] = np.concatenate((self.met[letters], np.zeros(len(new), np.int64)))
        found = found.to_numpy()
        self.met[letters][found] += 1
        return self.at[letters][found]

    def __call__(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and their bounds by text."""
        if self.pieces > REMEMBERED:
            self.forget(REMEMBERED // 2)
        words = Words(batch)
        if not len(words.codes):
            return np.zeros(0, np.uint32), np.zeros(len(words.offsets), np.int64)
        own = words.vocabulary
        stems = pc.ascii_rtrim(own, TAIL)
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64)
        where = np.flatnonzero(plain)
        kept = pc.ascii_lower(stems.take(pa.array(where)))
        coded = kept.dictionary_encode()
        first[where] = self._places(coded.dictionary, True)[coded.indices.to_numpy()]
        cut = pc.binary_length(own).to_numpy() > pc.binary_length(stems).to_numpy()
        tailed = np.flatnonzero(plain & cut)
        if len(tailed):
            tails = pc.extract_regex(own.take(pa.array(tailed)), f"(?P<tail>[{TAIL}]+)$").field("tail").dictionary_encode()
            second[tailed] = self._places(tails.dictionary, False)[tails.indices.to_numpy()]
        other = np.flatnonzero(~plain)
        if len(other):
            first[other] = self._places(own.take(pa.array(other)), False)
        # two pieces a word at most: ids of each word of the vocabulary, then of the texts
        pairs = np.stack((first, second), 1).ravel()
        lengths = np.where(pairs >= 0, self.length[pairs], 0)
        table = self.flat[gather(self.start[pairs], lengths)]
        size = lengths.reshape(-1, 2).sum(1)
        begin = np.cumsum(size) - size
        counts = size[words.codes]
        ids = table[gather(begin[words.codes], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[words.offsets]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of ``lengths[i]`` each, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # half the memory traffic where places fit 32 bits
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it lasts as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
