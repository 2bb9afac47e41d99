"""Token ids by a public vocabulary, word by word with a bounded memo."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers before it starts anew.
MEMO_WORDS = 200_000
#: ASCII marks that may follow a plain word as a piece of their own.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {32: 32}
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes UTF-8 texts by a tokenizers file whose pieces never span white space and whose white space gives no ids.

    A text's ids are then its words' ids in order, so each distinct word is encoded once and remembered. Words here are cut at ASCII white space only,
    which every such pre-tokenizer cuts at as well. Where the file lower-cases, maps bytes and marks ends of words, plain words (letters that
    normalisation can't split, perhaps with marks after them) need no normalisation: many new ones are merged in one call and told apart by the ends;
    anything else is encoded alone by the whole file. The memo has two generations, so it is bounded and frequent words stay."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix and [self._alone(w) for w in (b"ab.", b"Ab", b"ab!?'")] == [self._alone(b"ab") + self._alone(b"."), self._alone(b"ab"), self._alone(b"ab") + self._alone(b"!?'")]:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.merger = Tokenizer(self.tokenizer.model)  # the same model, without normalisation
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            if [self._merged([w])[0] for w in (b"ab", "öß".encode())] != [self._alone(w) for w in (b"ab", "öß".encode())]:
                self.ends = None

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain lower-case words."""
        out = []
        for lo in range(0, len(words), 1000):
            text = b" ".join(words[lo : lo + 1000])
            text = text.decode() if text.isascii() else text.decode("latin-1").translate(BYTE_CHARACTERS)
            ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *at], at)]
        return out

    def _remember(self, words: set[bytes], ids) -> None:
        """Puts words that aren't in the memo there, from the old generation or by ids(words)."""
        missing = words.difference(self.memo)
        if missing and self.old:
            self.memo.update([(w, self.old[w]) for w in missing if w in self.old])
            missing = missing.difference(self.memo)
        if missing:
            missing = list(missing)
            self.memo.update(zip(missing, ids(missing), strict=True))

    def _each_alone(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        ascii_, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
        found = dict(zip(ascii_, self._merged(ascii_), strict=True)) | dict(zip(other, self._merged(other), strict=True))
        return [found[w] for w in words]

    def _units(self, words: pa.Array, odd: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of units, and the two units of each distinct word: a plain word and the marks after it, or what must be encoded alone and nothing. Only units
        are remembered, so the memo holds what comes again. odd: some words come from texts that weren't lower-cased."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        n = len(words)
        if self.ends is None:
            plain = np.zeros(n, bool)
        else:
            base = pc.ascii_rtrim(words, characters=MARKS.decode())
            ok = pc.and_(pc.utf8_is_alpha(base), pc.invert(pc.match_substring_regex(base, r"[^\x00-\x{12F}]")))
            if odd:
                ok = pc.and_(ok, pc.invert(pc.match_substring_regex(words, r"[A-Z]|<\|")))
            plain = ok.to_numpy(zero_copy_only=False)
        first, second = np.zeros(n, np.int32), np.zeros(n, np.int32)
        units: list[bytes] = [b""]
        if plain.any():
            mask = pa.array(plain)
            own, short = words.filter(mask), base.filter(mask)
            coded = pc.utf8_lower(short).dictionary_encode()
            bases = coded.dictionary.cast(pa.binary()).to_pylist()
            self._remember(set(bases), self._plain)
            first[plain] = coded.indices.to_numpy(zero_copy_only=False) + len(units)
            units += map(self.memo.__getitem__, bases)
            more = pc.subtract(pc.binary_length(own), pc.binary_length(short)).to_numpy(zero_copy_only=False)
            code = np.zeros(len(more), np.int32)
            for k in np.unique(more[more > 0]).tolist():
                here = more == k
                coded = pc.utf8_slice_codeunits(own.filter(pa.array(here)), start=-k).dictionary_encode()
                marks = coded.dictionary.cast(pa.binary()).to_pylist()
                self._remember(set(marks), self._each_alone)
                code[here] = coded.indices.to_numpy(zero_copy_only=False) + len(units)
                units += map(self.memo.__getitem__, marks)
            second[plain] = code
        if not plain.all():
            alone = words.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
            self._remember({w for w in alone if w}, self._each_alone)
            first[~plain] = np.arange(len(alone), dtype=np.int32) + len(units)
            units += [self.memo[w] if w else b"" for w in alone]
        return units, first, second

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); a null text has none. Words are told apart and ids are put together by Arrow and numpy; Python
        sees each distinct unit once."""
        texts = pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")
        odd = pc.match_substring(texts, "<|")
        some = pc.any(odd).as_py() or False
        # Lower-casing ASCII first changes no ids but those of special tokens, which hold "<|".
        low = texts if self.ends is None else pc.if_else(odd, texts, pc.ascii_lower(texts)) if some else pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        units, first, second = self._units(coded.dictionary, some)
        length = np.fromiter(map(len, units), np.int32, len(units)) // 4
        flat, start = np.frombuffer(b"".join(units), "<u4"), np.cumsum(length, dtype=np.int32) - length
        at = coded.indices.to_numpy(zero_copy_only=False)
        seq = np.empty(2 * len(at), np.int32)
        seq[::2], seq[1::2] = first[at], second[at]
        n = length[seq]
        ends = np.cumsum(n, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total, dtype=np.int32) + np.repeat(start[seq] - (ends - n), n)]
        return ids, np.r_[0, ends[1::2]][lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Little-endian uint32 ids of each text."""
        out = []
        for lo, hi in slices(texts):
            ids, at = self.encode_array(pa.array(texts[lo:hi], pa.binary()))
            out += [ids[i:j] for i, j in zip(at[:-1], at[1:])]
        return out


def encoder(file: str) -> WordEncoder:
    """The worker's own encoder for a file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list, most: int = 4 << 20):
    """Consecutive lists of texts of about most bytes together, as (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def array_slices(texts: pa.Array, most: int = 2 << 20):
    """Consecutive (from, to) of about most bytes together."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(size)] if len(size) else [0, 0]
    return [(i, j) for i, j in zip(cuts[:-1], cuts[1:]) if i < j]
